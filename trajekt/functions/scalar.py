"""Column builders for rounding, time, frames, colours and label texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Overlay colours (blue, green, red), used in turn.
PALETTE = (
    (0, 255, 255),
    (255, 255, 0),
    (255, 0, 255),
    (0, 165, 255),
    (0, 255, 0),
    (255, 0, 0),
    (0, 0, 255),
    (255, 128, 0),
    (128, 255, 0),
    (255, 0, 128),
    (128, 0, 255),
    (0, 128, 255),
)
DEFAULT_COLOR = (0, 255, 255)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def sentinel(c: Column, missing: float = -1) -> Column:
    """-1 (or another mark) for null and NaN."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(float(missing))), F.lit(float(missing)))


def whole(c: Column) -> Column:
    """Half-even rounded int with -1 for missing values."""
    return F.bround(sentinel(c), 0).cast("int")


def frame_to_unix_ms(frame: Column, ref_frame: Column | int, ref_time: Column | int, fps: Column | float) -> Column:
    """Milliseconds of a frame, half-even; frames per second must be positive."""
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    ref_frame = ref_frame if isinstance(ref_frame, Column) else F.lit(ref_frame)
    ref_time = ref_time if isinstance(ref_time, Column) else F.lit(ref_time)
    fps = F.when(fps > 0, fps).otherwise(F.raise_error(F.lit("frames per second must be positive")).cast("double"))
    return F.bround(ref_time.cast("double") + (frame - ref_frame) * F.lit(1000.0) / fps, 0).cast("long")


def unix_ms_to_local(ms: Column, zone: str = "US/Eastern") -> Column:
    """ISO text with three fraction digits and the zone's offset at that moment."""
    moment = F.timestamp_millis(ms)
    local = F.from_utc_timestamp(moment, zone)
    offset = (F.unix_micros(local) - F.unix_micros(moment)) / F.lit(60_000_000)
    minutes = F.abs(offset).cast("int")
    sign = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+"))
    text = F.date_format(F.to_timestamp_ntz(F.from_utc_timestamp(F.from_utc_timestamp(moment, zone), "UTC")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(text, sign, F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def seconds_to_frame(seconds: Column, fps: Column) -> Column:
    """Frame at a time; the rate loses its fraction first."""
    return (fps.cast("int") * seconds).cast("int")


def clip_by_seconds(start: Column, length: Column, fps: Column) -> tuple[Column, Column]:
    """First frame and number of frames of a clip; a length that is not positive raises an error."""
    length = F.when(length > 0, length).otherwise(F.raise_error(F.lit("the clip length must be positive")).cast("double"))
    return (F.greatest(start, F.lit(0.0)) * fps).cast("int"), F.greatest(F.bround(length * fps, 0), F.lit(1.0)).cast("int")


def clamp_range(start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """Both within 0 and total - 1; an end before the start becomes the start."""
    last = total - 1
    start = F.least(F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)), last)
    end = F.least(F.greatest(F.coalesce(end, last), F.lit(0)), last)
    return start.cast("int"), F.greatest(start, end).cast("int")


def frame_range(start: int | None, end: int | None, total: int, strict: bool = True) -> tuple[int, int]:
    """Frames to read: missing, negative or too large bounds mean the first or last frame.

    strict: a start behind the end raises ValueError; else the end becomes the start, and no frames give (0, -1).
    """
    if total <= 0 and not strict:
        return 0, -1
    first = 0 if start is None or start < 0 or start >= total else int(start)
    last = total - 1 if end is None or end < 0 or end >= total else int(end)
    if last < first:
        if strict:
            raise ValueError("the first frame lies behind the last")
        last = first
    return first, last


def color_of(index: Column) -> Column:
    """array<int> from the palette; negative indexes count from its end."""
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in PALETTE])
    return F.element_at(table, F.pmod(index.cast("int"), F.lit(len(PALETTE))) + 1)


def normalized_color(color: Column, default: Sequence[int] = DEFAULT_COLOR) -> Column:
    """The first three numbers as ints, or the default where there are fewer or none."""
    own = F.transform(F.slice(color, 1, 3), lambda v: v.cast("int"))
    return F.when(F.size(F.coalesce(color, F.array().cast("array<int>"))) >= 3, own).otherwise(F.array(*[F.lit(int(v)) for v in default]))


def track_label(track: Column, name: Column | None = None) -> Column:
    """Id and class name, one blank between them even where the name is missing."""
    return F.format_string("%d %s", track, F.coalesce(name, F.lit("")) if name is not None else F.lit(""))


def detection_label(name: Column, cls: Column, score: Column, with_score: bool = True) -> Column:
    """Class name and score with one digit, or the class id alone."""
    if not with_score:
        return cls.cast("string")
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.format_string("%.1f", F.bround(score.cast("double"), 1)))


def first_parsable_timestamp(df, text: str = "text", frame: str = "frame", pattern: str = "yyyy-MM-dd HH:mm:ss"):
    """The earliest frame whose recognised text is a time, with that time; no such frame gives one null row."""
    t = F.try_to_timestamp(F.col(text), F.lit(pattern))
    return df.withColumn("__t", t).where("__t is not null").agg(F.min(frame).alias(frame), F.min_by("__t", frame).alias("timestamp"))
