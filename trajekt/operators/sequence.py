"""Gaps, clusters, filled frames, sliding counts and walk intervals, tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunked, numbered, written


def cluster_by_gap(df: DataFrame, value: str, gap: float, by: Sequence[str] = ()) -> DataFrame:
    """Number (cluster, from 0) the runs of sorted values whose steps are at most gap; repeated values stay.

    A negative gap raises ValueError. Without `by` the values are one sequence by definition.
    """
    if gap < 0:
        raise ValueError("the gap must not be negative")
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(order).cast("int")).drop("__new")


def cluster_lists(values: Sequence[float], gap: float) -> list[list[float]]:
    """The same on the driver for a short list; empty or nested input raises ValueError."""
    values = list(values)
    if gap < 0 or not values or any(hasattr(v, "__len__") for v in values):
        raise ValueError("a flat, non-empty list and a gap of at least 0 are needed")
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= gap:
            out[-1].append(v)
        else:
            out.append([v])
    return out


def first_per_frame(df: DataFrame, by: Sequence[str] = ("track",), ties: Sequence[str] = ()) -> DataFrame:
    """One row per track and frame: the first by `ties`, then by the box."""
    ties = list(ties) or [c for c in "xywh" if c in df.columns]
    order = Window.partitionBy(*by, "frame").orderBy(*ties)
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def track_gaps(df: DataFrame, by: Sequence[str] = ("track",)) -> DataFrame:
    """Neighbouring frames of a track with frames missing between them: frame, next_frame, gap."""
    order = Window.partitionBy(*by).orderBy("frame")
    d = df.select(*by, "frame").distinct().withColumn("next_frame", F.lead("frame").over(order))
    return d.withColumn("gap", F.col("next_frame") - F.col("frame") - 1).where("gap > 0")


def fill_frames(df: DataFrame, max_gap: int = 30, by: Sequence[str] = ("track",)) -> DataFrame:
    """The missing frames of gaps of at most max_gap: *by, frame."""
    gaps = track_gaps(df, by).where(F.col("gap") <= max_gap)
    return gaps.select(*by, F.explode(F.sequence(F.col("frame") + 1, F.col("next_frame") - 1)).alias("frame"))


def fill_attributes(df: DataFrame, by: Sequence[str] = ("track",), cls: str = "cls", score: str = "score") -> DataFrame:
    """What filled rows get: a track's most frequent class (ties: the smallest) and mean score, -1 without any."""
    real = F.when(~F.isnan(score), F.col(score))
    return df.groupBy(*by).agg(F.coalesce(F.mode(cls, True), F.lit(-1)).alias(cls), F.coalesce(F.avg(real), F.lit(-1.0)).alias(score))


def sliding_sum(df: DataFrame, value: str, window: int, by: Sequence[str] = (), order: str = "frame") -> DataFrame:
    """Sum of `window` rows from each row on (count), for all starts but those within `window` of the end."""
    d, _ = chunked(numbered(df, by, [order], "sliding"), by, 0, window)
    w = Window.partitionBy(*by, "__chunk").orderBy("__row")
    d = d.withColumn("count", F.sum(value).over(w.rowsBetween(0, window - 1)).cast("long")).withColumn("__ahead", F.lead("__row", window).over(w))
    return d.where("__own and __ahead is not null").drop("__row", "__chunk", "__own", "__ahead")


def walk_intervals(df: DataFrame, window: int, factor: float = 0.75, fps: float = 30, countdown: float = 10, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Walk (status 1) and countdown (2) intervals of pedestrian signals: *by, status, beg_frame, end_frame.

    df: *by, frame, detection 0/1. A run is a maximal series of window starts whose count reaches factor * window.
    The walk starts at the run's earliest maximum among its second and later starts with a positive count, else
    at its first start; the countdown follows it.
    """
    keys = list(by)
    d, size = chunked(numbered(df, keys, ["frame"], "signal_rows"), keys, 1, window)
    w = Window.partitionBy(*keys, "__chunk").orderBy("__row")
    d = d.withColumn("count", F.sum("detection").over(w.rowsBetween(0, window - 1)).cast("long"))
    d = d.withColumn("end", F.lead("frame", window).over(w)).withColumn("ahead", F.lead("__row", window).over(w))
    d = d.withColumn("hit", F.col("ahead").isNotNull() & F.coalesce(F.col("count") >= F.lit(factor * window), F.lit(False)))
    hits = d.withColumn("start", ~F.lag("hit", 1, False).over(w)).where("__own and hit")
    # Runs of a chunk count from 1; 0 goes on from the chunk before.
    hits = hits.withColumn("run", F.sum(F.col("start").cast("int")).over(w))
    hits = hits.withColumn("rank", F.when(~F.col("start") & (F.col("count") > 0), F.col("count")).otherwise(F.lit(-1)))
    # The first start ranks -1 as later starts without a count do, and comes before them.
    place = F.struct("rank", -F.col("__row"))
    pieces = hits.groupBy(*keys, "__chunk", "run").agg(F.max_by(F.struct("frame", "end"), place).alias("s"), F.max(place).alias("place"), (F.max("__row") % size == 0).alias("cut"))
    pieces = written(pieces, "signal_runs")
    # Only the first and the last run of a chunk may be pieces of a longer one.
    edge = F.col("cut") | (F.col("run") == 0)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__chunk", "run")
    joined = pieces.where(edge).withColumn("run", F.sum((F.col("run") > 0).cast("int")).over(order))
    joined = joined.groupBy(*keys, "run").agg(F.max_by("s", "place").alias("s"))
    best = pieces.where(~edge).select(*keys, "s").unionByName(joined.select(*keys, "s"))
    frames = int(countdown * fps)
    both = F.array(
        F.struct(F.lit(1).alias("status"), F.col("s.frame").alias("beg_frame"), F.col("s.end").alias("end_frame")),
        F.struct(F.lit(2).alias("status"), (F.col("s.end") + 1).alias("beg_frame"), (F.col("s.end") + frames).alias("end_frame")),
    )
    return best.select(*keys, F.explode(both).alias("i")).select(*keys, "i.*")


def tails(df: DataFrame, length: int, by: Sequence[str] = ("track",)) -> DataFrame:
    """For each row the centres of its track in the `length` frames before (-1: all before): tail_frame, tail_x, tail_y.

    Centres are whole: int(x) + int(w / 2), int(y) + int(h / 2). A window collects them; no self join.
    """
    first = Window.unboundedPreceding if length < 0 else -length
    w = Window.partitionBy(*by).orderBy("frame").rangeBetween(first, -1)
    centre = lambda p, s: F.col(p).cast("int") + (F.col(s) / 2).cast("int")
    d = df.withColumn("__c", F.struct(F.col("frame").alias("tail_frame"), centre("x", "w").alias("tail_x"), centre("y", "h").alias("tail_y")))
    d = d.withColumn("__t", F.collect_list("__c").over(w))
    return d.select(*df.columns, F.explode("__t").alias("__t")).select(*df.columns, "__t.*")
