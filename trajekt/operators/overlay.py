"""Overlay tables: what a renderer would draw, as rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import PALETTE, color_of, detection_label, track_label
from ..sources.schema import DRAW
from .sequence import tails


class ElementType(StrEnum):
    TXT = "txt"
    LINE = "line"
    BOX = "box"
    BBOX = "bbox"
    CIRCLE = "circle"
    POLYGON = "polygon"
    POLYLINES = "polylines"


class LabelMethod(StrEnum):
    OPENCV = "opencv"
    FFMPEG = "ffmpeg"
    CHROME_SAFE = "chrome_safe"


class Encoder(StrEnum):
    LIBX264 = "libx264"
    LIBX265 = "libx265"
    H264_NVENC = "h264_nvenc"
    HEVC_NVENC = "hevc_nvenc"


class Preset(StrEnum):
    ULTRAFAST = "ultrafast"
    SUPERFAST = "superfast"
    VERYFAST = "veryfast"
    FASTER = "faster"
    FAST = "fast"
    MEDIUM = "medium"
    SLOW = "slow"
    SLOWER = "slower"
    VERYSLOW = "veryslow"


class TrackClipMethod(StrEnum):
    ALL = "all"
    RANDOM = "random"
    SPECIFY = "specify"


def point(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def _fixed(color: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in color[:3]])


def _element(kind: str, coords: Column, color: Column, size: float, thick: int, desc: Column, fill: bool, alpha: float) -> list[Column]:
    return [
        F.col("frame").cast("int").alias("frame"), F.lit(str(kind)).alias("type"), coords.alias("coords"), color.alias("color"), F.lit(float(size)).alias("size"),
        F.lit(int(thick)).alias("thick"), desc.alias("desc"), F.lit(bool(fill)).alias("fill"), F.lit(min(max(float(alpha), 0.0), 1.0)).alias("alpha"),
    ]


def _corners() -> Column:
    return F.array(point(F.col("x"), F.col("y")), point(F.col("x") + F.col("w"), F.col("y") + F.col("h")))


def _named(df: DataFrame, names: DataFrame | None, cls: str) -> DataFrame:
    """With the column name: a class list is a few hundred rows by nature. Unknown and negative classes have none."""
    if names is None:
        return df.withColumn("name", F.lit(""))
    return df.join(F.broadcast(names.select(F.col("id").alias("__id"), "name")), F.col(cls) == F.col("__id"), "left").drop("__id")


def draw_tracks(
    tracks: DataFrame,
    names: DataFrame | None = None,
    color: Sequence[int] | None = None,
    thick: int = 2,
    size: float = 1,
    tail_length: int = 0,
    tail_size: float | None = None,
    label_class: bool = False,
    shapes: Sequence | None = None,
    fill: bool = False,
    alpha: float = 0.0,
    start_frame: int | None = None,
    end_frame: int | None = None,
) -> DataFrame:
    """A box per track row within the frames, and a circle per earlier centre of its tail; equal rows once.

    Tails look at all rows of the table, also before start_frame; -1 means all earlier frames.
    """
    shown = F.lit(True)
    if start_frame is not None:
        shown &= F.col("frame") >= start_frame
    if end_frame is not None:
        shown &= F.col("frame") <= end_frame
    paint = color_of(F.col("track")) if color is None else _fixed(color)
    boxes = _named(tracks.where(shown), names if label_class else None, "cls")
    label = track_label(F.col("track").cast("long"), F.col("name"))
    out = boxes.select(*_element(ElementType.BBOX, _corners(), paint, size, thick, label, fill, alpha))
    if tail_length:
        radius = max(1, int(size if tail_size is None else tail_size))
        dots = tails(tracks.select("frame", "track", *"xywh"), tail_length).where(shown)
        at = F.array(point(F.col("tail_x"), F.col("tail_y")))
        out = out.unionByName(dots.select(*_element(ElementType.CIRCLE, at, paint, radius, -1, F.lit(""), fill, alpha)))
    return with_shapes(out.dropDuplicates(), shapes)


def draw_detections(
    dets: DataFrame, names: DataFrame | None = None, color: Sequence[int] | None = None, thick: int = 2, size: float = 1, label_score: bool = True, shapes: Sequence | None = None, fill: bool = False, alpha: float = 0.0, start_frame: int | None = None, end_frame: int | None = None
) -> DataFrame:
    """A box per detection within the frames, coloured by class, labelled with class name and score or class id."""
    if start_frame is not None:
        dets = dets.where(F.col("frame") >= start_frame)
    if end_frame is not None:
        dets = dets.where(F.col("frame") <= end_frame)
    paint = color_of(F.col("class")) if color is None else _fixed(color)
    rows = _named(dets, names, "class")
    label = detection_label(F.col("name"), F.col("class"), F.col("conf"), label_score)
    return with_shapes(rows.select(*_element(ElementType.BBOX, _corners(), paint, size, thick, label, fill, alpha)).dropDuplicates(), shapes)


def _pairs(geometry) -> tuple[str, list[tuple[float, float]]]:
    """(kind or "", points) of a WKT text, a flat list or a list of pairs."""
    if isinstance(geometry, str):
        m = re.fullmatch(r"\s*(\w+)\s*\(+([^()]*)\)+\s*", geometry)
        if not m:
            raise ValueError(f"unreadable geometry: {geometry!r}")
        return m[1].lower(), [tuple(map(float, p.split()[:2])) for p in m[2].split(",")]
    values = list(geometry)
    if values and not isinstance(values[0], (list, tuple)):
        if len(values) % 2:
            raise ValueError("a flat list of coordinates has an even length")
        values = list(zip(values[::2], values[1::2]))
    return "", [(float(x), float(y)) for x, y in values]


def shape_row(shape, index: int) -> tuple:
    """An overlay element without its frame from a shape: a geometry, or a dict of type, geometry, color, fill,
    alpha (also as transparent or transparant), size, thick and desc. Wrong point counts raise ValueError."""
    s = shape if isinstance(shape, dict) else {"geometry": shape}
    raw = s.get("geometry")
    geometry, points = _pairs(raw)
    kind = str(s.get("type", "")).lower().strip()
    if not kind:
        kind = {"linestring": "polyline", "linearring": "polyline", "polygon": "polygon", "point": "circle"}.get(geometry, "rectangle" if not isinstance(raw, str) and len(raw) == 4 else "")
    box = kind in ("rectangle", "rect", "box")
    if box and geometry:
        xs, ys = zip(*points)
        points = [(min(xs), min(ys)), (max(xs), max(ys))]
    elements = {"line": "line", "polyline": "polylines", "polylines": "polylines", "circle": "circle", "polygon": "polygon"}
    element = "box" if box else elements.get(kind)
    if element is None:
        raise ValueError(f"unsupported shape type: {kind!r}")
    few, many = {"line": (2, 2), "polylines": (2, 10**9), "circle": (1, 1), "polygon": (3, 10**9), "box": (2, 2)}[element]
    if not few <= len(points) <= many:
        raise ValueError(f"wrong number of points for a {kind}: {len(points)}")
    if element == "polygon" and points[0] != points[-1]:
        points = [*points, points[0]]
    color = s.get("color")
    color = [int(v) for v in color[:3]] if color is not None and len(color) >= 3 else list(PALETTE[index % len(PALETTE)])
    alpha = min(max(float(s.get("alpha", s.get("transparent", s.get("transparant", 0.0)))), 0.0), 1.0)
    return element, [list(p) for p in points], color, float(s.get("size", 4.0)), int(s.get("thick", 2)), str(s.get("desc", "")), bool(s.get("fill", False)), alpha


def shapes_table(spark: SparkSession, shapes: Sequence) -> DataFrame:
    from pyspark.sql.types import StructType

    return spark.createDataFrame([shape_row(s, k) for k, s in enumerate(shapes)], StructType(DRAW.fields[1:]))


def draw_shapes(spark: SparkSession, shapes: Sequence, base: DataFrame | None = None) -> DataFrame:
    """base with every shape in every frame of it; frame 0 where it has none. The shapes are literal parameters."""
    base = spark.createDataFrame([], DRAW) if base is None else base
    shapes = [shapes] if isinstance(shapes, (dict, str)) else shapes
    if not shapes:
        return base
    frames = base.select(F.col("frame").cast("int").alias("frame")).distinct()
    none = frames.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).alias("frame"))
    rows = frames.union(none).crossJoin(F.broadcast(shapes_table(spark, shapes)))
    return base.unionByName(rows.select(*base.columns))


def with_shapes(df: DataFrame, shapes: Sequence | None) -> DataFrame:
    return draw_shapes(df.sparkSession, shapes, df) if shapes else df


def ensure_draw_columns(df: DataFrame) -> DataFrame:
    """fill and alpha with their defaults where missing, columns in order."""
    if "fill" not in df.columns:
        df = df.withColumn("fill", F.lit(False))
    if "alpha" not in df.columns:
        df = df.withColumn("alpha", F.lit(0.0))
    return df.select(*DRAW.names)


def select_tracks(tracks: DataFrame, method: str = "all", number: int = 10, ids: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """Track ids: all, `number` drawn without replacement (10 if it is not positive), or the listed ones."""
    found = tracks.select("track").distinct()
    if method == TrackClipMethod.ALL:
        return found
    if method == TrackClipMethod.RANDOM:
        return found.orderBy(F.xxhash64(F.lit(seed), "track"), "track").limit(number if number > 0 else 10)
    if method == TrackClipMethod.SPECIFY:
        return found.where(F.col("track").isin(list(ids or [])))
    raise ValueError("method is all, random or specify")


def track_clips(tracks: DataFrame, selected: DataFrame, n_frames: int, start_offset: int = 0, end_offset: int = 0, prefix: str | None = None) -> DataFrame:
    """(track, start_frame, end_frame, file): each selected track's frames, widened and clamped to the video."""
    d = tracks.join(selected, "track", "left_semi").groupBy("track").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    name = F.concat(F.lit(f"{prefix}_" if prefix else ""), F.col("track").cast("string"), F.lit(".mp4"))
    return d.select("track", F.greatest(F.col("a") - start_offset, F.lit(0)).cast("int").alias("start_frame"), F.least(F.col("b") + end_offset, F.lit(n_frames - 1)).cast("int").alias("end_frame"), name.alias("file"))


def frame_files(frames: DataFrame, prefix: str | None = None, track: bool = False) -> DataFrame:
    """(frame[, track], file): names of exported pictures, <track>_<frame>.jpg or <frame>.jpg behind the prefix."""
    cols = ["track", "frame"] if track else ["frame"]
    name = F.concat(F.lit(f"{prefix}-" if prefix else ""), F.concat_ws("_", *[F.col(c).cast("string") for c in cols]), F.lit(".jpg"))
    return frames.select(*cols, name.alias("file")).distinct()


def seek_list(frames: DataFrame, videos: DataFrame, by: str = "video_id") -> DataFrame:
    """Frames (by, frame) that their video (by, n_frames) has: from 0 to n_frames - 1. Frames of unknown videos go."""
    inside = (frames[by] == videos[by]) & (frames["frame"] >= 0) & (frames["frame"] < videos["n_frames"])
    return frames.join(videos, inside, "left_semi")


def elements_by_frame(draw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, frame, elements): the draw rows of each frame as one array, for writers that go frame by frame."""
    own = [c for c in draw.columns if c not in (*by, "frame")]
    return draw.groupBy(*by, "frame").agg(F.collect_list(F.struct(*own)).alias("elements"))


def in_frame_order(draw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The draw rows ordered by frame; within a frame by type, then coordinates."""
    return draw.orderBy(*by, "frame", "type", "coords")
