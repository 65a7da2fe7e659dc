"""Pedestrian signals: probabilities to detections, walk intervals, overlay labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequence import walk_intervals


def threshold_signals(probabilities: DataFrame, threshold: float = 0.98, by: Sequence[str] = ()) -> DataFrame:
    """(frame, signal, detection) from rows (frame, probabilities array: one per signal zone); 1 above the threshold."""
    d = probabilities.select(*by, "frame", F.posexplode("probabilities").alias("signal", "p"))
    return d.select(*by, "frame", "signal", F.coalesce((F.col("p") > threshold).cast("int"), F.lit(0)).alias("detection"))


def pedestrian_intervals(dets: DataFrame, walk_seconds: float, countdown_seconds: float, fps: float, factor: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """Walk and countdown intervals of every signal; the window is int(fps * walk_seconds) rows."""
    out = walk_intervals(dets, int(fps * walk_seconds), factor, fps, countdown_seconds, [*by, "signal"])
    return out.select(*by, *[F.col(c).cast("int").alias(c) for c in ("signal", "status", "beg_frame", "end_frame")])


def signal_labels(spark: SparkSession, intervals: DataFrame, zones: Sequence[Sequence[float]], n_frames: int, size_factor: float = 1.5, thick: int = 1, row_order: str | None = None) -> DataFrame:
    """A circle per frame and zone (x, y, w, h), coloured by the status of the first interval that covers the frame
    (red none, green walk, yellow countdown). row_order names a column with the intervals' order; by default
    the earlier begin, then the smaller status, comes first.

    Intervals are expanded to the frames they cover, so the join is hashed on frame and signal.
    """
    rows = [(k, float(int(x + w / 2)), float(int(y + h / 2)), float(int(max(w, h) * size_factor))) for k, (x, y, w, h) in enumerate(zones)]
    table = spark.createDataFrame(rows, "signal int, cx double, cy double, r double")
    grid = spark.range(n_frames).select(F.col("id").cast("int").alias("frame")).crossJoin(F.broadcast(table))
    inside = intervals.where(F.col("beg_frame") <= F.col("end_frame")).where((F.col("end_frame") >= 0) & (F.col("beg_frame") < n_frames))
    frames = F.explode(F.sequence(F.greatest("beg_frame", F.lit(0)), F.least("end_frame", F.lit(n_frames - 1))))
    rank = F.struct(row_order) if row_order else F.struct("beg_frame", "status")
    cover = inside.select("signal", "status", rank.alias("rank"), frames.alias("frame")).withColumn("frame", F.col("frame").cast("int"))
    cover = cover.groupBy("frame", "signal").agg(F.min_by("status", "rank").alias("status"))
    d = grid.join(cover, ["frame", "signal"], "left").withColumn("status", F.coalesce("status", F.lit(0)))
    color = F.when(F.col("status") == 1, F.array(F.lit(0), F.lit(255), F.lit(0))).when(F.col("status") == 2, F.array(F.lit(0), F.lit(255), F.lit(255))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(255)))
    return d.select("frame", F.lit("circle").alias("type"), F.array(F.array("cx", "cy")).alias("coords"), color.alias("color"), F.col("r").alias("size"), F.lit(int(thick)).alias("thick"), F.lit("").alias("desc"))
