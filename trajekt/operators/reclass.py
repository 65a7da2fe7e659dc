"""Re-classification of tracks by the overlap of their largest boxes with a detections table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from .shared import written


def top_frames(tracks: DataFrame, num_frames: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """The rows of the num_frames largest boxes of each track (ties: the earlier frame, then the box)."""
    order = Window.partitionBy(*by, "track").orderBy(F.desc(F.col("w") * F.col("h")), "frame", *"xywh")
    return tracks.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= num_frames).drop("__rank")


def best_shares(boxes: DataFrame, dets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each of the distinct boxes (*by, frame, x, y, w, h) and each class the largest share of a same-frame detection
    (class, d_x, d_y, d_w, d_h) that it covers, as best; boxes that cover none have no row.

    Boxes and detections meet in cells of the plane. A width (a power of two) is the level of what is no larger. At the
    higher level of the two a detection lies in the cell of its corner, and a box looks into the cells, nine at
    most, where corners of detections that reach it lie. Sizes beyond 2^40 have one level with one cell.
    """
    size = lambda w, h: F.greatest(F.col(w), F.col(h), F.lit(1.0))
    level = lambda w, h: F.when(size(w, h) < 2.0**40, F.ceil(F.log2(size(w, h))).cast("int")).otherwise(F.lit(1000))
    boxes = boxes.where("w > 0 and h > 0").withColumn("level", level("w", "h"))
    dets = dets.where("d_w > 0 and d_h > 0").distinct().withColumn("d_level", level("d_w", "d_h"))
    at = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())
    of_boxes, of_dets = at(boxes, "level"), at(dets, "d_level")

    def levels(own: str, others: list[int]):
        higher = F.filter(F.lit(others).cast("array<int>") if others else F.array().cast("array<int>"), lambda v: v > F.col(own))
        return F.explode(F.concat(F.array(own), higher))

    step = F.pow(F.lit(2.0), F.col("meet"))
    cell = lambda c: F.when(F.col("meet") < 1000, F.floor(c / step)).otherwise(F.lit(0))
    span = lambda c, w: F.explode(F.sequence(cell(F.col(c) - step), cell(F.col(c) + F.col(w))))
    held = dets.withColumn("meet", levels("d_level", of_boxes)).withColumn("cell_x", cell(F.col("d_x"))).withColumn("cell_y", cell(F.col("d_y")))
    asked = boxes.withColumn("meet", levels("level", of_dets)).withColumn("cell_x", span("x", "w")).withColumn("cell_y", span("y", "h"))
    p = asked.join(held, [*by, "frame", "meet", "cell_x", "cell_y"]).where(F.col("meet") == F.greatest("level", "d_level"))
    p = p.withColumn("over", overlap([F.col(c) for c in "xywh"], [F.col(f"d_{c}") for c in "xywh"])).where("over > 0")
    return p.groupBy(*by, "frame", "class", *"xywh").agg(F.max(F.col("over") / F.greatest(F.col("d_w") * F.col("d_h"), F.lit(1e-300))).alias("best"))


def match_detections(tracks: DataFrame, dets: DataFrame, threshold: float = 0.75, classes: Sequence[int] = (1, 36), by: Sequence[str] = (), num_frames: int = 25) -> DataFrame:
    """Per track and class: mean over its top rows of the largest share of a same-frame detection that the row
    covers, of those at least threshold (avg_score, 0 without any), and hit: avg_score >= threshold."""
    box = list("xywh")
    rows = top_frames(tracks, num_frames, by).select(*by, "track", "frame", *[F.col(c).cast("double").alias(c) for c in box]).distinct()
    rows = written(rows, "reclass-rows")
    keep = dets.where(F.col("class").isin(list(classes))).select(*by, "frame", "class", *[F.col(c).alias(f"d_{c}") for c in box])
    there = keep.select(*by, "frame", "class").distinct()
    best = best_shares(rows.select(*by, "frame", *box).distinct(), keep, by)
    p = rows.join(there, [*by, "frame"]).join(best, [*by, "frame", "class", *box], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    out = p.groupBy(*by, "track", "class").agg(F.coalesce(F.avg(F.when(F.col("best") >= threshold, F.col("best"))), F.lit(0.0)).alias("avg_score"))
    return out.withColumn("hit", F.col("avg_score") >= threshold)


def re_classify(tracks: DataFrame, dets: DataFrame, num_frames: int = 25, threshold: float = 0.75, default_class: int = 0, match_class: Sequence[int] = (1, 36), track_ids: Sequence[int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(track, cls, avg_score to two digits) for every track, or the listed ones: the class of the best hit (ties:
    the earlier in match_class), else default_class with 0."""
    if track_ids is not None:
        tracks = tracks.where(F.col("track").isin(list(track_ids)))
    hits = match_detections(tracks, dets, threshold, match_class, by, num_frames).where("hit")
    place = F.array_position(F.array(*[F.lit(int(c)) for c in match_class]), F.col("class").cast("int"))
    best = hits.groupBy(*by, "track").agg(F.max_by(F.struct("class", "avg_score"), F.struct("avg_score", -place)).alias("b"))
    out = tracks.select(*by, "track").distinct().join(best, [*by, "track"], "left")
    return out.select(*by, "track", F.coalesce(F.col("b.class"), F.lit(default_class)).cast("int").alias("cls"), F.bround(F.coalesce(F.col("b.avg_score"), F.lit(0.0)), 2).alias("avg_score"))
