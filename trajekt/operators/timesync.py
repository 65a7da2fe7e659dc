"""Frames to clock times over a table of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import frame_to_unix_ms, unix_ms_to_local


def add_unix_time(videos: DataFrame, ref_frame: int, ref_time: int, video: str = "video_id") -> DataFrame:
    """(frame, unix_time, video) for every frame of every video; frames per second must be positive."""
    frames = F.explode(F.when(F.col("n_frames") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).otherwise(F.array().cast("array<long>")))
    d = videos.select(F.col(video).alias("video"), "fps", frames.alias("frame"))
    return d.select("frame", frame_to_unix_ms(F.col("frame"), ref_frame, ref_time, F.col("fps")).alias("unix_time"), "video")


def synchronize(videos: DataFrame, ref_frame: int, ref_time: int, zone: str = "US/Eastern", local: bool = False, apply_offsets: bool = False, order: str = "position", video: str = "video_id") -> DataFrame:
    """Time map of a sequence of videos (position, video_id, fps, n_frames[, offset in ms]).

    ref_frame holds for the first video, frame 0 for the others; ref_time for all, plus the video's offset with
    apply_offsets. local adds local_time: ISO text with milliseconds and the zone's offset.
    """
    first = F.min(order).over(_all())
    frames = F.explode(F.when(F.col("n_frames") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).otherwise(F.array().cast("array<long>")))
    d = videos.withColumn("ref", F.when(F.col(order) == first, F.lit(ref_frame)).otherwise(F.lit(0)))
    at = F.lit(ref_time) + F.coalesce(F.col("offset"), F.lit(0)) if apply_offsets else F.lit(ref_time)
    d = d.select(F.col(video).alias("video"), "fps", "ref", at.alias("at"), frames.alias("frame"))
    out = d.select("frame", frame_to_unix_ms(F.col("frame"), F.col("ref"), F.col("at"), F.col("fps")).alias("unix_time"), "video")
    return out.withColumn("local_time", unix_ms_to_local(F.col("unix_time"), zone)) if local else out


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
