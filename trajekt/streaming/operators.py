"""Streaming forms: clusters of frames as session windows, and the tracker as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import OUT, ByteTracker, rows_of


def frame_time(df: DataFrame, fps: float, frame: str = "frame", name: str = "frame_time") -> DataFrame:
    """Event time from the frame number, counted from the epoch."""
    return df.withColumn(name, F.timestamp_micros((F.col(frame) * F.lit(1_000_000.0) / F.lit(float(fps))).cast("long")))


def cluster_stream(df: DataFrame, gap_frames: int, fps: float, keys: tuple[str, ...] = ("video_id",), late: str = "10 seconds") -> DataFrame:
    """First and last frame and row count of every run of frames whose steps are at most gap_frames.

    A session window whose gap lies between gap_frames and the next step; rows later than `late` are dropped.
    """
    micros = int((gap_frames + 0.5) * 1_000_000 / fps)
    d = frame_time(df, fps).withWatermark("frame_time", late)
    out = d.groupBy(*keys, F.session_window("frame_time", f"{micros} microseconds"))
    return out.agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("rows")).drop("session_window")


def track_stream(dets: DataFrame, key: str = "video_id", **options) -> DataFrame:
    """ByteTrack per video over a stream of detections whose frames arrive in order, micro-batch by micro-batch.

    The tracker's state is kept per video; frames missing between batches are stepped as empty ones.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (ByteTracker(**options), None)  # noqa: S301
        pdf = pd.concat(list(parts))
        out: list[tuple] = []
        for frame, g in pdf.sort_values(["frame", "conf"], ascending=[True, False]).groupby("frame"):
            for empty in range((last if last is not None else int(frame) - 1) + 1, int(frame)):
                tracker.step(np.zeros((0, 6)))
            if last is not None and frame <= last:
                continue  # a late frame can't be stepped any more
            out += rows_of(int(frame), tracker.step(g[["x", "y", "w", "h", "conf", "class"]].to_numpy()), True)
            last = int(frame)
        state.update((pickle.dumps((tracker, last)),))
        got = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield got.assign(**{key: k[0]})[[key, *got.columns]]

    kind = dets.schema[key].dataType.simpleString()
    return dets.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {OUT}", "state binary", "append", GroupStateTimeout.NoTimeout)
