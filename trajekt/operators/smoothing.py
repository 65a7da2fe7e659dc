"""Gap filling and smoothing of tracks with a constant-velocity Kalman filter and a backward (RTS) pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole_groups

# Frames (times tracks) that are smoothed at a time.
CELLS = 200_000


def smooth_axes(values: np.ndarray, seen: np.ndarray, q: float, r: np.ndarray) -> np.ndarray:
    """Smoothed positions of independent axes (frames x axes) over consecutive frames."""
    return smooth_many(values[None], seen[None], np.array([len(values)]), q, r)[0]


def smooth_many(values: np.ndarray, seen: np.ndarray, length: np.ndarray, q: float, r: np.ndarray) -> np.ndarray:
    """Smoothed positions (tracks x frames x axes) of many tracks, each with `length` consecutive frames, the rest padding.

    The model of a box is block diagonal, so each axis is a filter of position and velocity by itself. State at
    the start: first value, no velocity, variance 100; each frame predicts and then, where seen, updates. A frame is one
    step for all tracks together; only filtered variances enter the backward pass.
    """
    many, n, m = values.shape
    x, v = values[:, 0].astype(float), np.zeros((many, m))
    a, b, c = np.full((many, m), 100.0), np.zeros((many, m)), np.full((many, m), 100.0)  # covariance [[a, b], [b, c]]
    xs, vs, cov = np.empty((n, many, m)), np.empty((n, many, m)), np.empty((n, 3, many, m))
    for k in range(n):
        x = x + v
        a, b, c = a + 2 * b + c + q / 4, b + c + q / 2, c + q
        on = seen[:, k, None]
        g, h = np.where(on, a / (a + r), 0.0), np.where(on, b / (a + r), 0.0)
        gap = values[:, k] - x
        x, v = x + g * gap, v + h * gap
        a, b, c = (1 - g) * a, (1 - g) * b, c - h * b
        xs[k], vs[k] = x, v
        cov[k] = a, b, c
    for k in range(n - 2, -1, -1):
        a, b, c = cov[k]
        pa_, pb, pc = a + 2 * b + c + q / 4, b + c + q / 2, c + q
        det = pa_ * pc - pb * pb
        # gain = P F' inverse(predicted)
        g11, g12 = ((a + b) * pc - b * pb) / det, (b * pa_ - (a + b) * pb) / det
        g21, g22 = ((b + c) * pc - c * pb) / det, (c * pa_ - (b + c) * pb) / det
        on = (k + 1 < length)[:, None]
        dx, dv = np.where(on, xs[k + 1] - (xs[k] + vs[k]), 0.0), np.where(on, vs[k + 1] - vs[k], 0.0)
        xs[k], vs[k] = xs[k] + g11 * dx + g12 * dv, vs[k] + g21 * dx + g22 * dv
    return xs.transpose(1, 0, 2)


def interpolate_tracks(
    df: DataFrame,
    *,
    fill_gaps_only: bool = True,
    smooth_existing: bool = False,
    process_var: float = 10.0,
    meas_var_pos: float = 25.0,
    meas_var_size: float = 16.0,
    min_track_len: int = 2,
    max_gap: int = 30,
    add_interp_flag: bool = True,
    interp_col: str = "interp",
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    ordered: bool = False,
) -> DataFrame:
    """Fill the gaps of at most max_gap frames of each track with smoothed boxes.

    df: *by, frame, track, x, y, w, h, score, cls, r3, r4. One row per track and frame is kept (the first by `ties`,
    then by the box). Tracks of fewer than min_track_len frames pass through. The filter also runs through
    longer gaps, which stay empty. Observed rows keep their box unless smooth_existing, or fill_gaps_only is
    off. Filled rows have the track's most frequent class, its mean score, sizes of at least 1 and -1 elsewhere.

    Returns *by, frame, track, x, y, w, h (int, half-even), score, cls, interp_col (0 observed, 1 filled; the
    old r3 where add_interp_flag is off), r4, ordered by frame and track on request. One shuffle by track; a task
    steps many tracks together, and tracks without a gap to fill are not smoothed.
    """
    keys = [*by, "track"]
    missing = [c for c in ("frame", "track", "x", "y", "w", "h") if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    df = df.withColumns({c: F.lit(-1) for c in ("score", "cls", "r3", "r4") if c not in df.columns})
    touch = smooth_existing or not fill_gaps_only
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, "frame"])
    schema = f"{kinds}, x double, y double, w double, h double, score double, cls double, r3 double, r4 double, filled int"

    figures = ["x", "y", "w", "h", "score", "cls", "r3", "r4"]
    r = np.array([meas_var_pos, meas_var_pos, meas_var_size, meas_var_size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            frame = table["frame"].to_numpy().astype(np.int64)
            last = np.append(frame[1:] != frame[:-1], True)
            last[starts[1:] - 1] = True
            first = np.insert(last[:-1], 0, True)  # of each track and frame the first row stays
            table, frame = table.filter(pa.array(first)), frame[first]
            starts = np.searchsorted(np.flatnonzero(first), starts)
            box = np.column_stack([table[c].to_numpy().astype(float) for c in "xywh"])
            middle = np.column_stack([box[:, 0] + box[:, 2] / 2, box[:, 1] + box[:, 3] / 2, box[:, 2:]])
            begin, size = starts[:-1], np.diff(starts)
            span = frame[starts[1:] - 1] - frame[begin] + 1
            gap = np.append(np.diff(frame) - 1, 0)
            gap[starts[1:] - 1] = 0
            gap[(gap > max_gap) | (np.repeat(size, size) < min_track_len)] = 0
            asked = np.flatnonzero((size >= min_track_len) & ((np.add.reduceat(gap, begin) > 0) | touch)) if len(frame) else np.zeros(0, int)
            asked = asked[np.argsort(span[asked], kind="stable")]
            # A filled row: the row before its gap, the frame and the smoothed box.
            before, frames, boxes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 4))]
            at = 0
            while at < len(asked):
                stop = at + 1
                while stop < len(asked) and (stop + 1 - at) * span[asked[stop]] <= CELLS:
                    stop += 1
                own = asked[at:stop]
                n = int(span[own[-1]])
                values, seen = np.zeros((len(own), n, 4)), np.zeros((len(own), n), bool)
                rows = np.concatenate([np.arange(begin[t], begin[t] + size[t]) for t in own])
                track = np.repeat(np.arange(len(own)), size[own])
                place = frame[rows] - np.repeat(frame[begin[own]], size[own])
                values[track, place], seen[track, place] = middle[rows], True
                s = smooth_many(values, seen, span[own], process_var, r)
                sizes = np.maximum(s[..., 2:], 1.0)
                s = np.concatenate([s[..., :2] - sizes / 2, sizes], axis=2)
                if touch:
                    box[rows] = s[track, place]
                more = gap[rows]
                step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
                before.append(np.repeat(rows, more))
                frames.append(np.repeat(frame[rows], more) + step)
                boxes.append(s[np.repeat(track, more), np.repeat(place, more) + step])
                at = stop
            source = np.concatenate(before)
            track = np.repeat(np.arange(len(begin)), size)
            cls, score = (pd.Series(table[c].to_numpy().astype(float)) for c in ("cls", "score"))
            mean = score.groupby(track).mean().reindex(range(len(begin))).fillna(-1.0).to_numpy()
            mode = cls.groupby(track).agg(lambda c: c.mode().iloc[0] if c.notna().any() else -1.0).reindex(range(len(begin))).to_numpy() if len(source) else np.zeros(len(begin))
            take = pa.array(np.concatenate([np.arange(len(frame)), source]))
            out = [table[k].take(take) for k in keys]
            out.append(pa.array(np.concatenate([frame, *frames])).cast(table["frame"].type))
            box = np.concatenate([box, *boxes])
            blank = np.full(len(source), -1.0)
            rest = [np.concatenate([table[c].to_numpy().astype(float), f]) for c, f in (("score", mean[track[source]]), ("cls", mode[track[source]]), ("r3", blank), ("r4", blank))]
            filled = np.concatenate([np.zeros(len(frame), np.int32), np.ones(len(source), np.int32)])
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in [*out, *map(pa.array, box.T.copy()), *map(pa.array, rest), pa.array(filled)]]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "frame", *figures, "filled"])

    own = df.select(*keys, "frame", *[F.col(c).cast("double").alias(c) for c in figures], *[F.col(c).alias(f"tie_{k}") for k, c in enumerate(ties)])
    order = [*keys, "frame", *[f"tie_{k}" for k in range(len(ties))], *figures]
    out = own.repartition(*keys).sortWithinPartitions(*order).select(*keys, "frame", *figures).mapInArrow(run, schema)
    whole = lambda c: F.bround(F.coalesce(F.nanvl(c, F.lit(-1.0)), F.lit(-1.0)), 0).cast("int")
    flag = F.col("filled") if add_interp_flag else whole("r3")
    out = out.select(
        *by, "frame", "track", *[whole(c).alias(c) for c in "xywh"], F.coalesce(F.nanvl("score", F.lit(-1.0)), F.lit(-1.0)).alias("score"), whole("cls").alias("cls"), flag.alias(interp_col), whole("r4").alias("r4")
    )
    return out.orderBy(*by, "frame", "track") if ordered else out
