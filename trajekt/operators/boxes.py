"""Raw boxes to tables, overlaps of boxes of one frame, box interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import inf
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.geometry import iob, iou
from .shared import numbered, written

#: Boxes in a block, boxes of either side in a unit of work, and pairs for which one task is planned.
BLOCK, UNIT, TASK_PAIRS = 256, 4_096, 4_000_000


def normalize_detections(df: DataFrame, mode: str = "trunc", x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """Corner boxes to (frame, res, x, y, w, h, conf, class). trunc: sizes from the exact corners, all four cut
    toward zero; round: sizes to whole numbers, corners to one digit, both half-even. conf to two digits."""
    if mode not in ("trunc", "round"):
        raise ValueError("mode is trunc or round")
    w, h = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    if mode == "trunc":
        box = [c.cast("int") for c in (F.col(x1), F.col(y1), w, h)]
    else:
        box = [F.bround(F.col(x1), 1), F.bround(F.col(y1), 1), F.bround(w, 0), F.bround(h, 0)]
    named = [c.alias(n) for c, n in zip(box, "xywh")]
    return df.select("frame", F.lit(-1).alias("res"), *named, F.bround("conf", 2).alias("conf"), F.col("class").cast("int").alias("class"))


def top_detections(df: DataFrame, limit: int = 300, by: Sequence[str] = ("frame",), score: str = "conf", ties: Sequence[str] = ("x", "y", "w", "h")) -> DataFrame:
    """The best-scored rows of each frame, at most `limit`."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= limit).drop("__rank")


def nms(df: DataFrame, threshold: float = 0.7, by: Sequence[str] = ("frame", "class"), score: str = "conf", ties: Sequence[str] = ("x", "y", "w", "h")) -> DataFrame:
    """Greedy non-maximum suppression per frame and class; frames are small groups by nature. Equal scores go by `ties`."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, *ties], ascending=[False, *[True] * len(ties)], kind="stable")
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        live = np.ones(len(pdf), bool)
        # In the order of the left edge, what can overlap a box is a slice; without an overlap only a negative threshold drops.
        left = np.argsort(x, kind="stable")
        sx, sy, sw, sh = x[left], y[left], w[left], h[left]
        lo, hi = np.zeros(len(pdf), int), np.full(len(pdf), len(pdf))
        if threshold >= 0 and np.isfinite([x, w]).all():
            # A margin for rounded sums of edges.
            slack = 1e-9 * (np.abs(x) + np.abs(w) + np.abs(w).max(initial=0) + 1)
            lo = np.searchsorted(sx, x - w.max(initial=0) - slack)
            hi = np.searchsorted(sx, x + w + slack, side="right")
        for k in range(len(pdf)):
            if live[k]:
                at = slice(lo[k], hi[k])
                across = np.minimum(x[k] + w[k], sx[at] + sw[at]) - np.maximum(x[k], sx[at])
                down = np.minimum(y[k] + h[k], sy[at] + sh[at]) - np.maximum(y[k], sy[at])
                both = np.maximum(across, 0) * np.maximum(down, 0)
                over = left[at][both / np.maximum(w[k] * h[k] + sw[at] * sh[at] - both, 1e-6) > threshold]
                live[over[over > k]] = False
        return pdf[live]

    return df.groupBy(*by).applyInPandas(keep, df.schema)


def parse_tracker_rows(df: DataFrame, with_score_cls: bool = True) -> DataFrame:
    """Tracker output (frame, values: x1, y1, x2, y2, id, conf, cls, ...) to track rows; rows with fewer than five values go."""
    at = lambda k: F.get("values", F.lit(k))
    whole = lambda c: F.bround(c, 0).cast("int")
    score = F.coalesce(F.bround(at(5), 2), F.lit(-1.0)) if with_score_cls else F.lit(-1.0)
    cls = F.coalesce(whole(at(6)), F.lit(-1)) if with_score_cls else F.lit(-1)
    return df.where(F.size("values") >= 5).select(
        "frame", whole(at(4)).alias("track"), whole(at(0)).alias("x"), whole(at(1)).alias("y"), whole(at(2) - at(0)).alias("w"), whole(at(3) - at(1)).alias("h"), score.alias("score"), cls.alias("cls"), F.lit(-1).alias("r3"), F.lit(-1).alias("r4")
    )


#: Edges of boxes, where they lie if nothing is known of them, and how a block's follow from those of its boxes.
EDGES = {"left": (-inf, F.min), "right": (inf, F.max), "top": (-inf, F.min), "bottom": (inf, F.max)}


def _units(df: DataFrame, side: str, key: Sequence[str], id_col: str) -> DataFrame:
    """Boxes numbered within their key from left to right, in units of at most UNIT: *key, box with its edges, {side}_unit.

    Edges are doubles; a box with negative sizes or with a value missing, huge, not a number or a decimal has no bounds.
    """
    plain = [F.col(c).between(-1e9 if c in "xy" else 0, 1e9) for c in "xywh" if not isinstance(df.schema[c].dataType, DecimalType)]
    plain = reduce(and_, plain) if len(plain) == 4 else F.lit(False)
    at = {"left": F.col("x"), "right": F.col("x") + F.col("w"), "top": F.col("y"), "bottom": F.col("y") + F.col("h")}
    edges = [F.when(plain, at[n].cast("double")).otherwise(F.lit(end)).alias(f"{side}_{n}") for n, (end, _) in EDGES.items()]
    d = df.select(*key, F.struct(*edges, F.col(id_col).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in "xywh"]).alias("box"))
    d = numbered(d.where(reduce(and_, [F.col(k).isNotNull() for k in key])), key, ["box"], f"boxes_{side}")
    return d.withColumn(f"{side}_unit", F.floor((F.col("__row") - 1) / UNIT))


def _apart(a: str, b: str, inclusive: bool) -> Column:
    """Whether edges show that two boxes share nothing, by differences as overlap() takes them."""
    ends = ((a, "right", b, "left"), (b, "right", a, "left"), (a, "bottom", b, "top"), (b, "bottom", a, "top"))
    return reduce(or_, [F.col(f"{p}_{end}") - F.col(f"{q}_{start}") <= F.lit(-1.0 if inclusive else 0.0) for p, end, q, start in ends])


def _meetings(a: DataFrame, b: DataFrame, key: Sequence[str], a_id: str, b_id: str, inclusive: bool = False) -> DataFrame:
    """Boxes of a with their edges, each with every block of b of equal key: its b_boxes, their b_ids, and `far` where the
    whole block shares nothing with a.

    Blocks unfold to pairs one at a time. Units of boxes of either side meet, so that a frame of
    many boxes is dealt to many tasks. Tasks are planned by pairs, as the size of what is read says nothing of them.
    """
    key = list(key)
    a, b = _units(a, "a", key, a_id), _units(b, "b", key, b_id)
    hull = [f(f"box.b_{n}").alias(f"hull_{n}") for n, (_, f) in EDGES.items()]
    b = b.groupBy(*key, "b_unit", F.floor((F.col("__row") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("box")).alias("b_boxes"), *hull)
    b = b.withColumn("b_ids", F.col("b_boxes.b_id"))
    a, b = written(a.select(*key, "box.*", "a_unit"), "boxes_a"), written(b.drop("block"), "blocks_b")
    size = lambda d, s, n: d.groupBy(*key).agg((F.max(f"{s}_unit") + 1).alias(f"{s}_units"), F.sum(n).alias(f"{s}_n"))
    sizes = written(size(a, "a", F.lit(1)).join(size(b, "b", F.size("b_boxes")), key), "box_counts")
    pairs, units = sizes.agg(F.sum(F.col("a_n").cast("double") * F.col("b_n")), F.sum(F.col("a_units") * F.col("b_units"))).first()
    tasks = int(min(units or 1, (pairs or 0) // TASK_PAIRS + 1, 20_000))
    each = lambda d, s: d.join(sizes.select(*key, f"{s}_units"), key).withColumn(f"{s}_unit", F.explode(F.sequence(F.lit(0), F.col(f"{s}_units") - 1))).drop(f"{s}_units")
    meet = [*key, "a_unit", "b_unit"]
    d = each(a, "b").repartition(tasks, *meet).join(each(b, "a").repartition(tasks, *meet).hint("merge"), meet)
    d = d.withColumn("far", _apart("a", "hull", inclusive))
    return d.select(*key, *[c for c in a.columns if c not in meet], "far", "b_ids", "b_boxes")


def _cols(side: str):
    return [F.col(f"{side}_{c}") for c in "xywh"]


def box_pairs(a: DataFrame, b: DataFrame, key: Sequence[str] = ("frame",), a_id: str = "id", b_id: str = "id") -> DataFrame:
    """All pairs of boxes with equal key, as a_id, b_id and both boxes."""
    d = _meetings(a, b, key, a_id, b_id)
    return d.select(*key, *[f"a_{c}" for c in ("id", *"xywh")], F.inline("b_boxes")).select(*key, *[f"{s}_{c}" for s in "ab" for c in ("id", *"xywh")])


def _shares(a: DataFrame, b: DataFrame, key: Sequence[str], a_id: str, b_id: str, inclusive: bool = False, **shares: Column) -> DataFrame:
    """Shares of all pairs, worked out only where edges don't show that both boxes lie apart; most do, and share nothing."""
    d = _meetings(a, b, key, a_id, b_id, inclusive)
    # Of a block that lies apart only the ids are read.
    far = d.where("far").select(*key, "a_id", F.explode("b_ids").alias("b_id"), *[F.lit(0.0).alias(n) for n in shares])
    near = d.where(~F.col("far")).select(*[c for c in d.columns if c not in ("far", "b_ids", "b_boxes")], F.inline("b_boxes"))
    near = near.select(*key, "a_id", "b_id", *[F.when(_apart("a", "b", inclusive), F.lit(0.0)).otherwise(c).alias(n) for n, c in shares.items()])
    return far.union(near)


def box_iou(a: DataFrame, b: DataFrame, key: Sequence[str] = ("frame",), a_id: str = "id", b_id: str = "id", inclusive: bool = False) -> DataFrame:
    """Intersection over union of the pairs of each frame."""
    return _shares(a, b, key, a_id, b_id, inclusive, iou=iou(_cols("a"), _cols("b"), inclusive))


def box_iob(a: DataFrame, b: DataFrame, key: Sequence[str] = ("frame",), a_id: str = "id", b_id: str = "id") -> DataFrame:
    """Intersection over either box of the pairs of each frame."""
    over_a, over_b = iob(_cols("a"), _cols("b"))
    return _shares(a, b, key, a_id, b_id, iob_a=over_a, iob_b=over_b)


def spline(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic interpolation with the not-a-knot ends; two and three points give a line and a parabola."""
    n = len(t)
    if n == 1:
        return np.repeat(v, len(at), axis=0)
    if n == 2:
        return v[0] + (at - t[0])[:, None] / (t[1] - t[0]) * (v[1] - v[0])
    if n == 3:
        return np.vander(at - t[0], 3) @ np.linalg.solve(np.vander(t - t[0], 3), v)
    h = np.diff(t)
    slope = np.diff(v, axis=0) / h[:, None]
    m = np.zeros((n, n))
    rhs = np.zeros_like(v)
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        rhs[k] = 6 * (slope[k] - slope[k - 1])
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    second = np.linalg.solve(m, rhs)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    d, w = (at - t[k])[:, None], h[k][:, None]
    return v[k] + d * (slope[k] - w * (2 * second[k] + second[k + 1]) / 6) + d**2 * second[k] / 2 + d**3 * (second[k + 1] - second[k]) / (6 * w)


def interpolate_boxes(boxes: DataFrame, targets: DataFrame, method: str = "cubic", by: Sequence[str] = ("track",)) -> DataFrame:
    """Boxes of each track at the target frames (columns *by, frame), cut toward zero.

    boxes: *by, frame, x, y, w, h, frames distinct within a track. linear and nearest look up the known neighbours
    with windows; any other name but cubic means linear. A target before the first or after the last frame
    of its track, or of a track without boxes, raises an error.
    """
    keys = list(by)
    if method == "cubic":

        def fit(key, known: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(wanted):
                return pd.DataFrame(columns=[*keys, "frame", *"xywh"])
            known = known.sort_values("frame")
            t, at = known["frame"].to_numpy(float), wanted["frame"].to_numpy(float)
            if not len(t) or at.min() < t[0] or at.max() > t[-1]:
                raise ValueError(f"a target frame of {key} lies outside its boxes")
            got = np.trunc(spline(t, known[list("xywh")].to_numpy(float), at)).astype("int32")
            return wanted[[*keys, "frame"]].assign(**{c: got[:, k] for k, c in enumerate("xywh")})

        kinds = ", ".join(f"`{c}` {boxes.schema[c].dataType.simpleString()}" for c in [*keys, "frame"])
        return boxes.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(fit, f"{kinds}, x int, y int, w int, h int")
    box = F.struct("frame", *"xywh")
    rows = boxes.select(*keys, "frame", F.lit(0).alias("target"), box.alias("box")).unionByName(
        targets.select(*keys, "frame", F.lit(1).alias("target"), F.lit(None).cast(box_type(boxes)).alias("box"))
    )
    back = Window.partitionBy(*keys).orderBy("frame", "target").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("frame"), "target").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.last("box", True).over(back)).withColumn("b", F.last("box", True).over(ahead)).where("target = 1")
    outside = F.col("a").isNull() | F.col("b").isNull()
    at, a, b = F.col("frame"), F.col("a.frame"), F.col("b.frame")
    if method == "nearest":  # halfway goes to the earlier frame
        value = lambda c: F.when(at - a <= b - at, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    else:
        share = F.when(b > a, (at - a) / F.greatest(b - a, F.lit(1))).otherwise(F.lit(0.0))
        value = lambda c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share
    wrong = F.raise_error(F.lit("a target frame lies outside its track's boxes")).cast("double")
    return rows.select(*keys, "frame", *[F.when(outside, wrong).otherwise(value(c)).cast("int").alias(c) for c in "xywh"])


def interpolate_gaps(boxes: DataFrame, max_gap: int = 30, method: str = "linear", by: Sequence[str] = ("track",)) -> DataFrame:
    """Boxes of each track, cut toward zero, at the frames missing from its gaps of at most max_gap frames.

    The rows of interpolate_boxes over fill_frames; but each known row looks at the next and only then unfolds, so what is
    sorted are the known rows alone. boxes: *by, frame, x, y, w, h, frames distinct within a track. linear or nearest.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method is linear or nearest")
    keys = list(by)
    after = F.lead(F.struct("frame", *"xywh")).over(Window.partitionBy(*keys).orderBy("frame"))
    d = boxes.select(*keys, F.struct("frame", *"xywh").alias("a"), after.alias("b"))
    d = d.where((F.col("b.frame") - F.col("a.frame")).between(2, max_gap + 1))
    d = d.select(*keys, "a", "b", F.explode(F.sequence(F.col("a.frame") + 1, F.col("b.frame") - 1)).alias("frame"))
    at, a, b = F.col("frame"), F.col("a.frame"), F.col("b.frame")
    if method == "nearest":  # halfway goes to the earlier frame
        value = lambda c: F.when(at - a <= b - at, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    else:
        value = lambda c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * ((at - a) / (b - a))
    return d.select(*keys, "frame", *[value(c).cast("int").alias(c) for c in "xywh"])


def box_type(boxes: DataFrame) -> str:
    return "struct<" + ",".join(f"{c}:{boxes.schema[c].dataType.simpleString()}" for c in ["frame", *"xywh"]) + ">"
