"""Linking tracklets: descriptors, gated candidates, one-to-one assignment, chains."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .shared import components, whole_groups, written


def descriptors(df: DataFrame, *, vel_frames: int = 5, by: Sequence[str] = (), loose_equal: bool = False) -> DataFrame:
    """One row per track with at least two real rows (interp other than 1): first and last box, centre and frame,
    class of the last row (-1 without a class column) and velocity: the slope of the centre over the last
    vel_frames real rows, or the last difference where these share one frame. loose_equal also takes frames
    within 1e-8 + 1e-5 * first for equal.
    """
    keys = [*by, "track"]
    if "class" in df.columns and "cls" not in df.columns:
        df = df.withColumnRenamed("class", "cls")
    interp = F.coalesce(F.expr("try_cast(interp as double)"), F.lit(0.0)) if "interp" in df.columns else F.lit(0.0)
    cls = F.col("cls") if "cls" in df.columns else F.lit(-1)
    real = df.where(interp != 1).select(*keys, "frame", *[F.col(c).cast("double").alias(c) for c in "xywh"], cls.cast("int").alias("cls"))
    order = ["frame", *"xywh", "cls"]
    w = Window.partitionBy(*keys)
    back = w.orderBy(*[F.desc(c) for c in order])
    real = real.withColumn("back", F.row_number().over(back)).withColumn("real_rows", F.count(F.lit(1)).over(w))
    real = real.withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)
    late = F.col("back") <= vel_frames
    row = F.struct("frame", *"xywh", "cls", "cx", "cy")
    at = F.struct(*order)
    slope = lambda c: F.regr_slope(F.when(late, F.col(c)), F.when(late, F.col("frame").cast("double")))
    d = real.where("real_rows >= 2").groupBy(*keys).agg(
        F.min_by(row, at).alias("s"),
        F.max_by(row, at).alias("e"),
        F.max(F.when(F.col("back") == 2, F.struct("frame", "cx", "cy"))).alias("p"),
        F.min(F.when(late, F.col("frame"))).alias("t0"),
        slope("cx").alias("sx"),
        slope("cy").alias("sy"),
    )
    step = F.greatest(F.col("e.frame") - F.col("p.frame"), F.lit(1))
    same = F.col("e.frame") == F.col("t0")
    if loose_equal:
        same = F.col("e.frame") - F.col("t0") <= F.lit(1e-8) + F.lit(1e-5) * F.abs("t0")
    speed = lambda s, c: F.when(same | F.col(s).isNull(), (F.col(f"e.{c}") - F.col(f"p.{c}")) / step).otherwise(F.col(s))
    box = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("s", "start"), ("e", "end")) for c in ("x", "y", "w", "h", "cx", "cy")]
    area = F.greatest(F.col("e.w") * F.col("e.h"), F.lit(1.0))
    return d.select(*keys, F.col("e.cls").alias("cls"), F.col("s.frame").alias("t_start"), F.col("e.frame").alias("t_end"), *box, area.alias("area_end"), speed("sx", "cx").alias("vx"), speed("sy", "cy").alias("vy"))


def candidates(
    d: DataFrame, *, max_gap: int = 20, size_ratio_max: float = 2.0, dist_mult: float = 2.5, iou_min: float = 0.05, w_d: float = 1.0, w_iou: float = 1.0, w_s: float = 0.3, by: Sequence[str] = ()
) -> DataFrame:
    """Pairs (a_track ends, b_track starts) that pass all gates, with dt, dist, iou and cost.

    Class, a time bucket of max_gap frames and a cell of the plane are equi keys. An end looks into the two buckets its
    window can touch and into the cells that its path over max_gap frames, widened by the distance gate, can
    touch: cells are powers of two at least as wide as that, so these are four at most. A start takes the
    cell of its centre at each such width that occurs.
    """
    gap = max(1, int(max_gap))
    d = written(d, "link-descriptors")
    ends = d.select(*by, "cls", F.col("track").alias("a_track"), F.col("t_end"), "end_cx", "end_cy", "end_w", "end_h", "area_end", "vx", "vy")
    first, last = F.floor((F.col("t_end") + 1) / F.lit(gap)), F.floor((F.col("t_end") + gap) / F.lit(gap))
    reach = F.lit(float(dist_mult)) * F.sqrt("area_end") * (F.lit(1.0) + F.lit(0.03) * F.lit(max_gap)) + F.lit(1.0)
    low = lambda c, v: F.col(c) + F.least(F.col(v), F.col(v) * max_gap) - F.col("reach")
    high = lambda c, v: F.col(c) + F.greatest(F.col(v), F.col(v) * max_gap) + F.col("reach")
    ends = ends.withColumn("reach", reach).withColumn("wide", F.greatest(high("end_cx", "vx") - low("end_cx", "vx"), high("end_cy", "vy") - low("end_cy", "vy")))
    # A path without a finite width (or beyond what whole cells can hold) looks everywhere: one cell holds all.
    level = F.when((F.col("wide") > 0) & (F.col("wide") < 2.0**40), F.greatest(F.ceil(F.log2("wide")).cast("int"), F.lit(0)) + 1).otherwise(F.lit(1000))
    ends = ends.withColumn("level", level)
    levels = [r["level"] for r in ends.select("level").distinct().collect()]
    cell = lambda c: F.when(F.col("level") < 1000, F.floor(c / F.pow(F.lit(2.0), F.col("level")))).otherwise(F.lit(0))
    spans = {}
    for axis in "xy":
        at = [cell(side(f"end_c{axis}", f"v{axis}")) for side in (low, high)]
        spans[axis] = F.explode(F.array_distinct(F.array(*at)))
    ends = ends.withColumn("bucket", F.explode(F.array_distinct(F.array(first, last)))).withColumn("cell_x", spans["x"]).withColumn("cell_y", spans["y"]).drop("reach", "wide")
    starts = d.select(*by, "cls", F.col("track").alias("b_track"), F.col("t_start").alias("b_start"), *[F.col(f"start_{c}") for c in ("x", "y", "w", "h", "cx", "cy")])
    starts = starts.withColumn("bucket", F.floor(F.col("b_start") / F.lit(gap))).withColumn("level", F.explode(F.lit(levels).cast("array<int>") if levels else F.array(F.lit(0))))
    starts = starts.withColumn("cell_x", cell(F.col("start_cx"))).withColumn("cell_y", cell(F.col("start_cy")))
    p = ends.join(starts, [*by, "cls", "bucket", "level", "cell_x", "cell_y"]).withColumn("dt", F.col("b_start") - F.col("t_end"))
    p = p.where(F.col("dt").between(1, max_gap) & (F.col("a_track") != F.col("b_track")))
    size = lambda c: F.greatest(F.col(c), F.lit(1.0))
    p = p.withColumn("rw", size("start_w") / size("end_w")).withColumn("rh", size("start_h") / size("end_h"))
    least, most = 1.0 / size_ratio_max, float(size_ratio_max)
    p = p.where(F.col("rw").between(least, most) & F.col("rh").between(least, most))
    p = p.withColumn("px", F.col("end_cx") + F.col("vx") * F.col("dt")).withColumn("py", F.col("end_cy") + F.col("vy") * F.col("dt"))
    p = p.withColumn("dist", F.hypot(F.col("px") - F.col("start_cx"), F.col("py") - F.col("start_cy")))
    root = F.sqrt("area_end")
    p = p.where(F.col("dist") < F.lit(float(dist_mult)) * root * (F.lit(1.0) + F.lit(0.03) * F.col("dt")))
    a = [F.col("px") - size("end_w") / 2, F.col("py") - size("end_h") / 2, size("end_w"), size("end_h")]
    p = p.withColumn("iou", iou(a, [F.col(f"start_{c}") for c in "xywh"])).where(F.col("iou") >= iou_min)
    away = F.lit(float(w_d)) * F.col("dist") / (root + F.lit(1e-6))
    cost = away + F.lit(float(w_iou)) * (F.lit(1.0) - F.col("iou")) + F.lit(float(w_s)) * (F.abs(F.ln("rw")) + F.abs(F.ln("rh")))
    return p.select(*by, "a_track", "b_track", F.col("t_end").alias("a_end"), "b_start", "dt", "dist", "iou", cost.alias("cost"))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Exact assignment on a dense matrix (inf: not allowed): as many pairs as possible, then least total cost.

    Shortest augmenting paths with potentials; forbidden pairs carry a cost above any sum of allowed ones.
    """
    finite = np.isfinite(cost)
    if not finite.any():
        return []
    if (finite.sum(axis=0) <= 1).all() and (finite.sum(axis=1) <= 1).all():
        return list(zip(*(at.tolist() for at in np.nonzero(finite))))
    big = float(np.abs(cost[finite]).sum()) * 2 + 1
    c = np.where(finite, cost, big)
    turned = c.shape[0] > c.shape[1]
    c = c.T if turned else c
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[row_of[j0] - 1, free - 1] - u[row_of[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    pairs = [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    pairs = [(j, i) for i, j in pairs] if turned else pairs
    return [(i, j) for i, j in pairs if finite[i, j]]


def match(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-to-one links (a_track, b_track, cost) of candidates: most links, then least total cost.

    Edges of one connected group of candidates are solved together, groups apart. Groups are found by
    components of the edges, an end and a start being different nodes; a link whose end and start have no other is taken
    as it is. Tasks solve many groups, one after another.
    """
    keys = list(by)
    e = written(edges.select(*keys, "a_track", "b_track", "cost"), "link-edges")
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
    e = written(e.withColumn("na", alone("a_track")).withColumn("nb", alone("b_track")), "link-counted")
    rest = e.where("na > 1 or nb > 1").select(*keys, "a_track", "b_track", "cost")
    # A node is the hash-free text of its side, keys and track.
    node = lambda side, c: F.to_json(F.struct(F.lit(side).alias("s"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col(c).alias("t")), {"ignoreNullFields": "false"})
    named = written(rest.withColumn("a_node", node("a", "a_track")).withColumn("b_node", node("b", "b_track")), "link-nodes")
    roots = components(named.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "link-groups")
    grouped = named.join(roots, named["a_node"] == roots["node"]).select(*keys, "a_track", "b_track", "cost", F.col("root").alias("group"))
    kinds = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in [*keys, "a_track", "b_track"])

    def solve(batches):
        for table, starts in whole_groups(batches, ["group"]):
            a, b, cost = (table[c].to_numpy() for c in ("a_track", "b_track", "cost"))
            keep: list[int] = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own_i, i = np.unique(a[lo:hi], return_inverse=True)
                own_j, j = np.unique(b[lo:hi], return_inverse=True)
                grid = np.full((len(own_i), len(own_j)), np.inf)
                grid[i, j] = cost[lo:hi]
                found = set(assign(grid))
                keep += [lo + n for n, pair in enumerate(zip(i.tolist(), j.tolist())) if pair in found]
            yield from table.take(pa.array(keep, pa.int64())).drop_columns(["group"]).to_batches()

    solved = grouped.repartition("group").sortWithinPartitions("group", "a_track", "b_track").mapInArrow(solve, f"{kinds}, cost double")
    return e.where("na = 1 and nb = 1").select(*keys, "a_track", "b_track", F.col("cost").cast("double").alias("cost")).union(solved)


def chains(links: DataFrame, by: Sequence[str] = (), rounds: int = 40) -> DataFrame:
    """(track, head) for every linked track: pointer jumping over predecessors, doubling the distance each round.

    Each track has at most one predecessor, and starts get later, so the head is the earliest.
    """
    keys = list(by)
    p = written(links.select(*keys, F.col("b_track").alias("track"), F.col("a_track").alias("head")), "chains")
    for _ in range(rounds):
        up = p.select(*keys, F.col("track").alias("head"), F.col("head").alias("up"))
        nxt = p.join(up, [*keys, "head"], "left").select(*keys, "track", F.coalesce("up", "head").alias("head"), F.col("up").isNotNull().alias("moved"))
        nxt = written(nxt, "chains")
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        p = nxt.drop("moved")
    raise RuntimeError("a chain has more than 2^40 members")


def link_tracklets(df: DataFrame, *, vel_frames: int = 5, by: Sequence[str] = (), ordered: bool = False, loose_equal: bool = False, **gates) -> DataFrame:
    """Give linked tracklets the id of their chain's earliest member; other columns and rows stay (two rows may
    share track and frame then). interp is added as 0 where missing. gates: the arguments of candidates."""
    missing = [c for c in ("frame", "track", "x", "y", "w", "h") if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if "interp" not in df.columns:
        df = df.withColumn("interp", F.lit(0))
    if "class" in df.columns and "cls" not in df.columns:
        df = df.withColumnRenamed("class", "cls")
    d = descriptors(df, vel_frames=vel_frames, by=by, loose_equal=loose_equal)
    heads = chains(match(candidates(d, by=by, **gates), by), by)
    out = df.join(heads, [*by, "track"], "left").withColumn("track", F.coalesce("head", "track")).select(*df.columns)
    return out.orderBy(*by, "frame", "track") if ordered else out
