"""Registered queries of the trajectory engine and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as C
from ..operators import boxes, filters, linking, overlay, reclass, sequence, signals, smoothing, timesync, tracking
from ..operators.shared import shared_path
from ..sources import files
from . import fixtures as X
from .fixtures import with_tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Zones and lines with whole coordinates.
A = [(300, 200), (400, 200), (400, 260), (300, 260)]
B = [(500, 300), (900, 300), (900, 600), (500, 600)]
FAR = [(5000, 5000), (5010, 5000), (5010, 5010), (5000, 5010)]
TRIANGLE = [(0, 0), (800, 0), (0, 600)]
RING = [[(0, 0), (1000, 0), (1000, 700), (0, 700)], [(200, 100), (600, 100), (600, 500), (200, 500)]]
LINE_V, LINE_H, LINE_W = [(1000, 0), (1000, 5000)], [(0, 900), (6000, 900)], [(0, 1500), (6000, 1500)]
IN_A = "{x} > 300 and {x} < 400 and {y} > 200 and {y} < 260"
IN_B = "{x} > 500 and {x} < 900 and {y} > 300 and {y} < 600"
ZONES_SQL = f"(({IN_A}) or ({IN_B}))"
CC, BC = {"x": "(x + w / 2)", "y": "(y + h / 2)"}, {"x": "(x + w / 2)", "y": "(y + h)"}
TRACK_COLS = ["frame", "track", "event_id", "x", "y", "w", "h", "score", "cls"]
TCOLS = ", ".join(TRACK_COLS)
SMOOTH_COLS = ["frame", "track", "x", "y"]


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def add(name: str, f: Query, sql: str | None = None) -> None:
    query(name, sql)(f)


# Detections: normalisation and filters

add("det_normalize_trunc", lambda s, d: boxes.normalize_detections(X.raw_boxes(s, d), "trunc"),
    with_tables("select frame, -1 as res, cast(trunc(x1) as int) as x, cast(trunc(y1) as int) as y, cast(trunc(x2 - x1) as int) as w, cast(trunc(y2 - y1) as int) as h, round_even(conf, 2) as conf, class from raw", "raw"))
add("det_normalize_round", lambda s, d: boxes.normalize_detections(X.raw_boxes(s, d), "round"),
    with_tables("select frame, -1 as res, round_even(x1, 1) as x, round_even(y1, 1) as y, round_even(x2 - x1, 0) as w, round_even(y2 - y1, 0) as h, round_even(conf, 2) as conf, class from raw", "raw"))
add("det_filter_score_class", lambda s, d: filters.filter_detections(X.detections(s, d), classes=[1, 2, 3], min_score=0.5), with_tables("select * from det where conf >= 0.5 and class in (1, 2, 3)", "det"))
add("det_filter_zone", lambda s, d: filters.filter_detections(X.detections(s, d), zones=[A, B], min_score=0.3), with_tables(f"select * from det where conf >= 0.3 and {ZONES_SQL.format(**CC)}", "det"))
add("det_filter_multipolygon", lambda s, d: filters.filter_detections(X.detections(s, d), zones=[[[A], [B]]]), with_tables(f"select * from det where {ZONES_SQL.format(**CC)}", "det"))
add("det_filter_triangle", lambda s, d: filters.filter_detections(X.detections(s, d), zones=[TRIANGLE]), with_tables("select * from det where x + w / 2 > 0 and y + h / 2 > 0 and 600 * (x + w / 2) + 800 * (y + h / 2) < 480000", "det"))
add("det_filter_hole", lambda s, d: filters.filter_detections(X.detections(s, d), zones=[RING]),
    with_tables("""select * from det where x + w / 2 > 0 and x + w / 2 < 1000 and y + h / 2 > 0 and y + h / 2 < 700
        and not (x + w / 2 >= 200 and x + w / 2 <= 600 and y + h / 2 >= 100 and y + h / 2 <= 500)""", "det"))  # fmt: skip
add("det_top_per_frame", lambda s, d: boxes.top_detections(X.detections(s, d), 5, ties=("id", "x", "y", "w", "h")), with_tables("select * from det qualify row_number() over (partition by frame order by conf desc, id, x, y, w, h) <= 5", "det"))
KEPT = "greatest(least(r.x + r.w, b.x + b.w) - greatest(r.x, b.x), 0) * greatest(least(r.y + r.h, b.y + b.h) - greatest(r.y, b.y), 0)"
add("det_nms", lambda s, d: boxes.nms(X.detections(s, d), 0.3, ties=("x", "y", "w", "h", "id")),
    with_tables(f"""with p as (select *, row_number() over (partition by frame, class order by conf desc, x, y, w, h, id) as rank from det),
        rem as (select *, rank = 1 as best from p union all
            select * exclude (best), rank = min(rank) over (partition by frame, class) as best from (
                select r.* from rem r join rem b on r.frame = b.frame and r.class = b.class
                where b.best and not r.best and not {KEPT} / greatest(r.w * r.h + b.w * b.h - {KEPT}, 1e-6) > 0.3))
        select distinct frame, res, x, y, w, h, conf, class, id from rem where best""", "det"))  # fmt: skip


@query("filter_class_file", with_tables("select frame, res, x, y, w, h, conf, class from det where class in (1, 2) and conf >= 0.4", "det"))
def filter_class_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = shared_path(spark, "detections"), shared_path(spark, "filtered")
    files.write_table(X.detections(spark, sf_dir).drop("id"), source)
    filters.filter_class_file(spark, source, target, [1, 2], 0.4)
    return files.read_detections(spark, target)


# Whole tracks and frames by zones

IN = "(track in (select track from trk where {0}) or not exists (select 1 from trk where {0}))"
HAS = "track in (select track from trk where {0})"
add("tracks_include_zone", lambda s, d: filters.filter_tracks(X.tracks(s, d), include=[A]).select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk where {IN.format(IN_A.format(**CC))}", "trk"))
add("tracks_include_no_match", lambda s, d: filters.filter_tracks(X.tracks(s, d), include=[FAR]).select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk", "trk"))
add("tracks_exclude_zone", lambda s, d: filters.filter_tracks(X.tracks(s, d), exclude=[A]).select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk where not {HAS.format(IN_A.format(**CC))}", "trk"))
SMALL = [(700, 500), (760, 500), (760, 540), (700, 540)]
IN_SMALL = "{x} > 700 and {x} < 760 and {y} > 500 and {y} < 540"
add("tracks_include_exclude", lambda s, d: filters.filter_tracks(X.tracks(s, d), include=[A, B], exclude=[SMALL]).select(*TRACK_COLS),
    with_tables(f"select {TCOLS} from trk where {IN.format(ZONES_SQL.format(**CC))} and not {HAS.format(IN_SMALL.format(**CC))}", "trk"))
# No box has its left middle in A.
NEAR = [(200, 100), (300, 100), (300, 200), (200, 200)]
IN_NEAR = "{x} > 200 and {x} < 300 and {y} > 100 and {y} < 200"
for anchor, (ax, ay) in G.ANCHORS.items():
    at = {"x": f"(x + w * {ax})", "y": f"(y + h * {ay})"}
    zone, inside = (NEAR, IN_NEAR) if anchor == "cl" else (A, IN_A)
    add(f"tracks_zone_agg_{anchor}", lambda s, d, a=anchor, z=zone: filters.filter_tracks_by_zones_agg(X.tracks(s, d), [z], "include", a).select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk where {IN.format(inside.format(**at))}", "trk"))
moved = {"x": "(x + w / 2 + 25)", "y": "(y + h - 10)"}
add("tracks_zone_agg_offset", lambda s, d: filters.filter_tracks_by_zones_agg(X.tracks(s, d), [A, SMALL], "exclude", "bc", (25, -10)).select(*TRACK_COLS),
    with_tables(f"select {TCOLS} from trk where not {HAS.format(f'({IN_A.format(**moved)}) or ({IN_SMALL.format(**moved)})')}", "trk"))
add("frames_zone_include", lambda s, d: filters.filter_frames_by_zones_agg(X.tracks(s, d), [A, B]).select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk where {ZONES_SQL.format(**BC)} or not exists (select 1 from trk where {ZONES_SQL.format(**BC)})", "trk"))
add("frames_zone_exclude", lambda s, d: filters.filter_frames_by_zones_agg(X.tracks(s, d), [A, B], "exclude").select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk where not {ZONES_SQL.format(**BC)} or not exists (select 1 from trk where {ZONES_SQL.format(**BC)})", "trk"))
WIDE = [(200, 100), (800, 100), (800, 500), (200, 500)]
IN_WIDE = "{x} > 200 and {x} < 800 and {y} > 100 and {y} < 500"
add("frames_zone_repeat", lambda s, d: filters.filter_frames_by_zones_agg(X.tracks(s, d), [A, B, WIDE], repeat=True).select(*TRACK_COLS, "zone"),
    with_tables(" union all ".join(f"select {TCOLS}, {k} as zone from trk where {z.format(**BC)}" for k, z in enumerate((IN_A, IN_B, IN_WIDE))), "trk"))
ZONE_ROWS = "hit as (" + " union ".join(f"select track, {k} as zone from trk where {z.format(**BC)}" for k, z in enumerate((IN_A, "{x} > 5000", IN_SMALL))) + ")"
add("tracks_zone_list", lambda s, d: filters.filter_tracks_by_zones(X.tracks(s, d), [A, FAR, SMALL]).select(*TRACK_COLS, "zone"), with_tables(f"with {ZONE_ROWS} select {TCOLS}, zone from trk join hit using (track)", "trk"))
add("tracks_zone_label", lambda s, d: filters.filter_tracks_by_zones(X.tracks(s, d), [A, FAR, SMALL], "label").select(*TRACK_COLS, "zone"),
    with_tables(f"with {ZONE_ROWS}, last as (select track, max(zone) as zone from hit group by track) select {TCOLS}, coalesce(zone, -1) as zone from trk left join last using (track)", "trk"))
add("tracks_zone_label_matched", lambda s, d: filters.filter_tracks_by_zones(X.tracks(s, d), [A, FAR, SMALL], "label", label="matched").select(*TRACK_COLS, "zone"),
    with_tables(f"""with {ZONE_ROWS}, used as (select zone, cast(row_number() over (order by zone) - 1 as int) as rank from (select distinct zone from hit)),
        last as (select track, max(rank) as zone from hit join used using (zone) group by track) select {TCOLS}, coalesce(zone, -1) as zone from trk left join last using (track)""", "trk"))  # fmt: skip
add("tracks_zone_filter", lambda s, d: filters.filter_tracks_by_zones(X.tracks(s, d), [A, FAR, SMALL], "filter").select(*TRACK_COLS, "zone"),
    with_tables(f"with {ZONE_ROWS}, last as (select track, max(zone) as zone from hit group by track) select {TCOLS}, zone from trk join last using (track)", "trk"))

# Lines

HIT = {"v": "x <= 1000 and x + w >= 1000 and y <= 5000 and y + h >= 0", "h": "y <= 900 and y + h >= 900 and x <= 6000 and x + w >= 0", "w": "y <= 1500 and y + h >= 1500 and x <= 6000 and x + w >= 0"}
LINES_SQL = "hit as (select track, " + ", ".join(f"bool_or({c}) as {k}" for k, c in HIT.items()) + " from smo group by track)"
SCOLS = ", ".join(SMOOTH_COLS)


def _lines(where: str, negate: bool = False) -> str:
    return with_tables(f"with {LINES_SQL} select {SCOLS} from smo where track {'not ' * negate}in (select track from hit where {where})", "smo")


L = [LINE_V, LINE_H, LINE_W]
add("tracks_lines_include", lambda s, d: filters.filter_tracks_by_lines(X.smooth_tracks(s, d), L).select(*SMOOTH_COLS), _lines("v and h and w"))
add("tracks_lines_exclude", lambda s, d: filters.filter_tracks_by_lines(X.smooth_tracks(s, d), L, "exclude").select(*SMOOTH_COLS), _lines("v and h and w", True))
add("tracks_lines_v2_tolerance", lambda s, d: filters.filter_tracks_by_lines_v2(X.smooth_tracks(s, d), L, tolerance=1).select(*SMOOTH_COLS), _lines("v::int + h::int + w::int >= 2"))
add("tracks_lines_v2_force", lambda s, d: filters.filter_tracks_by_lines_v2(X.smooth_tracks(s, d), L, tolerance=2, forced=[0, 2]).select(*SMOOTH_COLS), _lines("v::int + h::int + w::int >= 1 and v and w"))
add("tracks_lines_v2_bbox", lambda s, d: filters.filter_tracks_by_lines_v2(X.smooth_tracks(s, d), [LINE_V, LINE_H], box_size=5).select(*SMOOTH_COLS),
    with_tables(f"""with hit as (select track, bool_or(x + w / 2 - 5 <= 1000 and x + w / 2 + 5 >= 1000 and y + h >= 0 and y + h - 5 <= 5000) as v,
        bool_or(y + h - 5 <= 900 and y + h >= 900 and x + w / 2 + 5 >= 0 and x + w / 2 - 5 <= 6000) as h from smo group by track)
        select {SCOLS} from smo where track in (select track from hit where v and h)""", "smo"))  # fmt: skip
add("tracks_lines_slanted", lambda s, d: filters.filter_tracks_by_lines(X.smooth_tracks(s, d), [[(0, 3000), (3000, 0)]]).select(*SMOOTH_COLS),
    with_tables(f"""with hit as (select distinct track from smo where x <= 3000 and x + w >= 0 and y <= 3000 and y + h >= 0 and x + y <= 3000 and x + w + y + h >= 3000)
        select {SCOLS} from smo where track in (select track from hit)""", "smo"))  # fmt: skip

# Boxes

PAIRS = "p as (select a.frame, a.id as a_id, b.id as b_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y by_, b.w bw, b.h bh from det a join det b on a.frame = b.frame where a.class = 1 and b.class = 2)"
INTER = "greatest(least(ax + aw, bx + bw) - greatest(ax, bx){0}, 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_){0}, 0)"


def _two(s, d):
    x = X.detections(s, d)
    return x.where("class = 1"), x.where("class = 2")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    # Most pairs of boxes share nothing, and bround goes by way of decimal numbers.
    return df.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.bround(c, 6)) for c in cols})


add("box_iou_pairs", lambda s, d: _rounded(boxes.box_iou(*_two(s, d)), "iou"), with_tables(f"with {PAIRS}, q as (select *, {INTER.format('')} as i from p) select frame, a_id, b_id, round_even(i / greatest(aw * ah + bw * bh - i, 1e-6), 6) as iou from q", "det"))
add("box_iou_inclusive", lambda s, d: _rounded(boxes.box_iou(*_two(s, d), inclusive=True), "iou"),
    with_tables(f"with {PAIRS}, q as (select *, {INTER.format(' + 1')} as i from p) select frame, a_id, b_id, round_even(i / ((aw + 1) * (ah + 1) + (bw + 1) * (bh + 1) - i), 6) as iou from q", "det"))
add("box_iob_pairs", lambda s, d: _rounded(boxes.box_iob(*_two(s, d)), "iob_a", "iob_b"),
    with_tables(f"with {PAIRS}, q as (select *, {INTER.format('')} as i from p) select frame, a_id, b_id, round_even(i / (aw * ah), 6) as iob_a, round_even(i / (bw * bh), 6) as iob_b from q", "det"))
add("box_reference_points", lambda s, d: X.detections(s, d).select("id", *[c.alias(n) for n, c in zip(("px", "py"), G.ref_point("cr", (1.5, -2)))], G.area().alias("area")),
    with_tables("select id, x + w + 1.5::double as px, y + h / 2 - 2 as py, w * h as area from det", "det"))

# Sequences

add("cluster_by_gap", lambda s, d: sequence.cluster_by_gap(X.tracks(s, d).select("track", "frame", "event_id"), "frame", 3, ["track"]),
    with_tables("""with b as (select track, frame, event_id, case when frame - lag(frame) over (partition by track order by frame) > 3 then 1 else 0 end as n from trk)
        select track, frame, event_id, cast(sum(n) over (partition by track order by frame) as int) as cluster from b""", "trk"))  # fmt: skip
GAPS = "g as (select track, frame, lead(frame) over (partition by track order by frame) as next_frame from (select distinct track, frame from trk))"
add("track_gaps", lambda s, d: sequence.track_gaps(X.tracks(s, d)), with_tables(f"with {GAPS} select track, frame, next_frame, next_frame - frame - 1 as gap from g where next_frame - frame > 1", "trk"))
add("track_fill_frames", lambda s, d: sequence.fill_frames(X.tracks(s, d), 30),
    with_tables(f"with {GAPS} select track, cast(unnest(range(frame + 1, next_frame)) as int) as frame from g where next_frame - frame between 2 and 31", "trk"))
add("track_fill_attributes", lambda s, d: _rounded(sequence.fill_attributes(X.tracks(s, d).withColumn("cls", F.expr("cast(event_id % 4 as int)"))), "score"),
    with_tables("""with n as (select track, cast(event_id % 4 as int) as cls, count(*) as n from trk group by all),
        m as (select track, cls from n qualify row_number() over (partition by track order by n desc, cls) = 1)
        select track, cls, round_even(score, 6) as score from m join (select track, avg(score) as score from trk group by track) using (track)""", "trk"))  # fmt: skip
add("sliding_sum", lambda s, d: sequence.sliding_sum(X.signals(s, d), "detection", 20, ["signal"]),
    with_tables("""select frame, signal, detection, cast(n as bigint) as count from (select *, sum(detection) over (partition by signal order by frame rows between current row and 19 following) as n,
        count(*) over (partition by signal) - row_number() over (partition by signal order by frame) as rest from sig) where rest >= 20""", "sig"))  # fmt: skip
add("first_per_frame", lambda s, d: sequence.first_per_frame(X.tracks(s, d), ties=["event_id"]).select(*TRACK_COLS), with_tables(f"select {TCOLS} from trk qualify row_number() over (partition by track, frame order by event_id) = 1", "trk"))
add("tails", lambda s, d: sequence.tails(X.smooth_tracks(s, d).select("frame", "track", "x", "y", "w", "h"), 7),
    with_tables("""select a.frame, a.track, a.x, a.y, a.w, a.h, b.frame as tail_frame, cast(trunc(b.x) + trunc(b.w / 2) as int) as tail_x, cast(trunc(b.y) + trunc(b.h / 2) as int) as tail_y
        from smo a join smo b on a.track = b.track and b.frame between a.frame - 7 and a.frame - 1""", "smo"))  # fmt: skip

# Box interpolation over the gaps of the tracks

ENDS = """f as (select * from trk qualify row_number() over (partition by track, frame order by event_id) = 1),
    g as (select track, frame as f0, lead(frame) over w as f1, x as x0, lead(x) over w as x1, y as y0, lead(y) over w as y1, w as w0, lead(w) over w as w1, h as h0, lead(h) over w as h1
          from f window w as (partition by track order by frame)),
    t as (select *, cast(unnest(range(f0 + 1, f1)) as int) as frame from g where f1 - f0 between 2 and 31)"""


def _interp(method: str) -> Query:
    def run(s, d):
        known = sequence.first_per_frame(X.tracks(s, d), ties=["event_id"]).select("track", "frame", "x", "y", "w", "h")
        if method != "cubic":
            return boxes.interpolate_gaps(known, 30, method)
        return boxes.interpolate_boxes(known, sequence.fill_frames(X.tracks(s, d), 30), method)

    return run


add("bbox_interp_linear", _interp("linear"), with_tables(f"with {ENDS} select track, frame, " + ", ".join(f"cast(trunc({c}0 + ({c}1 - {c}0) * ((frame - f0)::double / (f1 - f0))) as int) as {c}" for c in "xywh") + " from t", "trk"))
add("bbox_interp_nearest", _interp("nearest"), with_tables(f"with {ENDS} select track, frame, " + ", ".join(f"cast(trunc(case when frame - f0 <= f1 - frame then {c}0 else {c}1 end) as int) as {c}" for c in "xywh") + " from t", "trk"))
add("bbox_interp_cubic", _interp("cubic"))

# Smoothing and linking

STEP = """{0}a + 2 * {0}b + {0}c + 10.0::double / 4 as {0}pa, {0}b + {0}c + 10.0::double / 2 as {0}pb, {0}c + 10.0::double as {0}pc"""
GAIN = """case when o.frame is null then 0 else {0}pa / ({0}pa + {1}::double) end as {0}g, case when o.frame is null then 0 else {0}pb / ({0}pa + {1}::double) end as {0}h"""
AXES = (("x", "p"), ("y", "p"), ("w", "s"), ("h", "s"))


def _rts_sql(name: str, existing: bool) -> str:
    """The filter frame by frame and the way back as recursive queries: m_ is a middle or size, v_ its velocity, p and s the
    variances (a, b, c) of positions and sizes."""
    first = "".join(f", o_{x} as m_{x}, 0.0::double as v_{x}" for x in "xywh") + "".join(f", 100.0::double as {k}a, 0.0::double as {k}b, 100.0::double as {k}c" for k in "ps")
    moved = ", ".join(f"m_{x} + v_{x} as m_{x}, v_{x}" for x in "xywh") + ", " + ", ".join(STEP.format(k) for k in "ps")
    update = ", ".join(f"m_{x} + {k}g * coalesce(o_{x} - m_{x}, 0) as m_{x}, v_{x} + {k}h * coalesce(o_{x} - m_{x}, 0) as v_{x}" for x, k in AXES)
    update += ", " + ", ".join(f"(1 - {k}g) * {k}pa as {k}a, (1 - {k}g) * {k}pb as {k}b, {k}pc - {k}h * {k}pb as {k}c" for k in "ps")
    stay = ", ".join(["track", "frame", "f1", *[f"{c}_{x}" for x in "xywh" for c in "mv"], *[f"{k}{c}" for k in "ps" for c in "abc"]])
    step = lambda source: f"""select u.track, u.frame, u.f1, {update} from (select u.*, o.frame as of, o_x, o_y, o_w, o_h, {GAIN.format("p", 25)}, {GAIN.format("s", 16)}
        from (select track, frame, f1, {moved} from {source}) u left join obs o on o.track = u.track and o.frame = u.frame) u"""  # noqa: E731
    back = ", ".join(
        f"f.m_{x} + g{k}11 * (b.m_{x} - (f.m_{x} + f.v_{x})) + g{k}12 * (b.v_{x} - f.v_{x}) as m_{x}, f.v_{x} + g{k}21 * (b.m_{x} - (f.m_{x} + f.v_{x})) + g{k}22 * (b.v_{x} - f.v_{x}) as v_{x}" for x, k in AXES
    )
    gains = ", ".join(
        f"(({k}a + {k}b) * {k}pc - {k}b * {k}pb) / ({k}pa * {k}pc - {k}pb * {k}pb) as g{k}11, ({k}b * {k}pa - ({k}a + {k}b) * {k}pb) / ({k}pa * {k}pc - {k}pb * {k}pb) as g{k}12, "
        f"(({k}b + {k}c) * {k}pc - {k}c * {k}pb) / ({k}pa * {k}pc - {k}pb * {k}pb) as g{k}21, ({k}c * {k}pa - ({k}b + {k}c) * {k}pb) / ({k}pa * {k}pc - {k}pb * {k}pb) as g{k}22" for k in "ps"
    )
    ties = "event_id, x" if name == "trk" else "x"
    smooth = "m_x - greatest(m_w, 1) / 2 as x, m_y - greatest(m_h, 1) / 2 as y, greatest(m_w, 1) as w, greatest(m_h, 1) as h"
    own = f"select o.frame, o.track, {smooth}, score, cls, 0 as interp, r4 from obs o join bwd using (track, frame)" if existing else "select frame, track, x, y, w, h, score, cls, 0 as interp, r4 from obs"
    return with_tables(f"""with obs as materialized (select *, x + w / 2 as o_x, y + h / 2 as o_y, w as o_w, h as o_h, lead(frame) over (partition by track order by frame) as nxt
            from (select * from {name} qualify row_number() over (partition by track, frame order by {ties}) = 1)),
        ends as materialized (select track, min(frame) as f0, max(frame) as f1, count(*) as n, avg(score) as mean from obs group by track),
        modes as (select track, cls as often from (select track, cls, count(*) as n from obs group by all) qualify row_number() over (partition by track order by n desc, cls) = 1),
        start as (select o.track, o.frame - 0 as frame, f1{first} from obs o join ends e on o.track = e.track and o.frame = f0 where n >= 2),
        fwd as ({step("start")} union all {step("(select track, frame + 1 as frame, " + stay.split(", ", 2)[2] + " from fwd where frame < f1)")}),
        flt as materialized (select *, {", ".join(STEP.format(k) for k in "ps")} from fwd), gain as materialized (select *, {gains} from flt),
        bwd as (select track, frame, {", ".join(f"{c}_{x}" for x in "xywh" for c in "mv")} from fwd where frame = f1 union all
            select f.track, f.frame, {back} from bwd b join gain f on f.track = b.track and f.frame = b.frame - 1),
        gaps as (select track, cast(unnest(range(frame + 1, nxt)) as int) as frame from obs where nxt - frame between 2 and 31),
        rows_ as ({own} union all select g.frame, g.track, {smooth}, mean as score, often as cls, 1 as interp, -1 as r4 from gaps g join bwd using (track, frame) join ends using (track) join modes using (track))
        select frame, track, cast(round_even(x, 0) as int) as x, cast(round_even(y, 0) as int) as y, cast(round_even(w, 0) as int) as w, cast(round_even(h, 0) as int) as h, round_even(score, 6) as score, cls, interp, r4 from rows_""", name)  # fmt: skip


add("rts_interpolate", lambda s, d: _rounded(smoothing.interpolate_tracks(X.tracks(s, d), ties=["event_id"]), "score"), _rts_sql("trk", False))
add("rts_smooth_existing", lambda s, d: _rounded(smoothing.interpolate_tracks(X.smooth_tracks(s, d), smooth_existing=True), "score"), _rts_sql("smo", True))
DESC = """r as (select *, x + w / 2 as cx, y + h / 2 as cy, row_number() over (partition by track order by frame desc) as back, count(*) over (partition by track) as n from lnk where interp <> 1),
    k as (select track, min(cls) as cls, min(frame) as t_start, max(frame) as t_end, arg_min(cx, frame) as start_cx, arg_min(cy, frame) as start_cy, arg_max(cx, frame) as end_cx, arg_max(cy, frame) as end_cy,
          arg_max(w, frame) * arg_max(h, frame) as area_end, regr_slope(cx, frame) filter (where back <= 5) as vx, regr_slope(cy, frame) filter (where back <= 5) as vy from r where n >= 2 group by track)"""
DCOLS = ["track", "cls", "t_start", "t_end", "start_cx", "start_cy", "end_cx", "end_cy", "area_end", "vx", "vy"]
add("link_descriptors", lambda s, d: _rounded(linking.descriptors(X.tracklets(s, d)).select(*DCOLS), "vx", "vy"), with_tables(f"with {DESC} select {', '.join(DCOLS[:-2])}, round_even(vx, 6) as vx, round_even(vy, 6) as vy from k", "lnk"))
COST = """, c as (select a.track as a_track, b.track as b_track, a.t_end as a_end, b.t_start as b_start, b.t_start - a.t_end as dt, a.area_end,
        sqrt((a.end_cx + a.vx * (b.t_start - a.t_end) - b.start_cx) ** 2 + (a.end_cy + a.vy * (b.t_start - a.t_end) - b.start_cy) ** 2) as dist,
        greatest(50 - abs(a.end_cx + a.vx * (b.t_start - a.t_end) - b.start_cx), 0) * greatest(100 - abs(a.end_cy + a.vy * (b.t_start - a.t_end) - b.start_cy), 0) as i
        from k a join k b on a.cls = b.cls and b.t_start - a.t_end between 1 and 20),
    e as (select *, i / (10000 - i) as iou from c where dist < 2.5 * sqrt(area_end) * (1 + 0.03 * dt) and i / (10000 - i) >= 0.05)"""
add("link_candidates", lambda s, d: _rounded(linking.candidates(linking.descriptors(X.tracklets(s, d))), "dist", "iou", "cost"),
    with_tables(f"with {DESC}{COST} select a_track, b_track, a_end, b_start, dt, round_even(dist, 6) as dist, round_even(iou, 6) as iou, round_even(dist / (sqrt(area_end) + 1e-6) + 1 - iou, 6) as cost from e", "lnk"))
add("link_tracklets", lambda s, d: linking.link_tracklets(X.tracklets(s, d)).select("frame", "track", "x", "y", "cls", "interp"),
    with_tables(f"""with {DESC}, u as (select *, track // 1000 as usr from k),
        s as (select *, case when t_start - lag(t_end) over (partition by usr order by t_start) between 1 and 20 then 0 else 1 end as brk from u),
        c as (select *, sum(brk) over (partition by usr order by t_start) as chain from s),
        heads as (select track, first_value(track) over (partition by usr, chain order by t_start) as head from c)
        select frame, coalesce(head, track) as track, x, y, cls, interp from lnk left join heads using (track)""", "lnk"))  # fmt: skip
# A user's tracklets lie on one way far from all others, so the most links at least cost join each to the next.
add("link_assignment", lambda s, d: _rounded(linking.match(linking.candidates(linking.descriptors(X.tracklets(s, d)))), "cost"),
    with_tables(f"""with {DESC}{COST} select a_track, b_track, round_even(dist / (sqrt(area_end) + 1e-6) + 1 - iou, 6) as cost from e
        qualify row_number() over (partition by a_track order by dt) = 1 and row_number() over (partition by b_track order by dt) = 1""", "lnk"))  # fmt: skip

# Signals

ROWS = """n as (select *, count(*) over (partition by signal) as rows_, row_number() over (partition by signal order by frame) as rn,
          sum(detection) over (partition by signal order by frame rows between current row and 39 following) as cnt, lead(frame, 40) over (partition by signal order by frame) as stop from sig),
    q as (select *, rn - row_number() over (partition by signal order by rn) as run from n where rn <= rows_ - 40 and cnt >= 24),
    o as (select *, row_number() over (partition by signal, run order by rn) as place from q),
    b as (select * from o qualify row_number() over (partition by signal, run order by case when place > 1 and cnt > 0 then cnt else -1 end desc, rn) = 1),
    iv as (select signal, 1 as status, frame as beg_frame, stop as end_frame from b union all select signal, 2, stop + 1, stop + 20 from b)"""


def _intervals(dets):
    return signals.pedestrian_intervals(dets, 20, 10, 2, 0.6)


def _labels(s, d):
    dets = X.signals(s, d)
    return signals.signal_labels(s, _intervals(dets), ZONE_BOXES, dets.agg(F.max("frame")).first()[0] + 1)


add("signal_walk_intervals", lambda s, d: _intervals(X.signals(s, d)), with_tables(f"with {ROWS} select signal, status, beg_frame, end_frame from iv", "sig"))
ZONE_BOXES = [(100, 50, 21, 30), (400, 80, 40, 25)]
add("signal_labels", lambda s, d: _labels(s, d).selectExpr("frame", "type", "coords[0][0] cx", "coords[0][1] cy", "color[0] c0", "color[1] c1", "color[2] c2", "size", "thick", "desc"),
    with_tables(f"""with {ROWS}, g as (select cast(f.range as int) as frame, z.* from range((select max(frame) + 1 from sig)) f, (values (0, 110.0::double, 65.0::double, 45.0::double), (1, 420.0::double, 92.0::double, 60.0::double)) z(signal, cx, cy, r)),
        m as (select g.*, (select status from iv where iv.signal = g.signal and g.frame between beg_frame and end_frame order by beg_frame, status limit 1) as st from g)
        select frame, 'circle' as type, cx, cy, 0 as c0, case when coalesce(st, 0) = 0 then 0 else 255 end as c1, case when coalesce(st, 0) = 1 then 0 else 255 end as c2, r as size, 1 as thick, '' as desc from m""", "sig"))  # fmt: skip
add("signal_threshold", lambda s, d: signals.threshold_signals(X.table(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("frame")).agg(F.array(F.max("l_discount") * 10, F.min("l_tax") * 10).alias("probabilities")), 0.6),
    "select frame, signal, cast(p > 0.6 as int) as detection from (select cast(l_orderkey as int) as frame, 0 as signal, max(l_discount) * 10 as p from lineitem group by 1 union all select cast(l_orderkey as int), 1, min(l_tax) * 10 from lineitem group by 1)")

# Re-classification

TOP = "top as (select *, hash(frame, x, y, w, h) as r from (select frame, track, x, y, w, h from trk) qualify row_number() over (partition by track order by w * h desc, frame, x, y, w, h) <= 25)"
DETS = "d as (select frame, class, x as dx, y as dy, w as dw, h as dh from det where class in (1, 3))"
BEST = """m as (select track, class, frame, x, y, w, h, max(greatest(least(x + w, dx + dw) - greatest(x, dx), 0) * greatest(least(y + h, dy + dh) - greatest(y, dy), 0) / (dw * dh)) as best
    from top join d using (frame) group by all), a as (select track, class, coalesce(avg(best) filter (where best >= 0.5), 0) as avg_score from m group by all)"""
add("reclass_top_frames", lambda s, d: reclass.top_frames(X.tracks(s, d)).select("frame", "track", "x", "y", "w", "h"), with_tables(f"with {TOP} select frame, track, x, y, w, h from top", "trk"))
add("reclass_match", lambda s, d: _rounded(reclass.match_detections(X.tracks(s, d), X.detections(s, d), 0.5, (1, 3)), "avg_score"),
    with_tables(f"with {TOP}, {DETS}, {BEST} select track, class, round_even(avg_score, 6) as avg_score, avg_score >= 0.5 as hit from a", "trk", "det"))
add("reclass_result", lambda s, d: reclass.re_classify(X.tracks(s, d), X.detections(s, d), 25, 0.5, 0, (1, 3)),
    with_tables(f"""with {TOP}, {DETS}, {BEST}, b as (select * from a where avg_score >= 0.5 qualify row_number() over (partition by track order by avg_score desc, class) = 1)
        select track, coalesce(class, 0) as cls, round_even(coalesce(avg_score, 0), 2) as avg_score from (select distinct track from trk) left join b using (track)""", "trk", "det"))  # fmt: skip

# Time

MS = "cast(round_even(1700000000123 + shift + (frame - ref) * 1000.0::double / fps, 0) as bigint)"
GRID = "g as (select video_id as video, fps, shift, case when position = 0 then 10 else 0 end as ref, cast(unnest(range(n_frames)) as bigint) as frame from vid)"
add("sync_unix_time", lambda s, d: timesync.synchronize(X.videos(s), 10, 1700000000123), with_tables(f"with {GRID} select frame, {MS.replace(' + shift', '')} as unix_time, video from g", "vid"))
add("sync_offsets", lambda s, d: timesync.synchronize(X.videos(s), 10, 1700000000123, apply_offsets=True), with_tables(f"with {GRID} select frame, {MS} as unix_time, video from g", "vid"))
add("sync_local_utc", lambda s, d: timesync.synchronize(X.videos(s), 10, 1700000000123, "UTC", True),
    with_tables(f"with {GRID} select frame, {MS.replace(' + shift', '')} as unix_time, video, strftime(make_timestamp({MS.replace(' + shift', '')} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' as local_time from g", "vid"))
# In November US/Eastern is five hours behind.
add("sync_local_time", lambda s, d: timesync.synchronize(X.videos(s), 10, 1700000000123, "US/Eastern", True),
    with_tables(f"with {GRID} select frame, {MS.replace(' + shift', '')} as unix_time, video, strftime(make_timestamp(({MS.replace(' + shift', '')} - 18000000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '-05:00' as local_time from g", "vid"))
add("seconds_to_frame", lambda s, d: X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.seconds_to_frame(F.col("l_quantity") * 1.5, F.lit(29.97)).alias("frame")),
    "select l_orderkey, l_linenumber, cast(trunc(29 * (l_quantity * 1.5::double)) as int) as frame from lineitem")
add("clip_by_time", lambda s, d: X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in zip(("start_frame", "n"), C.clip_by_seconds(F.col("l_quantity") - 5, F.col("l_tax") * 10 + 0.01, F.lit(29.97)))]),
    "select l_orderkey, l_linenumber, cast(trunc(greatest(l_quantity - 5, 0) * 29.97::double) as int) as start_frame, cast(greatest(round_even((l_tax * 10 + 0.01::double) * 29.97::double, 0), 1) as int) as n from lineitem")
add("clip_ranges", lambda s, d: X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in zip(("a", "b"), C.clamp_range(F.col("l_partkey") % 900 - 50, F.col("l_suppkey") % 900 - 20, F.lit(720)))]),
    "select l_orderkey, l_linenumber, cast(least(greatest(l_partkey % 900 - 50, 0), 719) as int) as a, cast(greatest(least(greatest(l_partkey % 900 - 50, 0), 719), least(greatest(l_suppkey % 900 - 20, 0), 719)) as int) as b from lineitem")
add("first_parsable_timestamp", lambda s, d: C.first_parsable_timestamp(X.table(s, d, "events").select(F.col("event_id").alias("frame"), F.when(F.col("event_id") % 7 == 6, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("??").alias("text"))).select("frame", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp")),
    "select event_id as frame, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp from events where event_id % 7 = 6 order by event_id limit 1")

# Overlays

FLAT = ["frame", "type", "coords[0][0] x0", "coords[0][1] y0", "get(coords, 1)[0] x1", "get(coords, 1)[1] y1", "color[0] c0", "color[1] c1", "color[2] c2", "size", "thick", "desc", "fill", "alpha"]
PAL = "(values " + ", ".join(f"({k}, {b}, {g}, {r})" for k, (b, g, r) in enumerate(C.PALETTE)) + ") pal(k, c0, c1, c2)"
BOX_SQL = "select {0}.frame, 'bbox' as type, x as x0, y as y0, x + w as x1, y + h as y1, c0, c1, c2, 1.0::double as size, 2 as thick, {1} as desc, false as fill, 0.0::double as alpha from {0} join " + PAL + " on {2} % 12 = k"
NAMES = "(values (0, 'car'), (1, 'bus'))"


def _names(s):
    return s.createDataFrame([(0, "car"), (1, "bus")], "id int, name string")


add("draw_tracks", lambda s, d: overlay.draw_tracks(X.smooth_tracks(s, d), _names(s), label_class=True, start_frame=50, end_frame=300).selectExpr(*FLAT),
    with_tables(f"with s as (select smo.*, n.name from smo left join {NAMES} n(id, name) on cls = n.id where frame between 50 and 300) select distinct * from ({BOX_SQL.format('s', chr(39) * 2 + ' || track || ' + chr(39) + ' ' + chr(39) + ' || coalesce(name, ' + chr(39) * 2 + ')', 'track')})", "smo"))
add("draw_tracks_tail", lambda s, d: overlay.draw_tracks(X.smooth_tracks(s, d), tail_length=4).selectExpr(*FLAT),
    with_tables(f"""select distinct * from ({BOX_SQL.format('smo', "track || ' '", 'track')}) union all
        select distinct a.frame, 'circle', trunc(b.x) + trunc(b.w / 2), trunc(b.y) + trunc(b.h / 2), null, null, c0, c1, c2, 1.0::double, -1, '', false, 0.0::double
        from smo a join smo b on a.track = b.track and b.frame between a.frame - 4 and a.frame - 1 join {PAL} on a.track % 12 = k""", "smo"))  # fmt: skip
add("draw_dets", lambda s, d: overlay.draw_detections(X.detections(s, d), label_score=False).selectExpr(*FLAT), with_tables(f"select distinct * from ({BOX_SQL.format('det', 'class::varchar', 'class')})", "det"))
add("draw_dets_score", lambda s, d: overlay.draw_detections(X.detections(s, d), _names(s), color=(1, 2, 3)).selectExpr(*FLAT),
    with_tables(f"""select distinct frame, 'bbox' as type, x as x0, y as y0, x + w as x1, y + h as y1, 1 as c0, 2 as c1, 3 as c2, 1.0::double as size, 2 as thick,
        coalesce(n.name, '') || ' ' || printf('%.1f', round_even(conf, 1)) as desc, false as fill, 0.0::double as alpha from det left join {NAMES} n(id, name) on class = n.id""", "det"))  # fmt: skip
SHAPES = ["LINESTRING (0 0, 10 5)", {"type": "circle", "geometry": [7, 8], "color": (9, 8, 7), "size": 3}]
add("draw_shapes", lambda s, d: overlay.draw_shapes(s, SHAPES, overlay.draw_tracks(X.smooth_tracks(s, d), color=(1, 2, 3))).where("type <> 'bbox'").selectExpr(*FLAT),
    with_tables("""select frame, 'polylines' as type, 0.0::double as x0, 0.0::double as y0, 10.0::double as x1, 5.0::double as y1, 0 as c0, 255 as c1, 255 as c2, 4.0::double as size, 2 as thick, '' as desc, false as fill, 0.0::double as alpha
        from (select distinct frame from smo) union all select frame, 'circle', 7, 8, null, null, 9, 8, 7, 3, 2, '', false, 0 from (select distinct frame from smo)""", "smo"))  # fmt: skip
add("track_clips", lambda s, d: overlay.track_clips(X.tracks(s, d), overlay.select_tracks(X.tracks(s, d), "specify", ids=[1, 2, 3, 5, 8]), 720, 15, 20, "cam1"),
    with_tables("select track, greatest(min(frame) - 15, 0) as start_frame, least(max(frame) + 20, 719) as end_frame, 'cam1_' || track || '.mp4' as file from trk where track in (1, 2, 3, 5, 8) group by track", "trk"))
add("track_sample", lambda s, d: overlay.select_tracks(X.tracks(s, d), "random", 5))
add("track_frame_files", lambda s, d: overlay.frame_files(X.tracks(s, d), "cam1", True), with_tables("select distinct track, frame, 'cam1-' || track || '_' || frame || '.jpg' as file from trk", "trk"))
add("palette", lambda s, d: X.tracks(s, d).select("track").distinct().select("track", *[C.color_of(F.col("track"))[k].alias(f"c{k}") for k in range(3)]), with_tables(f"select distinct track, c0, c1, c2 from trk join {PAL} on track % 12 = k", "trk"))

# Files and manifests


@query("io_detections", with_tables("select frame, res, x, y, w, h, conf, class from det", "det"))
def io_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "detections")
    files.write_table(X.detections(spark, sf_dir).drop("id"), path)
    return files.read_detections(spark, path)


@query("io_tracks", with_tables("select frame, track, x, y, w, h, score, cls, r3, r4 from trk", "trk"))
def io_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tracks")
    files.write_table(X.tracks(spark, sf_dir).drop("event_id"), path)
    return files.read_tracks(spark, path)


@query("io_draw", with_tables(f"select distinct * from ({BOX_SQL.format('smo', chr(39) * 2 + ' || track || ' + chr(39) + ' ' + chr(39), 'track')})", "smo"))
def io_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "draw")
    files.write_draw(overlay.draw_tracks(X.smooth_tracks(spark, sf_dir)), path)
    return files.read_draw(spark, path).selectExpr(*FLAT)


@query("io_segmentation", with_tables("select frame, count(*) as n, round_even(sum(conf), 6) as total from det group by frame", "det"))
def io_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "masks")
    corner = F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    d = X.detections(spark, sf_dir).groupBy("frame").agg(F.first("res").alias("res"), F.collect_list(F.col("class").cast("double")).alias("class"), F.collect_list("conf").alias("conf"), F.collect_list(corner).alias("mask"))
    files.write_segmentation(d, path)
    total = F.aggregate("conf", F.lit(0.0), lambda a, v: a + v)
    return files.read_segmentation(spark, path).select("frame", F.size("mask").cast("long").alias("n"), F.bround(total, 6).alias("total"))


add("batch_manifest", lambda s, d: files.batch_manifest(X.table(s, d, "part").select(F.format_string("/data/cam%d_iou.txt", F.col("p_partkey")).alias("path")), "_track.txt", "_iou", X.table(s, d, "part").where("p_partkey % 3 = 0").select(F.format_string("cam%d_track.txt", F.col("p_partkey")).alias("output"))).select("path", "stem", "output"),
    "select '/data/cam' || p_partkey || '_iou.txt' as path, 'cam' || p_partkey as stem, 'cam' || p_partkey || '_track.txt' as output from part where p_partkey % 3 <> 0")
add("class_names", lambda s, d: X.detections(s, d).join(F.broadcast(s.createDataFrame([(k, f"class{k}") for k in (0, 2, 4)], "cid int, name string")), F.col("class") == F.col("cid"), "left").groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("n")),
    with_tables("select case when class in (0, 2, 4) then 'class' || class else '' end as name, count(*) as n from det group by 1", "det"))
add("tracker_rows", lambda s, d: boxes.parse_tracker_rows(X.raw_boxes(s, d).select("frame", F.array("x1", "y1", "x2", "y2", F.col("class").cast("double"), "conf", F.col("class") * 1.0).alias("values"))),
    with_tables("select frame, class as track, cast(round_even(x1, 0) as int) as x, cast(round_even(y1, 0) as int) as y, cast(round_even(x2 - x1, 0) as int) as w, cast(round_even(y2 - y1, 0) as int) as h, round_even(conf, 2) as score, class as cls, -1 as r3, -1 as r4 from raw", "raw"))

# Tracking

# Four videos for every 40 track ids, so the videos grow in number with the table and each holds ten ids at most.
add("track_bytetrack", lambda s, d: tracking.track(X.smooth_tracks(s, d).selectExpr("cast(track div 40 * 4 + track % 4 as int) video_id", "frame", "x", "y", "w", "h", "score conf", "cls class")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
