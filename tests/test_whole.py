"""Queries answer for every row of their tables, also where the smallest tables don't show it."""

import os

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_bytetrack_steps_every_track(spark):
    from trajekt.operators.tracking import ByteTracker, rows_of
    from trajekt.plans import fixtures, queries

    boxes: dict[int, dict[int, list[tuple]]] = {}
    for r in fixtures.smooth_tracks(spark, SF).collect():
        boxes.setdefault(r.track // 40 * 4 + r.track % 4, {}).setdefault(r.frame, []).append((r.x, r.y, r.w, r.h, r.score, r.cls))
    assert len(boxes) > 4
    want = []
    for video, frames in boxes.items():
        tracker = ByteTracker()
        for f in range(min(frames), max(frames) + 1):
            want += [(video, *r) for r in rows_of(f, tracker.step(np.array(sorted(frames.get(f, [])))), True)]
    assert sorted(map(tuple, queries.queries()["track_bytetrack"](spark, SF).collect())) == sorted(want)


def test_draw_dets_score_draws_every_class(spark):
    from trajekt.plans import fixtures, queries

    dets = fixtures.detections(spark, SF).selectExpr("frame", "x", "y", "w", "h", "class", "conf").collect()
    want = {(r.frame, r.x, r.y, r.x + r.w, r.y + r.h, f"{ {0: 'car', 1: 'bus'}.get(r['class'], '')} {round(r.conf, 1):.1f}") for r in dets}
    got = queries.queries()["draw_dets_score"](spark, SF).collect()
    assert any(r.desc.startswith(" ") for r in got)
    assert sorted((r.frame, r.x0, r.y0, r.x1, r.y1, r.desc) for r in got) == sorted(want)


def test_signal_labels_cover_every_frame(spark):
    from trajekt.plans import fixtures, queries

    frames = {r.frame for r in fixtures.signals(spark, SF).select("frame").distinct().collect()}
    assert len(frames) > 400 and {r.frame for r in queries.queries()["signal_labels"](spark, SF).select("frame").distinct().collect()} == frames


def test_zone_and_line_queries_keep_some_tracks_and_drop_some(spark):
    from trajekt.plans import fixtures, queries

    all_tracks = fixtures.tracks(spark, SF).select("track").distinct().count()
    for name in ("tracks_zone_agg_cl", "tracks_lines_include", "tracks_lines_v2_force"):
        assert 0 < queries.queries()[name](spark, SF).select("track").distinct().count() < all_tracks, name


def test_link_candidates_are_those_of_all_pairs_and_meet_by_place(spark):
    from trajekt.operators import linking

    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        t, size = int(rng.integers(0, 60)), float(rng.choice([5, 40, 300]))
        x, y, vx, vy = *rng.uniform(-400, 400, 2).tolist(), *(rng.normal(size=2) * rng.choice([0, 3, 50])).tolist()
        rows += [(t + n, k, x + n * vx, y + n * vy, size, size, int(k % 2)) for n in range(3)]
    d = linking.descriptors(spark.createDataFrame(rows, "frame int, track int, x double, y double, w double, h double, cls int"))
    got = linking.candidates(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "cell_x" in next(line for line in plan.splitlines() if "Join" in line)
    have = d.collect()
    want = set()
    for a in have:
        for b in have:
            dt = b.t_start - a.t_end
            ratios = (b.start_w / a.end_w, b.start_h / a.end_h)
            if a.cls != b.cls or a.track == b.track or not 1 <= dt <= 20 or not all(0.5 <= r <= 2 for r in ratios):
                continue
            dx, dy = abs(a.end_cx + a.vx * dt - b.start_cx), abs(a.end_cy + a.vy * dt - b.start_cy)
            both = max((a.end_w + b.start_w) / 2 - dx, 0) * max((a.end_h + b.start_h) / 2 - dy, 0)
            if np.hypot(dx, dy) < 2.5 * a.area_end**0.5 * (1 + 0.03 * dt) and both / (a.end_w * a.end_h + b.start_w * b.start_h - both) >= 0.05:
                want.add((a.track, b.track))
    assert len(want) > 50 and sorted((r.a_track, r.b_track) for r in got.collect()) == sorted(want)


def test_links_of_many_groups_at_one_time_are_solved_apart(spark):
    from trajekt.operators import linking

    rng = np.random.default_rng(6)
    edges = [(g * 10 + i, g * 10 + 5 + j, 0, 5, float(rng.random())) for g in range(40) for i in range(4) for j in range(3) if rng.random() < 0.7]
    df = spark.createDataFrame(edges, "a_track int, b_track int, a_end int, b_start int, cost double")
    got = linking.match(df)
    assert "hashpartitioning(0" not in got._jdf.queryExecution().executedPlan().toString() and "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    ids = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    cost = np.full((len(ids[0]), len(ids[1])), np.inf)
    for a, b, _, _, c in edges:
        cost[ids[0].index(a), ids[1].index(b)] = c
    want = {(ids[0][i], ids[1][j]) for i, j in linking.assign(cost)}
    assert {(r.a_track, r.b_track) for r in got.collect()} == want


def test_reclass_by_cells_is_that_of_all_pairs(spark):
    from trajekt.operators import reclass

    rng = np.random.default_rng(5)
    box = lambda most: [*rng.uniform(-300, 300, 2).round(1).tolist(), *(rng.uniform(0, most, 2).round(1)).tolist()]
    rows = [(int(rng.integers(0, 6)), k % 20, *box([60, 400][k % 7 == 0])) for k in range(400)] + [(1, 3, -500.0, -500.0, 2000.0, 2000.0)]
    dets = [(int(rng.integers(0, 5)), *box([3, 50, 50, 700][k % 4]), int(rng.integers(0, 4))) for k in range(600)] + [(2, 0.0, 0.0, 0.0, 5.0, 1)]
    t = spark.createDataFrame(rows, "frame int, track int, x double, y double, w double, h double")
    d = spark.createDataFrame(dets, "frame int, x double, y double, w double, h double, class int")
    got = reclass.match_detections(t, d, 0.3, (1, 3), num_frames=15)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" in plan
    want = {}
    for track in range(20):
        top = sorted({r for r in rows if r[1] == track}, key=lambda r: (-r[4] * r[5], r[0], *r[2:]))[:15]
        for c in (1, 3):
            best = []
            for f, _, x, y, w, h in top:
                shares = [max(min(x + w, u + p) - max(x, u), 0) * max(min(y + h, v + q) - max(y, v), 0) / (p * q) if p * q > 0 else 0.0 for g, u, v, p, q, k in dets if g == f and k == c]
                best += [max(shares)] if shares else []
            if best:
                hit = [b for b in best if b >= 0.3]
                want[track, c] = sum(hit) / len(hit) if hit else 0.0
    have = {(r.track, r["class"]): r.avg_score for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    assert any(want.values())


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_gaps_are_filled_as_targets_are_and_sort_known_rows_only(spark, method):
    from trajekt.operators import boxes, sequence
    from trajekt.plans import queries

    rng = np.random.default_rng(9)
    frames = [(t, int(f)) for t in range(6) for f in sorted(rng.choice(120, 14, replace=False))]
    df = spark.createDataFrame([(t, f, *rng.uniform(-90, 90, 4).round(2).tolist()) for t, f in frames], "track int, frame int, x double, y double, w double, h double")
    got = sorted(map(tuple, boxes.interpolate_gaps(df, 9, method).collect()))
    assert got and got == sorted(map(tuple, boxes.interpolate_boxes(df, sequence.fill_frames(df, 9), method).collect()))
    plan = queries.queries()[f"bbox_interp_{method}"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.index("Generate explode") < plan.index("Window")


def test_suppression_looks_at_boxes_near_by_only(monkeypatch):
    import pandas as pd

    from trajekt.operators import boxes

    class Groups:
        schema = None
        groupBy = lambda self, *by: self
        applyInPandas = lambda self, f, schema: f

    seen = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def minimum(self, a, b):
            seen.append(len(b))
            return np.minimum(a, b)

    monkeypatch.setattr(boxes, "np", Counting())
    rng = np.random.default_rng(2)
    n = 600
    d = pd.DataFrame({c: rng.uniform(0, m, n) for c, m in (("x", 3000), ("y", 100), ("w", 60), ("h", 60), ("conf", 1))})
    kept = boxes.nms(Groups(), 0.3)(d)
    want = []
    for r in d.sort_values("conf", ascending=False).itertuples():
        for k in want:
            both = max(min(r.x + r.w, k.x + k.w) - max(r.x, k.x), 0) * max(min(r.y + r.h, k.y + k.h) - max(r.y, k.y), 0)
            if both / (r.w * r.h + k.w * k.h - both) > 0.3:
                break
        else:
            want.append(r)
    assert kept.index.tolist() == [r.Index for r in want] and len(want) < n
    assert sum(seen) < 0.1 * n * len(seen)


def test_assignment_without_rivals_takes_all():
    from trajekt.operators.linking import assign

    cost = np.full((3, 4), np.inf)
    cost[0, 2], cost[2, 0] = 0.5, 0.25
    assert sorted(assign(cost)) == [(0, 2), (2, 0)]


def windows_of(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]


def test_rows_are_numbered_by_ranges(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from trajekt.operators import shared

    d = spark.range(5000).selectExpr("case when id % 7 = 0 then null when id % 3 < 2 then 'a' else 'b' end k", "(id * 7919) % 5003 - 100 t", "id v").repartition(5)
    for keys in (["k"], ["k", "k"], []):
        want = d.withColumn("__row", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t")))
        got = shared.numbered(d, keys, ["t"], "test", rows=300)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert not shared.numbered(d.where("v < 0"), ["k"], ["t"], "test", rows=300).count()


def test_signal_intervals_and_sums_are_those_of_whole_signals_in_chunks_of_any_size(spark, monkeypatch):
    from trajekt.operators import sequence, shared

    rng, rows, runs, sums = np.random.default_rng(9), [], [], []
    for k in range(6):
        # Long runs, over many chunks, and short ones; frames with gaps.
        det = (rng.random(400) < np.repeat(rng.choice([0.2, 0.7, 1.0], 20), 20)).astype(int).tolist()
        frames = np.cumsum(rng.integers(1, 4, 400)).tolist()
        rows += [(k if k else None, f, v) for f, v in zip(frames, det)]
        counts = [sum(det[i : i + 8]) for i in range(392)]
        sums += [(k if k else None, f, v, c) for f, v, c in zip(frames, det, counts)]
        i = 0
        while i < 392:
            e = i
            while e < 392 and counts[e] >= 4:
                e += 1
            if e > i:
                best = max(range(i, e), key=lambda j: (counts[j] if j > i else -1, -j))
                b, f = frames[best], frames[best + 8]
                runs += [(k if k else None, 1, b, f), (k if k else None, 2, f + 1, f + 6)]
            i = e + 1
    df = spark.createDataFrame(rows, "signal int, frame int, detection int").repartition(3)
    for task, chunk in ((10**6, 10**6), (150, 10), (700, 64)):
        monkeypatch.setattr(shared, "TASK_ROWS", task)
        monkeypatch.setattr(shared, "CHUNK_ROWS", chunk)
        got = sequence.walk_intervals(df, 8, 0.5, 2, 3)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, runs))
        got = sequence.sliding_sum(df, "detection", 8, ["signal"])
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, sums))
    # No window needs a whole signal.
    assert windows_of(got) and all("__chunk" in line for line in windows_of(got))


def test_signal_labels_in_many_tasks_are_those_of_the_sql(spark, monkeypatch):
    import duckdb

    from trajekt.operators import shared
    from trajekt.plans import fixtures, queries

    calls, signals = [], fixtures.signals
    monkeypatch.setattr(shared, "TASK_ROWS", 900)
    monkeypatch.setattr(shared, "CHUNK_ROWS", 300)
    monkeypatch.setattr(fixtures, "signals", lambda *a: calls.append(a) or signals(*a))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    for name in ("signal_walk_intervals", "signal_labels", "sliding_sum"):
        cur = con.execute(queries.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        calls.clear()
        got = queries.queries()[name](spark, SF).select(*cols).collect()
        assert got and sorted(map(tuple, got)) == sorted(cur.fetchall())
        assert len(calls) == 1


def test_pairs_of_one_frame_are_whole_and_dealt_to_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F
    from trajekt.operators import boxes, shared

    for name, n in (("BLOCK", 7), ("UNIT", 28), ("TASK_PAIRS", 500)):
        monkeypatch.setattr(boxes, name, n, raising=False)
    monkeypatch.setattr(shared, "TASK_ROWS", 60, raising=False)
    rng = np.random.default_rng(2)
    # Many boxes in frame 0, few in others, none of a side in some, repeated boxes, frames unknown.
    rows = [(None if k % 41 == 0 else 0 if k < 150 else int(rng.integers(1, 9)), int(k // 2), *map(float, rng.integers(0, 60, 2)), 20.0, float(k % 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "frame int, id long, x double, y double, w double, h double")
    for left, right in ((rows, rows[:120]), (rows[:90], rows), (rows[:0], rows)):
        a, b = (spark.createDataFrame(r, df.schema) for r in (left, right))
        pairs = boxes.box_pairs(a, b)
        assert pairs.columns == ["frame", *[f"{s}_{c}" for s in "ab" for c in ("id", *"xywh")]]
        want = [(p[0], *p[1:], *q[1:]) for p in left for q in right if p[0] is not None and p[0] == q[0]]
        assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert boxes.box_pairs(df, df).where("frame = 0").select(F.spark_partition_id()).distinct().count() > 2


def odd_boxes(spark, kind="double", negative=False):
    """Boxes of two frames: some far from others, touching, empty, without values or with values that are not numbers."""
    rng = np.random.default_rng(4)
    rows = [(k % 2, k, *map(float, (rng.integers(0, 9) * 40, rng.integers(0, 4) * 20, rng.integers(0, 3) * 20, rng.integers(1, 60)))) for k in range(60)]
    if kind == "double":
        odd = [None, float("nan"), float("inf"), 1e200, 1e17, -0.0, 0.1 + 0.2] + [-float("inf"), -5.0] * negative
        rows += [(k % 2, 100 + k, *(odd[k // 4] if c == k % 4 else 7.5 for c in range(4))) for k in range(4 * len(odd))]
    return spark.createDataFrame(rows, "frame int, id long, x double, y double, w double, h double").selectExpr("frame", "id", *[f"cast({c} as {kind}) {c}" for c in "xywh"])


def shares_of_all_pairs(d, shares):
    """The shares of every pair of a frame by the formula alone, as texts."""
    from pyspark.sql import functions as F

    a, b = (d.select("frame", *[F.col(c).alias(f"{s}_{c}") for c in ("id", *"xywh")]) for s in "ab")
    got = a.join(b, "frame").select("frame", "a_id", "b_id", *shares(*([F.col(f"{s}_{c}") for c in "xywh"] for s in "ab")))
    return sorted(tuple(map(str, r)) for r in got.collect())


def small_blocks(monkeypatch):
    from trajekt.operators import boxes

    for name, n in (("BLOCK", 5), ("UNIT", 15)):
        monkeypatch.setattr(boxes, name, n)
    return boxes


def test_iob_of_boxes_apart_is_not_worked_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trajekt.functions import geometry as G

    boxes = small_blocks(monkeypatch)
    for kind in ("double", "float", "int", "decimal(9,2)"):
        d = odd_boxes(spark, kind)
        want = shares_of_all_pairs(d, lambda a, b: [c.alias(n) for n, c in zip(("iob_a", "iob_b"), G.iob(a, b))])
        assert sorted(tuple(map(str, r)) for r in boxes.box_iob(d, d).collect()) == want
    with pytest.raises(Exception, match="negative"):
        boxes.box_iob(odd_boxes(spark, negative=True), odd_boxes(spark)).collect()
    # A formula that fails shows where it is worked out: not for the pair of boxes apart, but for the one of boxes that meet.
    fails = F.raise_error(F.lit("worked out")).cast("double")
    monkeypatch.setattr(boxes, "iob", lambda a, b: (fails, fails))
    d = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0)], "frame int, id int, x double, y double, w double, h double")
    for x, y in ((10.0, 0.0), (-10.0, 0.0), (0.0, 10.0), (0.0, -10.0), (500.0, 500.0)):
        assert boxes.box_iob(d, d.withColumns({"x": F.lit(x), "y": F.lit(y)})).select("iob_a", "iob_b").collect() == [(0.0, 0.0)]
    with pytest.raises(Exception, match="worked out"):
        boxes.box_iob(d, d.withColumn("x", F.lit(9.5))).collect()


def test_inclusive_iou_of_boxes_apart_is_not_worked_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trajekt.functions import geometry as G

    boxes = small_blocks(monkeypatch)
    for kind in ("double", "int"):
        d = odd_boxes(spark, kind, True)
        for inclusive in (True, False):
            want = shares_of_all_pairs(d, lambda a, b: [G.iou(a, b, inclusive).alias("iou")])
            assert sorted(tuple(map(str, r)) for r in boxes.box_iou(d, d, inclusive=inclusive).collect()) == want
    # Pixels of boxes that touch are shared; a pixel further they are not, and nothing is worked out.
    monkeypatch.setattr(boxes, "iou", lambda *a: F.raise_error(F.lit("worked out")).cast("double"))
    d = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0)], "frame int, id int, x double, y double, w double, h double")
    assert boxes.box_iou(d, d.withColumn("x", F.lit(11.0)), inclusive=True).select("iou").collect() == [(0.0,)]
    with pytest.raises(Exception, match="worked out"):
        boxes.box_iou(d, d.withColumn("x", F.lit(10.0)), inclusive=True).collect()


def test_blocks_apart_give_rows_from_ids_alone(spark, monkeypatch):
    from trajekt.functions import geometry as G

    boxes = small_blocks(monkeypatch)
    # Boxes in a row, most blocks of which lie apart; some ids are unknown.
    rows = [(k % 2, None if k % 7 == 0 else k, 9.0 * k, 0.0, 20.0, 10.0) for k in range(80)]
    d = spark.createDataFrame(rows, "frame int, id long, x double, y double, w double, h double")
    for got, shares in (
        (boxes.box_iou(d, d, inclusive=True), lambda a, b: [G.iou(a, b, True).alias("iou")]),
        (boxes.box_iob(d, d), lambda a, b: [c.alias(n) for n, c in zip(("iob_a", "iob_b"), G.iob(a, b))]),
    ):
        assert sorted(tuple(map(str, r)) for r in got.collect()) == shares_of_all_pairs(d, shares)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode(b_ids") == 1 and plan.count("Generate inline(b_boxes") == 1
