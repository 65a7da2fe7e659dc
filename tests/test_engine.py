"""Operators against stated examples, brute force and invariants on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajekt.functions import geometry as G
from trajekt.functions import scalar as C
from trajekt.operators import boxes, filters, linking, overlay, reclass, sequence, signals, smoothing, timesync, tracking
from trajekt.sources import files

TRK = "frame int, track int, x double, y double, w double, h double, score double, cls int, r3 int, r4 int"


def track_rows(spark, rows):
    return spark.createDataFrame([(f, t, float(x), float(y), float(w), float(h), 0.9, 1, -1, -1) for f, t, x, y, w, h in rows], TRK)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_cluster_by_gap_examples(spark):
    for gap, want in ((2, [[1, 2], [5, 6], [10]]), (1, [[1, 2], [5, 6], [10]]), (4, [[1, 2, 5, 6, 10]])):
        assert sequence.cluster_lists([1, 2, 5, 6, 10], gap) == want
        df = sequence.cluster_by_gap(spark.createDataFrame([(v,) for v in (10, 1, 6, 2, 5)], "v int"), "v", gap)
        got = {}
        for v, c in values(df, "v", "cluster"):
            got.setdefault(c, []).append(v)
        assert [got[k] for k in sorted(got)] == want
    for wrong in ([], [[1]]):
        with pytest.raises(ValueError):
            sequence.cluster_lists(wrong, 1)
    with pytest.raises(ValueError):
        sequence.cluster_lists([1], -1)


def test_iob_example(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0)], "frame int, id int, x double, y double, w double, h double")
    other = spark.createDataFrame([(0, 2, 5.0, 5.0, 10.0, 10.0)], df.schema)
    assert values(boxes.box_iob(df, other), "iob_a", "iob_b") == [(0.25, 0.25)]
    assert values(boxes.box_iou(df, other), "iou") == [(25 / 175,)]
    with pytest.raises(Exception, match="negative"):
        boxes.box_iob(df.withColumn("w", F.lit(-1.0)), other).collect()


def inside_naive(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def test_point_in_polygon_against_naive(spark):
    rng = random.Random(3)
    points = [(x / 2, y / 2) for x in range(-2, 22) for y in range(-2, 22)]
    df = spark.createDataFrame(points, "x double, y double")
    zones = [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 7), (3, 7)]], [[(0, 0), (8, 2), (4, 10), (4, 5)]]]
    zones += [[[(rng.randint(0, 10), rng.randint(0, 10)) for _ in range(5)]] for _ in range(2)]
    for rings in zones:
        if len(set(rings[0])) < 3:
            continue
        got = {(r.x, r.y): r.i for r in df.withColumn("i", G.within_zone(F.col("x"), F.col("y"), rings)).collect()}
        assert got == {p: inside_naive(*p, rings) for p in points}


def test_box_meets_line_touching(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "x double, y double, w double, h double")
    for line, want in (([(10, 5), (20, 5)], True), ([(10.5, 5), (20, 5)], False), ([(-5, 15), (15, -5)], True), ([(-5, 4), (4, -5)], False), ([(2, 2), (3, 3)], True), ([(0, 21), (21, 0)], False), ([(30, 30), (20, 20), (5, 5)], True)):
        assert df.select(G.box_meets_line(line).alias("m")).first().m is want


def test_filters_without_match_and_errors(spark):
    df = track_rows(spark, [(0, 1, 0, 0, 10, 10), (1, 1, 50, 50, 10, 10), (0, 2, 200, 200, 10, 10)])
    zone, far = [(0, 0), (20, 0), (20, 20), (0, 20)], [(900, 900), (901, 900), (901, 901)]
    assert values(filters.filter_tracks(df, include=[zone]), "track", "frame") == [(1, 0), (1, 1)]
    assert filters.filter_tracks(df, include=[far]).count() == 3
    assert filters.filter_tracks(df, include=[far], empty_on_no_match=True).count() == 0
    assert values(filters.filter_tracks(df, exclude=[zone]), "track") == [(2,)]
    assert filters.filter_frames_by_zones_agg(df, [far]).count() == 3
    assert filters.filter_frames_by_zones_agg(df, [zone, zone], anchor="cc", repeat=True).count() == 2
    both = df.withColumn("video_id", F.lit("a")).union(df.where("track = 2").withColumn("video_id", F.lit("b")))
    assert values(filters.filter_tracks(both, include=[zone], by=["video_id"]), "video_id", "track") == [("a", 1), ("a", 1), ("b", 2)]
    assert filters.filter_tracks_by_lines(df, []).count() == 3
    with pytest.raises(ValueError):
        filters.filter_tracks_by_lines(df, [], "list")
    nan = spark.createDataFrame([(float("nan"), 1), (0.5, 1)], "conf double, class int")
    assert filters.filter_detections(nan, min_score=0.1).count() == 1


def test_matched_labels_count_matched_zones_only(spark):
    df = track_rows(spark, [(0, 1, 0, 0, 10, 10), (0, 2, 200, 200, 10, 10)])
    zones = [[(0, 0), (20, 0), (20, 20), (0, 20)], [(900, 900), (901, 900), (901, 901)], [(190, 190), (230, 190), (230, 230), (190, 230)]]
    assert values(filters.filter_tracks_by_zones(df, zones, "label", "cc"), "track", "zone") == [(1, 0), (2, 2)]
    assert values(filters.filter_tracks_by_zones(df, zones, "label", "cc", label="matched"), "track", "zone") == [(1, 0), (2, 1)]
    by = df.withColumn("v", F.lit(1))
    assert values(filters.filter_tracks_by_zones(by, zones, "label", "cc", by=["v"], label="matched"), "track", "zone") == [(1, 0), (2, 1)]


def walk_naive(det, window, factor):
    """One step at a time over the counts, remembering the best start of the run."""
    counts = [sum(det[i : i + window]) for i in range(len(det) - window)]
    out, inside, best, start = [], False, 0, 0
    for i, c in enumerate(counts):
        if c >= factor * window:
            if not inside:
                inside, best, start = True, 0, i
            elif c > best:
                best, start = c, i
        elif inside:
            out.append(start)
            inside = False
    return out + [start] if inside else out


def test_walk_intervals_against_procedure(spark):
    rng = random.Random(5)
    rows, want = [], []
    for k in range(40):
        det = [int(rng.random() < 0.6) for _ in range(rng.randint(8, 40))]
        rows += [(k, f, v) for f, v in enumerate(det)]
        want += [(k, s, s + 5) for s in walk_naive(det, 5, 0.6)]
    df = spark.createDataFrame(rows, "signal int, frame int, detection int")
    got = sequence.walk_intervals(df, 5, 0.6, 2, 3).where("status = 1")
    assert values(got, "signal", "beg_frame", "end_frame") == sorted(want)


def eight_state(values_, seen, q, r):
    """The whole smoother of one box with matrices."""
    f = np.kron(np.eye(4), [[1, 1], [0, 1]])
    qm = np.kron(np.eye(4), np.array([[0.25, 0.5], [0.5, 1]]) * q)
    h = np.kron(np.eye(4), [[1, 0]])
    x, p = h.T @ values_[0], np.eye(8) * 100
    xs, ps = [], []
    for k in range(len(values_)):
        x, p = f @ x, f @ p @ f.T + qm
        if seen[k]:
            g = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(r))
            x, p = x + g @ (values_[k] - h @ x), (np.eye(8) - g @ h) @ p
        xs.append(x)
        ps.append(p)
    for k in range(len(xs) - 2, -1, -1):
        pp = f @ ps[k] @ f.T + qm
        g = ps[k] @ f.T @ np.linalg.inv(pp)
        xs[k] = xs[k] + g @ (xs[k + 1] - f @ xs[k])
        ps[k] = ps[k] + g @ (ps[k + 1] - pp) @ g.T
    return np.array([h @ x for x in xs])


def test_axes_equal_the_whole_smoother():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 4)).cumsum(axis=0) * 5
    seen = rng.random(40) < 0.6
    seen[[0, -1]] = True
    r = np.array([25.0, 25.0, 16.0, 16.0])
    assert np.allclose(smoothing.smooth_axes(v, seen, 10.0, r), eight_state(v, seen, 10.0, r))


def test_rts_example(spark):
    df = track_rows(spark, [(0, 1, 10, 20, 100, 50), (1, 1, 12, 22, 100, 50), (5, 1, 20, 30, 100, 50), (6, 1, 22, 32, 100, 50)])
    got = smoothing.interpolate_tracks(df)
    assert values(got.where("interp = 1"), "frame", "x", "y", "w", "h") == [(2, 14, 24, 100, 50), (3, 16, 26, 100, 50), (4, 18, 28, 100, 50)]
    assert values(got.where("interp = 0"), "frame", "x") == [(0, 10), (1, 12), (5, 20), (6, 22)]
    assert smoothing.interpolate_tracks(df, max_gap=2).where("interp = 1").count() == 0
    with pytest.raises(ValueError):
        smoothing.interpolate_tracks(df.drop("h"))


def test_assignment_against_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = np.array([[rng.random() if rng.random() < 0.6 else np.inf for _ in range(m)] for _ in range(n)])
        best = (0, 0.0)
        for k in range(1, min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    c = sum(cost[i, j] for i, j in zip(rows, cols))
                    if np.isfinite(c) and (k, -c) > (best[0], -best[1]):
                        best = (k, c)
        got = linking.assign(cost)
        assert len(got) == best[0] and abs(sum(cost[i, j] for i, j in got) - best[1]) < 1e-9


def test_link_example(spark):
    rows = [(f, t, 10 + 2 * f, 20 + 2 * f, 40, 80) for t, fs in ((1, (0, 1)), (2, (10, 11)), (3, (20, 21))) for f in fs]
    df = track_rows(spark, [*rows, (0, 9, 900, 900, 10, 10)])
    out = linking.link_tracklets(df, max_gap=15)
    assert values(out, "frame", "track") == [(0, 1), (0, 9), (1, 1), (10, 1), (11, 1), (20, 1), (21, 1)]
    assert "interp" in out.columns
    with pytest.raises(ValueError):
        linking.link_tracklets(df.drop("w"))


def test_spline_is_exact_for_cubics():
    t = np.array([0.0, 1, 3, 4, 7])
    at = np.array([0.5, 2, 5, 7])
    poly = lambda u: (u**3 - 2 * u**2 + u - 5)[:, None]
    assert np.allclose(boxes.spline(t, poly(t), at), poly(at))
    for n in (1, 2, 3):
        assert np.allclose(boxes.spline(t[:n], t[:n, None], t[:n]), t[:n, None])


def test_interpolation_outside_fails(spark):
    known = track_rows(spark, [(0, 1, 0, 0, 10, 10), (4, 1, 8, 8, 10, 10)]).select("track", "frame", "x", "y", "w", "h")
    ok, late = (spark.createDataFrame([(1, f)], "track int, frame int") for f in (3, 5))
    for method in ("linear", "nearest", "cubic"):
        boxes.interpolate_boxes(known, ok, method).collect()
        with pytest.raises(Exception, match="outside"):
            boxes.interpolate_boxes(known, late, method).collect()


def test_reclass_default_and_best(spark):
    trk = track_rows(spark, [(0, 1, 0, 0, 10, 10), (1, 1, 0, 0, 10, 10), (0, 2, 500, 500, 10, 10)])
    det = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (1, 36, 0.0, 0.0, 10.0, 8.0), (0, 36, 0.0, 0.0, 10.0, 10.0)], "frame int, class int, x double, y double, w double, h double")
    assert values(reclass.re_classify(trk, det), "track", "cls", "avg_score") == [(1, 1, 1.0), (2, 0, 0.0)]


def test_times(spark):
    df = spark.createDataFrame([(1699999999790,), (1720000000000,)], "t long")
    got = [r[0] for r in df.select(C.unix_ms_to_local(F.col("t"))).collect()]
    assert got == ["2023-11-14T17:13:19.790-05:00", "2024-07-03T05:46:40.000-04:00"]
    with pytest.raises(Exception, match="positive"):
        timesync.add_unix_time(spark.createDataFrame([("a", 0.0, 3)], "video_id string, fps double, n_frames int"), 0, 0).collect()
    assert C.frame_range(None, None, 10) == (0, 9) and C.frame_range(8, 3, 10, strict=False) == (8, 8) and C.frame_range(1, 2, 0, strict=False) == (0, -1)
    with pytest.raises(ValueError):
        C.frame_range(8, 3, 10)


def test_shapes():
    assert overlay.shape_row("POLYGON ((0 0, 4 0, 4 4))", 1)[:2] == ("polygon", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]])
    assert overlay.shape_row([1, 2, 3, 4], 0)[:2] == ("box", [[1.0, 2.0], [3.0, 4.0]])
    assert overlay.shape_row({"type": "circle", "geometry": [1, 2], "color": [1]}, 2)[2] == list(C.PALETTE[2])
    for wrong in ({"type": "line", "geometry": [1, 2]}, {"type": "polygon", "geometry": [(0, 0), (1, 1)]}, {"type": "star", "geometry": [0, 0]}):
        with pytest.raises(ValueError):
            overlay.shape_row(wrong, 0)


def test_shapes_without_rows_use_frame_zero(spark):
    assert values(overlay.draw_shapes(spark, ["POINT (3 4)"]), "frame", "type") == [(0, "circle")]


def test_configs(tmp_path):
    path = str(tmp_path / "c.yaml")
    c = tracking.OCSORTConfig(max_age=50, extra_kwargs={"q": 1})
    c.export_yaml(path)
    assert tracking.import_config(path) == c and tracking.OCSORTConfig.import_yaml(path) == c
    assert tracking.ByteTrackConfig.from_dict({"unknown": 2}).extra_kwargs == {"unknown": 2}
    (tmp_path / "bad.yaml").write_text("- a\n- b\n")
    with pytest.raises(ValueError):
        tracking.read_yaml(str(tmp_path / "bad.yaml"))
    assert len(tracking.CONFIGS) == 8 and tracking.BoTSORTConfig().track_high_thresh == 0.5


def test_tracker_keeps_two_crossing_boxes_apart(spark):
    rows = [(v, f, 10.0 * f, 50.0, 30.0, 60.0, 0.9, 0) for v in (1, 2) for f in range(30) if f % 7 != 3] + [(1, f, 600 - 10.0 * f, 300.0, 30.0, 60.0, 0.9, 0) for f in range(30)]
    df = spark.createDataFrame(rows, "video_id int, frame int, x double, y double, w double, h double, conf double, class int")
    out = tracking.track(df)
    ids = values(out.groupBy("video_id", "track").count(), "video_id", "count")
    assert [v for v, _ in ids] == [1, 1, 2] and all(n >= 24 for _, n in ids)
    with pytest.raises(ValueError):
        tracking.track(df, tracking.ByteTrackConfig(extra_kwargs={"x": 1}))


def test_streams(spark, tmp_path):
    from trajekt.streaming import operators as S

    rows = [("a", f, 10.0 * f, 50.0, 30.0, 60.0, 0.9, 0) for f in range(12)] + [("a", f, 0.0, 0.0, 5.0, 5.0, 0.05, 0) for f in (40, 200)]
    schema = "video_id string, frame int, x double, y double, w double, h double, conf double, class int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("tracked", S.track_stream(stream)), ("clustered", S.cluster_stream(stream, 5, 10, late="1 seconds"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("tracked").select("track").distinct().count() == 1 and spark.table("tracked").count() == 12
    assert (0, 11, 12) in values(spark.table("clustered"), "first_frame", "last_frame", "rows")


def test_files(spark, tmp_path):
    for video in ("cam 1", "cam2"):
        (tmp_path / f"{video}_track.txt").write_text("0,1,1.5,2,3,4,0.9,1,-1,-1\n")
    got = files.read_tracks(spark, [str(tmp_path / f"{v}_track.txt") for v in ("cam 1", "cam2")], video_from_name="_track")
    assert values(got, "video_id", "x") == [("cam 1", 1.5), ("cam2", 1.5)]
    with pytest.raises(Exception, match="fraction"):
        files.read_tracks_int(spark, str(tmp_path / "cam2_track.txt")).collect()
    (tmp_path / "bad.txt").write_text("0,x,1,2,3,4,0.9,1,-1,-1\n")
    with pytest.raises(Exception):
        files.read_tracks(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "names").write_text("person\n\n bike \n")
    assert values(files.load_class_dict(spark, str(tmp_path / "names")), "id", "name") == [(0, "person"), (2, "bike")]
    assert values(files.load_classes(spark, str(tmp_path / "names")), "id", "name") == [(0, "person"), (1, "bike")]
    (tmp_path / "draw.csv").write_text('frame,type,coords,color,size,thick,desc\n1,bbox,"[(1, 2), (3, 4)]","(0, 255, 255)",1,2,"7 "\n')
    row = files.read_draw(spark, str(tmp_path / "draw.csv")).first()
    assert row.coords == [[1.0, 2.0], [3.0, 4.0]] and row.color == [0, 255, 255] and row.desc == "7 " and row.fill is False


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TRK)
    assert smoothing.interpolate_tracks(empty).count() == 0
    assert linking.link_tracklets(empty).count() == 0
    assert filters.filter_tracks(empty, include=[[(0, 0), (1, 0), (1, 1)]]).count() == 0
    assert overlay.draw_tracks(empty, tail_length=3).count() == 0
    assert signals.pedestrian_intervals(spark.createDataFrame([], "signal int, frame int, detection int"), 1, 1, 5).count() == 0


def test_nms_keeps_the_best(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 1.0, 0.0, 10.0, 10.0, 0.8), (0, 1, 50.0, 0.0, 10.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, "frame int, class int, x double, y double, w double, h double, conf double")
    assert values(boxes.nms(df, 0.5), "conf") == [(0.1,), (0.9,)]


def test_track_batch_skips_what_is_there(spark, tmp_path):
    for v in ("a", "b"):
        (tmp_path / f"{v}_iou.txt").write_text("".join(f"{f},-1,{10 + f},20,30,60,0.9,0\n" for f in range(5)))
    first = tracking.track_batch(spark, [str(tmp_path / "a_iou.txt")], str(tmp_path / "out"))
    assert values(first, "video_id", "rows") == [("a", 5)]
    tracking.track_batch(spark, [str(tmp_path / f"{v}_iou.txt") for v in "ab"], str(tmp_path / "out"))
    assert values(spark.read.csv(str(tmp_path / "out")).groupBy("video_id").count(), "video_id", "count") == [("a", 5), ("b", 5)]


def test_smoothing_many_tracks_is_smoothing_each(monkeypatch):
    rng = np.random.default_rng(3)
    length = np.array([5, 40, 1, 17])
    values, seen = np.zeros((4, 40, 4)), np.zeros((4, 40), bool)
    for t, n in enumerate(length):
        seen[t, :n] = rng.random(n) < 0.6
        seen[t, [0, n - 1]] = True
        values[t, :n] = rng.normal(size=(n, 4)) * 50 * seen[t, :n, None]
    r = np.array([25.0, 25, 16, 16])
    got = smoothing.smooth_many(values, seen, length, 10.0, r)
    for t, n in enumerate(length):
        assert np.allclose(got[t, :n], smoothing.smooth_axes(values[t, :n], seen[t, :n], 10.0, r))


def test_smoothing_in_small_blocks_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(t, int(f), float(rng.integers(0, 99)), 1.0 * t, 10.0, 20.0, 0.5, t % 2, -1, -1) for t in range(12) for f in sorted(rng.choice(60, 9, replace=False))]
    df = spark.createDataFrame(rows + rows[:5], "track int, frame int, x double, y double, w double, h double, score double, cls int, r3 int, r4 int")
    whole = sorted(smoothing.interpolate_tracks(df).collect())
    monkeypatch.setattr(smoothing, "CELLS", 50)
    assert sorted(smoothing.interpolate_tracks(df).collect()) == whole and len(whole) > len(rows)


def test_class_names_pairs_and_views(spark, tmp_path):
    names = {r.id: r.name for r in files.load_class_dict(spark).collect()}
    assert len(names) == 80 and (names[0], names[2], names[36], names[79]) == ("person", "car", "skateboard", "toothbrush")
    assert files.load_classes(spark).count() == 80
    (tmp_path / "empty.names").write_text("")
    with pytest.raises(ValueError):
        files.load_classes(spark, str(tmp_path / "empty.names"))
    pairs = files.pair_files(spark, ["a_iou.txt", "b_iou.txt"], ["a.mp4", "b.mp4"]).collect()
    assert [tuple(r) for r in pairs] == [(0, "a_iou.txt", "a.mp4"), (1, "b_iou.txt", "b.mp4")]
    assert files.pair_files(spark, ["a"]).first().video is None
    with pytest.raises(ValueError):
        files.pair_files(spark, ["a", "b"], ["a"])
    spark.createDataFrame([("cam", 5)], "video_id string, n_frames int").write.parquet(str(tmp_path / "videos"))
    files.write_table(spark.createDataFrame([(3, 1, 0.0, 0.0, 2.0, 2.0, 0.5, 1, -1, -1)], "frame int, track int, x double, y double, w double, h double, score double, cls int, r3 int, r4 int"), str(tmp_path / "tracks"))
    assert files.register_views(spark, str(tmp_path)) == ["tracks", "videos"]
    assert spark.sql("select count(*) n from tracks cross join videos where frame < n_frames").first().n == 1


def test_seek_lists_elements_and_order(spark):
    frames = spark.createDataFrame([("a", -1), ("a", 0), ("a", 4), ("a", 5), ("b", 1), ("c", 0)], "video_id string, frame int")
    videos = spark.createDataFrame([("a", 5), ("b", 0)], "video_id string, n_frames int")
    assert sorted(map(tuple, overlay.seek_list(frames, videos).collect())) == [("a", 0), ("a", 4)]
    shape = {"type": "circle", "geometry": [7, 8], "transparant": 0.25}
    draw = overlay.draw_shapes(spark, shape)
    assert draw.count() == 1 and draw.first().alpha == 0.25
    tracks = spark.createDataFrame([(f, t, 1.0 * t, 1.0, 2.0, 2.0) for f in (3, 1, 2) for t in (1, 2)], "frame int, track int, x double, y double, w double, h double")
    rows = overlay.draw_tracks(tracks)
    assert {r.frame: len(r.elements) for r in overlay.elements_by_frame(rows).collect()} == {1: 2, 2: 2, 3: 2}
    assert [r.frame for r in overlay.in_frame_order(rows).collect()] == [1, 1, 2, 2, 3, 3]


def test_tracker_by_class_and_from_files(spark, tmp_path):
    boxes = [(0, f, 10.0 + f, 10.0, 20.0, 20.0, 0.9, f % 2) for f in range(8)]  # one box whose class alternates
    dets = spark.createDataFrame(boxes, "video_id int, frame int, x double, y double, w double, h double, conf double, class int")
    ids = lambda config: {r.track for r in tracking.Tracker(config).track(dets).collect()}
    assert ids(tracking.ByteTrackConfig()) == {1}
    assert len(ids(tracking.ByteTrackConfig(per_class=True))) >= 1 and {r.cls for r in tracking.Tracker(tracking.ByteTrackConfig(per_class=True)).track(dets).where("track = 1").collect()} == {0}
    path = str(tmp_path / "own" / "tracker.yaml")
    tracking.Tracker(tracking.ByteTrackConfig(track_buffer=7)).export_current_config_to_yaml(path)
    assert tracking.Tracker(tracking.OCSORTConfig(), config_yaml=path).config == tracking.ByteTrackConfig(track_buffer=7)
    assert tracking.Tracker().config.model == tracking.MOTModels.BOTSORT
