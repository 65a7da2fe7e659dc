"""Trajectory tables derived from the driver's tables, in Spark and as DuckDB common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_of_ts():
    return F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - START) / 3600).cast("int")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per order line, with an id."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey % 300 as int) frame", "-1 res", "cast((l_partkey * 7) % 1600 as double) x", "cast((l_suppkey * 13 + l_linenumber * 37) % 900 as double) y",
        "cast(20 + l_quantity as double) w", "cast(20 + (l_partkey % 60) as double) h", "1.0D - 8 * l_discount conf", "cast(l_linenumber % 8 as int) class", "l_orderkey * 10 + l_linenumber id",
    )


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner boxes with fractions, some negative."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey % 300 as int) frame", "l_quantity * 3.25D - 30 x1", "(l_suppkey % 50) * 7.375D - 60.5D y1", "l_quantity * 3.25D - 30 + 30.875D + l_linenumber x2",
        "(l_suppkey % 50) * 7.375D - 60.5D + 51.25D + l_linenumber * 0.5D y2", "1.0D - 8 * l_discount conf", "cast(l_linenumber % 8 as int) class",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per event; repeated (track, frame) pairs and gaps occur. event_id breaks ties."""
    return table(spark, sf_dir, "events").select(
        frame_of_ts().alias("frame"), F.expr("cast(user_id as int) track"), "event_id", F.expr("cast(10 * (event_id % 150) as double) x"), F.expr("cast((event_id * 7) % 900 as double) y"),
        F.expr("cast(40 + event_id % 30 as double) w"), F.expr("cast(60 + event_id % 50 as double) h"), F.expr("cast((event_id % 100) as double) / 100 score"), F.expr("cast(user_id % 3 as int) cls"), F.lit(-1).alias("r3"), F.lit(-1).alias("r4"),
    )


def smooth_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that move evenly."""
    q = table(spark, sf_dir, "events").select(frame_of_ts().alias("frame"), F.expr("cast(user_id as int) track")).distinct()
    return q.selectExpr(
        "frame", "track", "cast(5 * frame + 37 * (track % 7) as double) x", "cast(3 * frame + 53 * (track % 11) as double) y", "cast(50 + track % 5 as double) w", "cast(100 as double) h", "0.9D score", "cast(track % 3 as int) cls", "-1 r3", "-1 r4"
    )


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly moving users far apart from one another, cut where frames step by more than 5."""
    from ..operators.sequence import cluster_by_gap

    q = table(spark, sf_dir, "events").select(frame_of_ts().alias("frame"), F.expr("cast(user_id as int) user")).distinct()
    return cluster_by_gap(q, "frame", 5, ["user"]).selectExpr(
        "frame", "user * 1000 + cluster track", "cast(5 * frame + 1000 * user as double) x", "cast(3 * frame as double) y", "cast(50 as double) w", "cast(100 as double) h", "0.9D score", "user % 3 cls", "0 interp", "-1 r4"
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 detections of two signals, a row per event: consecutive frames within a signal."""
    from ..operators.shared import numbered

    e = table(spark, sf_dir, "events").selectExpr("event_id", "cast(event_id % 2 as int) signal", "case when (event_id div 2) % 40 < 25 then 1 else 0 end detection")
    return numbered(e, ["signal"], ["event_id"], "signals").select((F.col("__row") - 1).cast("int").alias("frame"), "signal", "detection")


def videos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "cam1", 30.0, 720, 1920, 1080, 250), (1, "cam2", 25.0, 500, 1280, 720, -125), (2, "cam3", 29.97, 333, 640, 480, 0)], "position int, video_id string, fps double, n_frames int, width int, height int, offset int")


FRAME = f"cast(floor((epoch(ts) - {START}) / 3600) as int)"
SQL = {
    "det": """select cast(l_orderkey % 300 as int) as frame, -1 as res, cast((l_partkey * 7) % 1600 as double) as x,
        cast((l_suppkey * 13 + l_linenumber * 37) % 900 as double) as y, cast(20 + l_quantity as double) as w,
        cast(20 + (l_partkey % 60) as double) as h, 1.0 - 8 * l_discount as conf, cast(l_linenumber % 8 as int) as class,
        l_orderkey * 10 + l_linenumber as id from lineitem""",
    "raw": """select cast(l_orderkey % 300 as int) as frame, l_quantity * 3.25::double - 30 as x1, (l_suppkey % 50) * 7.375::double - 60.5::double as y1,
        l_quantity * 3.25::double - 30 + 30.875::double + l_linenumber as x2, (l_suppkey % 50) * 7.375::double - 60.5::double + 51.25::double + l_linenumber * 0.5::double as y2,
        1.0 - 8 * l_discount as conf, cast(l_linenumber % 8 as int) as class from lineitem""",
    "trk": f"""select {FRAME} as frame, cast(user_id as int) as track, event_id, cast(10 * (event_id % 150) as double) as x,
        cast((event_id * 7) % 900 as double) as y, cast(40 + event_id % 30 as double) as w, cast(60 + event_id % 50 as double) as h,
        cast((event_id % 100) as double) / 100 as score, cast(user_id % 3 as int) as cls, -1 as r3, -1 as r4 from events""",
    "smo": f"""select frame, track, cast(5 * frame + 37 * (track % 7) as double) as x, cast(3 * frame + 53 * (track % 11) as double) as y,
        cast(50 + track % 5 as double) as w, cast(100 as double) as h, cast(0.9 as double) as score, cast(track % 3 as int) as cls, -1 as r3, -1 as r4
        from (select distinct {FRAME} as frame, cast(user_id as int) as track from events)""",
    "lnk": f"""select frame, cast(usr * 1000 + cluster as int) as track, cast(5 * frame + 1000 * usr as double) as x, cast(3 * frame as double) as y,
        cast(50 as double) as w, cast(100 as double) as h, cast(0.9 as double) as score, usr % 3 as cls, 0 as interp, -1 as r4
        from (select *, sum(brk) over (partition by usr order by frame) as cluster from (
            select *, case when frame - lag(frame) over (partition by usr order by frame) > 5 then 1 else 0 end as brk
            from (select distinct {FRAME} as frame, cast(user_id as int) as usr from events)))""",
    "sig": """select cast(row_number() over (partition by event_id % 2 order by event_id) - 1 as int) as frame, cast(event_id % 2 as int) as signal,
        case when (event_id // 2) % 40 < 25 then 1 else 0 end as detection from events""",
    "vid": """select * from (values (0, 'cam1', 30.0::double, 720, 250), (1, 'cam2', 25.0::double, 500, -125), (2, 'cam3', 29.97::double, 333, 0))
        t(position, video_id, fps, n_frames, shift)""",
}


def with_tables(body: str, *names: str) -> str:
    """body behind the named table expressions; body may open with further ones."""
    head = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    body = body.strip()
    return f"with recursive {head}, {body[5:]}" if body.lower().startswith("with ") else f"with recursive {head} {body}"
