"""Score, class, zone and line filters on detections, frames and whole tracks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_meets_line, ref_point, within_any, within_zone


def _method(method: str, allowed: Sequence[str]) -> None:
    if method not in allowed:
        raise ValueError(f"method is one of {', '.join(allowed)}")


def filter_detections(df: DataFrame, zones: Sequence | None = None, classes: Sequence[int] | None = None, min_score: float = 0, score: str = "conf", cls: str = "class") -> DataFrame:
    """Rows whose score is at least min_score, whose class is listed (if any is) and whose centre lies in a zone
    (if any is given). NaN scores fail. Each row comes once, whichever zones it lies in."""
    keep = (F.col(score) >= F.lit(float(min_score))) & ~F.isnan(score)
    if classes:
        keep &= F.col(cls).isin(list(classes))
    if zones:
        keep &= within_any(*ref_point("cc"), zones)
    return df.where(keep)


def filter_class_file(spark: SparkSession, source: str, target: str, classes: Sequence[int] | None = None, min_score: float = 0) -> None:
    """File to file; the score counts only where classes are given."""
    from ..sources.files import read_detections, write_table

    df = read_detections(spark, source)
    write_table(filter_detections(df, classes=classes, min_score=min_score) if classes else df, target)


def _hit_tracks(df: DataFrame, hit: Column, by: Sequence[str], track: str) -> DataFrame:
    """Tracks with a hit, one row each."""
    return df.where(hit).select(*by, track).distinct()


def _keep_tracks(df: DataFrame, hits: DataFrame, include: bool, by: Sequence[str], track: str, empty_on_no_match: bool) -> DataFrame:
    """Semi or anti join with the hit tracks; where a video has none, all its rows stay unless told otherwise."""
    keys = [*by, track]
    if not include:
        # Without hits the anti join keeps everything; the option only matters for what is left then.
        out = df.join(hits, keys, "left_anti")
        return out.join(hits.select(*by).distinct(), list(by), "left_semi") if empty_on_no_match and by else out
    if empty_on_no_match:
        return df.join(hits, keys, "left_semi")
    marked = df.join(hits.withColumn("__hit", F.lit(True)), keys, "left")
    if by:
        marked = marked.join(hits.select(*by).distinct().withColumn("__any", F.lit(True)), list(by), "left")
    else:
        marked = marked.crossJoin(F.broadcast(hits.agg((F.count(F.lit(1)) > 0).alias("__any"))))
    keep = F.col("__hit").isNotNull() | ~F.coalesce(F.col("__any"), F.lit(False))
    return marked.where(keep).select(*df.columns)


def filter_tracks(df: DataFrame, include: Sequence | None = None, exclude: Sequence | None = None, by: Sequence[str] = (), track: str = "track", empty_on_no_match: bool = False) -> DataFrame:
    """Whole tracks: those with a centre in an include zone, then without those with a centre in an exclude zone.

    If no track enters an include zone all stay (per video, with `by`); empty_on_no_match changes that.
    """
    point = ref_point("cc")
    if include:
        df = _keep_tracks(df, _hit_tracks(df, within_any(*point, include), by, track), True, by, track, empty_on_no_match)
    if exclude:
        df = _keep_tracks(df, _hit_tracks(df, within_any(*point, exclude), by, track), False, by, track, False)
    return df


def filter_tracks_by_zones_agg(
    df: DataFrame, zones: Sequence | None = None, method: str = "include", anchor: str = "bc", offset: Sequence[float] | None = None, by: Sequence[str] = (), track: str = "track", empty_on_no_match: bool = False
) -> DataFrame:
    """Keep (include) or drop (any other method) the tracks with an anchor point in any zone; no match keeps all."""
    if not zones:
        return df
    hits = _hit_tracks(df, within_any(*ref_point(anchor, offset), zones), by, track)
    return _keep_tracks(df, hits, method == "include", by, track, empty_on_no_match)


def filter_frames_by_zones_agg(
    df: DataFrame,
    zones: Sequence | None = None,
    method: str = "include",
    anchor: str = "bc",
    offset: Sequence[float] | None = None,
    by: Sequence[str] = (),
    empty_on_no_match: bool = False,
    repeat: bool = False,
) -> DataFrame:
    """Keep or drop single rows by their anchor point; no match keeps all (per video, with `by`).

    repeat: a row comes once per zone it lies in, with the zone's index in the column zone.
    """
    if not zones:
        return df
    point = ref_point(anchor, offset)
    hit = within_any(*point, zones)
    if repeat and method == "include":
        index = F.array_compact(F.array(*[F.when(within_zone(*point, z), F.lit(k)) for k, z in enumerate(zones)]))
        return df.withColumn("zone", F.explode(index))
    keep = hit if method == "include" else ~hit
    if empty_on_no_match:
        return df.where(keep)
    found = df.where(hit)
    if by:
        marked = df.join(found.select(*by).distinct().withColumn("__any", F.lit(True)), list(by), "left")
    else:
        marked = df.crossJoin(F.broadcast(found.agg((F.count(F.lit(1)) > 0).alias("__any"))))
    return marked.where(keep | ~F.coalesce(F.col("__any"), F.lit(False))).select(*df.columns)


def filter_tracks_by_zones(
    df: DataFrame,
    zones: Sequence | None = None,
    method: str = "list",
    anchor: str = "bc",
    offset: Sequence[float] | None = None,
    zone_col: str = "zone",
    by: Sequence[str] = (),
    track: str = "track",
    label: str = "zone",
) -> DataFrame:
    """Zones that tracks enter. method list: all rows of a track once per zone it enters, with the zone's index;
    label: one row each, the index of the last zone entered or -1; filter: as label, without -1.

    label="matched" numbers only the zones that some track enters (per video, with `by`), in order.
    """
    _method(method, ("list", "label", "filter"))
    if label not in ("zone", "matched"):
        raise ValueError("label is zone or matched")
    if not zones:
        raise ValueError("zones are needed")
    point = ref_point(anchor, offset)
    flags = df.groupBy(*by, track).agg(*[F.bool_or(within_zone(*point, z)).alias(f"__z{k}") for k, z in enumerate(zones)])
    index = F.array_compact(F.array(*[F.when(F.col(f"__z{k}"), F.lit(k)) for k in range(len(zones))]))
    entered = flags.select(*by, track, F.explode(index).alias(zone_col))
    if label == "matched":
        # The zones entered are at most len(zones) per video.
        used = entered.select(*by, zone_col).distinct()
        order = Window.partitionBy(*by).orderBy(zone_col) if by else Window.partitionBy(F.lit(0)).orderBy(zone_col)
        used = used.withColumn("__rank", F.row_number().over(order) - 1)
        entered = entered.join(F.broadcast(used) if not by else used, [*by, zone_col]).select(*by, track, F.col("__rank").alias(zone_col))
    rows = df.drop(zone_col)
    if method == "list":
        return rows.join(entered, [*by, track])
    last = entered.groupBy(*by, track).agg(F.max(zone_col).alias(zone_col))
    out = rows.join(last, [*by, track], "inner" if method == "filter" else "left")
    return out.withColumn(zone_col, F.coalesce(F.col(zone_col), F.lit(-1)).cast("int"))


def filter_tracks_by_lines(df: DataFrame, lines: Sequence | None = None, method: str = "include", by: Sequence[str] = (), track: str = "track", ordered: bool = False) -> DataFrame:
    """Tracks that touch every line (in whichever frames); no lines: every track does. ordered sorts by frame and track."""
    return filter_tracks_by_lines_v2(df, lines, method, by=by, track=track, ordered=ordered)


def filter_tracks_by_lines_v2(
    df: DataFrame,
    lines: Sequence | None = None,
    method: str = "include",
    tolerance: int = 0,
    box_size: float = 0,
    forced: Sequence[int] | None = None,
    by: Sequence[str] = (),
    track: str = "track",
    ordered: bool = False,
    last_forced_only: bool = False,
) -> DataFrame:
    """Tracks that touch at least len(lines) - tolerance lines and all forced ones.

    A criterion outside 1 to len(lines) means all lines. box_size > 0 tests the square on the bottom centre
    instead of the box. last_forced_only enforces only the last forced index.
    """
    _method(method, ("include", "exclude"))
    lines = list(lines or [])
    need = len(lines) - tolerance
    need = need if 1 <= need <= len(lines) else len(lines)
    flags = df.groupBy(*by, track).agg(F.count(F.lit(1)).alias("__n"), *[F.bool_or(box_meets_line(line, box_size)).alias(f"__l{k}") for k, line in enumerate(lines)])
    count = reduce(lambda a, b: a + b, [F.col(f"__l{k}").cast("int") for k in range(len(lines))], F.lit(0))
    must = list(forced or [])[-1:] if last_forced_only else list(forced or [])
    ok = reduce(and_, [F.col(f"__l{k}") for k in must if 0 <= k < len(lines)], count >= need)
    hits = flags.where(ok).select(*by, track)
    out = df.join(hits, [*by, track], "left_semi" if method == "include" else "left_anti")
    return out.orderBy(*by, "frame", track) if ordered else out
