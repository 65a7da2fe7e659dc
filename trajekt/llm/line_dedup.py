"""Line dedup: explode and hash normalised lines, count documents per hash, drop the common ones, reassemble by position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, sieve, written

STRIP = " \t\n\v\f\r"


def lines_of(text: Column) -> Column:
    """A text's lines; null has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line with its edges stripped of ASCII white space and A-Z lower-cased (by the faster lower where all is ASCII)."""
    line = F.btrim(line, F.lit(STRIP))
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def without(lines: Column, gone: Column) -> Column:
    """An array without the positions (from 0, ascending) of another, put together from the runs between them."""
    begin = lambda k: F.coalesce(F.get(gone, k - 1) + 1, F.lit(0))
    end = lambda k: F.coalesce(F.get(gone, k), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k))))


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that many documents hold, from all but the document with the largest id.

    docs: any columns; id_col long and text_col string are read. A line's key is the line with ASCII
    white space stripped at both ends and A-Z lower-cased; lines are cut at "\\n". Keys of at least
    min_chars code points found in at least min_docs distinct ids lose all their lines except in the
    largest id that holds them; the other lines stay, joined by "\\n".

    Returns all columns of docs with the text replaced (null stays null), then kept_lines and
    dropped_lines (int; clashing names in docs are replaced). Null or empty text: one empty line, never
    dropped. Rows of one id count once and share decisions, whatever their texts; a null id counts as no document,
    and its rows lose every common line. Empty input gives an empty result.

    Long lines are exploded with their position and shuffled as 16-byte hashes; a line in a third of all documents is
    counted by partial aggregation and found again by a broadcast of the less than a thousand hottest keys. The
    positions to drop meet their document in a merge join (the same plan at every size); documents that a
    sieve of bounded size shows to lose nothing pass it by and are not shuffled. All of it runs in the JVM.
    """
    own = fresh(docs)
    names = [c for c in docs.columns if c not in ("kept_lines", "dropped_lines")]
    cols = [F.col(f"`{c}`") for c in names]
    text = F.col(f"`{text_col}`")
    # A row is known by its id and text; equal rows lose the same lines.
    row = [F.col(f"`{id_col}`").cast("long").alias(f"{own}id"), F.xxhash64(text).alias(f"{own}text")]
    held = docs.select(*row, F.posexplode(lines_of(text)).alias("pos", "line")).where(F.length("line") >= min_chars)
    held = held.select(F.col(f"{own}id").alias("id"), F.col(f"{own}text").alias("row"), "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    held = written(held.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(8), "key").alias("h2")), "lines")
    found = held.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"), F.count("*").alias("rows"))
    common = written(found.where(F.col("n") >= min_docs).select("h1", "h2", "last", "rows"), "common-lines")
    drops = join_hot(held, common, ["h1", "h2"], "rows").where(~F.col("id").eqNullSafe(F.col("last")))
    drops = written(drops.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "line-drops")
    drops = drops.select(F.col("id").alias(f"{own}i"), F.col("row").alias(f"{own}r"), F.col("gone").alias(f"{own}gone"))
    rows = docs.select(*cols, *row)
    asked, rest = sieve(rows, [f"{own}id", f"{own}text"], drops, [f"{own}i", f"{own}r"])
    lines, gone = lines_of(text), F.coalesce(f"{own}gone", F.array().cast("array<int>"))
    same = F.col(f"{own}id").eqNullSafe(F.col(f"{own}i")) & (F.col(f"{own}text") == F.col(f"{own}r"))
    changed = asked.join(drops.hint("merge"), same, "left").withColumn(f"{own}kept", F.when(F.col(f"{own}gone").isNotNull(), without(lines, gone)))
    new = F.when(F.col(f"{own}kept").isNull(), text).otherwise(F.array_join(f"{own}kept", "\n"))
    out = changed.select(
        *[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.size(F.coalesce(f"{own}kept", lines)).alias("kept_lines"),
        F.size(gone).alias("dropped_lines"),
    )
    return out.union(rest.select(*cols, F.size(lines).alias("kept_lines"), F.lit(0).alias("dropped_lines")))
