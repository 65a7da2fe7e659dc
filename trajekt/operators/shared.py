"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task sorts, and consecutive rows of a key that one window sees.
TASK_ROWS, CHUNK_ROWS = 250_000, 65_536


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where the session names none, a local master gets a temporary
    folder and any other an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_trajekt_dir", None) or tempfile.mkdtemp(prefix="trajekt-")
        spark._trajekt_dir = base
    return f"{base.rstrip('/')}/trajekt-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """df and `__row`: the number of a row among those of its keys in this order, from 1, as row_number gives it.

    With more than `rows` rows no task has a whole key to sort: rows are dealt by ranges of keys and order, sorted and
    written with their place; a row's number is its place after the first of its key in that range, and the key's rows in
    the ranges before.
    """
    parts = -(-df.count() // (rows or TASK_ROWS))
    if parts <= 1:
        return df.withColumn("__row", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)))
    sort = [*keys, *order]
    # The upper bits of the place are the range's number.
    d = written(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = d.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*([f"__key{i}" for i in range(len(keys))] or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
    sizes = written(sizes, f"{name}_sizes")
    same = part == F.col("__part")
    for i, k in enumerate(keys):
        same &= d[k].eqNullSafe(F.col(f"__key{i}"))
    return d.join(sizes, same).select(*[d[c] for c in df.columns], (F.col("__at") + F.col("__before")).alias("__row"))


def chunked(d: DataFrame, keys: Sequence[str], before: int, after: int, rows: int | None = None, chunk_rows: int | None = None) -> tuple[DataFrame, int]:
    """The rows of `numbered` in chunks of consecutive rows of their keys, to be used with windows over keys and `__chunk`, and
    the size of a chunk. Each row is `__own` in one chunk; copies give the own rows of others the `before` and `after` rows
    next to them."""
    size = max(chunk_rows or CHUNK_ROWS, before + after, 1)
    at = F.col("__row") - 1
    first, last = F.floor(F.greatest(at - after, F.lit(0)) / size), F.floor((at + before) / size)
    tasks = -(-d.count() // (rows or TASK_ROWS))
    d = d.withColumn("__chunk", F.explode(F.sequence(first, last))).withColumn("__own", F.floor(at / size) == F.col("__chunk"))
    return d.repartition(max(tasks, 1), *keys, "__chunk"), size


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of links (a, b) of one kind of value: rows (node, root) for every node, the root being the
    least node reachable. Large-star and small-star steps in turn, each round written, until all hang on their root."""
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(60):
        above = e.select(F.col("b").alias("a")).distinct().join(e.select("a").distinct(), "a", "left_semi")
        if above.union(e.groupBy("a").count().where("count > 1").select("a")).isEmpty():
            own = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
    raise RuntimeError("components did not settle")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by `keys`: tables of whole groups, with the groups' start rows and the end."""
    rest: list[pa.RecordBatch] = []

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if rest[0] is not batch and all(rest[0].column(k)[0].equals(batch.column(k)[-1]) for k in keys):
            continue  # still the one group
        table = pa.Table.from_batches(rest)
        last = int(starts_of(table)[-1])
        if last:
            done = table.slice(0, last)
            yield done, np.append(starts_of(done), last)
        rest = table.slice(last).to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.append(starts_of(table), table.num_rows)
