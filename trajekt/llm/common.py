"""Shared pieces: written intermediate tables, whole-group Arrow batches, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a written file holds at least, where its table has as much.
FILE_BYTES = 2 << 20
FILE_ROWS = 20_000
# Python works on slices of a batch of at most this many text bytes (or one text).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where the cluster names none, only a local master may use a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_trajekt_dir", None) or tempfile.mkdtemp(prefix="trajekt-")
        spark._trajekt_dir = path
    return path.rstrip("/")


def fresh(df: DataFrame) -> str:
    """A prefix that no column of df begins with, for an operator's own columns."""
    own = "_"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return own


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def packed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in no more partitions than its scanned bytes (or `rows`, where a bound is known) fill.

    An input of many tiny files would otherwise be written again as many tiny files, each of which costs the file
    system several calls and, on local disks, processes. Partitions of FILE_BYTES scanned and more are left alone, as are
    two for every core.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scanned = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, scanned // FILE_BYTES)
    if rows is not None:
        most = min(most, -(-rows // FILE_ROWS))
    return df.coalesce(max(1, min(most, 1 << 30)))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    Lost executors cost no recomputation, and the planner knows the table's real size when it chooses between
    broadcast and shuffle joins. rows: a known bound of its rows. What the application wrote is deleted when it ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/trajekt-{spark.sparkContext.applicationId}"
    if getattr(spark, "_trajekt_written", None) != folder:
        fs, at = _file_system(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        spark._trajekt_written = folder
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    packed(df, rows).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trajekt_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    fs, at = _file_system(df.sparkSession, df._trajekt_path)
    fs.delete(at, True)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined to table (one row a key) on keys, without `weight`, the number of rows that a key has.

    Keys of over a thousandth of all these rows are less than a thousand: they are broadcast, and no other key is
    frequent enough to skew the join of the rest.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = F.broadcast(table.where(F.col(weight) * 1000 > total).drop(weight))
    cold = table.where(F.col(weight) * 1000 <= total).drop(weight)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def sieve(rows: DataFrame, keys: list[str], among: DataFrame, others: list[str], bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys may occur in `among` (all that do, and some more), and the others.

    One bit a hash of the keys, in 2 ** (bits - 6) words at most, which are broadcast: a bound that holds at every size. With
    far more keys than bits all rows come out as such that may occur.
    """
    at = lambda cols: F.shiftrightunsigned(F.xxhash64(F.lit(24), *cols), 64 - bits)
    place = lambda cols: F.shiftright(at(cols), 6)
    bit = lambda cols: (at(cols) % 64).cast("int")
    own = fresh(rows)
    words = among.groupBy(place(others).alias(f"{own}word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(others))).alias(f"{own}bits"))
    marked = rows.withColumn(f"{own}word", place(keys)).join(F.broadcast(words), f"{own}word", "left")
    may = F.coalesce(F.getbit(f"{own}bits", bit(keys)) == 1, F.lit(False))
    return tuple(marked.where(c).select(*[F.col(f"`{c}`") for c in rows.columns]) for c in (may, ~may))


def text_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges that hold at most `limit` bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by `keys`: tables of whole groups, with the groups' start rows and the end."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rest.append(batch)
        table = pa.Table.from_batches(rest).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            x = table[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            last = int(starts[-1])
            yield table.slice(0, last), np.concatenate([[0], starts])
            rest = table.slice(last).to_batches()
        else:
            rest = table.to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            x = table[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        yield table, np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
# Texts are hashed in blocks of this many bytes, so that scratch space does not depend on their length.
BLOCK_BYTES = 1 << 16


def _powers(base: int) -> np.ndarray:
    p = np.full(BLOCK_BYTES + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z lower-cased, and each text's first word (plus the end).

    A word's hash is a sum over its bytes, so a word cut by the end of a block is put together from its parts.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n, out, first_word = len(raw), [], np.zeros(len(offsets), np.int64)
    begun, open_hash, open_length = 0, 0, 0
    for p in range(0, n, BLOCK_BYTES):
        q = min(n, p + BLOCK_BYTES)
        part = raw[p:q]
        inside = ~_SPACE[part]
        cut = np.zeros(q - p + 1, bool)
        lo, hi = np.searchsorted(offsets, (p, q))
        cut[offsets[lo : np.searchsorted(offsets, q, side="right")] - p] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
        own = begin[1:] if open_length else begin
        first_word[lo:hi] = begun + np.searchsorted(own, offsets[lo:hi] - p)
        begun += len(own)
        total = np.cumsum(_BYTE[part] * _POWER[: q - p], dtype=np.uint64)
        h, length = total[end], (end - begin + 1).astype(np.uint64)
        later = begin > 0
        h[later] -= total[begin[later] - 1]
        h *= _INVERSE[begin]
        if open_length:
            h[0] = (open_hash + int(h[0]) * pow(_BASE, open_length, 1 << 64)) % (1 << 64)
            length[0] += np.uint64(open_length)
        if q < n and inside[-1] and not cut[-1] and not _SPACE[raw[q]]:
            open_hash, open_length = int(h[-1]), int(length[-1])
            h, length = h[:-1], length[:-1]
        else:
            open_length = 0
        out.append(mix(h + length * np.uint64(0xD6E8FEB86659FD93)))
    first_word[np.searchsorted(offsets, n) :] = begun
    return np.concatenate(out or [np.zeros(0, np.uint64)]), first_word


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a-b, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


class Forest:
    """Links seen by one task, thinned to those that join something new; forgets itself at `limit` nodes."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.up: dict[int, int] = {}

    def _root(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mask of the links that no chain of links before them implies."""
        if len(self.up) > self.limit:
            self.up = {}
        out = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self._root(x), self._root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out[k] = True
        return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of links (a, b), both long: rows (node, root), root the least node reachable.

    Alternates large-star and small-star steps until every node hangs on its root; each round is
    written to the shared folder (and the one before deleted), and no step brings the links of a node into one task
    except as partial minima and skew-splittable joins. Nodes without links are not returned.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, f"{name}-links")
    n = e.count()
    for turn in range(60):
        inner = e.select(F.col("b").alias("a")).distinct().join(e.select("a").distinct(), "a", "left_semi")
        more = e.groupBy("a").count().where("count > 1").select("a")
        if inner.union(more).isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A round never makes more links than there were.
        last, e = e, written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}", n)
        forget(last)
    raise RuntimeError("components did not settle")
