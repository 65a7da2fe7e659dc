"""Embedding near-dedup: binary codes of randomly rotated vectors with correction factors decide which pairs are recomputed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, least_labels, whole_groups, written
from .vectors import centroids, matrix, rotation, sample, valid_vectors

# Vectors that are compared at a time in a task, which gets two blocks of them, and how many of these at once.
BLOCK = 4096
TILE = 512
SEED = 711
# Pairs are rejected only where a cosine at the threshold would put the estimate this many standard errors away.
ERRORS = 6.0


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors, and the factor <code, vector> that corrects the estimate."""
    turned = unit @ turn.T
    code = np.where(turned >= 0, np.float32(1), np.float32(-1))
    return code, np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def doubtful(query: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (query row, code row) whose cosine may reach the threshold.

    <code, query> / (sqrt(dim) * factor) is unbiased for <vector, query>; given the cosine c its standard error
    is sqrt(1 - factor^2) / factor * sqrt(1 - c^2) / sqrt(dim - 1).
    """
    dim = code.shape[1]
    estimate = (query.astype(np.float32) @ code.T) / (np.sqrt(dim) * factor).astype(np.float32)
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * np.sqrt(max(1 - threshold**2, 0)) / np.sqrt(max(dim - 1, 1))
    return estimate >= (threshold - ERRORS * error - 1e-4).astype(np.float32)


def _pairs(query: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The doubtful pairs, tile by tile; of a block with itself each pair once."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(query), TILE):
        for b in range(a if same else 0, len(code), TILE):
            i, j = np.nonzero(doubtful(query[a : a + TILE], code[b : b + TILE], factor[b : b + TILE], threshold))
            i, j = i + a, j + b
            once = i < j if same else slice(None)
            rows.append(i[once])
            cols.append(j[once])
    return np.concatenate(rows), np.concatenate(cols)


def near_duplicate_vectors(
    df: DataFrame,
    *,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str = "label",
    sample_rows: int = 16_384,
    rows_per_cell: int = 32_768,
) -> DataFrame:
    """Link vectors of one group whose cosine (double precision) is at least threshold.

    df: any columns; id_col (long), vector_col (array of numbers) and group_col are read. Vectors that are
    null, empty or zero, hold null or non-finite components, or have a null group link with nothing;
    neither do vectors of different length. Rows of one id should agree; they are kept as rows, and
    count as one vector.

    Returns one row per row of df: id_col, n_links long (other vectors linked directly), component_id long
    (least id reachable), kept boolean (id = component_id). A null id has 0 links, a null component and
    stays. Empty input gives an empty result.

    Equal vectors of a group are one class, so copies are counted, not paired. Within a group, vectors
    belong to the nearest of a few pivots (fitted on a bounded sample); two such cells are compared only if
    their pivots' angle and radii leave room for a link, which loses nothing. The 64 most frequent lengths have
    pivots; vectors of any other length are one cell, all compared. Cells are dealt to blocks of
    BLOCK rows, and a task gets one pair of blocks: sign codes of rotated vectors and their stored
    correction factors give unbiased estimates; pairs whose confidence bound reaches the threshold are
    recomputed exactly. Out come link counts and spanning forests, never the pairs.
    """
    spark = df.sparkSession
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(group_col).alias("g"))
    ok = valid_vectors(d.where("g is not null").withColumn("h", F.xxhash64("g")), "id", "v", ["h"])
    classes = ok.groupBy("h", "vec").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    classes = written(classes.withColumn("dim", F.length("vec")), "vec-classes")
    dims = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, total in dims.items():
        x = sample(classes.where(F.col("dim") == dim).withColumnRenamed("rep", "id"), sample_rows, total, SEED)
        if not len(x):
            continue
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        c = centroids(x, max(1, min(512, total // rows_per_cell)), SEED)
        norms = np.linalg.norm(c, axis=1, keepdims=True)
        pivots[dim] = np.where(norms > 1e-9, c / np.maximum(norms, 1e-9), np.eye(1, c.shape[1]))
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, angles = [], []
            for raw in batch.column(1).to_pylist():
                p = shared.value.get(len(raw))
                v = np.frombuffer(raw, np.float64)
                dots = p @ (v / np.linalg.norm(v)) if p is not None else np.zeros(1)
                cells.append(int(dots.argmax()))
                angles.append(float(np.arccos(np.clip(dots.max(), -1, 1))) if p is not None else np.pi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(angles, pa.float64())], ["h", "vec", "rep", "copies", "dim", "cell", "angle"])

    placed = written(classes.select("h", "vec", "rep", "copies", "dim").mapInArrow(place, "h long, vec binary, rep long, copies long, dim int, cell int, angle double"), "vec-placed")
    cells = placed.groupBy("h", "dim", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    cells = cells.withColumn("nb", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    angle_of = [(int(dim), a, b, float(np.arccos(np.clip(p[a] @ p[b], -1, 1)))) for dim, p in pivots.items() for a in range(len(p)) for b in range(a, len(p))]
    between = spark.createDataFrame(angle_of or [(0, 0, 0, 0.0)], "dim int, ca int, cb int, apart double")
    bare = cells.where(~F.col("dim").isin(list(pivots))).select("dim").distinct()
    between = between.union(bare.select("dim", F.lit(0), F.lit(0), F.lit(0.0)))
    reach = float(np.arccos(threshold)) + 1e-6
    ends = lambda s: cells.select("h", "dim", F.col("cell").alias(f"c{s}"), F.col("nb").alias(f"nb{s}"), F.col("radius").alias(f"r{s}"))
    pairs = between.join(ends("a"), ["dim", "ca"]).join(ends("b"), ["h", "dim", "cb"]).where(F.col("apart") <= F.col("ra") + F.col("rb") + reach)
    blocks = pairs.withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("nba") - 1))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nbb") - 1)))
    blocks = blocks.where("ca < cb or ba <= bb").select("h", "dim", "ca", "ba", "cb", "bb", F.xxhash64("h", "dim", "ca", "ba", "cb", "bb").alias("unit"))
    blocks = written(blocks, "vec-blocks")
    rows = placed.join(cells.select("h", "dim", "cell", "nb"), ["h", "dim", "cell"])
    rows = rows.select("h", "dim", "cell", F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("nb").cast("long")).cast("int").alias("block"), "rep", "copies", "vec")
    first = blocks.select("h", "dim", F.col("ca").alias("cell"), F.col("ba").alias("block"), "unit", F.lit(0).alias("side"))
    second = blocks.where("ca <> cb or ba <> bb").select("h", "dim", F.col("cb").alias("cell"), F.col("bb").alias("block"), "unit", F.lit(1).alias("side"))
    dealt = rows.join(first.union(second), ["h", "dim", "cell", "block"])
    dealt = dealt.select("unit", "side", "rep", "copies", "vec").repartition("unit").sortWithinPartitions("unit", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for table, starts in whole_groups(batches, ["unit"]):
            side, reps, copies = (table[c].to_numpy() for c in ("side", "rep", "copies"))
            out = {"rep": [], "n": [], "to": []}
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                m = a + int((side[a:b] == 0).sum())
                x = matrix(table["vec"].slice(a, b - a))
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                if x.shape[1] not in turns:
                    turns[x.shape[1]] = rotation(x.shape[1], SEED)
                turn = turns[x.shape[1]]
                left, right = x[: m - a], x[m - a :] if m < b else x
                code, factor = encode(right, turn)
                i, j = _pairs(left @ turn.T, code, factor, threshold, m == b)
                if m < b:
                    j = j + (m - a)
                exact = np.concatenate([(x[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)])
                i, j = i[exact >= threshold], j[exact >= threshold]
                ids, many = reps[a:b], copies[a:b]
                count = np.bincount(i, many[j], b - a) + np.bincount(j, many[i], b - a)
                label = least_labels(b - a, i, j)
                hit = np.flatnonzero(count)
                out["rep"].append(ids[hit])
                out["n"].append(count[hit].astype(np.int64))
                out["to"].append(ids[label[hit]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v or [np.zeros(0, np.int64)]), pa.int64()) for v in out.values()], list(out))

    links = written(dealt.mapInArrow(compare, "rep long, n long, to long"), "vec-links")
    direct = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = written(components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")), "vec"), "vec-roots")
    found = classes.select("h", "vec", "rep", "copies").join(direct, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("h", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    ids = ok.join(found, ["h", "vec"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    out = d.select("id").join(ids, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
