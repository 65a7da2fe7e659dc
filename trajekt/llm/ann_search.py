"""Approximate nearest neighbours: adaptive dimension scan of rotated vectors within probed lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import centroids, matrix, rotation, sample, valid_vectors

SEED = 404
COLUMNS = 16
# Queries whose true neighbours set the number of lists probed.
TRIED = 256
# Standard errors by which a partial product must fall short before a candidate is abandoned.
ERRORS = 3.5
LIST_BLOCK = 8192
QUERY_BLOCK = 2048


def scan(queries: np.ndarray, rows: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that survive the scan, column block after column block.

    Both are rotated at random. Hypothesis of the test: the pair's cosine is at least c, the one that gives the query's
    k-th best product so far. Seen from the query, the row is then c times it plus sqrt(1 - c^2) times a random
    direction at right angles to it; so if the query has the share s of its squared length in the columns seen, their
    product (of unit vectors) has mean c * s and standard deviation sqrt((1 - c^2) * s * (1 - s) / (dim - 1)). A
    candidate is abandoned as soon as its product lies ERRORS of these below the mean. Nothing is taken to be
    unlike the query in the columns not yet seen, so near copies pass.
    """
    dim = queries.shape[1]
    cuts = list(range(0, dim, COLUMNS)) + [dim]
    size_q, size_r = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    unit_q, unit_r = queries / size_q[:, None], rows / size_r[:, None]
    share = np.stack([(unit_q[:, :c] ** 2).sum(axis=1) for c in cuts])
    spread = ERRORS * np.sqrt(np.maximum(share * (1 - share), 0) / max(dim - 1, 1))
    # Below this cosine a larger one would allow a smaller product; its limit then holds for all.
    turn = -share / np.maximum(np.hypot(share, spread), 1e-300)
    bound = np.full(len(queries), -np.inf)
    best = np.full((len(queries), k), -np.inf)
    out_q, out_r = [], []

    def live(n: int, q, r, sums: np.ndarray) -> np.ndarray:
        c = np.clip(bound[q] / (size_q[q] * size_r[r]), turn[n][q], None)
        least = c * share[n][q] - spread[n][q] * np.sqrt(np.maximum(1 - c * c, 0))
        return (sums >= least - 1e-9) & (c <= 1 + 1e-9)

    for start in range(0, len(rows), step):
        part = unit_r[start : start + step]
        sums = unit_q[:, : cuts[1]] @ part[:, : cuts[1]].T
        keep = live(1, np.arange(len(queries))[:, None], np.arange(start, start + len(part))[None], sums)
        for n in range(1, len(cuts) - 1):
            a, b = cuts[n], cuts[n + 1]
            q, r = np.nonzero(keep)
            if len(q) * 32 > keep.size:
                sums += unit_q[:, a:b] @ part[:, a:b].T
            else:
                sums[q, r] += np.einsum("ij,ij->i", unit_q[q, a:b], part[r, a:b])
            if b < dim:
                keep[q, r] = live(n + 1, q, start + r, sums[q, r])
        q, r = np.nonzero(keep)
        sums = sums[q, r] * size_q[q] * size_r[start + r]
        near = sums >= bound[q] - 1e-9 * size_q[q] * size_r[start + r]
        q, r, sums = q[near], r[near], sums[near]
        out_q.append(q)
        out_r.append(r + start)
        full = np.full((len(queries), len(part)), -np.inf)
        full[q, r] = sums
        best = np.concatenate([best, full], axis=1)
        best = -np.partition(-best, k - 1, axis=1)[:, :k]
        bound = best.min(axis=1)
    return np.concatenate(out_q), np.concatenate(out_r)


def probes_for(rows: DataFrame, q: np.ndarray, ids: np.ndarray, centers: np.ndarray, k: int, goal: float) -> int:
    """Lists to probe so that the true neighbours of some queries, found among all rows, are met with the recall wanted.

    rows: id, vec, list. Every batch of rows gives the k best of its own for each query, a window their best.
    """

    def nearest(batches):
        for batch in batches:
            held = batch.column("id").to_numpy()
            score = q @ matrix(batch.column("vec")).T
            score[ids[:, None] == held[None]] = -np.inf
            n = min(k, len(held))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            lists = batch.column("list").to_numpy()[at]
            got = [pa.array(np.repeat(np.arange(len(q)), n), pa.int32()), pa.array(lists.ravel(), pa.int32()), pa.array(np.take_along_axis(score, at, axis=1).ravel())]
            yield pa.RecordBatch.from_arrays(got, ["q", "list", "score"])

    got = rows.mapInArrow(nearest, "q int, list int, score double").where(F.col("score") > F.lit(float("-inf")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))
    found = got.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "list").collect()
    if not found:
        return len(centers)
    order = np.argsort(-(q @ centers.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centers))[None, :], axis=1)
    need = place[[r["q"] for r in found], [r["list"] for r in found]]
    return int(np.quantile(need, goal, method="higher")) + 1


def search(
    df: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 8_192,
    rows_per_list: int = 8_192,
    recall: float = 0.985,
) -> DataFrame:
    """The k rows of largest inner product for each row that is_query selects, among all other rows.

    df: any columns; id_col (long), vector_col (array of numbers) and what is_query names are read. Vectors
    that are null, empty or zero or hold null or non-finite components take no part, nor do those whose
    length is not the most frequent one. Rows of one id count as one vector (one of them is taken).

    Returns query_id long, rank int (from 1), vec_id long, score double: the exact inner product of the
    original vectors in double precision, best first, ties to the smaller id. Fewer than k candidates
    are all returned; empty input gives an empty result.

    Inverted lists: centres come from a bounded sample, every row is indexed; the number of lists probed is
    set so that the true neighbours of about TRIED queries, compared with all rows, are found at `recall`. Hot lists are split into blocks, and a task
    gets one block with up to QUERY_BLOCK of the queries that probe it, so neither side gathers in a task.
    Each block gives at most k rows per query, which a window then ranks.
    """
    spark = df.sparkSession
    d = valid_vectors(df.withColumn("__q", F.coalesce(is_query, F.lit(False))), id_col, vector_col, ["__q"])
    d = written(d.withColumn("dim", F.length("vec")).dropDuplicates(["id"]), "ann-rows")
    common = d.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, total = (common["dim"], common["count"]) if common else (8, 0)
    d = d.where(F.col("dim") == dim)
    x = sample(d, sample_rows, total, SEED)
    centers = centroids(x, max(16, min(4096, total // rows_per_list)), SEED) if len(x) else np.zeros((1, dim // 8))
    index = spark.sparkContext.broadcast(centers)

    def to_list(batches):
        centers = index.value
        for batch in batches:
            v = matrix(batch.column(1))
            own = (v @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], ["id", "vec", "list"])

    def to_probes(batches):
        centers = index.value
        for batch in batches:
            v = matrix(batch.column(1))
            n = min(probes, len(centers))
            lists = np.argpartition(-(v @ centers.T), n - 1, axis=1)[:, :n] if len(v) else np.zeros((0, n))
            rows = batch.take(pa.array(np.repeat(np.arange(len(v)), n)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lists.ravel(), pa.int32())], ["id", "vec", "list"])

    rows = written(d.select("id", "vec").mapInArrow(to_list, "id long, vec binary, list int"), "ann-lists")
    tried = sorted((r["id"], r["vec"]) for r in d.where("__q").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(TRIED).select("id", "vec").collect())
    probes = 1
    if tried:
        q = np.frombuffer(b"".join(bytes(v) for _, v in tried), np.float64).reshape(len(tried), -1)
        probes = probes_for(rows, q, np.array([i for i, _ in tried]), centers, k, recall)
    asks = written(d.where("__q").select("id", "vec").mapInArrow(to_probes, "id long, vec binary, list int"), "ann-probes")
    rows_in = rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(LIST_BLOCK)).cast("int").alias("rb"))
    asks_in = asks.groupBy("list").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("qb"))
    sizes = written(rows_in.join(asks_in, "list"), "ann-sizes")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(F.lit(SEED), "id"), F.col(n).cast("long")).cast("int")
    left = asks.join(sizes, "list").select("list", own("qb").alias("q"), blocks("rb").alias("r"), "id", "vec")
    right = rows.join(sizes, "list").select("list", blocks("qb").alias("q"), own("rb").alias("r"), "id", "vec")

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        a, b = matrix(asked["vec"]), matrix(held["vec"])
        qid, rid = asked["id"].to_numpy(), held["id"].to_numpy()
        turn = rotation(a.shape[1], SEED)
        q, r = scan(a @ turn.T, b @ turn.T, k + 1)
        other = qid[q] != rid[r]
        q, r = q[other], r[other]
        score = np.concatenate([np.einsum("ij,ij->i", a[q[m : m + 65_536]], b[r[m : m + 65_536]]) for m in range(0, len(q), 65_536)] or [np.zeros(0)])
        order = np.lexsort((rid[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = place < k
        return pa.table([qid[q[top]], rid[r[top]], score[top]], schema=schema)

    found = left.groupBy("list", "q", "r").cogroup(right.groupBy("list", "q", "r")).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
