"""Vectors as fixed-width binaries, and what the two vector operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, more: list[str]) -> DataFrame:
    """id long, vec binary (float64, little endian), the columns `more`: vectors that are not null, empty or
    zero and hold no null or non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, v in enumerate(batch.column(1)):
                if v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        keep.append(k)
                        out.append(x.tobytes())
            rest = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(out, pa.binary()), *rest.columns[2:]], ["id", "vec", *more])

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *more).where("id is not null")
    schema = "id long, vec binary" + "".join(f", `{c}` {d.schema[c].dataType.simpleString()}" for c in more)
    return d.mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long float64 vectors."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def sample(df: DataFrame, rows: int, total: int, seed: int) -> np.ndarray:
    """About `rows` vectors at most, chosen by a hash of the id."""
    rate = min(1.0, rows / max(total, 1))
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    got = sorted((r["id"], r["vec"]) for r in df.where(u).select("id", "vec").collect())[: 2 * rows]
    return np.frombuffer(b"".join(bytes(v) for _, v in got), np.float64).reshape(len(got), -1) if got else np.zeros((0, 1))


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means of a sample; empty clusters keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c
