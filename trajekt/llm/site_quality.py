"""Quality by hierarchical empirical Bayes: document evidence, path and host posteriors, global priors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .toxicity import linear_classifier

FEATURES = 12
_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[float]:
    """Bounded figures of a whole text: shares of letters, digits, blanks, marks and capitals, repetition, lengths."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    letters = _LETTERS.findall(text)
    lettered = sum(map(len, letters))
    lines = text.count("\n") + 1
    return [
        lettered / n,
        sum(map(text.count, "0123456789")) / n * 4,
        (text.count(" ") + text.count("\n")) / n,
        min(1.0, (n - lettered - text.count(" ") - text.count("\n")) / n * 4),
        min(1.0, sum(w.isupper() and len(w) > 1 for w in letters) / m),
        len(counts) / m,
        counts.most_common(1)[0][1] / m if counts else 1.0,
        pairs / m,
        min(1.0, np.log1p(m) / 10),
        min(1.0, lettered / max(1, len(letters)) / 12),
        min(1.0, lines / m),
        min(1.0, text.count("|") / m),
    ]


@dataclass
class Classifier:
    weights: list[float]
    bias: float
    mean: list[float]
    scale: list[float]
    prior: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad, without the prior."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ np.array(self.weights) + self.bias
        return np.clip(z - np.log(self.prior / (1 - self.prior)), -20, 20)


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, max_rows: int = 12_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """A linear classifier of text figures from about max_rows labelled rows, drawn by a hash of the id.

    Without labels of both kinds it gives no evidence.
    """
    y = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    total = max(1, y.count())
    u = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) < int(min(1.0, max_rows / total) * (1 << 30)) + 1
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(y.where(u)), "i").select("t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").collect()
    x, t = np.array([r["x"] for r in got], float).reshape(-1, FEATURES), np.array([r["y"] for r in got], float)
    if not len(t) or t.min() == t.max():
        prior = float((t.sum() + 1) / (len(t) + 2))
        return Classifier([0.0] * FEATURES, float(np.log(prior / (1 - prior))), [0.0] * FEATURES, [1.0] * FEATURES, prior)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w, b = linear_classifier(np.clip((x - mean) / scale, -6, 6), t, l2=1.0, rounds=600)
    return Classifier(w.tolist(), b, mean.tolist(), scale.tolist(), float(t.mean()))


def classify(docs: DataFrame, model: Classifier, *, id_col: str, text_col: str, host: Column, path: Column, threshold: float = 0.5) -> DataFrame:
    """Combine each document's evidence with what its path and host are known for.

    docs: any columns; id_col, text_col and what host and path name are read. Nulls of host and path are
    sites of their own; null and empty texts have the evidence of their figures; repeated rows count
    each; empty input gives an empty result.

    Returns id_col, host, path string, evidence double (log likelihood ratio), host_rate and path_rate double
    (posterior means without this row), score double (probability of good quality), kept boolean
    (score >= threshold).

    A row's own probability is prior and evidence. Sums of it per path and per host give, by the method of
    moments, how strongly hosts differ from the whole and paths from their host; a host's posterior mean
    shrinks to the global rate and a path's to its host's, the more the fewer rows there are. Sums are
    partial aggregates of narrow rows; texts are never shuffled, and no site's rows meet in one task.
    """
    names = ["id", "host", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(3).to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(model.evidence(x))], [*names, "evidence"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    logit = float(np.log(model.prior / (1 - model.prior)))
    rows = d.mapInArrow(run, "id long, host string, path string, evidence double")
    rows = written(rows.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + logit)))), "quality-rows")
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "quality-hosts")
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    rate = (whole["s"] + 1) / (whole["n"] + 2) if whole["n"] else model.prior

    def strength(spread: float | None, weight: float | None, mean: float) -> float:
        """Prior rows of a beta distribution with this mean and variance; 1 to 10,000."""
        v = (spread or 0.0) / weight if weight else 0.0
        return float(np.clip(mean * (1 - mean) / v - 1, 1, 10_000)) if v > 1e-9 else 10_000.0

    h = hosts.agg(F.sum(F.col("hn") * (F.col("hs") / F.col("hn") - rate) ** 2 - rate * (1 - rate)).alias("v"), F.sum("hn").alias("w")).first()
    of_host = strength(h["v"], h["w"], rate)
    hosts = hosts.withColumn("host_prior", (F.col("hs") + of_host * rate) / (F.col("hn") + of_host))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"].alias("h"), paths["path"].alias("q"), "n", "s", "hn", "hs", "host_prior")
    m = F.col("host_prior")
    p = joined.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - m) ** 2 - m * (1 - m)).alias("v"), F.sum("n").alias("w")).first()
    of_path = strength(p["v"], p["w"], rate)
    sites = written(joined, "quality-sites")
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    out = out.withColumn("host_rate", (F.col("hs") - F.col("p") + of_host * rate) / (F.col("hn") - 1 + of_host))
    out = out.withColumn("path_rate", (F.col("s") - F.col("p") + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path))
    safe = F.least(F.greatest("path_rate", F.lit(1e-4)), F.lit(1 - 1e-4))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.ln(safe / (1 - safe))))))
    return out.select(F.col("id").alias(id_col), "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))
