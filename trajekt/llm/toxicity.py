"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MEMO_WORDS = 400_000
# Lexicon voters for and against; each holds every so-manieth unit of its side.
LEXICONS_FOR, LEXICONS_AGAINST = 24, 8
# G-squared, halved, that a unit of a lexicon has at least; few of 100,000 units get there by chance.
LEAST_EVIDENCE = 8.0
_WORDS = re.compile(r"[^\W\d_]+")
# Pattern voters, of form only, and what they vote (1: toxic, -1: not).
PATTERNS = {
    "shouting": (r"(?:\b[A-Z]{4,}\b[\s,!]+){4}", 1),
    "masked": (r"\b\w+[@$*#]{2,}\w+\b", 1),
    "exclaimed": (r"!{3,}", 1),
    "stretched": (r"([a-z])\1{3,}", 1),
    "tabular": (r"\|[^|\n]+\|", -1),
    "figures": (r"\d{4,}", -1),
    "address": (r"https?://|@\w+\.\w+", -1),
}
_PATTERNS = [(re.compile(p), v) for p, v in PATTERNS.values()]


def units(word: str) -> list[str]:
    """What of a lower-cased word can vote: the word, and its beginnings of 3 to 6 letters (marked by a final *)."""
    return [word, *(word[:n] + "*" for n in range(3, min(len(word), 7)))]


@dataclass
class Model:
    """Units and patterns with the classifier's weights."""

    weights: dict[str, float]
    patterns: list[float]
    bias: float


def _tokens(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per unit, summed per slice."""
    for batch in batches:
        for start, stop in text_slices(batch.column(0)):
            n: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0)[start:stop].to_pylist(), batch.column(1)[start:stop].to_pylist()):
                for u in {u for w in _tokens(text or "") for u in units(w)}:
                    n.setdefault(u, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["unit", "n0", "n1"])


def _hits_of(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, patterns = [], []
            for text in batch.column(0).to_pylist():
                words = _tokens(text or "")
                hits.append(sorted({vocabulary[u] for w in words for u in units(w) if u in vocabulary}))
                patterns.append([int(bool(p.search(text or ""))) for p, _ in _PATTERNS])
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), pa.array(patterns, pa.list_(pa.int32())), batch.column(1)], ["hits", "patterns", "y"])

    return run


def _tables(votes: np.ndarray, parent: np.ndarray, post: np.ndarray, shrink: float = 4.0) -> list[np.ndarray]:
    """log P(vote | label, parent's vote) of every voter, 2 x 3 x 3; few rows shrink it to log P(vote | label)."""
    out = []
    for j, up in enumerate(parent):
        v = votes[:, j] + 1
        of = votes[:, up] + 1 if up >= 0 else np.ones(len(v), int)
        c = np.stack([np.bincount(of * 3 + v, w, 9).reshape(3, 3) for w in (1 - post, post)])
        own = c.sum(axis=1) + 0.1
        own /= own.sum(axis=1, keepdims=True)
        out.append(np.log((c + shrink * own[:, None, :]) / (c.sum(axis=2, keepdims=True) + shrink)))
    return out


def _posterior(votes: np.ndarray, parent: np.ndarray, tables: list[np.ndarray], prior: float) -> np.ndarray:
    logit = np.full(len(votes), np.log(prior / (1 - prior)))
    for j, (up, t) in enumerate(zip(parent, tables)):
        of = votes[:, up] + 1 if up >= 0 else 1
        logit += t[1, of, votes[:, j] + 1] - t[0, of, votes[:, j] + 1]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def dependencies(votes: np.ndarray, post: np.ndarray, least: float = 0.002, share: float = 0.0) -> np.ndarray:
    """Each voter's parent (-1: none) in the forest of strongest dependencies: pairs whose votes tell of one another, given
    the label, at least `least` nats a row and at least `share` of what the less informative of them could."""
    n, m = votes.shape
    entropy = lambda p: -float((p[p > 0] * np.log(p[p > 0])).sum())
    links = []
    for i in range(m):
        for j in range(i):
            told = own_i = own_j = 0.0
            for w in (1 - post, post):
                c = np.bincount((votes[:, i] + 1) * 3 + votes[:, j] + 1, w, 9).reshape(3, 3)
                total = max(c.sum(), 1e-12)
                c /= total
                one, two = entropy(c.sum(axis=1)), entropy(c.sum(axis=0))
                told += (one + two - entropy(c)) * total / n
                own_i, own_j = own_i + one * total / n, own_j + two * total / n
            if told >= max(least, share * min(own_i, own_j)):
                links.append((told, i, j))
    parent, near = np.full(m, -1), [set() for _ in range(m)]
    tree = np.arange(m)
    for _, i, j in sorted(links, reverse=True):
        if tree[i] != tree[j]:
            tree[tree == tree[i]] = tree[j]
            near[i].add(j)
            near[j].add(i)
    seen: set[int] = set()
    for root in range(m):
        todo = [root] if root not in seen else []
        while todo:
            at = todo.pop()
            seen.add(at)
            for k in sorted(near[at] - seen):
                parent[k] = at
                todo.append(k)
    return parent


def label_model(votes: np.ndarray, prior: float, *, blocks: bool = True, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Posterior of the label of each row, each voter's parent, and the tables of the model.

    votes: rows x voters, 1 for, -1 against, 0 abstaining; no label enters. The generative model draws a label (by the
    prior) and then every vote, by the label and the vote of the voter's parent: how often a voter votes, how often it
    is right and how it goes along with its parent are one table, all estimated by expectation maximisation from a
    majority vote. What the voters still tell of one another given the label, after a first fit, makes the forest of
    parents, and the fit goes on with it, so that a voter that repeats another adds no evidence. With `blocks`, a block of
    like voters has the weight of one in the majority, and voters that tell much of another one have a
    parent in the first fit already; without, the first fit takes every voter by itself.
    """
    votes = votes.astype(np.int64)
    weight = np.ones(votes.shape[1])
    if blocks:
        apart = votes - votes.mean(axis=0)
        apart = apart / np.sqrt((apart**2).sum(axis=0)).clip(1e-9)
        weight = 1 / ((apart.T @ apart) ** 2).sum(axis=1).clip(1)
    post = 1 / (1 + np.exp(-(2.0 * votes @ weight + np.log(prior / (1 - prior)))))
    parent = dependencies(votes, post, share=0.3) if blocks else np.full(votes.shape[1], -1)
    for turn in range(2):
        for _ in range(rounds):
            tables = _tables(votes, parent, post)
            post = _posterior(votes, parent, tables, prior)
        if turn == 0:
            parent = dependencies(votes, post)
    return post, parent, tables


def linear_classifier(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; equal rows are taken together."""
    total = len(x)
    x, inverse = np.unique(x, axis=0, return_inverse=True)
    many = np.bincount(inverse.ravel(), minlength=len(x)).astype(float)
    y = np.bincount(inverse.ravel(), y, len(x)) / many
    many /= total
    n, m = total, x.shape[1]
    w, b = np.zeros(m), 0.0
    u, c = w.copy(), b
    rate = 4 / ((many @ np.square(x)).sum() + 1)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ u + c, -30, 30)))
        gap = many * (p - y)
        gw, gb = x.T @ gap + l2 * u / n, gap.sum()
        nw, nb = u - rate * gw, c - rate * gb
        k = t / (t + 3)
        u, c = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    max_rows: int = 12_000,
    max_units: int = 600,
    min_support: int = 3,
    seed: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit voters, label model and classifier on a bounded sample of the labelled rows that `learn` selects.

    Of the labelled ids, about max_rows are drawn by a hash. Units (words and word beginnings) that at least
    min_support toxic documents of it hold, far more often than clean ones, make up the lexicons of the voters for; units
    far more frequent in clean ones those of the voters against (max_units of either at most, of strongest evidence by
    G-squared); patterns of form vote too. The label model sees the votes alone, and the rate of label 1 as its prior.
    The classifier learns its posteriors; labels orient it (they choose between its two ways to begin, and turn it
    round where it points the wrong way) and at the end calibrate the classifier (a slope and an offset). Without labels of both kinds, nothing is learned and every score
    is the prior. Ties in evidence go by the unit's name.
    """
    y = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    total = max(1, y.count())
    u = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) < int(min(1.0, max_rows / total) * (1 << 30)) + 1
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(y.where(u)), "i").select("t", "y")
    counted = rows.mapInArrow(_count_units, "unit string, n0 long, n1 long").groupBy("unit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, [0.0] * len(_PATTERNS), float(np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))))
    a, b = F.col("n1") / F.lit(float(sizes[1])), F.col("n0") / F.lit(float(sizes[0]))
    both = (F.col("n1") + F.col("n0")) / F.lit(float(sum(sizes.values())))
    part = lambda n, rate: F.when(F.col(n) > 0, F.col(n) * F.ln(rate / both)).otherwise(F.lit(0.0))
    counted = counted.withColumn("g2", part("n1", a) + part("n0", b)).where(f"g2 > {LEAST_EVIDENCE}")
    sides = ((F.col("n1") >= min_support) & (a > 8 * b + F.lit(2.0 / sizes[1])), (F.col("n0") >= min_support) & (b > 1.5 * a))
    best = [counted.where(c).orderBy(F.desc("g2"), "unit").limit(max_units).select(F.lit(k).alias("side"), "g2", "unit") for k, c in enumerate(sides)]
    best = sorted((r["side"], -r["g2"], r["unit"]) for r in best[0].union(best[1]).collect())
    for_, against = ([u for k, _, u in best if k == side] for side in (0, 1))
    vocabulary = {u: k for k, u in enumerate([*for_, *against])}
    got = rows.mapInArrow(_hits_of(vocabulary), "hits array<int>, patterns array<int>, y int").collect()
    x = np.zeros((len(got), len(vocabulary) + len(_PATTERNS)), np.int8)
    for k, r in enumerate(got):
        x[k, r["hits"]] = 1
        x[k, len(vocabulary) :] = r["patterns"]
    gold = np.array([r["y"] for r in got], float)
    n = len(for_)
    voters = [x[:, k:n:LEXICONS_FOR].max(axis=1) for k in range(min(n, LEXICONS_FOR))]
    voters += [-x[:, n + k : len(vocabulary) : LEXICONS_AGAINST].max(axis=1) for k in range(min(len(against), LEXICONS_AGAINST))]
    voters += [x[:, len(vocabulary) + k] * v for k, (_, v) in enumerate(_PATTERNS)]
    prior = float(np.clip(gold.mean(), 1e-3, 0.999))
    votes = np.stack(voters, axis=1)
    fits = [label_model(votes, prior, blocks=b)[0] for b in (False, True)]
    fits += [1 - p for p in fits]
    agreed = [float((gold * np.log(p.clip(1e-6)) + (1 - gold) * np.log((1 - p).clip(1e-6))).mean()) for p in fits]
    post = fits[int(np.argmax(agreed))]
    w, bias = linear_classifier(x.astype(np.float64), post)
    slope, offset = linear_classifier((x @ w + bias)[:, None], gold, l2=1.0)
    slope = max(float(slope[0]), 0.0)
    return Model({u: slope * float(w[k]) for u, k in vocabulary.items()}, [slope * float(v) for v in w[len(vocabulary) :]], slope * bias + offset)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Toxicity of whole texts.

    docs: any columns; only text_col is read. Returns all columns of docs and toxicity double (0 to 1, the
    probability that the label is 1; clashing names are replaced). Null and empty texts get the score of
    a text without any voter; repeated rows are answered alike; empty input gives an empty result. No
    shuffle; the model is bounded by its number of voters.
    """
    names = [c for c in docs.columns if c != "toxicity"]
    at = names.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", toxicity double"
    weights, base = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column(at):
                text = text.as_py() or ""
                words = _tokens(text)
                if len(memo) > MEMO_WORDS:
                    memo = {}
                hits: set[str] = set()
                for w in words:
                    own = memo.get(w)
                    if own is None:
                        own = memo[w] = tuple(u for u in units(w) if u in weights)
                    if own:
                        hits.update(own)
                z = base + sum(weights[u] for u in sorted(hits))
                for (p, _), v in zip(_PATTERNS, model.patterns):
                    if v and p.search(text):
                        z += v
                out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(out, pa.float64())], [*names, "toxicity"])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
