"""The training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trajekt.llm import ann_search, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec, site_quality, token_counts, toxicity
from trajekt.llm.common import Forest, components, least_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and tree house river stone light winter green paper".split()


def docs(spark, texts, **more):
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] if not texts or not isinstance(texts[0], tuple) else texts
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def rows(df, *cols):
    return {r[cols[0]]: tuple(r[c] for c in cols[1:]) if len(cols) > 2 else r[cols[1]] for r in df.collect()}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def reach(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def near_texts():
    rng = random.Random(4)
    out = [None, "", " \t\n", "one", "One", "two words", "a b c d e"]
    for _ in range(25):
        base = prose(rng, rng.randint(20, 160)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            out.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return [*out, out[-1], out[-1], "x " * 30_000]


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("least", [80, 85])
def test_minhash_against_brute_force(spark, least):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    pairs = [(b, a) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    want = reach(len(texts), pairs)
    got = rows(minhash_dedup.near_duplicates(docs(spark, texts, component_id=7, sig=1), threshold=(least, 100)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in range(len(texts))}


def test_minhash_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "VERIFY_BLOCK", 4)
    rng = random.Random(9)
    base = prose(rng, 200).split()
    texts = [" ".join(base[:k] + [f"other{k}"] + base[k + 1 :]) for k in range(60)] + [" ".join(base)] * 20
    got = rows(minhash_dedup.near_duplicates(docs(spark, texts)), "doc_id", "component_id")
    assert set(got.values()) == {0}


def test_minhash_nulls_and_empty(spark):
    df = docs(spark, [(None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None)])
    got = minhash_dedup.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (3, 3, True), (3, 3, True)]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components_and_forest(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(5, 5)]
    want = reach(500, pairs)
    got = rows(components(spark.createDataFrame(pairs, "a long, b long"), "t"), "node", "root")
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    a, b = np.array(pairs).T
    assert least_labels(500, a, b).tolist() == want
    new = Forest().new(a, b)
    assert reach(500, [p for p, k in zip(pairs, new) if k]) == want


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    bad = ["idiot", "scum", "blarga", "blargo", "blargix"]
    texts = [prose(rng, 60) + "".join(f" {rng.choice(bad)} {prose(rng, 5)}" for _ in range(3 * (k % 5 == 0))) for k in range(400)]
    df = docs(spark, [*[(k, t, None, None, None) for k, t in enumerate(texts)], (900, None, None, None, None), (901, "", None, None, None), (None, "idiot scum blargix", None, None, None)])
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    out = rows(toxicity.score(df, toxicity.train(df, labels, learn)), "doc_id", "toxicity")
    assert all((out[k] >= 0.7) == (k % 5 == 0) for k in range(400))
    assert out[900] == out[901] < 0.7 <= out[None]
    plain = toxicity.score(df, toxicity.train(df, labels.limit(0), learn))
    assert all(0 <= r.toxicity <= 1 for r in plain.collect())


def votes_of(rng, y, voters):
    """Votes of (polarity, how often it votes where right, where wrong)."""
    out = [np.where(rng.random(len(y)) < np.where((y > 0) == (side > 0), right, wrong), side, 0) for side, right, wrong in voters]
    return np.stack(out, axis=1)


def test_label_model_beats_the_majority_without_labels():
    rng = np.random.default_rng(0)
    y = (rng.random(6000) < 0.2).astype(int)
    votes = votes_of(rng, y, [(1, 0.7, 0.02), (1, 0.6, 0.02), (1, 0.3, 0.25), (1, 0.3, 0.25), (1, 0.35, 0.3), (-1, 0.5, 0.05), (-1, 0.4, 0.05)])
    post, _, _ = toxicity.label_model(votes, 0.2)
    majority = votes.sum(axis=1) > 0
    assert ((post > 0.5) == y).mean() > max(0.93, (majority == y).mean() + 0.03)


def test_label_model_counts_a_correlated_block_once():
    rng = np.random.default_rng(1)
    y = (rng.random(8000) < 0.3).astype(int)
    votes = votes_of(rng, y, [(1, 0.5, 0.1), (1, 0.5, 0.1), (1, 0.5, 0.1), (-1, 0.5, 0.1), (-1, 0.5, 0.1)])
    block = np.concatenate([votes, votes[:, :1], votes[:, :1], votes[:, :1]], axis=1)
    alone, _, _ = toxicity.label_model(votes, 0.3)
    blocked, parent, _ = toxicity.label_model(block, 0.3)
    assert (parent >= 0).sum() == 3 and np.abs(alone - blocked).max() < 0.08
    tables = toxicity._tables(block, np.full(8, -1), blocked)
    apart = toxicity._posterior(block, np.full(8, -1), tables, 0.3)
    assert np.abs(alone - apart).max() > 0.2  # without parents, the block's votes add up


def test_label_model_against_plain_em():
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.4).astype(int)
    votes = votes_of(rng, y, [(1, 0.6, 0.1), (1, 0.5, 0.2), (-1, 0.6, 0.1)])
    got, parent, _ = toxicity.label_model(votes, 0.4, blocks=False)
    assert (parent == -1).all()
    logit = lambda p: np.log(p / (1 - p))
    post = [1 / (1 + np.exp(-(2.0 * sum(r) + logit(0.4)))) for r in votes.tolist()]
    for _ in range(60):
        rate = {}
        for j in range(3):
            for label in (0, 1):
                w = [p if label else 1 - p for p in post]
                for v in (-1, 0, 1):
                    plain = (sum(a for a, r in zip(w, votes.tolist()) if r[j] == v) + 0.1) / (sum(w) + 0.3)
                    rate[j, label, v] = (sum(a for a, r in zip(w, votes.tolist()) if r[j] == v) + 4 * plain) / (sum(w) + 4)
        post = [1 / (1 + np.exp(-(logit(0.4) + sum(np.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(r))))) for r in votes.tolist()]
    assert np.abs(got - post).max() < 1e-6


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(8)
    good = lambda: prose(rng, 80) + "."
    junk = lambda: " | ".join([rng.choice(WORDS)] * 60)
    texts = [(k, good() if k % 2 else junk(), None, f"h{k % 2}" if k < 300 else None, 0) for k in range(320)] + [(400, None, None, "lone", 0), (401, "", None, "h1", 0)]
    df = docs(spark, texts, evidence=1)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    model = site_quality.train(df, labels, F.lit(True))
    out = {r.doc_id: r for r in site_quality.classify(df, model, id_col="doc_id", text_col="text", host=F.col("source"), path=F.col("lang")).collect()}
    assert len(out) == 322 and all(out[k].kept == bool(k % 2) for k in range(320))
    assert out[1].host_rate > out[400].host_rate > out[0].host_rate
    empty = site_quality.classify(docs(spark, []), site_quality.train(docs(spark, []), labels, F.lit(True)), id_col="doc_id", text_col="text", host=F.col("source"), path=F.col("lang"))
    assert empty.count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=400, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(n // 2, n):
        x[k] = x[rng.integers(0, n // 2)] + rng.normal(size=dim) * rng.choice([0.0, 0.15, 0.25, 0.4])
    x = x.astype(np.float32)
    data = [(k, [float(v) for v in x[k]], k % 3 if k % 11 else None) for k in range(n)]
    odd = [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [], 2), (n + 6, data[20][1], data[20][2])]
    return x.astype(float), data, odd, spark.createDataFrame(data + odd, VECTORS)


def test_ann_recall_and_scores(spark):
    x, data, odd, df = vectors(spark)
    x = np.vstack([x, x[20]])
    ids = [*range(400), 406]
    got = collections.defaultdict(list)
    for r in ann_search.search(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [*range(0, 400, 20)]
    hit = 0
    for q, found in got.items():
        s = {i: float(x[k] @ x[q]) for k, i in enumerate(ids) if i != q}
        top = sorted(s, key=lambda i: (-s[i], i))[:10]
        hit += len({v for _, v, _ in found} & set(top))
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        assert [(-score, v) for _, v, score in found] == sorted((-score, v) for _, v, score in found)
    assert hit >= 0.9 * 10 * len(got)


def test_ann_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann_search.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert ann_search.search(df.limit(0), F.lit(True)).count() == 0


def test_embedding_dedup_against_brute_force(spark, monkeypatch):
    x, data, odd, df = vectors(spark)
    labels = [d[2] for d in data] + [data[20][2]]
    ids = [*range(400), 406]
    u = np.vstack([x, x[20]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    pairs = [(a, b) for b in range(401) for a in range(b) if labels[a] is not None and labels[a] == labels[b] and u[a] @ u[b] >= 0.93]
    links, root = collections.Counter(k for p in pairs for k in p), reach(401, pairs)
    want = {ids[k]: (links[k], ids[root[k]], root[k] == k) for k in range(401)} | {k: (0, k, True) for k in range(400, 406)}
    for block, cell in ((512, 32_768), (16, 40)):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        assert rows(embedding_dedup.near_duplicate_vectors(df, rows_per_cell=cell), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_codes_are_unbiased():
    rng = np.random.default_rng(3)
    o, q = rng.normal(size=(2, 64))
    o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
    got = []
    for seed in range(400):
        from trajekt.llm.vectors import rotation

        turn = rotation(64, seed)
        code, factor = embedding_dedup.encode(o[None], turn)
        got.append(float((q @ turn.T) @ code[0] / (8 * factor[0])))
    assert abs(np.mean(got) - o @ q) < 0.02


def test_language_id(spark):
    rng = random.Random(3)
    parts = {"aa": ["thon", "ing", "er", "wh"], "bb": ["sch", "ung", "lich", "tz"], "cc": ["eau", "ment", "oui", "re"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    data = [(k, text(lang := "abc"[k % 3] * 2, rng.randint(10, 200)), lang, None, 0) for k in range(240)]
    data += [(900, None, "aa", None, 0), (901, "", "aa", None, 0), (902, "123 !!", "aa", None, 0), (903, text("bb", 40_000), None, None, 0)]
    df = docs(spark, data, lang_score=3)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = rows(language_id.identify(df, language_id.train(df, fold != 0)), "doc_id", "lang_pred", "lang_score", "lang_accepted")
    right = [out[k][0] == "abc"[k % 3] * 2 for k in range(240)]
    assert sum(right) >= 235 and out[903][0] == "bb" and all(0 <= s <= 1 for _, s, _ in out.values())
    assert [out[k] for k in (900, 901, 902)] == [("und", 0.0, False)] * 3
    assert {r.lang_pred for r in language_id.identify(df, []).collect()} == {"und"}
    assert language_id.identify(df.limit(0), []).count() == 0


def fill(sizes, weights, most):
    """Clamp and redistribute until nothing is above its cap."""
    total, cap = sum(sizes), [most * s for s in sizes]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / w > cap[k]]
        if not over:
            for k in open_:
                target[k] = left * weights[k] / w
            break
        for k in over:
            target[k] = cap[k]
            open_.discard(k)
        left = total - sum(cap[k] for k in range(len(sizes)) if k not in open_)
    return target


def test_mixing(spark):
    rng = random.Random(1)
    names = ["b", "a", "Z", "é", None, "c", "zero"]
    data = [(k, " ".join(["w"] * rng.randint(1, 80)), None, rng.choices(names[:6], [30, 1, 1, 3, 5, 60])[0], 0) for k in range(600)]
    data += [(700, None, None, "zero", 0), (701, " \n", None, "zero", 0), (702, "x", None, "a", 0), (702, "x", None, "a", 0)]
    df = docs(spark, data, mix_taken=5, size=4)
    got = mixing.mix_sources(df)
    out = got.collect()
    size = collections.Counter()
    for r in out:
        assert r.mix_size == len((r.text or "").split())
        size[r.source] += r.mix_size
    order = sorted((n for n in size if n is not None), key=lambda s: s.encode()) + [None]
    target = dict(zip(order, fill([size[n] for n in order], [[5, 2, 1][k % 3] for k in range(len(order))], 3)))
    taken = collections.Counter()
    for r in out:
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - target[r.source]) < 1e-6
        assert 0 <= r.mix_taken <= 3 * r.mix_size
        taken[r.source] += r.mix_taken
    assert all(abs(taken[n] - target[n]) < 3 for n in order) and len(out) == len(data)
    key = lambda rs: sorted((r.doc_id, r.mix_taken) for r in rs)
    assert key(out) == key(mixing.mix_sources(df.repartition(5)).collect())
    again = collections.Counter()
    for r in mixing.repeated(got).collect():
        again[r.source] += len(r.text.split())
    assert {k: v for k, v in again.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [r.mix_taken for r in mixing.mix_sources(docs(spark, [(1, None, None, None, 0)])).collect()] == [0]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    common = ["A line that many documents hold, number %d of them all" % k for k in range(6)] + ["é" * 40, "é" * 39]
    data = []
    for k in range(60):
        lines = [prose(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 5))] + rng.choices(common, k=rng.randint(0, 6))
        lines = [f" {s.upper()}\t" if s in common[:6] and rng.random() < 0.4 else s for s in lines]
        rng.shuffle(lines)
        data.append((k // 2 if k < 8 else k, "\n".join(lines), None, None, 0))
    data += [(100, None, None, None, 0), (101, "", None, None, 0), (102, "\n\n", None, None, 0), (103, common[6] + "\n" + "x\n" * 50_000, None, None, 0)]
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    held = collections.defaultdict(set)
    for i, t, *_ in data:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held[key(s)].add(i)
    want = collections.Counter()
    for i, t, *_ in data:
        stay = [s for s in (t or "").split("\n") if not (len(held.get(key(s), ())) >= 5 and max(held[key(s)]) != i)]
        want[(i, (t or "").count("\n") + 1, len((t or "").split("\n")) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())] += 1
    out = line_dedup.dedup_lines(docs(spark, data, hash=1, kept_lines=9)).collect()
    assert collections.Counter((r.doc_id, r.kept_lines + r.dropped_lines, r.dropped_lines, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out) == want
    assert sum(n for _, _, n, _ in want) > 20 and line_dedup.dedup_lines(docs(spark, [])).count() == 0


ODD = ["", " ", "  a  b", "\n\n x ▁ y▁▁z ", "日本語 émoji 😀😀 <s> <0x0A>", "ab" * 4000, "<|endoftext|>x<|endoftext|> \x1c b é é́", "aaaaab  \t c d   e", "don't it's 12,345.", "....\r\n\r\n ====", "The THE the. the, The."]


def odd_texts():
    rng = random.Random(2)
    alphabet = "abcdeé日😀.,'1 \t\n▁<|>́ "
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_at_prefixes(name):
    path = public_tokenizers.path(name)
    counter = token_counts.PrefixCounter(path)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    rng = random.Random(1)
    for t in odd_texts():
        if len(t) > 1000 and name.endswith("model"):
            continue
        ends, sums = counter.index(t)
        assert (int(sums[-1]) if len(sums) else 0) == count(t), t
        for cut in {len(t), *(rng.randint(0, len(t)) for _ in range(3))}:
            assert token_counts.count_at(t, ends, sums, cut, counter) == count(t[:cut]), (t, cut)


def test_token_count_rows(spark):
    df = docs(spark, [(1, None, None, None, 0), (None, "a b", None, None, 0), (2, "one two three four", None, None, 0)], n_tokens=1)
    out = {r.doc_id: r for r in token_counts.prefix_token_counts(df, public_tokenizers.path("word_bpe_49k.json"), budget=2).collect()}
    assert out[1].prefix_tokens == [] and out[1].n_bytes == 0 and out[None].prefix_tokens == [1, 2]
    assert out[2].prefix_bytes == [3, 7, 13, 18] and out[2].budget_bytes == 7
    assert token_counts.prefix_token_counts(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_sentencepiece_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    c = sentencepiece_codec.Codec(path)
    texts = odd_texts()
    for got, t in zip(c.encode(texts), texts):
        assert got == sp.encode(t), t
        assert c.decode(got) == sp.decode(got)
    df = docs(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)] + [(999, None, None, None, 0)], piece_ids=1)
    out = sentencepiece_codec.encode(df, path)
    rows_ = {r.doc_id: r for r in out.collect()}
    assert rows_[999].piece_ids is None and rows_[999].round_trip is None
    assert all(rows_[k].round_trip == ("▁" not in t) for k, t in enumerate(texts))
    back = rows(sentencepiece_codec.decode(out.select("doc_id", "piece_ids"), path), "doc_id", "text")
    assert all(back[k] == t.replace("▁", " ") for k, t in enumerate(texts)) and back[999] is None
    assert sentencepiece_codec.encode(df.limit(0), path).count() == 0
