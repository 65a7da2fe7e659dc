"""Results that are right for all inputs, also those that the driver's tables don't hold."""

import os
import random
import resource
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trajekt.llm import ann_search, common, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec, token_counts


def test_special_strings_in_any_case_count_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    for s in ("<|endoftext|>", "<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "x<|EndOfText|>", "<|endoftext|>The.", "<|EndOfText|>The."):
        for t in (s, f"The {s} end.", f"{s}, {s.lower()} {s}"):
            ends, sums = counter.index(t)
            for cut in range(len(t) + 1):
                want = len(tok.encode(t[:cut], add_special_tokens=False).ids)
                assert token_counts.count_at(t, ends, sums, cut, counter) == want, (t, cut)


def test_every_vector_length_has_its_links(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for dim in range(2, 70):  # more lengths than have pivots
        v = rng.normal(size=dim)
        vectors += [v, v * 2 + 1e-3]
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(2)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {k: (1, k // 2 * 2) for k in range(len(vectors))}


def test_a_rare_vector_length_has_its_links(spark):
    v = np.array([0.3, -1.0, 0.5])
    vectors = [*np.random.default_rng(4).normal(size=(300, 64)), v, v * 2 + 1e-3]
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(2)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df, sample_rows=4).collect()}
    assert got == {k: int(k >= 300) for k in range(len(vectors))}


def test_language_dictionaries_reach_the_ends_of_texts(spark):
    texts = [(k, ("shared header " * 200 if k % 2 else "title " * 120) + "body " * 150 + "finish " * 40 + "x" * (k // 2), "en") for k in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(2)
    ((_, raw),) = language_id.train(df, F.lit(True))
    assert all(w in raw for w in (b"shared header", b"title", b"body", b"finish"))
    assert language_id.train(df.repartition(3), F.lit(True)) == [("en", raw)]
    ((_, short),) = language_id.train(df.where("doc_id % 2 = 0"), F.lit(True), docs_per_language=100)
    assert b"finish" in short


def message(number, value):
    """A protocol buffer field."""
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    n, size = len(value), b""
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + value


def small_model(kind, own=False):
    """A hand-written model file: no training, fixed pieces and scores."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    plain = ["▁", "▁▁", "a", "b", "c", "d", "e", "ab", "bc", "abc", "▁a", "▁ab", "cd", "de", "cde", "bcd", "abcd", "ea", "dea", "▁abc", "eab"]
    pieces += [(p, -1.5 - 0.37 * k % 5 - 0.01 * k, 1) for k, p in enumerate(plain)] + [("#", -1.0, 4)] * own
    raw = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, t)) for p, s, t in pieces)
    raw += message(2, message(3, kind))
    return raw + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))


def test_unigram_models_give_the_librarys_pieces(tmp_path):
    from sentencepiece import SentencePieceProcessor

    path = tmp_path / "unigram.model"
    path.write_bytes(small_model(sentencepiece_codec.UNIGRAM))
    sp, codec = SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
    assert codec.kind == sentencepiece_codec.UNIGRAM
    rng = random.Random(5)
    texts = ["", " ", "a", "zz", "a z zz a", "  abcde  "] + ["".join(rng.choice("abcdeabcde  zé") for _ in range(rng.randint(1, 40))) for _ in range(600)]
    assert codec.encode(texts) == [sp.encode(t) for t in texts]
    for kind, own in ((3, False), (4, False), (sentencepiece_codec.UNIGRAM, True)):
        path.write_bytes(small_model(kind, own))
        with pytest.raises(ValueError):
            sentencepiece_codec.Codec(str(path))


def test_texts_in_parts_encode_as_a_whole(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    monkeypatch.setattr(sentencepiece_codec, "PART_CHARS", 9)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab cde  ▁é") for _ in range(rng.randint(0, 120))) for _ in range(200)] + [" " * 50, "x" * 60]
    ids, same = codec.encode_texts(texts)
    assert [i.tolist() for i in ids] == [sp.encode(t) for t in texts]
    assert same == ["▁" not in t for t in texts]
    monkeypatch.setattr(sentencepiece_codec, "SHORT_WORD", 3)  # most words by walking back
    codec.forget()
    assert codec.encode(texts) == [sp.encode(t) for t in texts]


def grown(work):
    """MB by which a fresh process grows while it works."""
    import multiprocessing

    pool = multiprocessing.get_context("fork").Pool(1)
    try:
        return pool.apply(work)
    finally:
        pool.terminate()


def _peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def _long_word():
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    before = _peak()
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    (ids,), (same,) = codec.encode_texts([text])
    assert same and len(ids) > 100_000
    return _peak() - before


def _long_text():
    text = pa.array([" ".join(f"word{k % 9973} {k}" for k in range(3_600_000))])
    assert text.nbytes > 50_000_000
    before = _peak()
    (batch,) = minhash_dedup._describe(5)([pa.RecordBatch.from_arrays([pa.array([1]), text], ["id", "text"])])
    assert batch.column(1)[0].as_py() > 7_000_000
    return _peak() - before


def test_long_words_and_texts_need_little_memory():
    assert grown(_long_word) < 400
    assert grown(_long_text) < 400


def test_words_cut_by_blocks_hash_alike(monkeypatch):
    rng = random.Random(7)
    texts = pa.array([None if rng.random() < 0.1 else "".join(rng.choice("ab A\n\té") for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(200)])
    want = common.word_hashes(texts)
    monkeypatch.setattr(common, "BLOCK_BYTES", 7)
    got = common.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(want, got))


CLASH = ["whole", "h", "n", "s", "source_size", "target", "extra", "left", "rest", "cut", "piece", "_n", "_source", "__s", "__id", "_id", "_gone", "__drop", "kept_lines", "mix_size", "pos", "line", "row"]


def clashing(df):
    return df.withColumns({c: F.lit(-5) for c in CLASH})


def test_mix_and_line_dedup_take_columns_of_any_name(spark):
    shared = "a line that is longer than forty code points " + "x" * 10
    rows = [(k, f"own {k}\n  {shared.upper()} \nend {k}", f"s{k % 2}") for k in range(8)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(3)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "kept_lines"] + ["kept_lines", "dropped_lines"]
    got = {r["doc_id"]: (r["text"], r["kept_lines"], r["dropped_lines"], r["__id"]) for r in out.collect()}
    assert got == {k: (f"own {k}\nend {k}", 2, 1, -5) if k < 7 else (rows[k][1], 3, 0, -5) for k in range(8)}
    mixed = mixing.mix_sources(docs)
    assert {c for c in docs.columns} <= set(mixed.columns) and all(r["whole"] == r["__s"] == -5 for r in mixed.collect())
    assert {r["doc_id"] for r in mixing.repeated(mixed).where("_n = -5").collect()} <= set(range(8))


def test_line_dedup_of_repeated_rows_and_hot_lines(spark, monkeypatch):
    a, b = "first common line of the table, forty points long", "second common line of the table, forty points long"
    rows = [(k, f"{a}\nx{k}\n{b}\n{a}") for k in range(6)] + [(2, f"{b}\n{b}\nother"), (2, f"{a}\nx2\n{b}\n{a}"), (None, f"{a}\nnull"), (9, None), (10, ""), (11, f"{b}")]
    got = sorted(((r.doc_id, r.text, r.kept_lines, r.dropped_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()), key=repr)
    want = [(k, f"x{k}", 1, 3) for k in range(5)] + [(5, f"{a}\nx5\n{a}", 3, 1), (2, "other", 1, 2), (2, "x2", 1, 3), (None, "null", 1, 1), (9, None, 1, 0), (10, "", 1, 0), (11, b, 1, 0)]
    assert got == sorted(want, key=repr)


def test_sieve_passes_all_that_occur(spark):
    rows, among = spark.range(400).withColumnRenamed("id", "k"), spark.range(0, 400, 3).withColumnRenamed("id", "j")
    for bits in (6, 24):
        asked, rest = common.sieve(rows, ["k"], among, ["j"], bits)
        asked, rest = ({r.k for r in x.collect()} for x in (asked, rest))
        assert asked | rest == set(range(400)) and not asked & rest and set(range(0, 400, 3)) <= asked
        assert bits == 6 or len(asked) == 134


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_mix_cuts_at_any_fineness(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "PIECE_BITS", bits)
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(0, 30)), rng.choice("aaaaab") if k % 9 else None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix_sources(docs).collect()
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        whole = int(own[0].mix_target // own[0].mix_source_size)
        assert sum(r.mix_taken for r in own) == int(own[0].mix_target)
        extra = [r for r in own if r.mix_size and r.mix_taken - whole * r.mix_size not in (0, r.mix_size)]
        assert len(extra) <= 1


def test_mix_and_line_dedup_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for out in (mixing.repeated(mixing.mix_sources(docs)), line_dedup.dedup_lines(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_registered_ann_search_finds_the_true_neighbours(spark):
    from trajekt.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = sorted((r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got: dict[int, dict[int, float]] = {}
    for r in queries.op4_ann_search(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist()) and all(len(v) == 20 for v in got.values())
    found = 0
    for k in asked:
        score = x @ x[k]
        score[k] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        found += len(best & set(got[int(ids[k])]))
        assert all(abs(s - float(x[np.searchsorted(ids, i)] @ x[k])) < 1e-12 for i, s in got[int(ids[k])].items())
    assert found >= 0.95 * 20 * len(asked)


def test_vectors_of_a_group_larger_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * rng.choice([0.02, 0.4], (150, 1))
    df = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300)[None] % 2) & ~np.eye(300, dtype=bool)
    for block, tile in ((4096, 512), (16, 5), (4096, 7)):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df).collect()}
        assert got == {k: int(linked[k].sum()) for k in range(300)}


@pytest.mark.parametrize("kind", ["families", "shifted", "sizes"])
def test_ann_scan_keeps_neighbours_that_are_much_alike(kind):
    rng = np.random.default_rng(12)
    n, dim, k = 4000, 64, 21
    x = rng.normal(size=(n, dim))
    if kind == "families":
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.3 * x
    elif kind == "shifted":
        x += 2
    else:
        x *= np.exp(rng.normal(size=(n, 1)))
    turn = ann_search.rotation(dim, ann_search.SEED)
    q, r = ann_search.scan(x[::20] @ turn.T, x @ turn.T, k)
    kept = set(zip(q.tolist(), r.tolist()))
    best = np.argsort(-(x[::20] @ x.T), axis=1)[:, :k]
    assert sum((a, b) in kept for a, row in enumerate(best.tolist()) for b in row) >= 0.99 * best.size
    assert len(kept) < 0.25 * n * len(best)


def test_ann_lists_are_probed_as_the_queries_need(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 16))
    x[::20] += 3 * rng.normal(size=16)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = 0
    for r in ann_search.search(df, F.col("vec_id") % 20 == 0, k=20).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        score = x @ x[r.query_id]
        score[r.query_id] = -np.inf
        found += len(set(r.ids) & set(np.argsort(-score)[:20].tolist()))
    assert found >= 0.95 * 3000
