"""The registered queries and the stages of the pipeline on the smallest tables."""

import os
import re

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def names():
    from trajekt.llm import queries

    return sorted(queries.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    from trajekt.llm import queries

    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for t in ("documents", "embeddings"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cur = c.execute(queries.oracle_sql()[name])
        have = [d[0] for d in cur.description]
        assert got == sorted(repr(tuple(plain(r[have.index(k)]) for k in cols)) for r in cur.fetchall())


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "source_mix", "sentencepiece"]
    all_docs = docs.count()
    first = p.written(p.keep_identified(spark, docs, SF), "t1")
    assert first.columns == docs.columns and 0.9 * all_docs <= first.count() <= all_docs
    second = p.written(p.drop_common_lines(spark, first, SF), "t2")
    assert second.columns == docs.columns and second.count() == first.count()
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = p.written(p.one_of_each_group(spark, second, SF), "t3")
    ids, texts = {r.doc_id for r in third.collect()}, {r.doc_id: r.text for r in second.collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert ids == {k for k in root if root[k] == k}
    fourth = p.written(p.mix(spark, third, SF), "t4")
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} <= ids
    last = p.encode(spark, fourth, SF)
    assert last.count() == fourth.count() and all(r.round_trip or "▁" in texts[r.doc_id] for r in last.collect())
