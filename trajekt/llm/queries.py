"""The queries op1 to op10: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec, site_quality, token_counts, toxicity

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=5, threshold=(85, 100))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources of documents, paths their language sections."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = site_quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    out = site_quality.classify(docs, model, id_col="doc_id", text_col="text", host=F.col("source"), path=F.col("lang"))
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold("doc_id", 5) != 0)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), max_epochs=3)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.93)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select(
        "doc_id",
        (F.col("kept_lines") + F.col("dropped_lines")).cast("long").alias("n_lines"),
        F.col("dropped_lines").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP8_SQL = r"""
with lines as (
    select doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos
          from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), common as (
    select key, max(doc_id) as last from lines where length(key) >= 40
    group by key having count(distinct doc_id) >= 5
), marked as (
    select l.doc_id, l.pos, l.line, c.key is not null and l.doc_id is distinct from c.last as gone
    from lines l left join common c on l.key = c.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), budget=2048)
    total = F.when(F.size("prefix_tokens") > 0, F.element_at("prefix_tokens", -1)).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > 2048).alias("over_limit"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))
    return out.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


REACH = """reach(node, root) as (
    select a, b from links union select l.a, r.root from links l join reach r on l.b = r.node
), least as (select node, min(root) as root from reach group by node)"""

OP1_SQL = rf"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), shingles as (
    select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), pairs as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
), links(a, b) as (select x, y from pairs union all select y, x from pairs), {REACH}
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, d.doc_id <= coalesce(root, d.doc_id) as kept
from documents d left join sizes using (doc_id) left join least on node = d.doc_id
"""

OP6_SQL = r"""
with sizes as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as h from documents
), sources as (
    select source, sum(size)::bigint as source_size from sizes group by source
), weighed as (
    select *, list_extract([5.0, 2.0, 1.0]::double[], 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3) as weight, source_size * 3.0::double as cap from sources
), levels as (
    select *, sum(source_size) over ()::double - coalesce(sum(cap) over upto, 0) as left_, sum(weight) over () - coalesce(sum(weight) over upto, 0) as open_, cap / weight as level
    from weighed window upto as (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)
), water as (
    select *, case when left_ > 0 then left_ / open_ else 0 end as water from levels
), plan as (
    select source, source_size, least(cap, coalesce(weight * (select arg_min(water, level) from water where water <= level), cap)) as target from water
), parts as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from plan
), rest as (
    select *, greatest(floor(target - whole * source_size)::bigint, 0) as rest from parts
), placed as (
    select s.*, r.source_size, r.target, r.whole, r.rest, coalesce(sum(size) over (partition by s.source order by h rows between unbounded preceding and 1 preceding), 0) as before
    from sizes s join rest r on s.source is not distinct from r.source
)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::bigint as taken from placed
"""

OP7_SQL = f"""
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links(a, b) as (
    select p.vec_id, q.vec_id from v p join v q on p.label = q.label and p.vec_id <> q.vec_id and len(p.e) = len(q.e) where list_cosine_similarity(p.e, q.e) >= 0.93
), {REACH}, counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(root, vec_id)) as component_id, vec_id <= coalesce(root, vec_id) as kept
from embeddings left join counts on a = vec_id left join least on node = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op6_source_mix": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL}
