"""Language ID by compression: the language whose zstandard dictionary makes the text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A text is compressed in blocks, so that the dictionary stays within reach in long texts.
BLOCK_CHARS = 16_384
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased runs of letters, one blank between them."""
    return " ".join(_LETTERS.findall(text.lower()))


def train(
    docs: DataFrame,
    rows: Column,
    *,
    docs_per_language: int = 160,
    dictionary_bytes: int = 98_304,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> list[tuple[str, bytes]]:
    """Raw-content dictionaries from a bounded sample of the labelled rows that `rows` selects.

    About docs_per_language documents of each language (a hash of the id decides, not their place) give
    one piece each, dictionary_bytes together; a piece begins at a hashed place of the whole text. Returned by
    falling frequency, which settles ties.
    Rows with null text or language teach nothing.
    """
    d = docs.where(rows & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.col(id_col).alias("i")
    )
    counts = {r["l"]: r["count"] for r in d.groupBy("l").count().collect()}
    rates = F.lit(0.0)
    for lang, n in counts.items():
        rates = F.when(F.col("l") == lang, F.lit(min(1.0, 1.5 * docs_per_language / n))).otherwise(rates)
    u, v, w = (F.pmod(F.xxhash64(F.lit(seed + k), "i", "t"), F.lit(1 << 30)) / F.lit(float(1 << 30)) for k in range(3))
    piece = 4 * dictionary_bytes // docs_per_language
    start = F.floor(v * (F.greatest(F.length("t") - piece, F.lit(0)) + 1)).cast("int") + 1
    got = d.withColumn("u", u).where(F.col("u") < rates).select("l", "u", w.alias("w"), F.substring("t", start, F.lit(piece)).alias("t")).collect()
    by: dict[str, list[tuple[float, float, str]]] = {}
    for r in got:
        by.setdefault(r["l"], []).append((r["u"], r["w"], r["t"]))
    out = []
    for lang in sorted(by, key=lambda x: (-counts[x], x)):
        texts = [(w, letters(t).encode()) for _, w, t in sorted(by[lang])[:docs_per_language]]
        each = max(64, dictionary_bytes // len(texts))
        parts = [t[(a := int(w * (max(len(t) - each, 0) + 1))) : a + each] for w, t in texts]
        out.append((lang, b" ".join(parts)[-dictionary_bytes:]))
    return out


class Compressors:
    """One compressor per language, its dictionary digested once."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int):
        self.langs = [x for x, _ in dictionaries]
        self.each = []
        for _, raw in dictionaries:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        blocks = [text[k : k + BLOCK_CHARS].encode() for k in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c(b)) for b in blocks) for c in self.each]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], *, min_margin: float = 0.01, level: int = 6, text_col: str = "text") -> DataFrame:
    """Predict each text's language.

    docs: any columns; only text_col is read. The whole text, lower-cased, is compressed with every
    dictionary in blocks; the smallest sum wins, ties go to the language more frequent in training.
    lang_score = 1 - smallest / second smallest (0 to 1; 1 with one language only). lang_accepted is
    false where it is under min_margin, and for texts without a letter.

    Returns all columns of docs, lang_pred string (`und` for null, empty and letterless texts),
    lang_score double, lang_accepted boolean (clashing names are replaced). No dictionaries: all
    `und`. Empty input gives an empty result; repeated rows are answered alike. No shuffle; the
    dictionaries travel with the task.
    """
    own = ["lang_pred", "lang_score", "lang_accepted"]
    names = [c for c in docs.columns if c not in own]
    at = names.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, lang_score double, lang_accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(dictionaries, level)
        for batch in batches:
            preds, scores = [], []
            for text in batch.column(at):
                text = letters(text.as_py() or "")
                if not text or not model.langs:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                sizes = np.array(model.sizes(text))
                best = int(sizes.argmin())
                preds.append(model.langs[best])
                scores.append(1.0 if len(sizes) == 1 else float(1 - sizes[best] / np.partition(sizes, 1)[1]))
            accepted = [p != "und" and s >= min_margin for p, s in zip(preds, scores)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], [*names, *own])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
