"""Token counts at every prefix: cumulative counts per word, and a prefix table per distinct word."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _SPACE, text_slices

# Distinct words remembered per Python worker and generation.
MEMO_WORDS = 500_000
_CUT = re.compile(r"(?<!\s)(?=[ \t\n\r\x0b\x0c])")
_MARK = re.compile(r"(?<![ \u2581])(?= )")
_LOADED: dict[str, tuple[Callable[[list[str]], list[int]], Callable[[list[str]], list[int]], str, list[bytes]]] = {}


def load(path: str) -> tuple[Callable[[list[str]], list[int]], Callable[[list[str]], list[int]], str, list[bytes]]:
    """(counts of texts, counts of units, kind, lower-cased added tokens) for a .json (tokenizers) or .model (sentencepiece) file.

    kind says which units tokenise independently: "words" (white space is dropped), "spaced" (white
    space belongs to the word that follows) or "marked" (as spaced, one leading blank being the
    model's own mark). A model for which no such cut is exact raises ValueError.
    """
    if path not in _LOADED:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()

            def counts(texts: list[str]) -> list[int]:
                return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

            kind = "words" if counts([" \n\t", "a \n a", "a"]) == [0, 2, 1] else "spaced"

            def joined(words: list[str]) -> list[int]:
                """Words behind one another in one text; each token counts for the word in which it begins."""
                begins = np.cumsum([0] + [len(w) + 1 for w in words])
                at = [a for a, _ in tok.encode(" ".join(words), add_special_tokens=False).offsets]
                own = np.searchsorted(begins, at, side="right") - 1
                return np.bincount(own, minlength=len(words))[: len(words)].tolist()

            each = joined if kind == "words" else counts
            added = sorted({t.content.lower().encode() for t in tok.get_added_tokens_decoder().values()})
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_file=path)

            def counts(texts: list[str]) -> list[int]:
                return [len(x) for x in sp.encode(texts, num_threads=1)]

            kind, each, added = "marked", counts, []
            if sp.decode(sp.encode("  a  b\n c")) != "  a  b\n c" or sp.encode("a b c") != sp.encode("a") + sp.encode("b") + sp.encode("c"):
                raise ValueError("the model rewrites white space; words are no exact cut")
        else:
            raise ValueError("a tokenizer is a .json or .model file")
        _LOADED[path] = counts, each, kind, added
    return _LOADED[path]


def units(text: bytes, kind: str) -> tuple[list[bytes], np.ndarray]:
    """Parts of a UTF-8 text that tokenise alone, and the byte offset where each ends."""
    if kind == "words":
        raw = np.frombuffer(text, np.uint8)
        inside = np.append(~_SPACE[raw], False)
        return text.split(), np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    cut = _MARK if kind == "marked" else _CUT
    parts = [x.encode() for x in cut.split(text.decode()) if x]
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
    if kind == "marked":  # the model puts the blank before each part itself
        parts = parts[:1] + [x[1:] for x in parts[1:]]
    return parts, ends


class PrefixCounter:
    """Exact counts for words and their prefixes, each computed once."""

    def __init__(self, path: str):
        self.counts, self.each, self.kind, self.added = load(path)
        # Probed: case is dropped, and a full stop or comma behind a letter is a token of its own.
        self.folds = self.kind == "words" and self.counts(["Zq", "zq", "zq.", "zq,", ".", ","])[1:] == [(n := self.counts(["Zq"])[0]), n + 1, n + 1, 1, 1]
        self.memo: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:  # two generations: frequent words stay
            self.older, self.memo = self.memo, {}
            new = words
        old = new.intersection(self.older)
        self.memo.update({w: self.older[w] for w in old})
        cores = {w: self.core(w) for w in new - old}
        plain = list({c for c, _ in cores.values()})
        found: dict[bytes, int] = {}
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            found.update(zip(part, self.each([w.decode() for w in part])))
        self.memo.update((w, found[c] + more) for w, (c, more) in cores.items())
        if self.kind == "marked":
            self.memo[b""] = 1  # a blank with nothing behind it is a mark alone

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))
        except KeyError:
            self.learn(set(words))
            return np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))

    def core(self, word: bytes) -> tuple[bytes, int]:
        """(what to encode for a word, tokens besides): many words differ in case and a last mark only. Added tokens
        are matched in the raw text, so a word that holds one in any case stays as it is."""
        if self.folds and word.isascii():
            low = word.lower()
            if any(a in low for a in self.added):
                return word, 0
            more = 0
            if len(word) > 1 and word[-1:] in b".," and word[-2:-1].isalpha():
                word, more = word[:-1], 1
            return word.lower(), more
        return word, 0

    def prefixes(self, word: bytes) -> list[int]:
        """Count of every code-point prefix of one word, from the empty one on."""
        text = word.decode()
        return [0, *self.counts([text[:k] for k in range(1, len(text) + 1)])]

    def index(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(byte ends, cumulative counts) over the units of a text."""
        parts, ends = units(text.encode(), self.kind)
        return ends, np.cumsum(self.of(parts), dtype=np.int64)


def count_at(text: str, ends: np.ndarray, tokens: np.ndarray, chars: int, counter: PrefixCounter) -> int:
    """Exact token count of text[:chars] from the stored index; only the last, cut word is looked up by its prefixes."""
    at = len(text[:chars].encode())
    k = int(np.searchsorted(ends, at, side="right"))
    done = int(tokens[k - 1]) if k else 0
    tail = text.encode()[int(ends[k - 1]) if k else 0 : at]
    if counter.kind == "words":
        tail = tail.strip()
    elif counter.kind == "marked" and k:
        tail = tail[1:]
        if not tail and at > int(ends[k - 1]):  # a blank alone after a word is one mark
            return done + 1
    return done + (counter.prefixes(tail)[-1] if tail else 0)


def longest_prefix(ends: np.ndarray, tokens: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix that ends with a unit and has at most budget tokens."""
    k = int(np.searchsorted(tokens, budget, side="right"))
    return int(ends[k - 1]) if k else 0


def prefix_token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """Token counts of every prefix of every text that ends with a word.

    docs: any columns; only id_col (long) and text_col are read. tokenizer: path of a .json or .model
    file, the same on every executor. Counts are the library's, without special tokens added; special
    strings inside a text are handled as the library does by default.

    Returns id_col, n_bytes long (UTF-8 length), prefix_bytes array<int> (where each unit ends),
    prefix_tokens array<int> (tokens up to there) and budget_bytes int (longest such prefix within
    `budget` tokens). Truncation and budget questions are binary searches in these arrays; a cut
    inside a word adds PrefixCounter.prefixes of that word alone (count_at). Null and empty texts
    have empty arrays; a text of any length is one row; repeated rows are answered alike; null ids pass.

    Units tokenise independently, so the dynamic programme over prefixes is a running sum, and each
    distinct word is encoded once per worker. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for start, stop in text_slices(texts):
                sizes, ends, sums, lens, budgets = [], [], [], [0], []
                raws = [(t or "").encode() for t in texts[start:stop].to_pylist()]
                cuts = [units(raw, counter.kind) for raw in raws]
                counter.learn({w for parts, _ in cuts for w in parts})
                for raw, (parts, end) in zip(raws, cuts):
                    total = np.cumsum(counter.of(parts), dtype=np.int64)
                    sizes.append(len(raw))
                    ends.append(end.astype(np.int32))
                    sums.append(total.astype(np.int32))
                    lens.append(lens[-1] + len(end))
                    budgets.append(longest_prefix(end, total, budget))
                offsets = pa.array(lens, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.zeros(0, np.int32)]), pa.int32())) for x in (ends, sums)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(sizes, pa.int64()), *lists, pa.array(budgets, pa.int32())], [id_col, "n_bytes", "prefix_bytes", "prefix_tokens", "budget_bytes"])

    schema = f"`{id_col}` long, n_bytes long, prefix_bytes array<int>, prefix_tokens array<int>, budget_bytes int"
    return docs.selectExpr(f"cast(`{id_col}` as long) `{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
