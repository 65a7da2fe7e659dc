"""SentencePiece encoding and decoding by a Viterbi pass over a trie of the distinct marked words.

Sorted words share their prefixes, and a depth-first walk keeps one forward state per prefix: how long the last piece of the
prefix's segmentation is. For a unigram model that is the best-scoring (Viterbi) segmentation. For a BPE model a best score
is not what the library gives; there a piece may follow another exactly if the two, joined, segment into
themselves, by which rule the segmentation of every prefix is unique and equals the library's. In both, a word's
pieces are read off by walking back once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
# Distinct words remembered per Python worker and generation, and characters of these at most.
MEMO_WORDS = 250_000
MEMO_CHARS = 3_000_000
# Words of at most this many characters keep the ids of all their prefixes while the trie is walked.
SHORT_WORD = 48
# What is remembered of pieces and pairs of pieces.
KNOWN_PIECES = 100_000
KNOWN_PAIRS = 250_000
# Texts are taken in parts of about this many characters, cut between words.
PART_CHARS = 262_144
UNIGRAM, BPE = 1, 2
_LOADED: dict[str, "Codec"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


def model_type(raw: bytes) -> int:
    """The trainer's model type of a serialised model: 1 unigram (also where none is given), 2 BPE, 3 words, 4 characters."""
    for number, value in _fields(raw):
        if number == 2:
            return next((v for k, v in _fields(value) if k == 3), UNIGRAM)
    return UNIGRAM


def has_own_symbols(raw: bytes) -> bool:
    """Whether a serialised model has user-defined pieces, which the library cuts out before it segments."""
    return any(k == 3 and v == 4 for number, value in _fields(raw) if number == 1 for k, v in _fields(value))


def _float(x: float) -> float:
    """Rounded to single precision, in which the library adds scores."""
    return struct.unpack("f", struct.pack("f", x))[0]


class Codec:
    """Tables of one model file and a bounded memory of encoded words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        shown = ["".join(sp.encode(t, out_type=str)) for t in ("  a  b", "a\nb")]
        if shown[0] != f"{MARK * 3}a{MARK * 2}b" or MARK in shown[1][1:]:
            raise ValueError("the model rewrites white space")
        raw = sp.serialized_model_proto()
        self.kind = model_type(raw)
        if self.kind not in (UNIGRAM, BPE) or has_own_symbols(raw):
            raise ValueError("the model is neither plain unigram nor plain BPE")
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.id = {names[i]: i for i in plain}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces hold marks inside; words are no exact cut")
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[tuple[float, str, str]] | None] = {}
        self.forget()
        # Pieces that can come up (in BPE: that their characters do merge to), and all their tails.
        self.pieces = {p: i for p, i in self.id.items() if self.kind == UNIGRAM or self.steps(p) is not None}
        self.tails = {p[k:] for p in self.pieces for k in range(len(p))}
        self.unknown_score = _float(min(self.score.values(), default=0.0) - 10.0)

    def forget(self) -> None:
        """Empty what is remembered of words. What is known of pieces and their pairs is small and stays."""
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bad: set[str] = set()
        self.chars = 0

    def steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """Plain BPE of one piece (join the best-scoring neighbours, the left one first): the score of each
        join and the outermost parts after it; None if the characters don't end up as this piece."""
        known = self.known.get(piece, 0)
        if known != 0:
            return known
        parts, out = list(piece), []
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1], -np.inf)
                if s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        self.known[piece] = out if len(parts) == 1 else None
        return self.known[piece]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether a + b segments into a, b: run the joins inside both, best first, and see if one across comes up."""
        key = (a, b)
        known = self.follows.get(key)
        if known is not None:
            return known
        if len(self.follows) > KNOWN_PAIRS:
            self.follows.clear()
        get, none = self.score.get, -np.inf
        left, right = self.steps(a), self.steps(b)
        i = j = 0
        end, begin = a[-1], b[0]
        across = get(end + begin, none)
        while True:
            x = left[i][0] if i < len(left) else none
            y = right[j][0] if j < len(right) else none
            if across > x and across >= y and across > none:
                ok = False
                break
            if x == none and y == none:
                ok = True
                break
            if x >= y:
                if left[i][2] != end:
                    end = left[i][2]
                    across = get(end + begin, none)
                i += 1
            else:
                if right[j][1] != begin:
                    begin = right[j][1]
                    across = get(end + begin, none)
                j += 1
        self.follows[key] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of marked words: depth-first over the trie that the sorted words form; the path's forward states stay for the words that share it."""
        short = [w for w in words if len(w) <= SHORT_WORD] if self.kind == BPE else []
        out = self.encode_short(sorted(short))
        forward = self.forward_bpe if self.kind == BPE else self.forward_unigram
        last: list[str] = [""]
        best: list[float] = [0.0]
        before = ""
        for word in sorted(words if self.kind == UNIGRAM else (w for w in words if len(w) > SHORT_WORD)):
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            forward(word, last, best)
            out[word] = self.walk_back(word, last)
            before = word
        self.chars += sum(map(len, words))
        return out

    def encode_short(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The same for sorted short words and BPE; the ids of each prefix are kept with its state, as they are few."""
        pieces, tails, follows = self.pieces, self.tails, self.follows
        out: dict[str, tuple[int, ...]] = {}
        last: list[str] = [""]
        ids: list[tuple[int, ...]] = [()]
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                begin = end - 1
                piece = word[begin:end]
                while True:
                    own = pieces.get(piece)
                    if own is not None or begin == end - 1:
                        ok = begin == 0 or follows.get((last[begin], piece))
                        if ok is None:
                            ok = self.may_follow(last[begin], piece)
                        if ok:
                            last.append(piece)
                            if own is not None:
                                ids.append((*ids[begin], own))
                            elif self.bytes:
                                ids.append(ids[begin] + self.spelled(piece))
                            else:  # a run of unknown characters is one unknown id
                                ids.append(ids[begin] if begin and last[begin] not in pieces else (*ids[begin], self.unknown))
                            break
                    begin -= 1
                    piece = word[begin:end]
                    if begin < 0 or piece not in tails:
                        raise AssertionError(f"no piece ends at {end} of {word!r}")
            out[word] = ids[-1]
            before = word
        return out

    def forward_bpe(self, word: str, last: list[str], best: list[float]) -> None:
        """Append the last piece of each further prefix's BPE segmentation."""
        pieces, tails, follows = self.pieces, self.tails, self.follows
        for end in range(len(last), len(word) + 1):
            begin = end - 1
            piece = word[begin:end]
            while True:
                if piece in pieces or begin == end - 1:
                    ok = begin == 0 or follows.get((last[begin], piece))
                    if ok is None:
                        ok = self.may_follow(last[begin], piece)
                    if ok:
                        last.append(piece)
                        break
                begin -= 1
                piece = word[begin:end]
                if begin < 0 or piece not in tails:
                    raise AssertionError(f"no piece ends at {end} of {word[:80]!r}")

    def forward_unigram(self, word: str, last: list[str], best: list[float]) -> None:
        """Append the last piece and the score of each further prefix's best segmentation; of equal scores the longer last
        piece stands, as in the library."""
        pieces, tails, score = self.pieces, self.tails, self.score
        for end in range(len(last), len(word) + 1):
            found, most = None, -np.inf
            begin = end - 1
            piece = word[begin:end]
            if piece not in pieces:
                found, most = piece, _float(best[begin] + self.unknown_score)
            while begin >= 0 and piece in tails:
                if piece in pieces:
                    total = _float(best[begin] + score[piece])
                    if total >= most:
                        found, most = piece, total
                begin -= 1
                piece = word[begin:end]
            last.append(found)
            best.append(most)

    def walk_back(self, word: str, last: list[str]) -> tuple[int, ...]:
        """Ids of the word's pieces, from the last one to the first; a run of unknown characters is one unknown id."""
        get, parts, at = self.pieces.get, [], len(word)
        while at:
            piece = last[at]
            parts.append(piece)
            at -= len(piece)
        parts.reverse()
        ids = tuple(map(get, parts))
        if None not in ids:
            return ids
        out: list[int] = []
        for k, piece in enumerate(parts):
            if ids[k] is not None:
                out.append(ids[k])
            elif self.bytes:
                out += self.spelled(piece)
            elif not k or ids[k - 1] is not None:
                out.append(self.unknown)
        return tuple(out)

    def spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    @staticmethod
    def words(text: str) -> list[str]:
        """Words of a text. Between single blanks a word is as it stands, its mark left out; where blanks or marks follow one
        another, words come with their marks, which stay with the characters that follow them."""
        if not text:
            return []
        if MARK not in text:
            parts = text.split(" ")
            if "" not in parts:
                return parts
        parts = text.replace(" ", MARK).split(MARK)
        out, marks = [], ""
        for p in parts:
            marks += MARK
            if p:
                out.append(marks + p)
                marks = ""
        if marks:
            out.append(marks)
        return out

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        """Parts of a text, cut at single blanks (which the next part's own mark stands for)."""
        start = 0
        while len(text) - start > PART_CHARS:
            at = text.find(" ", start + PART_CHARS)
            while 0 < at < len(text) - 1 and (text[at - 1] in (" ", MARK) or text[at + 1] in (" ", MARK)):
                at = text.find(" ", at + 1)
            if not 0 < at < len(text) - 1:
                break
            yield text[start:at]
            start = at + 1
        yield text[start:]

    def encode_parts(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text (a part, or whole), and whether they decode to it."""
        split = [self.words(t) for t in texts]
        words = set().union(*split)
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS or self.chars > MEMO_CHARS:  # two generations: frequent words stay
            self.older, self.memo, self.chars = self.memo, {}, 0
            self.bad &= self.older.keys()
            new = words
        old = new.intersection(self.older)
        self.memo.update({w: self.older[w] for w in old})
        new -= old
        if new:
            marked = {w: w if w[0] == MARK else MARK + w for w in new}
            found = self.encode_words(list(set(marked.values())))
            raw = self.raw.__getitem__
            self.bad.update(w for w, m in marked.items() if b"".join(map(raw, found[m])) != m.replace(MARK, " ").encode())
            self.memo.update((w, struct.pack(f"{len(found[m])}i", *found[m])) for w, m in marked.items())
        get = self.memo.__getitem__
        packed = [b"".join(map(get, ws)) for ws in split]
        # The words of a text decode to it, but where one has unknown characters or the text itself has a mark.
        same = [MARK not in t and self.bad.isdisjoint(ws) for t, ws in zip(texts, split)]
        return [np.frombuffer(p, np.int32) for p in packed], same

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_texts(texts)[0]]

    def encode_texts(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to it."""
        out, same = [], []
        for text in texts if any(len(t) > PART_CHARS for t in texts) else ():
            got = [self.encode_parts([p]) for p in self.parts(text)]
            out.append(np.concatenate([ids for own, _ in got for ids in own]))
            same.append(all(ok for _, own in got for ok in own))
        return (out, same) if out else self.encode_parts(texts)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, *, text_col: str = "text") -> DataFrame:
    """Encode whole texts.

    docs: any columns; only text_col is read. model: path of a sentencepiece .model file, unigram or BPE, that keeps
    white space (no normalisation), the same on every executor; any other raises ValueError. Unigram scores are added
    from each word's beginning; the library adds them in single precision from the text's, which in long texts can settle
    a near tie the other way.

    Returns all columns of docs, piece_ids array<int> as the library's encode gives them and
    round_trip boolean (decoding gives the text back; false where the text itself holds the mark
    character U+2581, which decodes to a blank). Null text: null ids and round_trip null; empty text:
    empty ids. Clashing names are replaced; repeated rows are answered alike; empty input gives an
    empty result. No shuffle; texts are taken in parts of bounded size, cut between words, a word of any
    length has one state per character, and what is remembered is bounded and forgotten with the task.
    """
    names = [c for c in docs.columns if c not in ("piece_ids", "round_trip")]
    at = names.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", piece_ids array<int>, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        try:
            for batch in batches:
                for start, stop in text_slices(batch.column(at), 2 << 20):
                    part = batch.slice(start, stop - start)
                    missing = pc.is_null(part.column(at))
                    ids, same = c.encode_texts(pc.fill_null(part.column(at), "").to_pylist())
                    offsets = np.cumsum([0] + [len(i) for i in ids], dtype=np.int64).astype(np.int32)
                    values = pa.array(np.concatenate(ids or [np.zeros(0, np.int32)]))
                    lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing)
                    ok = pa.array(same, pa.bool_(), mask=missing.to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, ok], [*names, "piece_ids", "round_trip"])
        finally:
            c.forget()  # workers live on after their task

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, *, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """Decode piece ids into text_col (added or replaced); null ids give null, no ids an empty text."""
    names = [c for c in rows.columns if c != text_col]
    at = names.index(ids_col)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + f", `{text_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [None if i is None else c.decode(i) for i in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text_col])

    return rows.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
