"""SentencePiece encoding and decoding with a forward pass over shared prefixes.

The distinct marked words of a batch are sorted, which lines them up as a trie in depth-first order; each word takes over the
forward states of the prefix it shares with the word before and only extends them.

* Unigram models: the state of a prefix is the best score and last piece (Viterbi).
* BPE models (the public 32k model is one): the best-score path is not what BPE merges give, so the state is the last piece of
  the prefix's own BPE encoding.  Every run of neighbouring pieces of an encoding is the encoding of what it spells, and a
  sequence of pieces is an encoding if each neighbouring pair is; so exactly one piece that ends at a position fits the state
  at its start, and states are shared by common prefixes just as Viterbi's are.  Results equal the merge procedure's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from os.path import commonprefix
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tickloom.llm.common import doc_slices, free_name, worker_cache

MARK = "▁"
#: Types of pieces and models in the public model format, fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NOTHING = -1  # no piece: the start of a word, or a character that has none
PAIR_MEMORY, WORD_BYTES = 1_000_000, 32 << 20
SLICE = 4 << 20  # bytes of text, or of ids, that are worked on at a time


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


class Subword:
    """A SentencePiece model: encodes words that begin with marks, decodes ids."""

    def __init__(self, raw: bytes) -> None:
        self.kind, self.dummy_prefix, self.pieces = UNIGRAM, True, []
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that keep text as it is (identity, no removal of spaces) are supported")
        if self.kind not in (UNIGRAM, BPE) or any(t in (USER_DEFINED, UNUSED) for _, _, t in self.pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on past a mark are not supported")
        self.scores = [s for _, s, _ in self.pieces]
        self.reach: dict[str, int] = {}  # length of the longest piece that ends with these two characters
        for piece in self.ids:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
        self.low = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0) - 10.0
        self.packed = [struct.pack("<I", i) for i in range(len(self.pieces))]
        self.sizes = [len(p) for p, _, _ in self.pieces]
        self.history: dict[int, tuple | None] = {}  # a story for each piece at most
        self.fits: dict[int, bool] = {}  # of pairs of pieces, emptied at PAIR_MEMORY
        self.words: dict[str, bytes] = {}  # encoded words; when they hold WORD_BYTES they become the older ones, which then go
        self.older: dict[str, bytes] = {}
        self.word_bytes = 0

    def merges(self, word: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE by its definition: pieces of a word, and after each merge its score, the first and the last symbol."""
        parts, done = list(word), []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts, done
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            done.append((best, parts[0], parts[-1]))

    def _story(self, k: int) -> tuple | None:
        """The merges that make a piece out of itself; None if BPE splits it."""
        if k not in self.history:
            piece = self.pieces[k][0]
            parts, done = self.merges(piece)
            self.history[k] = (piece[0], piece[-1], done) if len(parts) == 1 else None
        return self.history[k]

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves pieces a and b apart.  Their own merges run side by side, better scores first, leftmost on ties; they fit
        if no merge across the border comes first at any time.  After nothing (a below 0) every piece fits that BPE keeps whole."""
        if a < 0:
            return self._story(b) is not None
        pair = a * len(self.pieces) + b
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIR_MEMORY:
                self.fits.clear()
            known = self.fits[pair] = self._side_by_side(self._story(a), self._story(b))
        return known

    def _side_by_side(self, a: tuple | None, b: tuple | None) -> bool:
        if a is None or b is None:
            return False
        s = t = 0
        right, left, none = a[1], b[0], float("-inf")
        while True:
            k = self.ids.get(right + left)
            of_a, of_b = a[2][s][0] if s < len(a[2]) else none, b[2][t][0] if t < len(b[2]) else none
            if k is not None and self.scores[k] > of_a and self.scores[k] >= of_b:
                return False
            if of_a == of_b == none:
                return True
            if of_a >= of_b:
                right, s = a[2][s][2], s + 1
            else:
                left, t = b[2][t][1], t + 1

    def _unknown_ids(self, char: str) -> bytes:
        ids = [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]
        return np.array(ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words: depth-first over the trie that the sorted words are.  A prefix's state is its last piece, which
        is also the way back to where that piece begins: a few bytes a character, however long a word is."""
        out, before = {}, ""
        ids, reach, bpe, low = self.ids, self.reach, self.kind == BPE, self.low
        last, score = [NOTHING], [0.0]
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], score[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                best, top = NOTHING, low
                for j in range(max(0, i - reach.get(word[i - 2 : i], 1)) if i > 1 else 0, i):
                    k = ids.get(word[j:i])
                    if k is None:
                        continue
                    if bpe:
                        if self.pair_fits(last[j], k):
                            best = k
                            break
                    elif best < 0 or score[j] + self.scores[k] > top:
                        best, top = k, score[j] + self.scores[k]
                last.append(best)
                if not bpe:
                    score.append(top if best >= 0 else score[i - 1] + low)
            out[word] = self._way_back(word, last)
            before = word
        return out

    def _way_back(self, word: str, last: list[int]) -> bytes:
        """Ids of a word from its last piece to its first; a character without a piece stands alone."""
        found, at = [], len(word)
        while at:
            k = last[at]
            found.append(self._unknown_ids(word[at - 1]) if k < 0 else self.packed[k])
            at -= 1 if k < 0 else self.sizes[k]
        return b"".join(reversed(found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text.  Words that were met before, in any batch, are remembered."""
        split = [self.split(x) for x in texts]
        if self.word_bytes > WORD_BYTES:
            self.older, self.words, self.word_bytes = self.words, {}, 0
        known, older = self.words, self.older
        new = {w for words in split for w in words if w not in known}
        kept = {w: older[w] for w in new if w in older}
        made = self.encode_words([w for w in new if w not in kept]) | kept
        known.update(made)
        self.word_bytes += sum(map(len, made)) + sum(map(len, made.values())) + 150 * len(made)
        return [b"".join([known[w] for w in words]) for words in split]

    def split(self, text: str) -> list[str]:
        """Marked words: runs of marks, each with the characters up to the next mark."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if not self.dummy_prefix or "" in words:
            marked = (" " if self.dummy_prefix else "") + text
            words, held = [], 0
            for i, w in enumerate(marked.split(" ")):
                held += i > 0
                if w:
                    words.append(MARK * held + w)
                    held = 0
            return [*words, MARK * held] if held else words
        return [MARK + w for w in words]

    def decode(self, packed: bytes) -> str:
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _model(raw: bytes) -> Subword:
    cache = worker_cache("subword")
    if cache.get("subword_raw") != raw:
        cache |= {"subword_raw": raw, "subword": Subword(raw)}
    return cache["subword"]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, ids BINARY): each text's ids, packed as little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids.  Marks (U+2581) in a text count as spaces.  Repeated rows stay rows.  No shuffle.  Carried columns
    called id or ids are left out.
    """
    raw = Path(model_path).read_bytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1).cast(pa.binary())), 0).to_pylist()
            for a, b in doc_slices(sizes, SLICE):
                batch = whole.slice(a, b - a)
                ids = model.encode([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], "ids"])

    rest = docs.select(F.col(id_col).alias("id"), *[c for c in carry if c not in ("id", "ids")], F.col(text_col).cast("string").alias(free_name("text", ["id", *carry])))
    return rest.mapInArrow(each, StructType([*rest.schema.fields[:-1], StructField("ids", BinaryType())]))


def decode(table: DataFrame, model_path: str, *, ids_col: str = "ids", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The kept columns and text, decoded from packed ids.  Null ids give null.  A kept column called text is left out."""
    raw = Path(model_path).read_bytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_pylist()
            for a, b in doc_slices(sizes, SLICE):
                batch = whole.slice(a, b - a)
                texts = [None if x is None else model.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    rest = table.select(*[c for c in keep if c != "text"], F.col(ids_col).alias(free_name("ids", list(keep))))
    return rest.mapInArrow(each, StructType([*rest.schema.fields[:-1], StructField("text", StringType())]))
