"""Best-fit packing of tokenised documents by exact complements.

Only the number of pieces of each length matters to the plan, and there are at most `capacity` lengths: the plan is made on
that histogram (4,096 counters at most, whatever the corpus) and consists of patterns - combinations of lengths - with
multiplicities.  Pieces are then dealt to patterns by their rank among the pieces of their length, which is computed in
salted groups so that no length, however common, is ranked in one task.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import cut, hash_bucket, utf8_list, worker_cache

END_ID = 1
#: Words kept in a task's memory of encoded words; it is emptied when full.
WORD_MEMORY = 500_000
#: ASCII marks, which are split off after letters; letters of Latin-1 in lower case; how the tokenizer's vocabulary writes a word's last
#: token; fixed values.
MARKS = ".,;:!?" + "".join(x for x in string.punctuation if x not in ".,;:!?")
LATIN = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
WORD_END = "</w>"


class WordTokenizer:
    """Encodes texts with a tokenizer that drops white space and ends each word's last token alike: each word is encoded once and
    remembered.  Marks that follow letters are a word of their own to such a tokenizer, so they are split off.  Letters of Latin-1, which
    have one lower-case form and compose with nothing, are put in lower case here and encoded many at a time by the model alone; other
    letters go through the whole tokenizer, many at a time too.  Both are told apart by their end tokens.  Other words are encoded one by
    one."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.model = Tokenizer.from_str(definition), Tokenizer.from_str(definition)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, stems: list[str], tokenizer) -> None:
        """Encodes words of letters, some hundreds at a time."""
        groups = [stems[i : i + 256] for i in range(0, len(stems), 256)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, e in zip(part, tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                to = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(to) == len(group):
                    raw = ids.tobytes()
                    self.stems.update(zip(group, [raw[a:b] for a, b in zip([0, *to], to, strict=False)], strict=True))
                else:  # a letter to Python that is none to the tokenizer
                    self.stems.update((w, self._one(w)) for w in group)

    def _encode(self, words: list[bytes]) -> None:
        if not words:
            return
        text = b" ".join(words).decode()
        lowered = text.lower().split(" ")  # letter for letter where it is used, below
        stems = [w.rstrip(MARKS) for w in lowered]
        plain = [s.isalpha() and (s.isascii() or LATIN(s) is not None) for s in stems]
        known, learned, marks = self.words, self.stems, self.marks
        self._learn(list({s for s, ok in zip(stems, plain, strict=True) if ok}.difference(learned)), self.model)
        rest = []
        for w, low, stem, ok in zip(words, lowered, stems, plain, strict=True):
            if ok:
                tail = low[len(stem) :]
                if tail not in marks:
                    marks[tail] = self._one(tail)
                known[w] = learned[stem] + marks[tail]
            else:
                rest.append(w)
        if rest:
            self._encode_others(rest)

    def _encode_others(self, words: list[bytes]) -> None:
        split, rest = [], []
        for w in words:
            text = w.decode()
            stem = text.rstrip(MARKS)
            # judged as the tokenizer sees it: in lower case and composed, where a letter may have become a letter and a sign
            if unicodedata.normalize("NFC", stem.lower()).isalpha():
                split.append((w, stem, text[len(stem) :]))
            else:
                rest.append((w, text))  # as it is: the tokenizer's added tokens are matched before it lowers letters
        known, stems, marks = self.words, self.stems, self.marks
        self._learn(list({stem for _, stem, _ in split}.difference(stems)), self.tokenizer)
        for w, stem, tail in split:
            if tail not in marks:
                marks[tail] = self._one(tail)
            known[w] = stems[stem] + marks[tail]
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Token ids of each text, packed as little-endian unsigned 32-bit numbers."""
        split = [x.split() for x in texts]
        if len(self.words) > WORD_MEMORY:
            self.words.clear()
        if len(self.stems) > WORD_MEMORY:
            self.stems.clear()
        if len(self.marks) > WORD_MEMORY:
            self.marks = {"": b""}
        known = self.words
        self._encode(list(set().union(*split).difference(known)))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def pieces(docs: DataFrame, definition: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): documents as token ids, the end id after each, cut only if longer than capacity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("packing")
        if cache.get("word_definition") != definition:
            cache |= {"word_definition": definition, "word_tokenizer": WordTokenizer(definition)}
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), cache["word_tokenizer"].ids(utf8_list(batch.column(1))), strict=True):
                    ids += end
                    for k in range(0, len(ids) // 4, capacity):
                        part = ids[4 * k : 4 * (k + capacity)]
                        rows.append((doc, k // capacity, k, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


class Complements:
    """Index of the single lengths, pairs and triples of lengths by their sum, under the counts that are left.  Counts only fall, so an
    entry that they no longer allow is taken out for good, and what was tried in vain is not tried again."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.tolist()
        self.have = counts > 0
        self.pairs: dict[int, list[int]] = {}  # by sum: the larger lengths of its pairs, ascending
        self.thirds: dict[int, int] = {}  # by sum: the largest length of its triples that may still be there

    def use(self, lengths: tuple[int, ...]) -> int:
        """Takes a pattern as often as its counts allow."""
        n = min(self.left[x] // lengths.count(x) for x in lengths)
        for x in lengths:
            self.left[x] -= n
            self.have[x] = self.left[x] > 0
        return n

    def fits(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, most: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths with this sum, the larger as large as can be but `most` at most, beside those that are taken."""
        held = self.pairs.get(total)
        if held is None:
            low = (total + 1) // 2
            held = self.pairs[total] = (low + np.flatnonzero(self.have[low:total] & self.have[total - low : 0 : -1])).tolist() if total > 1 else []
        at = bisect_right(held, most)
        while at:
            at -= 1
            a, b = held[at], total - held[at]
            if not self.fits(a, b):
                del held[at]
            elif self.fits(a, b, *taken):
                return a, b
        return None

    def triple(self, total: int, taken: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Three lengths with this sum, the largest as large as can be, beside those that are taken."""
        c = top = self.thirds.get(total, total - 2)
        while 3 * c >= total:
            if self.left[c] and self.fits(c, *taken) and (found := self.pair(total - c, c, (c, *taken))):
                return (c, *found)
            if c == top and not (self.left[c] and self.pair(total - c, c, (c,))):
                top = self.thirds[total] = c - 1
            c -= 1
        return None

    def of(self, length: int, capacity: int) -> tuple[int, ...] | None:
        """What exactly fills the gap that a length leaves: nothing, a single, a pair or a triple."""
        gap = capacity - length
        if not gap:
            return ()
        if self.fits(length, gap):
            return (gap,)
        return self.pair(gap, gap - 1, (length,)) or self.triple(gap, (length,))


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, multiplicity) that use every piece counted, counts[n] being the pieces of length n.

    Longest first: its gap is looked up in the index of single lengths, of pair sums and of triple sums; an exact complement is
    consumed as often as its counts allow.  What no complement fills is packed best-fit.
    """
    index, out = Complements(np.pad(counts, (0, max(0, capacity + 1 - len(counts))))), []
    for length in range(capacity, 0, -1):
        while index.left[length] > 0 and (rest := index.of(length, capacity)) is not None:
            out.append(((length, *rest), index.use((length, *rest))))
    for length in range(capacity, 0, -1):
        while index.left[length] > 0:
            pattern, gap, free = [length], capacity - length, index.have.copy()
            free[length] = index.left[length] > 1
            while gap and (fits := free[gap:0:-1]).any():
                x = gap - int(fits.argmax())
                pattern.append(x)
                free[x] = index.left[x] > pattern.count(x)
                gap -= x
            out.append((tuple(pattern), index.use(tuple(pattern))))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which its slots begin, the first sequence of each slot and the offset in it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            found.setdefault(length, []).append((rank, base, offset))
            ranks[length] = rank + n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(table: DataFrame, *, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 4096, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length from 1 to capacity.  Rows with equal lengths may trade places.

    Lengths outside that range raise.  Ties in the order and repeated rows are packed like other rows; no rows give no rows.
    Existing columns named sequence_id or offset are replaced.
    """
    kept = [c for c in table.columns if c not in ("sequence_id", "offset")]
    salted = cut(table.select(F.struct(*kept).alias("row"), F.col(length_col).cast("int").alias("n"), hash_bucket(F.struct(*order), salts).alias("salt")))
    cells = salted.groupBy("n", "salt").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("n", "salt", "many", before.alias("before"))  # salts rows for a length at most
    by_length = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("n").agg(F.sum("many").alias("many")).collect():  # capacity rows at most
        if r.n is None or not 0 < r.n <= capacity:
            raise ValueError(f"length {r.n} does not fit a sequence of {capacity}")
        by_length[r.n] = r.many
    where = slots(plan_patterns(by_length, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order_ = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(n[order_]) != 0]) if len(n) else []
            for rows in np.split(order_, edges[1:]) if len(n) else []:
                begin, base, at = where[int(n[rows[0]])]
                k = np.searchsorted(begin, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - begin[k], at[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], schema=pa.schema([batch.schema.field(0), ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy(*[F.col(f"row.{c}") for c in order])) - 1
    offsets = cells.select(F.col("n").alias("cell_n"), F.col("salt").alias("cell_salt"), "before")
    ranked = salted.withColumn("rank", rank).join(F.broadcast(offsets), (F.col("n") == F.col("cell_n")) & (F.col("salt") == F.col("cell_salt")))  # capacity x salts rows at most
    placed = ranked.select("row", "n", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    schema = placed.select("row").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return placed.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (packed little-endian) if asked for.

    Null text is empty (one piece that holds the end id).  Rows with a null or repeated id are packed like other rows.
    """
    table = pieces(docs, Path(tokenizer_path).read_text(), id_col=id_col, text_col=text_col, capacity=capacity)
    return pack(table if with_ids else table.drop("ids"), order=("doc_id", "piece", "ids_crc32"), capacity=capacity)
