"""The common part of exact set-similarity joins: which earlier sets may match a later one.

Sets are hashed words, or hashed runs of words, and have a place (id, line) in the corpus's order.  Every set files its rarest members
- the prefix - with its size, the member's position and a parity sketch of all members.  Files are packed by a hash of the member, so
that Spark moves a few large rows instead of one for every member.  In a file, sets of like size that share a member are tried in the
corpus's order; length, position and sketch leave candidates, and a later set names its `most` earliest ones.  Sets that none of these
settles, and that had more, name all of their candidates in a second round.  Groups of like sets thus give a few rows a set, not all
pairs, and no candidate is lost.

Filters, for similarity num / den: with sizes a and b a match shares need = ceil(num (a + b) / (num + den)) members or more, so at most
a + b - 2 need stand in one set only; each flips a bit of the sketch.  The first shared member leaves `need` members in both sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import doc_slices, popcount, utf8_list, worker_cache

CELL_BITS = 18
CELLS = 1 << CELL_BITS  # counters of the rarity sketch
BASE = 0x9E3779B97F4A7C15  # of the words' polynomial hash, odd
PIECE = 1 << 19  # bytes that are hashed at a time
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Sizes above which a sketch has 128 and 256 bits instead of 64.
WIDER, WIDEST = 100, 220
PAIRS = 1 << 19  # that are tried at a time


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, kept by the worker."""
    cache = worker_cache("setjoin")
    if len(cache.get("line_powers", ((),))[0]) < n:
        n = max(n, 2 * PIECE)
        grow = lambda x: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, x, np.uint64))])
        cache["line_powers"] = grow(BASE), grow(pow(BASE, -1, 1 << 64))
    return cache["line_powers"]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased text, and where each begins.  All words are hashed at once: differences of a prefix
    sum of a polynomial, brought to place zero and mixed."""
    text = np.frombuffer(raw, np.uint8)
    word = ~IS_SPACE[text]
    edge = np.diff(np.r_[False, word, False].view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32)), start


#: Of lower-cased texts: the hashed members of each, in order, and the number of the text that each belongs to.
Members = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Members of each text: its words."""
    h, start = hashed_words(b"\n".join(texts))
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return h, np.searchsorted(ends, start, side="right")


def rarity_sketch(texts: DataFrame, text: str, members: Members = words_of) -> np.ndarray:
    """Counts of the whole corpus's members in CELLS counters.  Each task sends one row for each of 64 stretches of the counters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            found = utf8_list(batch.column(0))
            for a, b in doc_slices([len(x) for x in found], PIECE):
                h, _ = members([x.lower() for x in found[a:b]])
                cells += np.bincount((h >> np.uint64(64 - CELL_BITS)).view(np.int64), minlength=CELLS)
        parts = cells.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "cells"])

    def total(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(x, np.int64) for x in table.column("cells").to_pylist())
        return pa.table({"part": table.column("part")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})

    rows = texts.select(text).mapInArrow(each, "part int, cells binary").groupBy("part").applyInArrow(total, "part int, cells binary").collect()  # 64 rows of CELLS / 64 counters
    return np.concatenate([np.frombuffer(r.cells, np.int64) for r in sorted(rows, key=lambda r: r.part)]) if rows else np.zeros(CELLS, np.int64)


POSTING = np.dtype([("word", "<u4"), ("size", "<u4"), ("pos", "<u4"), ("line", "<i4"), ("id", "<i8"), ("parity", "<u8", 4)])
PLACE = np.dtype([("id", "<i8"), ("line", "<i4")])
FILED = "file int, postings binary"


def squeeze(p: np.ndarray) -> bytes:
    """Records byte by byte of their columns, compressed: neighbours have much in common."""
    return len(p).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes(), "zstd", asbytes=True)


def unsqueeze(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """All records of a column of squeezed pieces."""
    made = [np.zeros(0, kind)]
    for raw in column.to_pylist():
        if raw:
            n = int.from_bytes(raw[:4], "little")
            flat = np.frombuffer(pa.decompress(raw[4:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
            made.append(np.ascontiguousarray(flat.reshape(-1, n).T).reshape(-1).view(kind))
    return np.concatenate(made)


def by_file(records: np.ndarray, key: np.ndarray, files: int) -> tuple[list[int], list[bytes]]:
    """File numbers and squeezed records of each, in the order of the key."""
    file = (key % np.array(files, key.dtype)).astype(np.int64)
    order = np.argsort(file << 32 | key.astype(np.int64)) if key.dtype.itemsize == 4 else np.lexsort((key, file))
    records, file = records[order], file[order]
    begin = np.flatnonzero(np.r_[True, file[1:] != file[:-1]]) if len(file) else np.zeros(0, np.int64)
    return file[begin].tolist(), [squeeze(x) for x in np.split(records, begin[1:])] if len(file) else []


def postings(places: np.ndarray, hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Postings of sets - hashed members and the number of the set, ascending, that each belongs to - in the order of rarity.  A set
    too small to match any other set than its like files one hash of all its members, which no frequent member gathers in one file."""
    if not len(hashes):
        return np.zeros(0, POSTING)
    code, h = pd.factorize(hashes)
    by_rarity = np.lexsort((h, counts[(h >> np.uint64(64 - CELL_BITS)).view(np.int64)]))
    rank = np.empty(len(h), np.int64)
    rank[by_rarity] = np.arange(len(h))
    both = owner << 32 | rank[code]
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]]
    line, code = both >> 32, by_rarity[both & 0xFFFFFFFF]
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[begin, len(line)])
    words = np.where(size > WIDEST, 4, np.where(size > WIDER, 2, 1))
    mine = h[code]
    bit, word = np.uint64(1) << (mine & np.uint64(63)), (mine >> np.uint64(6)).astype(np.int64) & (np.repeat(words, size) - 1)
    parity = np.stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begin) for k in range(4)], axis=1)
    pos = np.arange(len(line)) - np.repeat(begin, size)
    alone = (size + 1) * num > size * den  # not even a set of one more matches
    prefix = pos < np.where(np.repeat(alone, size), 1, np.repeat(size - -(-num * size // den) + 1, size))
    at, of = line[prefix], np.repeat(np.arange(len(begin)), size)[prefix]
    out = np.empty(int(prefix.sum()), POSTING)
    whole = np.bitwise_xor.reduceat(mine * np.uint64(BASE) ^ (mine >> np.uint64(31)), begin)
    out["word"] = (np.where(alone[of], whole[of], mine[prefix]) >> np.uint64(16)).astype(np.uint32)
    out["pos"], out["size"], out["parity"] = pos[prefix], size[of], parity[of]
    out["id"], out["line"] = places["id"][at], places["line"][at]
    return out


def _ranks(p: np.ndarray) -> np.ndarray:
    """Each posting's set as a number in the corpus's order."""
    order = np.lexsort((p["line"], p["id"]))
    ids, lines = p["id"][order], p["line"][order]
    new = np.r_[False, (ids[1:] != ids[:-1]) | (lines[1:] != lines[:-1])] if len(p) else np.zeros(0, bool)
    rank = np.empty(len(p), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class _File:
    """The postings of a file, sorted by member, size class and place.  Sizes of matching sets are in the same or in neighbouring
    classes, each of which is den / num times as wide as the one before."""

    def __init__(self, table: pa.Table, num: int, den: int, wanted: np.ndarray | None = None) -> None:
        self.num, self.den = num, den
        self.file = table.column("file")[0].as_py() if table.num_rows else 0
        p = self._shared(unsqueeze(table.column("postings"), POSTING), wanted)
        rank = _ranks(p)
        step = np.log(den / num) if den > num else np.inf
        key = p["word"].astype(np.int64) << 16 | (np.log(np.maximum(p["size"], 1)) / step).astype(np.int64) + 1
        order = np.lexsort((rank, key))
        self.p, self.rank, self.key = p[order], rank[order], key[order]
        self.size = self.p["size"].astype(np.int64)
        self.rest = self.size - self.p["pos"]
        self.wide = np.searchsorted([WIDER, WIDEST], self.size)
        new = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(p) else np.zeros(0, np.int64)
        self.keys = self.key[new]
        self.place = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(p)])) << 32 | self.rank

    @staticmethod
    def _shared(p: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
        """Postings of members that two sets or more have filed and, if only some sets (PLACE) are wanted, one of them has."""
        order = np.argsort(p["word"], kind="stable")  # pieces are sorted, so this merges them
        word = p["word"][order]
        same = word[1:] == word[:-1]
        keep = np.r_[False, same] | np.r_[same, False] if len(p) else np.zeros(0, bool)
        p = p[order[keep]]
        return p if wanted is None else p[np.isin(p["word"], p["word"][_at(p, wanted)])]

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs pass the filters."""
        both = self.size[a] + self.size[b]
        need = -(-self.num * both // (self.num + self.den))
        ok = np.flatnonzero(np.minimum(self.rest[a], self.rest[b]) >= need)
        a, b, spare = a[ok], b[ok], (both - 2 * need)[ok]
        flips = self.p["parity"][a] ^ self.p["parity"][b]
        apart = np.where(self.wide[a] == self.wide[b], popcount(flips).sum(axis=1, dtype=np.int64), popcount(np.bitwise_xor.reduce(flips, axis=1)))
        return ok[apart <= spare]

    def candidates(self, later: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (later, earlier) of the given later postings and earlier ones that pass the filters, the earliest first.  After
        `most` + 1 of a posting, in a class, no more are looked for."""
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in (-1, 0, 1) if len(self.keys) else ():
            to = np.searchsorted(self.keys, self.key[later] + step)
            there = self.keys[np.minimum(to, len(self.keys) - 1)] == self.key[later] + step
            a, to = later[there], to[there]
            begin, end = np.searchsorted(self.place, to << 32), np.searchsorted(self.place, to << 32 | self.rank[a])
            live, held, at, width = np.flatnonzero(end > begin), np.zeros(len(a), np.int64), 0, 32
            while len(live):
                n = np.minimum(end[live] - begin[live] - at, width)
                edges = np.r_[0, np.cumsum(n)]
                first = 0
                while first < len(live):
                    last = max(first + 1, int(np.searchsorted(edges, edges[first] + PAIRS, side="right")) - 1)
                    who, many = live[first:last], n[first:last]
                    x = np.repeat(who, many)
                    y = np.repeat(begin[who] + at - (edges[first:last] - edges[first]), many) + np.arange(len(x))
                    ok = self.passes(a[x], y)
                    x, y = x[ok], y[ok]
                    if len(x):
                        new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                        nth = np.arange(len(x)) - np.repeat(new, np.diff(np.r_[new, len(x)])) + held[x]
                        keep = nth <= most
                        held += np.bincount(x, minlength=len(held))
                        found_a.append(a[x[keep]])
                        found_b.append(y[keep])
                    first = last
                at, width = at + width, min(2 * width, 4096)
                live = live[(end[live] - begin[live] > at) & (held[live] <= most)]
        return np.concatenate(found_a), np.concatenate(found_b)

    def named(self, later: np.ndarray, most: int) -> pa.Table:
        """Rows of CANDIDATE: the `most` earliest candidates of each later set, and whether it has more."""
        a, b = self.candidates(later, most)
        order = np.lexsort((self.rank[b], self.rank[a]))
        a, b = a[order], b[order]
        ra, rb = self.rank[a], self.rank[b]
        pair = np.flatnonzero(np.r_[True, (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1])]) if len(a) else np.zeros(0, np.int64)
        a, b, ra = a[pair], b[pair], ra[pair]
        new = np.flatnonzero(np.r_[True, ra[1:] != ra[:-1]]) if len(a) else pair
        many = np.diff(np.r_[new, len(a)])
        keep = np.arange(len(a)) - np.repeat(new, many) < most
        a, b, more = a[keep], b[keep], np.repeat(many > most, many)[keep]
        p = self.p
        return pa.table({"file": pa.array(np.full(len(a), self.file, np.int32)), "id": pa.array(p["id"][a]), "line": pa.array(p["line"][a]), "e_id": pa.array(p["id"][b]), "e_line": pa.array(p["line"][b]), "more": pa.array(more)})


def _at(p: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the postings of the wanted sets are."""
    some = np.flatnonzero(np.isin(p["id"], wanted["id"]))
    mine = np.zeros(len(some), PLACE)
    mine["id"], mine["line"] = p["id"][some], p["line"][some]
    return some[np.isin(mine.view("V12"), wanted.view("V12"))] if len(some) else some


CANDIDATE = "file int, id long, line int, e_id long, e_line int, more boolean"


def candidates_table(ids: np.ndarray, lines: np.ndarray) -> pa.Table:
    """Rows of CANDIDATE without an earlier set, for sets that are known to repeat one."""
    n = len(ids)
    return pa.table({"file": pa.array(np.zeros(n, np.int32)), "id": pa.array(ids), "line": pa.array(lines), "e_id": pa.nulls(n, pa.int64()), "e_line": pa.nulls(n, pa.int32()), "more": pa.array(np.zeros(n, bool))})


def first_round(filed: DataFrame, num: int, den: int, most: int, known: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """(id, line, named): of each set that has candidates the `most` earliest of each file, and whether the file has more.  known gives
    rows of candidates_table for a file's rows.  filed is read whole in both rounds, and named has all in one column, so that Spark
    makes and moves either once.  Joins on id and line add a test for nulls to the plans that read named; it stands here already, so that
    these plans stay the same."""

    def earliest(table: pa.Table) -> pa.Table:
        f = _File(table, num, den)
        rows = f.named(np.arange(len(f.p)), most)
        return pa.concat_tables([rows, known(table)]) if known else rows

    rows = filed.groupBy("file").applyInArrow(lambda t: earliest(t), CANDIDATE).where("id is not null and line is not null")
    return rows.groupBy("id", "line").agg(F.collect_set(F.struct("file", "e_id", "e_line", "more")).alias("named"))


def repeats() -> Column:
    """Whether a set of the first round is known to repeat an earlier one."""
    return F.exists("named", lambda x: x["e_id"].isNull())


def second_round(filed: DataFrame, still: DataFrame, num: int, den: int) -> DataFrame:
    """(id, line, e_id, e_line): all candidates of the sets in still (o_file, o_id, o_line), in those files."""

    def every(table: pa.Table, wanted: pa.Table) -> pa.Table:
        sets = np.zeros(wanted.num_rows, PLACE)
        sets["id"], sets["line"] = wanted.column("o_id").to_numpy(), wanted.column("o_line").to_numpy()
        f = _File(table.slice(0, table.num_rows if len(sets) else 0), num, den, sets)
        return f.named(_at(f.p, sets), 1 << 62)

    rows = filed.groupBy("file").cogroup(still.groupBy("o_file")).applyInArrow(lambda a, b: every(a, b), CANDIDATE)
    return rows.select("id", "line", "e_id", "e_line").distinct()


def pairs_of(named: DataFrame) -> DataFrame:
    """(id, line, e_id, e_line) of the first round's rows."""
    return named.where(~repeats()).select("id", "line", F.explode(F.array_distinct(F.transform("named", lambda x: F.struct(x["e_id"].alias("e_id"), x["e_line"].alias("e_line"))))).alias("e")).select("id", "line", "e.e_id", "e.e_line")


def open_in(named: DataFrame, settled: DataFrame) -> DataFrame:
    """(o_file, o_id, o_line): the files that have more candidates of sets that are not in settled (id, line)."""
    done = settled.select(F.col("id").alias("g_id"), F.col("line").alias("g_line"))
    files = F.array_distinct(F.transform(F.filter("named", lambda x: x["more"]), lambda x: x["file"]))
    rest = named.where(~repeats() & F.exists("named", lambda x: x["more"])).join(done, (F.col("id") == F.col("g_id")) & (F.col("line") == F.col("g_line")), "left_anti")
    return rest.select(F.explode(files).alias("o_file"), F.col("id").alias("o_id"), F.col("line").alias("o_line"))


def file_count(total_bytes: int, file_bytes: int) -> int:
    """How many files: a file holds the postings of so many bytes of text."""
    return max(512, total_bytes // file_bytes)
