"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints are split into `radius + spare` blocks.  Two fingerprints that differ in at most `radius` bits agree on at
least `spare` whole blocks, so every close pair shares the value of at least one combination of `spare` blocks.  Each distinct
fingerprint is filed once under every combination; inside a file, fingerprints are linked by verified Hamming distance.
Files emit a spanning forest of their links (as many rows as fingerprints at most), never all pairs, and the forest of all
files together has the same connected components as all links.

Equal fingerprints are collapsed to one row before anything is filed, so copies never travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, free_name, popcount, utf8_list
from tickloom.llm.components import components


def fingerprint(raw: bytes, shingle: int) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = raw.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = (ends - sizes)[:n].tolist(), ends[shingle - 1 :].tolist()
    for i in range(0, n, 1 << 16):
        h = np.array([of(joined[a:b], 42) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp LONG): one row per input row.  Null text counts as empty; other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in utf8_list(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "id long, fp long")


def block_masks(radius: int, spare: int) -> list[int]:
    """Bit masks of every combination of `spare` of the `radius + spare` blocks."""
    cuts = np.linspace(0, 64, radius + spare + 1).round().astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, spare)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Positions linked at `radius`: a spanning forest, found by absorbing neighbours until none is left."""
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            near = popcount(fps[rest] ^ fps[x]) <= radius
            if near.any():
                hit = rest[near]
                out.append((int(x), hit))
                open_.extend(hit.tolist())
                rest = rest[~near]
    return out


def _linker(radius: int):
    """Reads rows sorted by (mask, block) and emits links inside each run of equal keys."""

    def runs(key: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])])

    def links(batch: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        mask, key, fp, rep = batch
        begin = runs(key, mask)
        size = np.diff(np.r_[begin, len(key)])
        twos = begin[size == 2]
        twos = twos[popcount(fp[twos] ^ fp[twos + 1]) <= radius]
        a, b = [rep[twos]], [rep[twos + 1]]
        for i, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for x, hit in forest(fp[i : i + n], radius):
                a.append(np.full(len(hit), rep[i + x]))
                b.append(rep[i + hit])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(i).to_numpy() for i in range(4))
            now = (now[0], now[1], now[2].view(np.uint64), now[3])
            last = runs(now[1], now[0])[-1]
            same = held and (held[-1][0][-1], held[-1][1][-1]) == (now[0][0], now[1][0])
            if held and (last or not same):
                yield links(tuple(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in now), strict=True)))
                held = []
            elif last:
                yield links(tuple(x[:last] for x in now))
            held.append(tuple(x[last:] for x in now))
        if held:
            yield links(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    return each


def close_links(classes: DataFrame, *, radius: int = 4, spare: int = 3) -> DataFrame:
    """classes (fp, rep), one row per fingerprint: links (a, b) between representatives that span every component of
    the graph of pairs within `radius` bits.  With 7 blocks and 3 of them shared, a file's key has 27 bits."""
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("m")) for i, m in enumerate(block_masks(radius, spare))])
    filed = classes.select("fp", "rep", F.explode(masks).alias("k")).select(F.col("k.i").alias("i"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key"), "fp", "rep")
    return filed.repartition("i", "key").sortWithinPartitions("i", "key").mapInArrow(_linker(radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, spare: int = 3) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id reachable over links, the row's own included.

    Null text is empty, and empty texts share fingerprint zero.  A row whose id is null keeps its fingerprint and its links, but lends
    no id, so a component of such rows only is null.  Repeated ids are rows like any other.  No rows give no rows.
    Extra columns are ignored whatever their names.
    """
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    # the nodes are fingerprints: classes that share an id, or have none, stay apart or link as their bits say
    found = components(close_links(classes.select("fp", F.col("fp").alias("rep")), radius=radius, spare=spare))
    joined = classes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "fp").alias("root"), "rep")
    least = joined.groupBy(F.col("root").alias("l_root")).agg(F.min("rep").alias("component"))
    labelled = joined.join(least, F.col("root") == F.col("l_root")).select("class_fp", "component")
    return fps.join(labelled, F.col("fp") == F.col("class_fp"), "left").select("id", "fp", "component")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **detect) -> DataFrame:
    """documents of which each component keeps the row or rows with its smallest id; rows with a null id stay.  All columns stay."""
    found = near_duplicates(docs, id_col=id_col, **detect)
    name = free_name("away", docs.columns)
    away = found.where("id is not null and id <> component").select(F.col("id").alias(name))
    stay = found.where("id = component").select(F.col("id").alias("stay"))
    gone = away.join(stay, F.col(name) == F.col("stay"), "left_anti").distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
