"""Language-model scoring by online logistic mixing of hashed-context bit predictors, beside a unigram base.

The model predicts a text, its letters A-Z in lower case, bit by bit, and an end symbol (byte 255, which UTF-8 never uses) after it.  A
predictor is a context of the preceding bytes; the longest one is hashed.  For every node of a byte's eight binary decisions it has the
logit log((n + DELTA) / (m + DELTA)), n and m being how often the training texts took the bit that comes and the other one.  What no
training text has shown has logit 0 and so no say.  The logits are summed with weights, which are gated by the bit's place in its byte,
and refined by a scale, which is gated by how many predictors know the node.  Weights and scales start at fixed values and learn online, by
gradient steps after every bit; they begin anew every SEGMENT bytes of a text, so that a long text's segments can be scored apart.  The
contexts go on across segments.  Every probability depends on what precedes it alone, so a text's score is the logarithm of a probability.

On Spark: documents are cut into pieces of bounded size and hashed into blocks, those that train and those held out apart.  A block names
every distinct (context, byte) and word that it holds, with their counts if it trains, packed by shard of the context.  Shards sum the
counts and answer each block's names in their order with eight logits a name, or a count a word.  Blocks then run all their segments in
step, a bit at a time.  Nothing is broadcast, and what is counted and sent grows with the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, doc_slices, small, text_bytes, utf8_list

ORDERS = (2, 3, 4, 5)  # bytes of the predictors' contexts; the fifth byte of the last one is hashed from two
HEAD = 8  # bytes before a piece that its contexts need
END = b"\xff"
SEGMENT = 1024
DELTA = 0.1
START = (0.1, 0.2, 0.3, 0.4)  # weights that the mixing starts with
SCALES = (1.0, 2.5, 1.7, 1.2, 1.0)  # by how many predictors know the node
RATE, SCALE_RATE = 0.012, 0.004
UNIT = 4.0  # logits are kept as whole quarters, which pack well and cost nothing that could be seen
PIECE = 1 << 20
BATCH = 8 << 20
SLICE = 3 << 20  # bytes of a block that are mixed at a time
FIXED = 1 << 20  # bits are summed as whole numbers of 1/FIXED bit
SPACE = re.compile(rb"[\x20\x09-\x0D]")
GAPS = np.isin(np.arange(256), list(b" \t\n\r\v\f"))  # the bytes that SPACE matches
WORDS = -1
KINDS = (WORDS, *ORDERS)  # what a row of names holds, each kind in its place


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text cut behind white space into pieces of about `most` bytes; longer ones only where a word is longer."""
    at = 0
    while len(text) - at > most:
        found = SPACE.search(text, at + most - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of every text; equal rows of a batch become one row with their number."""
    for whole in batches:
        for batch in small(iter([whole]), 2, BATCH):
            rows = []
            found = Counter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_list(batch.column(2)), strict=True))
            for (key, held, raw), copies in found.items():
                text = raw.lower()  # A-Z only, as these are bytes
                digest, parts, before = hashlib.blake2b(text, digest_size=16).digest(), list(pieces(text)), b"\0" * HEAD
                for i, part in enumerate(parts):
                    rows.append((key, held, digest, i, i == len(parts) - 1, copies, before, len(part), pa.compress(part, "zstd", asbytes=True) if part else b""))
                    before = (before + part)[-HEAD:]
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


PIECES = "id long, held boolean, digest binary, part int, last boolean, copies long, before binary, size int, body binary"


def grams(before: list[bytes], bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every body a key of six bytes: the byte itself, the four before it, nearest first, and a byte hashed from the two
    before those.  A key's first k + 1 bytes are the gram of order k.  Also the number of bytes of each body."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    raw = b"".join(x for pair in zip(before, bodies, strict=True) for x in pair)
    eight = np.ndarray(max(0, len(raw) - HEAD), "<u8", raw, 1, (1,))  # each byte and the seven before it
    far = (eight >> np.uint64(8)).astype(np.uint16) * np.uint16(0x9E37) >> np.uint16(8)
    key = eight >> np.uint64(24) << np.uint64(8) | far
    starts = np.cumsum(sizes + HEAD) - (sizes + HEAD)
    valid = np.ones(len(key), bool)
    valid[(starts[1:, None] - HEAD + np.arange(HEAD)).ravel()] = False
    return key[valid], sizes


def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers in as narrow a type as holds them, and the bits that they take.  Stable sorts of 8 and 16 bits count, they don't compare."""
    bits = int(x.max(initial=0)).bit_length()
    return x.astype(np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint64), bits


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and where each stood; equal ones stay in order.  As much of a key's low end as fits in 64 bits with its place is sorted
    as one number, which is much faster, then what is left by counting."""
    place_bits = len(key).bit_length()
    low = 64 - place_bits
    both = (key << np.uint64(place_bits)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << place_bits) - 1)
    order = both.view(np.int64)
    top, bits = _dense(key >> np.uint64(low))
    if bits:
        order = order[np.argsort(top[order], kind="stable")]
    return key[order], order


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def levels(by_key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of sorted keys, for each order from the longest: its distinct grams, where each begins among those of the order before (at
    first: among the keys), and how many these are."""
    out, keys, width = [], by_key, 6
    for k in reversed(ORDERS):
        keys = keys >> np.uint64(8 * (width - k - 1)) if width > k + 1 else keys
        width, above = k + 1, len(keys)
        begin = _runs(keys)
        keys = keys[begin]
        out.append((keys, begin, above))
    return out


def _context(gram: np.ndarray, k: int) -> np.ndarray:
    return gram & np.uint64((1 << 8 * k) - 1)


def _shard(gram: np.ndarray, k: int, shards: int) -> np.ndarray:
    """A shard for every gram of order k; grams of one context have one shard."""
    h = (_context(gram, k) + np.uint64(k << 56)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _by_shard(shard: np.ndarray) -> np.ndarray:
    return np.argsort(_dense(shard)[0], kind="stable")


def _word_shard(word: bytes, shards: int) -> int:
    return zlib.crc32(word) % shards


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int, kind: str) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n).T).reshape(-1).view(kind)


def _texts(table: pa.Table) -> list[bytes]:
    """The pieces' texts, which travel packed."""
    return [pa.decompress(x, n, "zstd", asbytes=True) if n else b"" for x, n in zip(table.column("body").to_pylist(), table.column("size").to_pylist(), strict=True)]


def _bodies(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """The pieces' heads and bodies, the end symbol included, in a defined order."""
    return utf8_list(table.column("before")), [x + END if last else x for x, last in zip(_texts(table), table.column("last").to_pylist(), strict=True)]


def _sorted_pieces(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("digest", "ascending"), ("part", "ascending"), ("copies", "ascending")])


def _words(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a block in order, the place among them of every word of its texts, and how many words each text has."""
    texts = _texts(table)
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    gap = GAPS[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # where words begin and end, in turn, as a gap is on both sides
    begin, end = edge[::2], edge[1::2]
    own = np.diff(np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in texts)])))
    offsets = np.cumsum(np.r_[0, end - begin])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap])]).dictionary_encode()
    order = pc.array_sort_indices(spelled.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, at, letters = spelled.dictionary.take(pa.array(order)).buffers()
    at, letters = np.frombuffer(at, np.int64)[: len(order) + 1].tolist() if len(order) else [0], letters.to_pybytes() if letters else b""
    return [letters[a:b] for a, b in zip(at, at[1:], strict=False)], rank[spelled.indices.to_numpy()], own


NAMED = "shard int, block int, many array<int>, names array<binary>, counts array<binary>"


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    """A table of a DDL schema whose types are these few."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _namer(shards: int):
    """The distinct grams and words of a block, packed by shard, with their counts if the block trains."""

    def each(table: pa.Table) -> pa.Table:
        block, held = table.column("block")[0].as_py(), table.column("held")[0].as_py()
        cells: dict[int, list[tuple[int, bytes, bytes]]] = {}
        empty = lambda: [(0, b"", b"")] * len(KINDS)
        key, sizes = grams(*_bodies(table))
        copies, n = table.column("copies").to_numpy(), None
        if held or copies.max(initial=1) == 1:
            key.sort()
        else:
            key, order = ordered(key)
            n = np.repeat(copies, sizes)[order]
            del order
        for k, (gram, begin, width) in zip(reversed(ORDERS), levels(key), strict=True):
            n = np.diff(np.r_[begin, width]) if n is None else np.add.reduceat(n, begin)
            shard = _shard(gram, k, shards)
            order = _by_shard(shard)
            for x in np.split(order, _runs(shard[order])[1:]):
                cells.setdefault(int(shard[x[0]]), empty())[KINDS.index(k)] = (len(x), _pack(np.diff(gram[x], prepend=np.uint64(0))), b"" if held else _pack(n[x]))
        del key, n, gram, begin, shard, order, x
        words, place, own = _words(table)
        many = np.bincount(place, np.repeat(copies, own), len(words)).astype(np.int64)  # whole numbers below 2^53
        del place
        pa.default_memory_pool().release_unused()
        for shard, x in _dealt_words(words, shards).items():
            cells.setdefault(shard, empty())[0] = (len(x), pa.compress(b" ".join([words[i] for i in x.tolist()]), "zstd", asbytes=True), b"" if held else _pack(many[x]))
        return _rows([(shard, block, *map(list, zip(*cell, strict=True))) for shard, cell in cells.items()], NAMED)

    return each


def _dealt_words(words: list[bytes], shards: int) -> dict[int, np.ndarray]:
    """Places of a block's words by shard."""
    shard = np.fromiter((_word_shard(w, shards) for w in words), np.int32, len(words))
    order = _by_shard(shard)
    return {int(shard[x[0]]): x for x in np.split(order, _runs(shard[order])[1:]) if len(x)}


def logits(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted distinct grams with the byte last: the logits of its eight bits, a byte each, of what comes against what does not."""
    out = np.empty((len(gram), 8), np.int8)
    keys, total, index = gram, n.astype(np.int64), None
    for bit in range(7, -1, -1):
        keys_up = keys >> np.uint64(1)
        begin = _runs(keys_up)
        up = np.add.reduceat(total, begin) if len(begin) else total
        parent = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(keys)]))
        other = up[parent] - total
        value = np.log((total + np.float32(DELTA)).astype(np.float32) / (other + np.float32(DELTA)).astype(np.float32))
        value = np.clip(np.rint(value * np.float32(UNIT)), -40, 40).astype(np.int8)
        out[:, bit] = value if index is None else value[index]
        index = parent if index is None else parent[index]
        keys, total = keys_up[begin], up
    return out.reshape(-1).view(np.uint64)


ANSWER = "block int, shard int, many array<int>, answers array<binary>, fresh long"


def _answer(table: pa.Table) -> pa.Table:
    """A shard's answers to every row of names; fresh is the number of words that are counted in no earlier block."""
    table = table.sort_by("block")
    many = table.column("many").to_pylist()
    answers: list[list[bytes]] = [[] for _ in many]
    for place, kind in enumerate(KINDS):
        names, counts = (pc.list_element(table.column(c), place).to_pylist() for c in ("names", "counts"))
        sizes = [m[place] for m in many]
        if kind == WORDS:
            found, fresh = _word_answers(names, counts, sizes)
        else:
            found = _gram_answers(kind, names, counts, sizes)
        for mine, x in zip(answers, found, strict=True):
            mine.append(x)
    return _rows(list(zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), many, answers, fresh, strict=True)), ANSWER)


def _gram_answers(k: int, names: list[bytes], counts: list[bytes], sizes: list[int]) -> list[bytes]:
    if not sum(sizes):
        return [b""] * len(sizes)
    key = np.concatenate([np.cumsum(_unpack(x, m, "<u8"), dtype=np.uint64) for x, m in zip(names, sizes, strict=True) if m])
    n = np.concatenate([_unpack(x, m, "<i8") if x else np.zeros(m, np.int64) for x, m in zip(counts, sizes, strict=True) if m])
    by_context = _context(key, k) << np.uint64(8) | key >> np.uint64(8 * k)  # the byte last
    del key
    order = np.argsort(by_context)
    by_context, n = by_context[order], n[order]
    begin = _runs(by_context)
    each = logits(by_context[begin], np.add.reduceat(n, begin))
    value = np.empty(len(n), np.uint64)
    value[order] = np.repeat(each, np.diff(np.r_[begin, len(n)]))
    ends = np.cumsum(sizes).tolist()
    return [pa.compress(value[e - m : e].tobytes(), "zstd", asbytes=True) if m else b"" for m, e in zip(sizes, ends, strict=True)]


def _word_answers(names: list[bytes], counts: list[bytes], sizes: list[int]) -> tuple[list[bytes], list[int]]:
    """Counts of every row's words, and how many of its words no earlier row counts."""
    total: dict[bytes, int] = {}
    fresh, split = [], [_text(x).split(b" ") if m else [] for x, m in zip(names, sizes, strict=True)]
    for words, own, m in zip(split, counts, sizes, strict=True):
        before = len(total)
        if own:
            for w, c in zip(words, _unpack(own, m, "<i8").tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        fresh.append(len(total) - before)
    return [_pack(np.array([total.get(w, 0) for w in words], np.int64)) if words else b"" for words in split], fresh


def _text(raw: bytes) -> bytes:
    return pa.input_stream(pa.py_buffer(raw), compression="zstd").read()


def mix(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits that each segment costs.  many[t] segments, in falling order of length, are longer than t bytes; values (predictors, bytes) has
    eight logits for each byte, all segments' first bytes, then all their second ones, and so on."""
    width, k = int(many[0]) if len(many) else 0, len(values)
    bits, at = np.zeros(width), 0
    weights = np.empty((8, k, width), np.float32)  # negative, as what is needed is exp of minus the sum
    weights[:] = -(np.array(START, np.float32) / UNIT)[None, :, None]
    scales = np.repeat(np.array(SCALES, np.float32), width)
    place = np.arange(width)
    rate, scale_rate, low, high, least, most, one = (np.array(x, np.float32) for x in (-RATE / UNIT**2, -SCALE_RATE, -10, 10, 0.2, 8, 1))
    eight = values.view(np.int8).reshape(k, -1, 8)
    old = 0  # arrays are made anew only where fewer segments are left
    for m in many.tolist():
        if m != old:
            xs, e, ups, misses, taken, new = np.empty((8, k, m), np.float32), np.empty(m, np.float32), *(np.empty((8, m), np.float32) for _ in range(3)), np.empty(m, np.float32)
            gates, w, old, here = np.empty((8, m), np.int64), weights[:, :, :m], m, place[:m]
        x8 = eight[:, at : at + m]
        at += m
        xs[:] = x8.transpose(2, 0, 1)
        known = (x8 != 0).view(np.int8).sum(axis=0, dtype=np.int8)
        np.multiply(known.T, width, out=gates, dtype=np.int64)
        gates += here
        # a bit has weights of its own, so eight bits are summed and learned from at once; only their scales follow each other
        plains = np.einsum("bkm,bkm->bm", w, xs)
        steps = plains * scale_rate
        for plain, step, gate, up, miss, scale in zip(plains, steps, gates, ups, misses, taken, strict=True):
            scales.take(gate, out=scale, mode="clip")
            np.multiply(plain, scale, out=e)
            np.minimum(e, high, out=e)
            np.maximum(e, low, out=e)
            np.exp(e, out=e)
            np.add(e, one, out=up)
            np.divide(e, up, out=miss)
            np.multiply(miss, step, out=new)
            np.add(new, scale, out=new)
            np.maximum(new, least, out=new)
            np.minimum(new, most, out=new)
            scales[gate] = new
        taken *= misses
        taken *= rate
        xs *= taken[:, None, :]
        w += xs
        bits[:m] += np.log2(np.multiply.reduce(ups, axis=0))
    return bits


def _scorer(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Of every piece of a block: words, known words, sum of log10(count + 0.1), bits, and the block's fresh words at its first piece."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    answers = answers.sort_by("shard")
    many = answers.column("many").to_pylist()
    of_kind = lambda place: pc.list_element(answers.column("answers"), place).to_pylist()
    shards = int(docs.column("shards")[0].as_py())
    words, place, tokens = _words(docs)
    known, dealt = np.zeros(len(words), np.int64), _dealt_words(words, shards)
    for shard, m, raw in zip(answers.column("shard").to_pylist(), many, of_kind(0), strict=True):
        if m[0]:
            known[dealt[shard]] = _unpack(raw, m[0], "<i8")
    owner = np.repeat(np.arange(docs.num_rows), tokens)
    seen = np.bincount(owner, known[place] > 0, docs.num_rows).astype(np.int64)
    base = np.bincount(owner, np.log10(known + 0.1)[place], docs.num_rows)
    del words, place, owner, known, dealt
    pa.default_memory_pool().release_unused()
    bits = _bits(docs, {k: [np.frombuffer(pa.decompress(raw, 8 * m[i], "zstd", asbytes=True), np.uint64) for m, raw in zip(many, of_kind(i), strict=True) if m[i]] for i, k in enumerate(KINDS) if k != WORDS}, shards)
    fresh = [sum(answers.column("fresh").to_pylist())] + [0] * (docs.num_rows - 1)
    columns = [docs.column("id"), docs.column("held"), docs.column("digest"), docs.column("last"), docs.column("copies"), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(np.rint(bits * FIXED).astype(np.int64)), pa.array(fresh, pa.int64())]
    return pa.table(columns, names=names)


SCORED = "id long, held boolean, digest binary, last boolean, copies long, words long, known long, base double, bits long, fresh long"


def _bits(docs: pa.Table, by_kind: dict[int, list[np.ndarray]], shards: int) -> np.ndarray:
    """Bits of every piece.  The block's grams, in the order in which they were named, meet their answers first; then a slice of the
    pieces at a time is sorted, finds its grams among the block's, and is mixed."""
    before, bodies = _bodies(docs)
    key = grams(before, bodies)[0]
    key.sort()
    table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, (gram, _, _) in zip(reversed(ORDERS), levels(key), strict=True):
        own = np.empty(len(gram), np.uint64)
        own[_by_shard(_shard(gram, k, shards))] = np.concatenate(by_kind.pop(k))
        table[k] = gram, own
    del key
    slices = doc_slices([len(x) for x in bodies], SLICE)
    return np.concatenate([_slice_bits(before[a:b], bodies[a:b], table) for a, b in slices] or [np.zeros(0)])


def _slice_bits(before: list[bytes], bodies: list[bytes], table: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    key, sizes = grams(before, bodies)
    # segments, longest first, and where each byte's logits go
    each = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
    by_length = np.argsort(-length, kind="stable")
    rank = np.empty(len(owner), np.int32)
    rank[by_length] = np.arange(len(owner), dtype=np.int32)
    many = len(length) - np.searchsorted(np.sort(length), np.arange(length.max(initial=0)), side="right")
    base = (np.cumsum(many) - many).astype(np.int32)
    t = np.arange(len(key), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
    goes = base[t] + np.repeat(rank, length)
    del t
    key, order = ordered(key)
    goes = goes[order]
    del order
    values, above, by_order = np.empty((len(ORDERS), len(key)), np.uint64), [], levels(key)
    del key
    for i, (k, (gram, begin, width)) in enumerate(zip(reversed(ORDERS), by_order, strict=True)):
        grams_of_block, answers = table[k]
        own = answers[np.searchsorted(grams_of_block, gram)]
        # from an order's grams to those of the next longer one, and at last to the bytes
        above.append(np.diff(np.r_[begin, width]))
        for times in reversed(above):
            own = np.repeat(own, times)
        values[len(ORDERS) - 1 - i, goes] = own
    del by_order, above, gram, begin, own, goes
    cost = mix(values, many)
    return np.bincount(owner, cost[rank], len(sizes))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32(id as text) mod 10 is not 0 train.  Tokens are words (runs of what is no ASCII white space) and one end; base_score
    is the unigram log10 probability of the tokens, score the mixed model's of the text in lower case with its end.  Null text is empty;
    a null id counts as empty text (crc32 0) and is held out.  Rows with the same id and text train as often as they occur and score
    alike; other columns are left out.  No rows give no rows; without training rows all logits are 0 and a byte costs eight bits.
    """
    number = F.col(id_col).cast("long")
    held = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % 10 == 0
    total = text_bytes(docs, text_col)
    n, shards = max(1, -(-total // block_bytes)), max(1, total // shard_bytes) | 1
    n_held = max(1, -(-n // 9))
    spread = F.xxhash64("id", "digest", "part")
    block = F.when(F.col("held"), n + F.pmod(spread, F.lit(n_held))).otherwise(F.pmod(spread, F.lit(n))).cast("int")
    rows = docs.select(number.alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.mapInArrow(_cutter, PIECES).withColumn("block", block).withColumn("shards", F.lit(shards)).repartition(n + n_held, "block")
    name = _namer(shards)
    named = dealt.groupBy("block").applyInArrow(lambda t: name(_sorted_pieces(t)), NAMED).repartition(shards, "shard")
    answers = named.groupBy("shard").applyInArrow(lambda t: _answer(t), ANSWER).repartition(n + n_held, "block")
    scored = cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scorer(_sorted_pieces(a), b), SCORED))
    # three numbers of the whole corpus
    train = F.when(~F.col("held"), F.col("copies")).otherwise(0)
    ends = F.when(F.col("last"), train).otherwise(0)
    counted = scored.agg(F.sum(train * F.col("words")).alias("words"), F.sum(ends).alias("ends"), F.sum("fresh").alias("fresh")).first()
    c_end, n_all, v = counted.ends or 0, (counted.words or 0) + (counted.ends or 0), (counted.fresh or 0) + bool(counted.ends)
    last = F.col("last").cast("long") * F.col("copies")
    whole = scored.groupBy("id", "held", "digest").agg(F.sum(last).alias("copies"), *[F.sum(F.col(c) * F.col("copies")).alias(c) for c in ("words", "known", "base", "bits")])
    per = lambda c: F.col(c) / F.col("copies")
    tokens = per("words").cast("long") + 1
    base = per("base") + math.log10(c_end + 0.1) - tokens * math.log10(n_all + 0.1 * (v + 1))
    out = whole.select("id", F.col("held").alias("held_out"), tokens.alias("n_tokens"), (per("known").cast("long") + (1 if c_end else 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (-per("bits") * (math.log10(2) / FIXED)).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")
