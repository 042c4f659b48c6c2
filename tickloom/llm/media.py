"""Media columns: ISO base media containers (MP4, MOV) as binary columns.

`boxes` walks nested boxes, `probe` decodes the sample tables of every track and returns codec, duration and the byte ranges of
its keyframes without decoding a payload.  `store_pcm` keeps bytes losslessly as unsigned 8-bit samples in such a container.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes (ISO/IEC 14496-12), fixed values.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
UNIT = 64  # bytes in a stored sample
SAMPLES_IN_CHUNK = 64
TIMESCALE = 8000


def boxes(data: memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(type, depth, box start, body start, body end) of each box, parents first.  Sizes of 64 bits, to the end (0) and user types are read;
    a size that runs out of its parent ends the walk there."""
    ends = [len(data) if end is None else end]  # of the boxes that are open
    while ends:
        if start + 8 > ends[-1]:
            start = ends.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= ends[-1]:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = ends[-1] - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > ends[-1]:
            start = ends.pop()
            continue
        yield kind, depth + len(ends) - 1, start, body, start + size
        if kind in CONTAINERS:
            ends.append(start + size)
            start = body
        else:
            start += size


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sample numbers from 0

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keyframes].tolist(), self.sizes[self.keyframes].tolist(), strict=True))


def _table(data: memoryview, at: int, kind: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _placed(tables: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes and keyframe numbers of the samples that a sample table places; none if a part of it is missing."""
    none = np.zeros(0, np.int64)
    if not {"stsc", "chunks", "sizes"} <= tables.keys():
        return none, none, none
    chunks, sizes, runs = tables["chunks"], tables["sizes"], tables["stsc"]
    per_chunk = np.zeros(len(chunks), np.int64)
    for i, (first, n, _) in enumerate(runs.tolist()):
        per_chunk[first - 1 : runs[i + 1, 0] - 1 if i + 1 < len(runs) else None] = n
    held = np.cumsum(per_chunk)  # samples up to each chunk; a damaged count makes no more samples than there are sizes
    chunk = np.searchsorted(held, np.arange(min(len(sizes), int(held[-1]) if len(held) else 0)), side="right")
    sizes = sizes[: len(chunk)]
    before = np.cumsum(sizes) - sizes
    begin = np.r_[True, chunk[1:] != chunk[:-1]] if len(chunk) else np.zeros(0, bool)
    offsets = chunks[chunk] + before - before[begin][np.cumsum(begin) - 1] if len(chunk) else chunks[:0]
    keys = tables.get("stss")
    return offsets, sizes, np.arange(len(sizes)) if keys is None else keys[(keys >= 0) & (keys < len(sizes))]


#: Bits of a movie fragment's flags, and the bit of a sample's flags that says it is no keyframe (ISO/IEC 14496-12), fixed values.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_TIME = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEYFRAME = 0x10000


@dataclass
class _Fragment:
    """What a track fragment's header sets for its runs."""

    track: Track
    base: int
    duration: int
    size: int
    flags: int


def _header(data: memoryview, at: int, moof: int, base: int, defaults: dict[int, tuple[int, int, int]], tracks: list[Track]) -> _Fragment:
    set_, number = struct.unpack_from(">II", data, at)
    at += 8
    if set_ & BASE_OFFSET:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    elif set_ & BASE_IS_MOOF:
        base = moof
    at += 4 * bool(set_ & DESCRIPTION)
    values = list(defaults.get(number, (0, 0, 0)))
    for i, bit in enumerate((DURATION, SIZE, FLAGS)):
        if set_ & bit:
            values[i], at = struct.unpack_from(">I", data, at)[0], at + 4
    return _Fragment(next((t for t in tracks if t.number == number), Track()), base, *values)


def _run(data: memoryview, at: int, f: _Fragment) -> int:
    """Adds a run's samples to its track; gives the place after them."""
    set_, n = struct.unpack_from(">II", data, at)
    at, start, first = at + 8, f.base, None
    if set_ & RUN_OFFSET:
        start, at = f.base + struct.unpack_from(">i", data, at)[0], at + 4
    if set_ & RUN_FIRST_FLAGS:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    columns = [bit for bit in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_TIME) if set_ & bit]
    if not columns and n > len(data):
        raise ValueError("more samples than bytes")
    rows = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns))
    column = lambda bit, default: rows[:, columns.index(bit)] if bit in columns else np.full(n, default, np.int64)
    sizes, flags = column(RUN_SIZE, f.size), column(RUN_FLAGS, f.flags)
    if first is not None and n and RUN_FLAGS not in columns:
        flags[0] = first
    t, held = f.track, len(f.track.sizes)
    t.keyframes = np.r_[t.keyframes, held + np.flatnonzero(flags & NO_KEYFRAME == 0)]
    t.offsets, t.sizes = np.r_[t.offsets, start + np.cumsum(sizes) - sizes], np.r_[t.sizes, sizes]
    t.duration += int(column(RUN_DURATION, f.duration).sum())
    return start + int(sizes.sum())


def probe(raw: bytes) -> list[Track]:
    """The tracks of a container, with the samples of its sample tables and of its movie fragments.  A damaged or missing table leaves
    its track without samples; a damaged run adds none."""
    data, tracks, tables, defaults = memoryview(raw), [], {}, {}
    moof = after = 0
    fragment: _Fragment | None = None

    def finish() -> None:
        if tracks and tables:
            tracks[-1].offsets, tracks[-1].sizes, tracks[-1].keyframes = _placed(tables)
            tables.clear()

    for kind, _, begin, at, end in boxes(data):
        if kind == b"trak":
            finish()
            tracks.append(Track())
        elif kind == b"moof":
            finish()
            moof = after = begin
        if end - at < 8:
            continue
        try:
            if kind == b"trex":  # defaults may stand before the tracks
                defaults[struct.unpack_from(">I", data, at + 4)[0]] = struct.unpack_from(">III", data, at + 12)
            elif not tracks:
                continue
            elif kind == b"tkhd":
                tracks[-1].number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
            elif kind == b"mdhd":
                wide = data[at] == 1
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            elif kind == b"stsd":
                tracks[-1].codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"stsc":
                tables["stsc"] = _table(data, at + 4, ">u4", 3)
            elif kind in (b"stco", b"co64"):
                tables["chunks"] = _table(data, at + 4, ">u4" if kind == b"stco" else ">u8")[:, 0]
            elif kind == b"stsz":
                one, n = struct.unpack_from(">II", data, at + 4)
                if one * n > len(data):
                    raise ValueError("more samples than bytes")
                tables["sizes"] = np.full(n, one, np.int64) if one else _table(data, at + 8, ">u4")[:, 0]
            elif kind == b"stss":
                tables["stss"] = _table(data, at + 4, ">u4")[:, 0] - 1
            elif kind == b"tfhd":
                fragment = _header(data, at, moof, after, defaults, tracks)
            elif kind == b"trun" and fragment is not None:
                fragment.base = after = _run(data, at, fragment)
        except (struct.error, ValueError, OverflowError):
            continue
    finish()
    return tracks


def payload(raw: bytes, track: Track) -> bytes:
    """A track's samples in order, as stored.  Neighbouring samples are read as one range."""
    if not len(track.sizes):
        return b""
    apart = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    first, last = np.r_[0, apart], np.r_[apart, len(track.sizes)] - 1
    return b"".join(raw[a:b] for a, b in zip(track.offsets[first].tolist(), (track.offsets[last] + track.sizes[last]).tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def store_pcm(body: bytes) -> bytes:
    """A container with one track of unsigned 8-bit mono samples ('raw '): 64 bytes a sample, 64 samples a chunk, each chunk's first
    sample marked as a keyframe.  The bytes must be a multiple of 64."""
    n, rest = divmod(len(body), UNIT)
    if rest or not n:
        raise ValueError("a positive multiple of 64 bytes is stored")
    chunks = -(-n // SAMPLES_IN_CHUNK)
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  isom")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, SAMPLES_IN_CHUNK, 1)] if n % SAMPLES_IN_CHUNK == 0 else [(1, SAMPLES_IN_CHUNK, 1)] * (chunks > 1) + [(chunks, n % SAMPLES_IN_CHUNK, 1)]
    keys = np.arange(1, n + 1, SAMPLES_IN_CHUNK)

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * UNIT * SAMPLES_IN_CHUNK
        places = _box(b"stco", struct.pack(">II", 0, chunks), at.astype(">u4").tobytes()) if first + len(body) < 1 << 32 else _box(b"co64", struct.pack(">II", 0, chunks), at.astype(">u8").tobytes())
        stbl = _box(b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), entry), _box(b"stts", struct.pack(">IIII", 0, 1, n, UNIT)), _box(b"stss", struct.pack(">II", 0, len(keys)), keys.astype(">u4").tobytes()), _box(b"stsc", struct.pack(">II", 0, len(runs)), *(struct.pack(">III", *x) for x in runs)), _box(b"stsz", struct.pack(">III", 0, UNIT, n)), places)
        minf = _box(b"minf", _box(b"smhd", bytes(8)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
        mdhd = _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, TIMESCALE, len(body), 0x55C4, 0) if len(body) < 1 << 32 else struct.pack(">IQQIQHH", 1 << 24, 0, 0, TIMESCALE, len(body), 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _box(b"hdlr", struct.pack(">II4s", 0, 0, b"soun"), bytes(13)), minf)
        matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
        length = min(len(body), (1 << 32) - 1)
        tkhd = _box(b"tkhd", struct.pack(">IIIIII", 1, 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8))
        mvhd = _box(b"mvhd", struct.pack(">IIIIIIH", 0, 0, 0, TIMESCALE, length, 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide = len(body) + 8 >= 1 << 32
    index = moov(0)
    first = len(head) + len(index) + (16 if wide else 8)
    index = moov(first)
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, b"mdat")
    return b"".join((head, index, mdat, body))


def text_payload(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media BINARY): each text as a container.  Null is empty; repeated rows stay rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([store_pcm(text_payload(x)) for x in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("media")).schema)


MEDIA_SCHEMA = "codec string, timescale long, duration long, samples long, keyframes array<struct<start:bigint,length:bigint>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, others array<struct<codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<start:bigint,length:bigint>>>>"


def probe_column(table: DataFrame, *, media_col: str = "media", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The kept columns and, of the container's first track: codec, timescale, duration, samples, keyframe byte ranges; digests of the
    bytes its sample table points at and of the stored form; and `others`, the same features of its further tracks.  Null or unreadable
    media give an empty codec and no samples.  Repeated rows stay rows; kept columns may not have the names of what is added."""
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    track = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", ranges)])
    schema = pa.schema([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", ranges), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("others", pa.list_(track))])

    def features(t: Track) -> dict:
        small = lambda x: min(x, (1 << 63) - 1)
        keys = [{"start": a, "length": n} for a, n in t.keyframe_ranges()]
        return {"codec": t.codec, "timescale": t.timescale, "duration": small(t.duration), "samples": len(t.sizes), "keyframes": keys}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for raw in batch.column(batch.num_columns - 1).to_pylist():
                    raw = raw or b""
                    first, *rest = probe(raw) or [Track()]
                    body = payload(raw, first)
                    digests = {"payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-UNIT:]), "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
                    rows.append(features(first) | digests | {"others": [features(t) for t in rest]})
                made = pa.RecordBatch.from_pylist(rows, schema=schema)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.columns], names=[*batch.schema.names[:-1], *schema.names])

    rest = table.select(*keep, F.col(media_col).alias("__media"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[:-1])
    return rest.mapInArrow(each, f"{head}, {MEDIA_SCHEMA}")
