"""Containers: round trips, hand-made boxes and damage."""

import hashlib
import struct
import zlib

import pytest

from tickloom.llm import media

SCHEMA = "doc_id long, text string, media string"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 64 * 64 * 3 + 5])
def test_round_trip(n):
    body = media.text_payload(bytes(i % 251 for i in range(n)))
    raw = media.store_pcm(body)
    (track,) = media.probe(raw)
    assert media.payload(raw, track) == body and track.duration == len(body) and track.codec == "raw "
    for start, length in track.keyframe_ranges():
        assert raw[start : start + length] == body[start - track.offsets[0] :][:length]
    assert [k for k, *_ in media.boxes(memoryview(raw)) if k in (b"ftyp", b"moov", b"mdat")] == [b"ftyp", b"moov", b"mdat"]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_sample_tables_of_uneven_chunks():
    """Three chunks of 2, 2 and 1 samples of different sizes, the second and fifth being keyframes, 64-bit places."""
    sizes, chunks = [5, 7, 11, 2, 3], [100, 200, 300]
    stbl = box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), struct.pack(">I4s", 16, b"avc1"), bytes(8)), box(b"stsz", struct.pack(">III5I", 0, 0, 5, *sizes)), box(b"stsc", struct.pack(">II", 0, 2), struct.pack(">6I", 1, 2, 1, 3, 1, 1)), box(b"co64", struct.pack(">II3Q", 0, 3, *chunks)), box(b"stss", struct.pack(">II2I", 0, 2, 2, 5)))
    mdhd = box(b"mdhd", struct.pack(">I", 1 << 24), struct.pack(">QQIQI", 0, 0, 1000, 5000, 0))
    raw = box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl))))
    (t,) = media.probe(raw)
    assert t.codec == "avc1" and (t.timescale, t.duration) == (1000, 5000)
    assert t.offsets.tolist() == [100, 105, 200, 211, 300] and t.keyframe_ranges() == [(105, 7), (300, 3)]


def test_deep_nesting_ends():
    raw = b"".join(struct.pack(">I4s", 8 * (3000 - i), b"moov") for i in range(3000))
    assert len(list(media.boxes(memoryview(raw)))) == 3000 and media.probe(raw) == []
    depths = [d for _, d, *_ in media.boxes(memoryview(box(b"moov", box(b"trak", box(b"free")), box(b"free")) + box(b"free")))]
    assert depths == [0, 1, 2, 1, 0]


def track(number, codec, sizes=(), places=()):
    tkhd = box(b"tkhd", struct.pack(">IIII", 0, 0, 0, number), bytes(8))
    stbl = box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), struct.pack(">I4s", 16, codec), bytes(8)), box(b"stsz", struct.pack(f">III{len(sizes)}I", 0, 0, len(sizes), *sizes)), box(b"stsc", struct.pack(">II", 0, 1), struct.pack(">3I", 1, 1, 1)), box(b"stco", struct.pack(f">II{len(places)}I", 0, len(places), *places)))
    return box(b"trak", tkhd, box(b"mdia", box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 1000, 0, 0)), box(b"minf", stbl)))


def test_two_tracks_and_fragments(spark):
    trex = box(b"mvex", box(b"trex", struct.pack(">IIIIII", 0, 1, 1, 10, 100, 0)), box(b"trex", struct.pack(">IIIIII", 0, 2, 1, 20, 7, 0x10000)))
    moov = box(b"moov", track(1, b"avc1", [5], [40]), track(2, b"mp4a"), trex)

    def moof(base):
        one = box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), box(b"trun", struct.pack(">IIi", 0x705, 2, 500), struct.pack(">I", 0), struct.pack(">6I", 10, 30, 0, 10, 40, 0x10000)))
        two = box(b"traf", box(b"tfhd", struct.pack(">IIQ", 0x1, 2, base)), box(b"trun", struct.pack(">II", 0, 3)))
        return box(b"moof", box(b"mfhd", bytes(8)), one, two)

    raw = moov + moof(9000) + box(b"mdat", bytes(10)) + moof(9100)
    first, second = media.probe(raw)
    at = [len(moov), len(moov) + len(moof(0)) + 18]
    assert first.codec == "avc1" and first.sizes.tolist() == [5, 30, 40, 30, 40] and first.offsets.tolist() == [40, at[0] + 500, at[0] + 530, at[1] + 500, at[1] + 530]
    assert first.keyframes.tolist() == [0, 1, 3] and first.duration == 40
    assert second.codec == "mp4a" and second.offsets.tolist() == [9000, 9007, 9014, 9100, 9107, 9114] and len(second.keyframes) == 0 and second.duration == 120
    (row,) = media.probe_column(spark.createDataFrame([(1, bytearray(raw))], "id int, media binary")).collect()
    assert row.samples == 5 and [(t.codec, t.samples) for t in row.others] == [("mp4a", 6)]
    for cut in range(0, len(raw), 3):
        media.probe(raw[:cut] + b"\xff\xff\xff\xff" + raw[cut + 4 :])


def test_defaults_before_tracks_and_wide_sizes():
    trex = box(b"mvex", box(b"trex", struct.pack(">IIIIII", 0, 1, 1, 10, 100, 0)))
    moov = box(b"moov", trex, track(1, b"avc1"))
    traf = box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), box(b"trun", struct.pack(">IIi", 0x1, 3, 8)))
    moof = struct.pack(">I4sQ", 1, b"moof", 16 + len(traf)) + traf  # a size of 64 bits: the box begins 16 bytes before its body
    (t,) = media.probe(moov + moof)
    assert t.sizes.tolist() == [100] * 3 and t.duration == 30
    assert t.offsets.tolist() == [len(moov) + 8 + 100 * i for i in range(3)]


def test_damage_does_not_crash():
    raw = media.store_pcm(media.text_payload(b"abc" * 100))
    for cut in range(0, len(raw), 7):
        media.probe(raw[:cut])
    for at in range(0, 600, 3):
        media.probe(raw[:at] + b"\xff\xff\xff\xff" + raw[at + 4 :])


def test_columns(spark):
    texts = [(1, "abc", "m"), (2, None, "m"), (3, "", None), (4, "é" * 50_000, "m"), (5, "abc", "m"), (None, "x", "m")]
    df = spark.createDataFrame(texts, SCHEMA)
    got = {r.id: r for r in media.probe_column(media.encode_texts(df), keep=("id", "n_bytes")).collect()}
    for i, text, _ in texts:
        body = (text or "").encode()
        body += bytes(-len(body) % 64 or (0 if body else 64))
        r = got[i]
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(body))
    assert got[1].media_sha256 == got[5].media_sha256 and got[2].media_sha256 == got[3].media_sha256
    assert media.probe_column(media.encode_texts(df.limit(0))).count() == 0
    assert media.probe_column(spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id int, media binary")).where("samples = 0").count() == 2
