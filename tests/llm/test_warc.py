"""Archives: a round trip, splits of every size, and false magic bytes."""

import gzip

import pytest

from tickloom.llm import common, warc

SCHEMA = "page_id long, url string, html string, first string, payload int"


def pages():
    trap = "".join(map(chr, (0x1F, 0x8B, 0x08))) * 50
    rows = [(1, "http://a/", "same"), (None, "v", "lone"), (2, "http://b/\nx", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "u", trap), (7, "u", "same"), (None, "u", "lone"), (8, "u", "x" * 300_000)]
    return [(*r, "c", 0) for r in rows]


@pytest.mark.parametrize("split", [1 << 20, 4096, 97])
def test_round_trip(spark, split):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(2)
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(df, folder)
    got = sorted(((r.record_id, r.warc_type, r.refers_to, r.payload_length, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_archives(manifest, folder, split_bytes=split).collect()), key=str)
    name = lambda i: f"<urn:page:{i}>"
    first = {"same": 1, "": 3}
    want = []
    for i, _, html, *_ in pages():
        text = html or ""
        revisit = text in first and first[text] != i
        want.append((name("" if i is None else i), "revisit" if revisit else "response", name(first[text]) if revisit else None, len(text.encode()), None if revisit else text))
    assert got == sorted(want, key=str)
    digests = {r.payload_digest for r in warc.read_archives(manifest, folder).where("payload_length = 4").collect()}
    assert digests == {warc.payload_digest(b"same"), warc.payload_digest(b"lone")}


def test_small_payloads_are_all_responses_and_empty_tables_give_none(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    folder = warc.archive_folder(spark)
    got = warc.read_archives(warc.write_archives(df, folder, min_bytes=5), folder)
    assert got.where("warc_type = 'revisit'").count() == 0 and got.count() == 10
    folder = warc.archive_folder(spark)
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def test_every_range_is_a_task(spark):
    df = spark.createDataFrame([(i, "u", f"{i} " * 3000) for i in range(300)], "page_id long, url string, html string").repartition(2)
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(df, folder)
    got = warc.read_archives(manifest, folder, split_bytes=2048)
    assert got.rdd.getNumPartitions() >= manifest.agg({"n_bytes": "sum"}).first()[0] // 2048 > 4
    assert got.count() == 300


def test_an_archive_inside_a_record_stays_inside(spark, tmp_path):
    """A payload that deflate stores as it is holds a whole member; ranges of every size start inside it."""
    import zlib

    inner = warc.record_bytes("response", "9", "u", b"inner", warc.payload_digest(b"inner"), None)
    body = b"." * 500 + inner + b"." * 500
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    last = warc.record_bytes("response", "2", "u", b"last", warc.payload_digest(b"last"), None)
    whole = z.compress(raw) + z.flush() + last
    (tmp_path / "y.warc.gz").write_bytes(whole)
    manifest = spark.createDataFrame([(str(tmp_path / "y.warc.gz"), len(whole))], "path string, n_bytes long")
    for split in (64, 100, 10_000):
        got = warc.read_archives(manifest, f"file://{tmp_path}", split_bytes=split).collect()
        assert sorted(len(r.payload) for r in got) == [4, len(body)]
    for split in (64, 10_000):  # the long one keeps its row, digest and length, but for the payload
        rows = sorted(warc.read_archives(manifest, f"file://{tmp_path}", split_bytes=split, max_cell_bytes=900).collect(), key=lambda r: r.payload_length)
        assert [(r.payload and bytes(r.payload), r.payload_kept, r.payload_length, r.payload_digest) for r in rows] == [(b"last", True, 4, warc.payload_digest(b"last")), (None, False, len(body), warc.payload_digest(body))]


def test_long_records_digest_as_they_are_read(spark):
    df = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "x"), (3, "u", "ab" * 2_000_000)], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(df, folder)
    columns = ["record_id", "warc_type", "payload_digest", "payload_length", "url"]
    whole, cut = (warc.read_archives(manifest, folder, split_bytes=1000, max_cell_bytes=most) for most in (1 << 30, 100_000))
    assert sorted(map(tuple, cut.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert cut.where("payload is null and not payload_kept").count() == 2 and whole.where("payload_kept").count() == 3


def test_foreign_members_are_passed_over(spark, tmp_path):
    record = warc.record_bytes("response", "1", "http://a/", b"body", warc.payload_digest(b"body"), None)
    raw = gzip.compress(b"no archive") + b"junk\x1f\x8b\x08" + record + gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n") + record[:-9]
    (tmp_path / "x.warc.gz").write_bytes(raw)
    folder = f"file://{tmp_path}"
    manifest = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), len(raw))], "path string, n_bytes long")
    assert [bytes(r.payload) for r in warc.read_archives(manifest, folder, split_bytes=50).collect()] == [b"body"]
    assert common.shared_dir(spark)
