"""Versions, backfill and streamed events, with batches that come again, stop half-way or come late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import event_study
from tickloom.operators import upkeep as U
from tickloom.streaming import event_choice, versions

SCHEMA = "key string, month string, symbol string, at timestamp, n long"


def merge(a, b):
    return U.upsert(a, b, ["key"], ["n"])


@pytest.fixture
def table(spark, tmp_path):
    return versions.VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "month", merge, ("symbol", "at"))


def batch(spark, *rows):
    return spark.createDataFrame([(k, m, s, dt.datetime(2024, 1, n % 28 + 1), n) for k, m, s, n in rows], SCHEMA)


def held(table, version=None):
    return sorted((r.key, r.month, r.n) for r in table.read(version).collect())


def test_versions_and_repeated_batches(spark, table, tmp_path):
    assert held(table) == [] and table.state().count() == 0
    table.commit("s", 0, batch(spark, ("a", "2024-01", "X", 1), ("b", "2024-02", "Y", 2)))
    first = table.manifest()
    table.commit("s", 1, batch(spark, ("a", "2024-01", "X", 3), ("c", "2024-03", "X", 4), ("lost", None, "X", 9)))
    want = [("a", "2024-01", 3), ("b", "2024-02", 2), ("c", "2024-03", 4)]
    assert held(table) == want and table.manifest().version == 2
    assert held(table, 1) == [("a", "2024-01", 1), ("b", "2024-02", 2)]
    assert table.manifest().parts["2024-02"] == first.parts["2024-02"]  # parts that a batch does not touch stay as they are
    for number in (0, 1):
        assert table.commit("s", number, batch(spark, ("a", "2024-01", "X", 99))).version == 2
    assert held(table) == want
    assert [tuple(r) for r in table.state().orderBy("symbol").select("symbol", "rows", F.dayofmonth("covered_start"), F.dayofmonth("newest")).collect()] == [("X", 3, 2, 5), ("Y", 1, 3, 3)]
    table.commit("other", 0, batch(spark))  # nothing in it: a version all the same, as its number is now known
    assert held(table) == want and table.manifest().batches == {"s": 1, "other": 0}
    with pytest.raises(KeyError):
        table.read(77)


def test_a_killed_batch_leaves_one_version(spark, table, monkeypatch):
    table.commit("s", 0, batch(spark, ("a", "2024-01", "X", 1)))
    real, calls = versions.Files.put, []

    def dies(self, name, text, modified=None):
        calls.append(name)
        raise RuntimeError("killed")

    monkeypatch.setattr(versions.Files, "put", dies)
    with pytest.raises(RuntimeError):
        table.commit("s", 1, batch(spark, ("a", "2024-01", "X", 2)))
    assert calls and held(table) == [("a", "2024-01", 1)] and table.manifest().version == 1
    left = set(table.files.names("data"))
    monkeypatch.setattr(versions.Files, "put", real)
    table.commit("s", 1, batch(spark, ("a", "2024-01", "X", 2)))
    assert held(table) == [("a", "2024-01", 2)] and table.manifest().version == 2
    assert len(set(table.files.names("data")) & left) < len(left)  # what the killed one wrote is gone


def test_old_versions_go(spark, table):
    for i in range(5):
        table.commit("s", i, batch(spark, ("a", "2024-01", "X", i)))
    assert [n for n in table.files.names("versions")] == ["000000000003.json", "000000000004.json", "000000000005.json"][-3:]
    assert held(table, 4) == [("a", "2024-01", 3)]
    with pytest.raises(KeyError):
        table.read(1)


def test_odd_part_names(spark, table):
    table.commit("s", 0, batch(spark, ("a", "x/y=1 ü", "X", 1), ("b", "", "X", 2)))
    table.commit("s", 1, batch(spark, ("a", "x/y=1 ü", "X", 5)))
    assert held(table) == [("a", "x/y=1 ü", 5), ("b", "", 2)]


def test_ingest_drops_repeats_and_goes_on(spark, table, tmp_path):
    folder = f"file://{tmp_path}/in"
    run = lambda: versions.ingest(spark.readStream.schema(SCHEMA).parquet(folder), table, "in", f"file://{tmp_path}/cp", keys=["key", "symbol"], time="at", late="100 days")
    batch(spark, ("a", "2024-01", "X", 1), ("a", "2024-01", "X", 2), ("b", "2024-01", "Y", 3)).coalesce(1).write.parquet(folder)
    run()
    assert [r[:2] for r in held(table)] == [("a", "2024-01"), ("b", "2024-01")]
    before = held(table)
    run()  # nothing new
    assert held(table) == before
    batch(spark, ("a", "2024-01", "X", 7), ("c", "2024-02", "X", 4)).write.mode("append").parquet(folder)
    run()
    assert held(table) == [*before, ("c", "2024-02", 4)]  # the first fetch of a story counts


def test_backfill_goes_on_where_it_stopped(spark, table, tmp_path):
    months, calls = versions.months_before(spark, "2024-03", 5), []
    assert months == ["2024-02", "2024-01", "2023-12", "2023-11", "2023-10"]

    def fetch(month, broken=()):
        calls.append(month)
        if month in broken:
            raise RuntimeError("the vendor is down")
        return batch(spark, (month, month, "X", 1))

    folder = f"file://{tmp_path}/b"
    with pytest.raises(Exception, match="the vendor is down"):
        versions.backfill(spark, folder, months, lambda m: fetch(m, ("2023-12",)), table)
    assert calls == months[:3] and [r[0] for r in held(table)] == ["2024-01", "2024-02"]
    assert sorted(table.manifest().marks) == ["2024-01", "2024-02"]
    assert versions.backfill(spark, folder, months, fetch, table) == []
    assert calls[3:] == months[2:]  # the month that failed comes again, those done do not
    assert versions.backfill(spark, folder, ["2024-03", *months], fetch, table) == []
    assert calls[6:] == ["2024-03"] and [r[0] for r in held(table)] == sorted([*months, "2024-03"])


def closes(n):
    start = dt.datetime(2024, 1, 1, 21, tzinfo=dt.UTC)
    return [start + dt.timedelta(days=i) for i in range(n)]


def plain_events(rows, exclusion=5):
    """(symbol, pos, sentiment, count) by the batch rule."""
    import math

    import numpy as np

    out = set()
    for symbol in {r[0] for r in rows}:
        days = {}
        for _, pos, _, score in [r for r in rows if r[0] == symbol and r[1] is not None and r[3] is not None]:
            days.setdefault(pos, []).append(score)
        pos = sorted(days)
        salience = np.array([abs(sum(days[p]) / len(days[p])) * math.log1p(len(days[p])) for p in pos])
        for i in event_study.choose(np.array(pos), salience, exclusion) if pos else []:
            out.add((symbol, pos[i], round(sum(days[pos[i]]) / len(days[pos[i]]), 9), len(days[pos[i]])))
    return out


def run_events(spark, tmp_path, batches, calendar, late="2 days"):
    """Streams the batches one by one, each a run of its own over the same checkpoint."""
    millis = [int(c.timestamp() * 1000) for c in calendar]
    seen = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(s, p, a.replace(tzinfo=None), x) for s, p, a, x in rows], "symbol string, pos long, at timestamp, score double")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = event_choice.stream_events(stream, millis, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        out = spark.read.schema(event_choice.OUT).parquet(f"{tmp_path}/out").collect()
        seen.append({(r.symbol, r.pos, round(r.sentiment, 9), r.article_count) for r in out})
    return seen


def test_stream_and_batch_choose_the_same_events(spark, tmp_path):
    rnd, calendar = random.Random(4), closes(80)
    rows = [(s, p, calendar[p], rnd.choice([-0.5, 0.25, 0.75, rnd.random()])) for s in "AB" for p in rnd.sample(range(70), 30) for _ in range(rnd.randint(1, 3))]
    rows += [("A", None, calendar[5], 0.5), ("B", 3, calendar[3], None), ("C", 79, calendar[79], 0.9)]
    rows.sort(key=lambda r: r[2])
    n = len(rows) // 3
    end = [("", None, dt.datetime(2100, 1, 1), None)]
    seen = run_events(spark, tmp_path, [rows[:n], rows[n : 2 * n], rows[2 * n :] + end], calendar)
    assert seen[-1] == plain_events(rows)
    assert seen[0] < seen[-1] and seen[0] <= seen[1] <= seen[2]  # what was told stays


def test_late_articles_change_only_the_open_window(spark, tmp_path):
    calendar = closes(60)
    at = lambda p, score, s="A": (s, p, calendar[p], score)
    first = [at(3, 0.5), at(20, 0.5), at(22, 0.6)]
    late = [at(4, 0.9), at(21, 0.9)]  # 4 is in a window that has closed, 21 in the one that is open
    end = [("", None, dt.datetime(2100, 1, 1), None)]
    seen = run_events(spark, tmp_path, [first, late, end], calendar)
    assert {(s, p) for s, p, *_ in seen[0]} == {("A", 3)}
    assert {(s, p) for s, p, *_ in seen[2]} == {("A", 3), ("A", 21)}
    assert ("A", 3, 0.5, 1) in seen[2]


def test_a_symbols_state_gets_sessions_not_articles():
    """A hot symbol's articles are summed where they are read; rows without score or position keep their time, which moves the watermark."""
    import pyarrow as pa

    schema = pa.schema([("symbol", pa.string()), ("pos", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("score", pa.float64())])
    at = [c.replace(tzinfo=dt.UTC) for c in closes(7)]
    batches = [pa.RecordBatch.from_pylist([{"symbol": "A", "pos": i % 7, "at": at[i % 7], "score": 0.5 if i % 10 else None} for i in range(1000)], schema) for _ in range(200)]
    batches += [pa.RecordBatch.from_pylist([{"symbol": "", "pos": None, "at": at[6], "score": None}], schema)]
    got = [r for b in event_choice.summed(iter(batches)) for r in b.to_pylist()]
    assert len(got) == 8
    assert sum(r["many"] for r in got) == 200 * 900 and sum(r["total"] or 0 for r in got) == 200 * 450
    assert [r for r in got if r["pos"] is None] == [{"symbol": "", "pos": None, "at": at[6], "total": None, "many": 0}]
    assert list(event_choice.summed(iter([]))) == []


def test_late_articles_reach_their_session(spark, tmp_path):
    from tickloom.operators.alignment import daily_sentiment
    from tickloom.streaming.pipelines import upsert_daily

    body = upsert_daily(f"file://{tmp_path}", daily_sentiment)
    day = lambda n: dt.date(2024, 1, n)
    rows = lambda *x: spark.createDataFrame([(s, d, v) for s, d, v in x], "symbol string, session date, score double")
    held = lambda: sorted((r.symbol, r.session, r.mean_score, r.article_count) for r in spark.read.parquet(f"file://{tmp_path}/daily").collect())
    body(rows(("A", day(2), 0.5), ("A", day(3), 0.1), ("B", day(3), 0.2), ("B", None, 0.9)), 0)
    body(rows(("A", day(2), 0.7)), 1)  # late
    want = [("A", day(2), 0.6, 2), ("A", day(3), 0.1, 1), ("B", day(3), 0.2, 1)]
    assert held() == want
    body(rows(("A", day(2), 0.7)), 1)  # once more
    body(rows(), 2)
    assert held() == want


def test_a_part_is_not_scattered_over_files(spark, table):
    """Rows of every month in every task of the merge: each month goes to one file."""
    rows = spark.range(0, 600, 1, 8).selectExpr("concat('k', id) AS key", "concat('2024-', lpad(id % 6 + 1, 2, '0')) AS month", "'X' AS symbol", "timestamp '2024-01-01' AS at", "id AS n")
    table.merge = lambda stored, new: stored.unionByName(new)
    table.commit("s", 0, rows)
    assert table.read().count() == 600 and len(table.manifest().parts) == 6
    assert all(len([f for f in table.files.names(f"data/{folder}") if f.endswith(".parquet")]) == 1 for folder in table.manifest().parts.values())
