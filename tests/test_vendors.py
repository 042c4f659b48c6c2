"""The connectors over pages of every odd kind."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.sources import vendors

DAY = int(dt.datetime(2024, 1, 5, tzinfo=dt.UTC).timestamp())


@pytest.fixture
def pages(tmp_path):
    def put(vendor, exchange, month, lines, name="part-0.json"):
        folder = tmp_path / vendor / f"exchange={exchange}" / f"month={month}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    for exchange in ("US", "SGX", "LSE"):
        for month in ("2024-01", "2024-02", "2024-03"):
            at = int(dt.datetime.fromisoformat(f"{month}-05T00:00:00+00:00").timestamp())
            put("columns", exchange, month, [{"symbol": f"{exchange}{i}", "t": [at, at + 86400], "o": [1.0, 2.0], "h": [1.5, None], "l": [1, 2], "c": [1.25, 2], "v": [10, None]} for i in range(3)])
    put("records", "US", "2024-02", [{"meta": {"symbol": "US0"}, "values": [{"datetime": "2024-02-05", "open": "1", "high": "2", "low": "0.5", "close": "1.5"}, {"datetime": "x"}, {"open": "1"}, {"datetime": "2024-02-06", "open": "1", "high": "nan", "low": "1", "close": "1"}]}, "no json", "[1]", "", {"values": None}])
    put("records", "SGX", "2024-02", [{"meta": {"symbol": "SGX0"}, "values": [{"datetime": "2024-02-05", "open": "1", "high": "2", "low": "0.5", "close": "1.5"}]}])
    (tmp_path / "columns" / "exchange=US" / "month=2024-01" / "_SUCCESS").write_text("")
    return str(tmp_path)


def planned(df):
    """Partitions of the scan."""
    return df.rdd.getNumPartitions()


def test_rows_and_bad_rows(spark, pages):
    got = {(r.provider, r.symbol, str(r.session), r.close, r.volume) for r in vendors.read_bars(spark, pages).collect()}
    want = {("columns", f"{e}{i}", f"2024-0{m}-05", 1.25, 10.0) for e in ("US", "SGX") for i in range(3) for m in (1, 2, 3)}
    assert got == want | {("records", "US0", "2024-02-05", 1.5, 0.0)}  # a vendor's pages of an exchange that it does not cover are not read


def test_filters_plan_fewer_partitions(spark, pages):
    bars = vendors.read_bars(spark, pages)
    assert planned(bars) == 7
    day = lambda x: F.lit(x).cast("date")
    for condition, partitions, rows in [
        (F.col("exchange") == "SGX", 3, 9),
        (F.col("exchange").isin("SGX", "LSE"), 3, 9),
        (F.col("session") >= day("2024-02-10"), 5, 6),
        (F.col("session") > day("2024-02-05"), 5, 6),
        (F.col("session") == day("2024-02-05"), 3, 7),
        ((F.col("session") < day("2024-02-01")) & (F.col("symbol") == "US1"), 2, 1),
        (F.col("provider") == "records", 1, 1),
        ((F.col("provider") == "records") & (F.col("exchange") == "SGX"), 0, 0),
        (F.col("close") > 1.3, 7, 1),
        (F.col("symbol") != "US0", 7, 15),
    ]:
        got = bars.where(condition)
        assert planned(got) == max(partitions, 1), condition  # an empty plan has one partition without rows
        assert got.count() == rows, condition


def test_filters_are_taken_over(spark, pages, capsys):
    vendors.read_bars(spark, pages).where("exchange = 'US' AND close > 1").explain()
    plan = capsys.readouterr().out
    assert "Filter" in plan and "exchange" not in plan.split("Filter")[1].split("\n")[0].replace("isnotnull(exchange)", "")


def test_adapters_by_name(spark, pages):
    assert {r.provider for r in vendors.read_bars(spark, pages, adapters="records").collect()} == {"records"}
    with pytest.raises(Exception, match="unknown adapters"):
        vendors.read_bars(spark, pages, adapters="nobody").count()


def test_no_pages(spark, tmp_path):
    assert vendors.read_bars(spark, str(tmp_path)).count() == 0
    assert vendors.read_news(spark, f"file://{tmp_path}").count() == 0


def test_news_of_every_odd_kind(spark, tmp_path):
    good = {"datetime": DAY, "headline": " A title ", "url": "https://x.example/1", "summary": " ", "source": "Paper"}
    bad = [{**good, k: v} for k, v in [("datetime", None), ("datetime", "5"), ("headline", ""), ("headline", None), ("url", "ftp://x/1"), ("url", 5), ("source", " ")]]
    folder = tmp_path / "wire" / "exchange=SGX" / "month=2024-01"
    folder.mkdir(parents=True)
    (folder / "p.json").write_text(json.dumps({"symbol": "D05.SI", "items": [good, *bad]}) + "\n" + json.dumps({"symbol": None, "items": [good]}))
    folder = tmp_path / "tagged" / "exchange=US" / "month=2024-01"
    folder.mkdir(parents=True)
    (folder / "p.json").write_text(json.dumps({"data": [{"symbol": "A", "published_at": t, "title": "T", "url": "http://y.example", "snippet": "S", "source": "P"} for t in ("2024-01-05T03:00:00+03:00", "2024-01-05T00:00:00", "yesterday", None)]}))
    got = sorted((r.provider, r.symbol or "", r.title, r.summary, str(r.published_at)) for r in vendors.read_news(spark, str(tmp_path)).collect())
    assert got == [("tagged", "A", "T", "S", "2024-01-05 00:00:00")] * 2 + [("wire", "", "A title", None, "2024-01-05 00:00:00"), ("wire", "D05.SI", "A title", None, "2024-01-05 00:00:00")]
    one = vendors.read_news(spark, str(tmp_path)).where((F.col("published_at") >= F.lit("2024-01-05 00:00:00").cast("timestamp")) & (F.col("symbol") == "A"))
    assert one.count() == 2


def test_written_pages_read_back(spark, tmp_path):
    rows = [("US", f"S{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.5, 2.5, 1.0, 2.0, 100.0) for i in range(60)]
    bars = spark.createDataFrame(rows, "exchange string, symbol string, session date, open double, high double, low double, close double, volume double")
    vendors.write_column_bars(bars, str(tmp_path))
    vendors.write_record_bars(bars, str(tmp_path))
    got = vendors.read_bars(spark, str(tmp_path))
    for name in ("columns", "records"):
        assert sorted(map(tuple, got.where(F.col("provider") == name).drop("provider").collect())) == sorted(rows)


def test_a_busy_day_has_many_pages(spark, tmp_path):
    news = spark.range(1000).select(F.lit("US").alias("exchange"), F.lit("HOT").alias("symbol"), F.lit("2024-01-05 01:00:00").cast("timestamp").alias("published_at"), F.concat(F.lit("https://x.example/"), "id").alias("url"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("P").alias("publisher"))
    vendors.write_wire_news(news, str(tmp_path), page=20)
    lines = [json.loads(x) for f in (tmp_path / "wire").rglob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) > 30 and max(len(x["items"]) for x in lines) < 60
    assert vendors.read_news(spark, str(tmp_path)).select("url").distinct().count() == 1000
