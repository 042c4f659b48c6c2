"""Calendars by hand, feeds of every odd kind, and small rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import calendars as C
from tickloom.operators import patterns as P
from tickloom.operators import screening as S
from tickloom.operators import statistics as T
from tickloom.operators import upkeep as U
from tickloom.sources import feeds


def easter(y):
    """By the anonymous algorithm, in another form than the columns have."""
    a, b, c = y % 19, y // 100, y % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    r = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * r) // 451
    month, day = divmod(h + r - 7 * m + 114, 31)
    return dt.date(y, month, day + 1)


def test_easter(spark):
    got = {r.id: r.e for r in spark.range(1900, 2200).select("id", C.easter(F.col("id").cast("int")).alias("e")).collect()}
    assert got == {y: easter(y) for y in range(1900, 2200)}


@pytest.fixture(scope="module")
def days(spark):
    years = spark.range(1990, 2031).select(F.col("id").cast("int").alias("year"))
    return {(r.exchange, r.session): (r.early, r.close_utc) for r in C.sessions(years).collect()}


def test_holidays_by_hand(days):
    closed = [("US", x) for x in "2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25 2021-07-05 2021-12-24 2022-06-20 2022-12-26 2023-01-02 2010-12-24 2024-03-30 2024-03-31".split()]
    closed += [("SGX", x) for x in "2024-01-01 2024-03-29 2024-05-01 2024-08-09 2024-12-25 2023-01-02 2022-05-02 2022-12-26 2015-08-10".split()]
    opened = [("US", x) for x in "2021-12-31 2022-01-03 2021-06-18 2020-06-19 1997-01-20 2024-07-03 2024-11-29 2024-12-24 2024-12-26 2024-08-09".split()] + [("SGX", x) for x in "2024-07-04 2024-11-28 2024-12-24 2021-12-31 2021-05-03 2020-08-10".split()]
    day = dt.date.fromisoformat
    opened = [o for o in opened if o != ("SGX", "2020-08-10")]  # the ninth was a Sunday
    assert not [x for x in closed if (x[0], day(x[1])) in days]
    assert not [x for x in opened if (x[0], day(x[1])) not in days]
    assert ("SGX", day("2020-08-10")) not in days
    assert not [k for k in days if k[1].weekday() > 4]


def test_sessions_of_a_year(days):
    count = lambda e, y: sum(k[0] == e and k[1].year == y for k in days)
    assert [count("US", y) for y in (2019, 2021, 2023, 2024)] == [252, 252, 250, 252]


def test_closes_follow_summer_time_and_early_days(days):
    at = lambda e, x: days[e, dt.date.fromisoformat(x)]
    assert at("US", "2024-03-08") == (False, dt.datetime(2024, 3, 8, 21))
    assert at("US", "2024-03-11") == (False, dt.datetime(2024, 3, 11, 20))
    assert at("US", "2024-11-29") == (True, dt.datetime(2024, 11, 29, 18))
    assert at("US", "2024-07-03") == (True, dt.datetime(2024, 7, 3, 17))
    assert at("SGX", "2024-07-03") == (False, dt.datetime(2024, 7, 3, 9))


def test_given_holidays_and_no_years(spark):
    years = spark.createDataFrame([(2024,), (None,)], "year int")
    moon = spark.createDataFrame([("SGX", dt.date(2024, 2, 12)), ("SGX", dt.date(2024, 2, 12)), ("US", dt.date(2024, 2, 13)), ("SGX", None)], "exchange string, day date")
    got = {(r.exchange, r.session) for r in C.sessions(years, moon).collect()}
    assert ("SGX", dt.date(2024, 2, 12)) not in got and ("US", dt.date(2024, 2, 12)) in got
    assert ("US", dt.date(2024, 2, 13)) not in got and ("SGX", dt.date(2024, 2, 13)) in got
    assert C.sessions(years.where("year > 3000")).count() == 0


def test_feed_items_of_every_odd_kind(spark, tmp_path):
    item = lambda title="A - B - Paper", link="https://x.example/1", date="Fri, 05 Jan 2024 07:30:00 GMT", text="More", source="": f"<item><title>{title}</title><link>{link}</link><pubDate>{date}</pubDate><description>{text}</description>{source}</item>"
    items = [item(), item(title=""), item(title="No paper"), item(title="No paper", source='<source url="https://w.example">Wire</source>'), item(date="yesterday"), item(date="5 Jan 2024 07:30:00 +0800"), item(link="ftp://x"), item(text="&lt;b&gt;A - B&lt;/b&gt; Paper"), "<item><title>Broken</title><b></item>", item(text=""), "<item><title>Never closed", item()]
    (tmp_path / "feed.xml").write_text('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>' + "\n".join(items) + "</channel></rss>")
    read = feeds.read_items(spark, str(tmp_path)).cache()
    got = [(r.title, r.publisher, r.summary, str(r.published_at), r.fault) for r in feeds.read_feed(read).collect()]
    good = ("A - B", "Paper", "More", "2024-01-05 07:30:00", None)
    assert got[0] == good
    assert [g[4] for g in got] == [None, "no title", "no publisher", None, "no date", None, "bad address", None, "damaged", None, "damaged", None]
    assert got[3][:2] == ("No paper", "Wire") and got[5][3] == "2024-01-04 23:30:00" and got[7][2] is None and got[9][2] is None


def test_funds_trusts_and_managers(spark):
    rows = [("Acme Growth Fund", None, None, True), ("Acme ETF", "Banks", 5, True), ("Northern Trust", "Banks", 5, False), ("Acme Trust", None, None, False), ("Acme Hill", "Asset Management", 80, False), ("Acme Hill", "Asset Management", None, True), ("Acme Municipal", "Asset Management", 3, True), ("Acme Opportunities", "Asset Management", 3, True), ("Fundamental Corp", "Banks", 3, False), (None, None, None, False), ("Acme Funds", "Banks", 1, False)]
    df = spark.createDataFrame(rows, "name string, industry string, employees int, want boolean")
    assert [r.name for r in df.where(S.is_fund(F.col("name"), F.col("industry"), F.col("employees")) != F.col("want")).collect()] == []
    assert [r.name for r in df.where(S.is_fund(F.col("name"))).collect()] == ["Acme Growth Fund", "Acme ETF"]


def test_refresh_of_hourly_bars_while_open(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 5, h, m)
    last = spark.createDataFrame([(dt.date(2024, 1, 4), dt.datetime(2024, 1, 4, 21))], "last_session date, last_close timestamp_ntz")
    rows = [("daily", at(14), False, False), ("hourly", at(14), True, True), ("just fetched", at(14, 50), True, False), ("unknown", at(14), None, False)]
    state = spark.createDataFrame([(k, f, live, want, dt.datetime(2024, 1, 5, 14), dt.datetime(2021, 1, 1)) for k, f, live, want in rows], "k string, last_fetched_at timestamp_ntz, live boolean, want boolean, last_bar_at timestamp_ntz, covered_start timestamp_ntz")
    got = U.needs_refresh(state, last, start=F.lit("2021-01-01").cast("timestamp_ntz"), now=F.lit("2024-01-05 15:00:00").cast("timestamp_ntz"), live=F.col("live"))
    assert [r.k for r in got.where("needs_refresh <> want").collect()] == []


def test_history_and_symbols(spark):
    now = F.lit("2024-01-05 15:20:00").cast("timestamp_ntz")
    one = spark.range(1).select(U.history_start(F.lit("1d"), now).alias("d"), U.history_start(F.lit("1h"), now).alias("h"), U.history_start(F.lit("1w"), now).alias("w")).first()
    assert one == (dt.datetime(2020, 12, 31), dt.datetime(2023, 11, 6, 15, 20), None)
    symbols = spark.createDataFrame([("D05.SI", True), ("^STI", True), ("A" * 15, True), ("A" * 16, False), ("a", False), ("", False), (None, False), ("A\n", False), (".A", False)], "s string, want boolean")
    assert symbols.where(U.valid_symbol(F.col("s")) != F.col("want")).count() == 0


def test_earnings_note(spark):
    schema = "symbol string, scope string, label string"
    tested = spark.createDataFrame([("A", "all", "clear_effect"), ("A", "ex", "possible_effect"), ("B", "all", "clear_effect"), ("B", "ex", "no_clear_effect"), ("C", "all", "clear_effect"), ("D", "all", None), ("D", "ex", None)], schema)
    gap = spark.createDataFrame([("B", "ex", "clear_effect"), ("A", "all", None)], schema)
    got = {r.symbol: r.earnings_note is not None for r in T.earnings_note(tested, gap).collect()}
    assert got == {"A": True, "B": False, "C": False, "D": False}


def test_pattern_sentences(spark):
    rows = [("bullish", 20, 0.55, 0.5, True), ("bearish", 20, 0.555, None, True), ("neutral", 40, None, None, True), ("bullish", 1, 1.0, 0.5, False), ("bullish", None, None, None, None)]
    df = spark.createDataFrame(rows, "bias string, n int, hit_rate double, base_rate double, sufficient boolean")
    assert [r[0] for r in df.select(P.sentence()).collect()] == ["Closed higher a week later in 55% of 20 cases, against 50% of comparable days", "Closed lower a week later in 56% of 20 cases, against an unknown share of comparable days", "Seen 40 times; it points neither way", "Seen 1 time, too few to judge (fewer than 15)", "Seen 0 times, too few to judge (fewer than 15)"]


def test_an_items_text_is_parsed_once(spark, tmp_path):
    """Conditions on parsed fields do not repeat the parsing."""
    from tickloom.sources import feeds

    spark.createDataFrame([("<item><title>A - B</title><link>https://x.example/1</link></item>",)], "value string").write.text(f"{tmp_path}/feed")
    got = feeds.read_feed(feeds.read_items(spark, f"{tmp_path}/feed")).where("fault is null")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
