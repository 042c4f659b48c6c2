"""Queries of generated calendars and of feeds that Spark lays out from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.storage import new_folder
from tickloom.operators import calendars as C
from tickloom.plans.registry import query
from tickloom.sources import feeds
from tickloom.sources import views as V

#: Easter by Gauss' rule, another way to the same days.
_EASTER = """e0 AS (SELECT y, y % 19 AS a, y % 4 AS b, y % 7 AS c, (19 * (y % 19) + 24) % 30 AS d FROM yr), e1 AS (SELECT *, (2 * b + 4 * c + 6 * d + 5) % 7 AS e FROM e0),
    ea AS (SELECT y, make_date(y, 3, 22) + CAST(d + e - CASE WHEN d = 29 AND e = 6 OR d = 28 AND e = 6 AND a > 10 THEN 7 ELSE 0 END AS INTEGER) AS easter FROM e1)"""
_US = """SELECT make_date(y, 1, 1) + CASE dayofweek(make_date(y, 1, 1)) WHEN 0 THEN 1 ELSE 0 END AS h FROM yr
    UNION ALL SELECT d FROM dy WHERE dayofweek(d) = 1 AND (month(d) = 1 AND day(d) BETWEEN 15 AND 21 AND year(d) >= 1998 OR month(d) = 2 AND day(d) BETWEEN 15 AND 21 OR month(d) = 5 AND day(d) > 24 OR month(d) = 9 AND day(d) < 8)
    UNION ALL SELECT d FROM dy WHERE dayofweek(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28 UNION ALL SELECT easter - 2 FROM ea
    UNION ALL SELECT d + CASE dayofweek(d) WHEN 6 THEN -1 WHEN 0 THEN 1 ELSE 0 END FROM dy WHERE strftime(d, '%m-%d') IN ('07-04', '12-25') OR strftime(d, '%m-%d') = '06-19' AND year(d) >= 2022"""
_SGX = """SELECT d + CASE dayofweek(d) WHEN 0 THEN 1 ELSE 0 END AS h FROM dy WHERE strftime(d, '%m-%d') IN ('01-01', '05-01', '08-09', '12-25') UNION ALL SELECT easter - 2 FROM ea"""
#: Summer time in New York: first Sunday of April to last of October until 2006, second of March to first of November since.
_SUMMER = """CASE WHEN year(d) >= 2007 THEN d >= (SELECT max(x.d) FROM dy x WHERE year(x.d) = year(w.d) AND month(x.d) = 3 AND day(x.d) BETWEEN 8 AND 14 AND dayofweek(x.d) = 0) AND d < (SELECT max(x.d) FROM dy x WHERE year(x.d) = year(w.d) AND month(x.d) = 11 AND day(x.d) < 8 AND dayofweek(x.d) = 0)
    ELSE d >= (SELECT max(x.d) FROM dy x WHERE year(x.d) = year(w.d) AND month(x.d) = 4 AND day(x.d) < 8 AND dayofweek(x.d) = 0) AND d < (SELECT max(x.d) FROM dy x WHERE year(x.d) = year(w.d) AND month(x.d) = 10 AND day(x.d) > 24 AND dayofweek(x.d) = 0) END"""
_SESSIONS = f"""WITH yr AS (SELECT CAST(unnest(range(f, f + 30)) AS INTEGER) AS y FROM (SELECT min(year(o_orderdate)) AS f FROM orders)), dy AS (SELECT CAST(unnest(range(make_date(y, 1, 1), make_date(y + 1, 1, 1), INTERVAL 1 DAY)) AS DATE) AS d FROM yr), {_EASTER},
    w AS (SELECT d FROM dy WHERE dayofweek(d) BETWEEN 1 AND 5), us AS ({_US}), sg AS ({_SGX}), th AS (SELECT d + 1 AS d FROM dy WHERE dayofweek(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28),
    u AS (SELECT d, strftime(d, '%m-%d') IN ('07-03', '12-24') OR d IN (SELECT d FROM th) AS early, {_SUMMER} AS summer FROM w WHERE d NOT IN (SELECT h FROM us)),
    s AS (SELECT 'US' AS exchange, d AS session, early, CAST(d AS TIMESTAMP) + INTERVAL 1 HOUR * (CASE WHEN early THEN 13 ELSE 16 END + CASE WHEN summer THEN 4 ELSE 5 END) AS close_utc FROM u
        UNION ALL SELECT 'SGX', d, FALSE, CAST(d AS TIMESTAMP) + INTERVAL 9 HOUR FROM w WHERE d NOT IN (SELECT h FROM sg))"""


def _calendar(spark, d):
    """Thirty years from the first order's."""
    first = V.table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("first"))
    return C.sessions(first.select(F.explode(F.sequence(F.col("first"), F.col("first") + 29)).alias("year")))


@query("exchange_sessions", f"{_SESSIONS} SELECT exchange, session, early, close_utc FROM s")
def exchange_sessions(spark, d):
    """Sessions of two exchanges for thirty years, closes in UTC."""
    return _calendar(spark, d)


@query("orders_on_sessions", f"{_SESSIONS} SELECT exchange, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS orders FROM s JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY day) ON day = session GROUP BY exchange")
def orders_on_sessions(spark, d):
    """How many orders fall on sessions of each exchange."""
    days = V.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return _calendar(spark, d).join(days, F.col("session") == F.col("day")).groupBy("exchange").agg(F.count("*").alias("sessions"), F.sum("n").alias("orders"))


def feed_folder(spark, d):
    """Orders as feed items: with and without a publisher in the title, some without a date, with a bad address, or damaged."""
    k = F.col("o_orderkey")
    title = F.when(k % 8 == 0, F.concat(F.lit("Story "), k)).otherwise(F.concat(F.lit("Story "), k, F.lit(" &amp; more - Paper "), k % 5))
    link = F.concat(F.when(k % 11 == 0, F.lit("ftp://news.example/")).otherwise(F.lit("https://news.example/")), k)
    date = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("<pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 07:30:00 GMT</pubDate>")))
    text = F.when(k % 6 == 0, F.concat(F.lit("&lt;b&gt;Story "), k, F.lit("&lt;/b&gt;"))).otherwise(F.concat(F.lit("Orders of "), F.col("o_custkey"), F.lit("&amp;nbsp;grow a good deal")))
    ending = F.when(k % 13 == 0, F.lit("</description></item>")).otherwise(F.lit("</description><source url=\"https://paper.example\">Wire</source></item>"))
    broken = F.when(k % 13 == 0, F.lit("<b>")).otherwise(F.lit(""))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link>"), date, F.lit("<description>"), broken, text, ending)
    folder = new_folder(spark, "feed")
    V.table(spark, d, "orders").select(item.alias("value")).write.text(folder)
    return folder


_FEED = """i AS (SELECT o_orderkey AS k, 'https://news.example/' || o_orderkey AS url, CASE WHEN o_orderkey % 8 = 0 THEN 'Story ' || o_orderkey ELSE 'Story ' || o_orderkey || ' & more' END AS title, CASE WHEN o_orderkey % 6 <> 0 THEN 'Orders of ' || o_custkey || ' grow a good deal' WHEN o_orderkey % 8 <> 0 THEN 'Story ' || o_orderkey END AS summary,
    CASE WHEN o_orderkey % 8 = 0 THEN 'Wire' ELSE 'Paper ' || (o_orderkey % 5) END AS publisher, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 450 MINUTE AS published_at, CASE WHEN o_orderkey % 13 = 0 THEN 'damaged' WHEN o_orderkey % 10 = 0 THEN 'no date' WHEN o_orderkey % 11 = 0 THEN 'bad address' END AS fault FROM orders)"""


@query("rss_feed", f"WITH {_FEED} SELECT url, title, summary, publisher, published_at FROM i WHERE fault IS NULL")
def rss_feed(spark, d):
    """Articles of the feed's items."""
    got = feeds.read_feed(feeds.read_items(spark, feed_folder(spark, d))).where("fault is null")
    return got.select("url", "title", "summary", "publisher", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("rss_faults", f"WITH {_FEED} SELECT coalesce(fault, 'none') AS fault, count(*) AS items FROM i GROUP BY ALL")
def rss_faults(spark, d):
    """How many items could not be taken, and why."""
    return feeds.read_feed(feeds.read_items(spark, feed_folder(spark, d))).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("items"))
