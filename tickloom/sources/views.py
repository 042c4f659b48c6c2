"""The data model over the test tables: bars, sessions, articles, corporate events, titles, quotes, watchlists.

Each view exists twice: as a DataFrame plan, and as SQL text (`VIEW_SQL`) for the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars: symbol, session, open, high, low, close, volume.  First and last tick are aggregates with a total order, so ticks
    are combined before the shuffle and never sorted."""
    tick = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    px = F.col("l_extendedprice") / 1000 + 50
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("session")).agg(F.min_by(px, tick).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, tick).alias("close"), F.sum("l_quantity").alias("volume"))


def bench_daily(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark close of each session."""
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("session")).agg(F.avg(F.col("l_extendedprice") / 1000 + 50).alias("close"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Trading calendar: session, close_utc, pos.  A dimension of some thousand rows, which is why one window may number it."""
    days = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("session")).distinct()
    return days.select("session", (F.col("session").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOUR")).alias("close_utc"), (F.row_number().over(Window.orderBy("session")) - 1).cast("long").alias("pos"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Scored articles: article_id, symbol, published_at, score."""
    return articles_of(table(spark, d, "orders"))


def articles_of(o: DataFrame) -> DataFrame:
    """Orders, as a table or as a stream, read as articles."""
    symbol = F.when(F.col("o_custkey") % 3 == 0, "A").when(F.col("o_custkey") % 3 == 1, "N").otherwise("R")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("o_totalprice") - 250000) / 250000))
    return o.select(F.col("o_orderkey").alias("article_id"), symbol.alias("symbol"), (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("published_at"), score.alias("score"))


def earnings(spark: SparkSession, d: str) -> DataFrame:
    """Earnings dates: symbol, event_date, kind."""
    a = articles(spark, d)
    return a.groupBy("symbol", F.date_trunc("quarter", "published_at").alias("q")).agg(F.min("published_at").cast("date").alias("event_date")).select("symbol", "event_date", F.lit("earnings").alias("kind"))


def bars_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of event types: symbol, ts, open, high, low, close, volume."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """Headline-like text: doc_id, day, lang and title, the text's first line."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("day"), "lang", F.split("text", "\n")[0].alias("title"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Screener universe: symbol, name, exchange, pe_ratio, price, avg_volume_3m, market_cap."""
    vol = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("vol"))
    p = table(spark, d, "part").join(vol, F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.when(F.col("p_size") <= 25, "US").otherwise("SGX").alias("exchange"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("pe_ratio"), F.col("p_retailprice").alias("price"), F.col("vol").alias("avg_volume_3m"), (F.col("p_retailprice") * F.coalesce("vol", F.lit(0.0))).alias("market_cap"))


def watchers(spark: SparkSession, d: str) -> DataFrame:
    """Owners and their countries: owner_id, country, region, segment."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    joined = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("c_custkey").alias("owner_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))


VIEW_SQL = {
    "ticks": """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS session, l_extendedprice / 1000 + 50 AS px, l_quantity AS qty,
        row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a,
        row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS z FROM lineitem""",
    "bars": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS pos FROM (SELECT symbol, session, max(CASE WHEN a = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
        max(CASE WHEN z = 1 THEN px END) AS close, sum(qty) AS volume FROM ticks GROUP BY symbol, session)""",
    "bench": "SELECT session, avg(px) AS close FROM ticks GROUP BY session",
    "sessions": "SELECT session, CAST(session AS TIMESTAMP) + INTERVAL 21 HOUR AS close_utc, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM bench)",
    "articles": """SELECT o_orderkey AS article_id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS symbol, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS published_at,
        greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), (o_totalprice - 250000) / 250000)) AS score FROM orders""",
    "corp": "SELECT symbol, CAST(min(published_at) AS DATE) AS event_date, 'earnings' AS kind FROM articles GROUP BY symbol, date_trunc('quarter', published_at)",
    "hourly": """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(CASE WHEN a = 1 THEN value END) AS open, max(value) AS high, min(value) AS low, max(CASE WHEN z = 1 THEN value END) AS close, count(*) AS volume
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS a, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS z FROM events)
        GROUP BY event_type, date_trunc('hour', ts)""",
    "titles": "SELECT doc_id, source AS day, lang, split_part(text, chr(10), 1) AS title FROM documents",
    "quotes": """SELECT p.p_partkey AS symbol, p.p_name AS name, CASE WHEN p.p_size <= 25 THEN 'US' ELSE 'SGX' END AS exchange, CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE p.p_size END AS pe_ratio, p.p_retailprice AS price,
        v.vol AS avg_volume_3m, p.p_retailprice * coalesce(v.vol, 0) AS market_cap FROM part p LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS vol FROM lineitem GROUP BY l_partkey) v ON v.l_partkey = p.p_partkey""",
    "watchers": """SELECT c.c_custkey AS owner_id, n.n_name AS country, r.r_name AS region, c.c_mktsegment AS segment FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
}


def with_views(views: str, body: str, recursive: bool = False) -> str:
    """SQL that defines the named views (in order of use) before a body that starts with SELECT or with more CTEs and a comma."""
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
