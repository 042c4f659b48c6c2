"""Queries over vendors' pages, which Spark lays out from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.storage import new_folder
from tickloom.plans.registry import query
from tickloom.sources import vendors
from tickloom.sources import views as V
from tickloom.sources.views import with_views

EXCHANGE = "CASE WHEN symbol = 'R' THEN 'SGX' ELSE 'US' END"


def bar_pages(spark: SparkSession, d: str) -> str:
    """Every bar at the vendor of all exchanges, and those of the US at the other one as well."""
    folder = new_folder(spark, "bar-pages")
    bars = V.bars_daily(spark, d).withColumn("exchange", F.expr(EXCHANGE))
    vendors.write_column_bars(bars, folder)
    vendors.write_record_bars(bars.where("exchange = 'US'"), folder)
    return folder


def articles_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Articles as a vendor has them: each tenth has no web address, each seventh no summary."""
    o = V.articles(spark, d).withColumn("exchange", F.expr(EXCHANGE))
    url = F.when(F.col("article_id") % 10 != 0, F.concat(F.lit("https://news.example/"), F.col("article_id")))
    return o.select("exchange", "symbol", F.col("published_at").cast("timestamp").alias("published_at"), url.alias("url"), F.concat(F.lit(" Story "), F.col("article_id"), F.lit(" ")).alias("title"), F.when(F.col("article_id") % 7 != 0, "More of it").alias("summary"), F.concat(F.lit("Paper "), F.col("article_id") % 5).alias("publisher"))


def news_pages(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark, "news-pages")
    news = articles_with_text(spark, d)
    vendors.write_wire_news(news, folder)
    vendors.write_tagged_news(news.where("exchange = 'US'"), folder)
    return folder


@query("market_source", with_views("ticks bars", f"""
    , p AS (SELECT unnest(['columns', 'records']) AS provider), b AS (SELECT *, {EXCHANGE} AS exchange FROM bars)
    SELECT provider, exchange, symbol, session, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b JOIN p ON provider = 'columns' OR exchange = 'US'
    WHERE session BETWEEN DATE '1995-03-15' AND DATE '1996-02-10' AND symbol IN ('A', 'R')"""))
def market_source(spark, d):
    """Eleven months of two symbols from every vendor that covers them: months, exchanges and symbols are pruned in the source."""
    bars = vendors.read_bars(spark, bar_pages(spark, d))
    got = bars.where(F.col("session").between(F.lit("1995-03-15").cast("date"), F.lit("1996-02-10").cast("date")) & F.col("symbol").isin("A", "R"))
    return got.select("provider", "exchange", "symbol", "session", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("news_source", with_views("articles", f"""
    , n AS (SELECT *, {EXCHANGE} AS exchange FROM articles WHERE article_id % 10 <> 0), p AS (SELECT unnest(['wire', 'tagged']) AS provider)
    SELECT provider, exchange, symbol, published_at, 'https://news.example/' || article_id AS url, 'Story ' || article_id AS title, CASE WHEN article_id % 7 <> 0 THEN 'More of it' END AS summary, 'Paper ' || (article_id % 5) AS publisher
    FROM n JOIN p ON provider = 'wire' OR exchange = 'US' WHERE published_at >= TIMESTAMP '1997-01-10 05:00:00' AND published_at < TIMESTAMP '1997-06-01 00:00:00'"""))
def news_source(spark, d):
    """Some months of news of both vendors; items without a web address are passed over."""
    news = vendors.read_news(spark, news_pages(spark, d))
    at = lambda x: F.lit(x).cast("timestamp")
    got = news.where((F.col("published_at") >= at("1997-01-10 05:00:00")) & (F.col("published_at") < at("1997-06-01 00:00:00")))
    return got.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("news_first_vendor", with_views("articles", f"""
    SELECT {EXCHANGE} AS exchange, CASE WHEN symbol = 'R' THEN 'wire' ELSE 'tagged' END AS provider, count(*) AS stories FROM articles WHERE article_id % 10 <> 0 GROUP BY ALL"""))
def news_first_vendor(spark, d):
    """Each story once, from the first vendor by name that has it: vendors that do not cover an exchange have none of it."""
    news = vendors.read_news(spark, news_pages(spark, d))
    first = news.groupBy("exchange", "url").agg(F.min("provider").alias("provider"))
    return first.groupBy("exchange", "provider").agg(F.count("*").alias("stories"))
