"""Queries of what arrives over time: upserts into versions, months filled backwards, events chosen as their windows close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.storage import new_folder
from tickloom.operators import alignment as A
from tickloom.operators import upkeep as U
from tickloom.plans import streams, vendors
from tickloom.plans.macro import DAILY_SQL, PICK_SQL, VIEWS
from tickloom.plans.registry import query
from tickloom.sources import vendors as pages
from tickloom.sources import views as V
from tickloom.sources.views import with_views
from tickloom.streaming import event_choice, versions

STORY = "key string, month string, symbols array<string>, published_at timestamp, title string"


def merge_stories(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return U.upsert_articles(stored, batch)


#: Batches that the stories come in, and rows that a file of theirs holds about.
BATCHES, FILE_ROWS = 4, 500_000


def _story_files(spark: SparkSession, d: str) -> tuple[str, int]:
    """Orders as fetched stories, in as many files for each batch as their number asks for (given too): a story is a customer's month, found under the symbols of its orders' states."""
    o = V.table(spark, d, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = o.select(F.concat_ws("|", F.col("o_custkey").cast("string"), month).alias("key"), month.alias("month"), F.array("o_orderstatus").alias("symbols"), F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderpriority").alias("title"))
    folder, each = new_folder(spark, "stories"), -(-max(1, o.count()) // (BATCHES * FILE_ROWS))
    rows.repartition(BATCHES * each, "key", "symbol").write.parquet(folder)
    return folder, each


def _upserted(spark: SparkSession, d: str) -> versions.VersionedTable:
    folder, each = _story_files(spark, d)
    table = versions.VersionedTable(spark, new_folder(spark, "story-table"), f"{STORY}, symbol string", "month", lambda a, b: merge_stories(a.drop("symbol"), b.drop("symbol")).withColumn("symbol", F.lit(None).cast("string")), ("symbol", "published_at"))
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", each).parquet(folder)
    versions.ingest(stream, table, "orders", new_folder(spark, "story-checkpoint"), keys=["key", "symbol"], time="published_at", late="20000 days")
    return table


@query("stream_upsert", "SELECT o_custkey || '|' || strftime(o_orderdate, '%Y-%m') AS key, strftime(o_orderdate, '%Y-%m') AS month, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS symbols FROM orders GROUP BY ALL")
def stream_upsert(spark, d):
    """Stories upserted by a stream of four batches: known ones only gain symbols."""
    return _upserted(spark, d).read().select("key", "month", F.array_join("symbols", ",").alias("symbols"))


@query("stream_coverage", "SELECT o_orderstatus AS symbol, CAST(min(d) AS DATE) AS covered_start, CAST(max(d) AS DATE) AS newest FROM (SELECT o_orderstatus, o_orderdate AS d FROM orders) GROUP BY ALL")
def stream_coverage(spark, d):
    """What times a symbol's stories cover, as committed with the rows."""
    s = _upserted(spark, d).state()
    return s.select("symbol", F.col("covered_start").cast("date").alias("covered_start"), F.col("newest").cast("date").alias("newest"))


BACKFILL = "provider string, symbol string, url string, title string, published_at timestamp, month string"


@query("backfill_news", with_views("articles", """SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS stories FROM articles
    WHERE article_id % 10 <> 0 AND published_at >= TIMESTAMP '1997-01-01' AND published_at < TIMESTAMP '1997-07-01' GROUP BY ALL"""))
def backfill_news(spark, d):
    """Half a year filled backwards from vendors' pages, a month at a time; each story once, from its first vendor."""
    folder = vendors.news_pages(spark, d)
    table = versions.VersionedTable(spark, new_folder(spark, "news-table"), BACKFILL, "month", lambda a, b: U.dedupe_last(a.unionByName(b), ["url"], ["provider"]), ("symbol", "published_at"))

    def fetch(month: str) -> DataFrame:
        start = F.lit(f"{month}-01 00:00:00").cast("timestamp")
        news = pages.read_news(spark, folder)
        return news.where((F.col("published_at") >= start) & (F.col("published_at") < F.add_months(start, 1).cast("timestamp"))).withColumn("month", F.lit(month))

    missing = versions.backfill(spark, new_folder(spark, "backfill"), versions.months_before(spark, "1997-07", 6), fetch, table)
    if missing:
        raise RuntimeError(f"months are missing: {missing}")
    return table.read().groupBy("month").agg(F.count("*").alias("stories"))


@query("stream_select_events", with_views(VIEWS, f", {DAILY_SQL}, j AS (SELECT y.symbol, s.session, s.pos FROM (SELECT DISTINCT symbol FROM ds) y, sessions s), {PICK_SQL} SELECT symbol, pos, round(mean_score, 8) AS sentiment, article_count FROM pk", recursive=True))
def stream_select_events(spark, d):
    """Events by positions of the calendar, chosen over the stream of articles; a last row far ahead closes the windows."""
    calendar = V.sessions(spark, d)
    closes = [r[0] for r in calendar.orderBy("pos").select(F.unix_millis(F.col("close_utc").cast("timestamp"))).collect()]  # the calendar's days
    of = calendar.select(F.col("session").alias("on"), "pos", F.col("close_utc").alias("at"))
    articles = V.articles_of(streams.source(spark, d, "orders"))
    aligned = A.asof_session(articles, calendar).join(of, F.col("session") == F.col("on"))
    folder = new_folder(spark, "end")
    spark.createDataFrame([("", None, 4102444800, None)], "symbol string, pos long, at long, score double").write.parquet(folder)
    end = spark.readStream.schema("symbol string, pos long, at long, score double").parquet(folder).withColumn("at", F.timestamp_seconds("at"))
    rows = aligned.select("symbol", "pos", F.col("at").cast("timestamp").alias("at"), "score").unionByName(end)
    return streams.run(event_choice.stream_events(rows, closes)).select("symbol", "pos", F.round("sentiment", 8).alias("sentiment"), "article_count")
