"""Structured Streaming versions of what arrives over time: bars from ticks, news without repeats, visits, late articles.

Each takes a streaming (or batch) DataFrame and gives one; sinks are the caller's.  `upsert_daily` is a foreachBatch body that
recomputes only the sessions a batch touches, so late articles reach the right past session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV bars of event types (symbol, ts, open, high, low, close, volume); in append mode a bar comes once its window has closed,
    so a bar in progress is never shown.  Ties in time go to the smaller id first."""
    t = ticks.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    g = t.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol")
    order = F.struct("ts", "event_id")
    b = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    return b.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_dedupe(articles: DataFrame, key: str = "story_key", time: str = "published_at", window: str = "30 days") -> DataFrame:
    """Each story once, whichever fetch brings it first, as long as repeats come within the window."""
    return articles.withWatermark(time, window).dropDuplicatesWithinWatermark([key])


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, events): a visit ends when nothing came for the gap."""
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = e.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def upsert_daily(folder: str, aggregate: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: adds the batch to the raw rows under folder/raw and rewrites, under folder/daily, the sessions it touches.

    Raw rows are stored under the batch's number and their session, so a batch that is repeated replaces itself and only the folders of
    the sessions that it touches are read; daily results are partitioned by session and overwritten dynamically.  Rows without a
    session are left out."""

    def body(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{folder}/raw/batch={number}"
        batch.where("session is not null").write.mode("overwrite").partitionBy("session").parquet(own)
        schema = batch.schema
        read = lambda path: spark.read.schema(schema).option("basePath", f"{folder}/raw").parquet(path)
        touched = [r[0] for r in read(own).select("session").distinct().collect()]  # a batch's days, not its rows
        if touched:
            rows = read(f"{folder}/raw").where(F.col("session").isin(touched)).select(*schema.names)
            aggregate(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(f"{folder}/daily")

    return body
