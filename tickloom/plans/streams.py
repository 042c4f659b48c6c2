"""Streaming queries over the test tables, run to the end of their input (availableNow) and read back.

Output and checkpoints go to the folder that spark.checkpoint.dir names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.storage import new_folder
from tickloom.plans.registry import query
from tickloom.sources.views import with_views
from tickloom.streaming import pipelines as S


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{d}/{name}.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads its output."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: What append mode has shown at the end: windows that ended at or before the newest time less the allowed lateness.
@query("stream_bars", with_views("hourly", "SELECT symbol, ts, open, high, low, close, volume FROM hourly WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"))
def stream_bars(spark, d):
    b = run(S.stream_bars(source(spark, d, "events")))
    return b.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS visit FROM g), v AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM n GROUP BY user_id, visit)
    SELECT user_id, count(*) AS visits, CAST(sum(events) AS BIGINT) AS events FROM v WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY user_id""")
def stream_sessions(spark, d):
    v = run(S.stream_sessions(source(spark, d, "events")))
    return v.groupBy("user_id").agg(F.count("*").alias("visits"), F.sum("events").alias("events"))


@query("stream_dedupe", "SELECT count(*) AS stories FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def stream_dedupe(spark, d):
    """Stories that come again within the window are dropped; here all are within it."""
    o = source(spark, d, "orders").select(F.concat_ws("|", F.col("o_custkey"), "o_orderstatus").alias("story_key"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    return run(S.stream_dedupe(o, window="5000 days")).agg(F.count("*").alias("stories"))
