"""Articles and corporate dates against the trading calendar: as-of joins, daily sentiment, weekly timeline, regime.

As-of joins are equi-joins on the calendar day: every day knows the first session that closes on or after it, and the one after
that, so an article needs no range join and no window over all articles.  A session closes on its own date (UTC).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = ("positive", "neutral", "negative")


def session_days(sessions: DataFrame) -> DataFrame:
    """(day, session, close_utc, next_session): for each calendar day up to the last session, the first session on or after it.

    A calendar has some 250 rows a year, which is why one window may order it."""
    w = Window.orderBy("session")
    s = sessions.select("session", "close_utc", F.lag("session").over(w).alias("before"), F.lead("session").over(w).alias("next_session"))
    days = F.sequence(F.coalesce(F.date_add("before", 1), F.col("session")), F.col("session"))
    return s.select(F.explode(days).alias("day"), "session", "close_utc", "next_session")


def asof_session(articles: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds session: the first whose close is after published_at; null past the last close or without a time.  News at the close belongs to the next."""
    first = sessions.agg(F.min("session").alias("__first"))  # one row
    a = articles.crossJoin(F.broadcast(first)).withColumn("__day", F.greatest(F.col("published_at").cast("date"), F.col("__first"))).drop("__first")
    days = session_days(sessions).select(F.col("day").alias("__on"), F.col("session").alias("__s"), "close_utc", "next_session")
    session = F.when(F.col("published_at") < F.col("close_utc"), F.col("__s")).when(F.col("published_at") >= F.col("close_utc"), F.col("next_session"))
    return a.join(days, F.col("__day") == F.col("__on"), "left").withColumn("session", session).drop("__day", "__on", "__s", "close_utc", "next_session")


def sessions_on_or_after(dates: DataFrame, bars: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Adds session: the symbol's first bar on or after the date; dates past the data go, dates before it map to the first bar."""
    w = Window.partitionBy("symbol").orderBy("session")
    b = bars.select("symbol", "session").withColumn("before", F.lag("session").over(w))
    gaps = b.select(F.col("symbol").alias("__sym"), F.explode(F.sequence(F.coalesce(F.date_add("before", 1), F.col("session")), F.col("session"))).alias("__on"), "session")
    first = bars.groupBy(F.col("symbol").alias("__fs")).agg(F.min("session").alias("__first"))
    d = dates.join(first, F.col("symbol") == F.col("__fs")).withColumn("__day", F.greatest(F.col(date_col), F.col("__first")))
    return d.join(gaps, (F.col("symbol") == F.col("__sym")) & (F.col("__day") == F.col("__on"))).drop("__fs", "__first", "__day", "__sym", "__on")


def daily_sentiment(aligned: DataFrame) -> DataFrame:
    """Per symbol and session: mean_score, article_count, max_abs_score.  Silent sessions are absent; null sessions are left out."""
    return aligned.where("session is not null").groupBy("symbol", "session").agg(F.avg("score").alias("mean_score"), F.count("*").alias("article_count"), F.max(F.abs("score")).alias("max_abs_score"))


def weighted_mean() -> Column:
    """Article-weighted mean score; null without articles."""
    return F.try_divide(F.sum(F.col("mean_score") * F.col("article_count")), F.sum("article_count"))


def bucket_of(score: Column) -> Column:
    return F.when(score > 0.3, "positive").when(score < -0.3, "negative").when(score.isNotNull(), "neutral")


def weekly_timeline(daily: DataFrame) -> DataFrame:
    """(symbol, week_end, mean_score, article_count): weeks end on Friday; weeks without news are absent."""
    week_end = F.next_day(F.date_sub("session", 1), "FRI")
    return daily.groupBy("symbol", week_end.alias("week_end")).agg(weighted_mean().alias("mean_score"), F.sum("article_count").alias("article_count"))


def regime_blocks(daily: DataFrame, as_of: DataFrame, days: int = 30) -> DataFrame:
    """(symbol, block, mean, articles): blocks of `days` days counted back from each symbol's as_of; later sessions are not read."""
    d = daily.join(as_of, "symbol").where(F.col("session") <= F.col("as_of"))
    block = F.floor(F.datediff("as_of", "session") / days).cast("int")
    return d.groupBy("symbol", block.alias("block")).agg(weighted_mean().alias("mean"), F.sum("article_count").alias("articles")).where("mean is not null")


def sentiment_regime(daily: DataFrame, as_of: DataFrame, days: int = 30, min_blocks: int = 8) -> DataFrame:
    """One row per symbol whose recent block and history allow it: recent and baseline mean, z, label."""
    old = F.col("block") > 0
    g = regime_blocks(daily, as_of, days).groupBy("symbol").agg(
        F.max(F.when(~old, F.col("mean"))).alias("recent_mean"),
        F.avg(F.when(old, F.col("mean"))).alias("baseline_mean"),
        F.stddev_samp(F.when(old, F.col("mean"))).alias("sd"),
        F.count_if(old).alias("blocks"),
        F.max(F.when(~old, F.col("articles"))).alias("recent_articles"),
    )
    g = g.where((F.col("blocks") >= min_blocks) & F.col("recent_mean").isNotNull() & (F.col("sd") > 1e-12)).withColumn("z", (F.col("recent_mean") - F.col("baseline_mean")) / F.col("sd"))
    label = F.when(F.col("z") >= 1, "more_positive_than_usual").when(F.col("z") <= -1, "more_negative_than_usual").otherwise("typical")
    return g.select("symbol", "recent_mean", "baseline_mean", "z", "recent_articles", label.alias("label"))
