"""Sinks and upkeep as set operations: replace a range, upsert, append look-alikes, capped sets, retention, refresh and cache rules.

Each takes the stored table and a batch and gives the new table; writers keep their own format and commit protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedupe_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by a total order.  The aggregate combines before the shuffle, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def replace_range(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str], inside: Column) -> DataFrame:
    """Stored rows outside the range, and the batch's last row of each key.  An empty batch takes nothing away."""
    some = batch.limit(1).select(F.lit(True).alias("__some"))  # one row at most
    kept = stored.join(F.broadcast(some), inside, "left").where("__some is null").drop("__some")
    return kept.unionByName(dedupe_last(batch, keys, order).select(*stored.columns))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Batch rows overwrite stored ones with the same key; nulls in keys count as a value."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    return dedupe_last(both, keys, ["__new", *order]).drop("__new")


def upsert_articles(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Known stories only gain symbols; new ones get all columns, the earliest published first.  symbols is a sorted set."""
    rest = [c for c in stored.columns if c not in ("key", "symbols")]
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    g = both.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("symbols")))).alias("symbols"), F.min_by(F.struct(*rest), F.struct("__new", *rest)).alias("__row"))
    return g.select(*[F.col(c) if c in ("key", "symbols") else F.col("__row")[c].alias(c) for c in stored.columns])


def append_similar(heads: DataFrame, duplicates: DataFrame, most: int = 10) -> DataFrame:
    """Adds look-alikes to their head: similar (newest first, `most` at most), similar_keys (all), similar_count.  Idempotent by key.

    A look-alike that is listed already changes nothing.  The list that is shown is cut, the keys and the count are whole."""
    known = heads.select(F.col("key").alias("head"), F.explode("similar_keys").alias("dup_key"))
    fresh = dedupe_last(duplicates, ["head", "dup_key"], ["published_at", "title"]).join(known, ["head", "dup_key"], "left_anti")
    newest = F.row_number().over(Window.partitionBy("head").orderBy(F.desc("published_at"), "dup_key"))
    top = fresh.withColumn("__n", newest).where(F.col("__n") <= most).groupBy(F.col("head").alias("__h")).agg(F.collect_list(F.struct("published_at", "dup_key", "title")).alias("__top"))
    every = fresh.groupBy(F.col("head").alias("__k")).agg(F.collect_set("dup_key").alias("__keys"))
    j = heads.join(top, F.col("key") == F.col("__h"), "left").join(every, F.col("key") == F.col("__k"), "left")
    newer = lambda a, b: F.when(a["published_at"] > b["published_at"], -1).when(a["published_at"] < b["published_at"], 1).when(a["dup_key"] < b["dup_key"], -1).when(a["dup_key"] > b["dup_key"], 1).otherwise(0)
    both = F.when(F.col("__top").isNull(), F.col("similar")).otherwise(F.slice(F.array_sort(F.concat("similar", "__top"), newer), 1, most))
    keys = F.array_sort(F.array_union("similar_keys", F.coalesce("__keys", F.array().cast("array<string>"))))
    return j.withColumns({"similar": both, "similar_keys": keys}).withColumn("similar_count", F.size("similar_keys")).drop("__h", "__top", "__k", "__keys")


def capped_add(values: Column, value: Column, cap: int) -> Column:
    """The set with the value, unless it is full; a value that is there changes nothing."""
    return F.when(F.array_contains(values, value) | (F.size(values) >= cap), values).otherwise(F.concat(values, F.array(value)))


def unlink_symbol(articles: DataFrame, symbol: str) -> DataFrame:
    """Articles without the symbol; those that had no other go."""
    return articles.withColumn("symbols", F.array_remove("symbols", symbol)).where(F.size("symbols") > 0)


def exchange_of(symbol: Column) -> Column:
    """SGX for the .SI suffix and the Straits Times index, else US."""
    return F.when(F.upper(symbol).endswith(".SI") | (F.upper(symbol) == "^STI"), "SGX").otherwise("US")


def valid_symbol(symbol: Column) -> Column:
    """Whether a text is a ticker: one to fifteen capitals, digits, dots, dashes and carets, neither dot nor dash first; null is none."""
    return F.coalesce(symbol.rlike(r"\A[A-Z0-9^][A-Z0-9.^-]{0,14}\z"), F.lit(False))


def root_ticker(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), r"\.SI$", "")


def last_session(sessions: DataFrame, now: Column) -> DataFrame:
    """One row: the newest session that has closed by now, and its close."""
    return sessions.where(F.col("close_utc") <= now).agg(F.max("session").alias("last_session"), F.max("close_utc").alias("last_close"))


#: How many days of bars are kept by their width: three years for the daily ones, two months for the hourly ones.
HISTORY_DAYS = {"1d": 1100, "1h": 60}


def history_start(interval: Column, now: Column) -> Column:
    """Start of the kept history: midnight for daily bars; null for other widths."""
    back = lambda i: now - F.make_dt_interval(days=F.lit(HISTORY_DAYS[i]))
    return F.when(interval == "1d", F.date_trunc("DAY", back("1d")).cast("timestamp_ntz")).when(interval == "1h", back("1h"))


def needs_refresh(state: DataFrame, last: DataFrame, *, start: Column, now: Column, live: Column | None = None) -> DataFrame:
    """Adds needs_refresh: no state, coverage over 7 days late, fetched before the last close, or - 15 minutes after the last fetch -
    the newest bar is older than the last session, or the bars are `live`: hourly ones while their exchange is open.

    last has one row (last_session, last_close)."""
    live = F.lit(False) if live is None else F.coalesce(live, F.lit(False))
    s = state.crossJoin(F.broadcast(last))
    rule = (
        F.when(F.col("last_fetched_at").isNull() | (F.col("covered_start") > start + F.expr("INTERVAL 7 DAYS")), True)
        .when(F.col("last_fetched_at") < F.col("last_close"), True)
        .when(F.col("last_fetched_at") + F.expr("INTERVAL 15 MINUTES") > now, False)
        .otherwise(F.col("last_bar_at").isNull() | (F.col("last_bar_at").cast("date") < F.col("last_session")) | live)
    )
    return s.withColumn("needs_refresh", rule).drop("last_session", "last_close")


def completed_bars(bars: DataFrame, last: DataFrame) -> DataFrame:
    """Daily bars up to the last completed session."""
    return bars.crossJoin(F.broadcast(last.select("last_session"))).where(F.col("session") <= F.col("last_session")).drop("last_session")


def cache_state(now: Column) -> Column:
    """fresh until expires_at, then stale until stale_until, then gone; null deadlines count as passed."""
    return F.when(F.col("expires_at") > now, "fresh").when(F.col("stale_until") > now, "stale").otherwise("gone")


def age_phrase(then: Column, now: Column) -> Column:
    """How long ago: under a minute, minutes, hours, days."""
    s = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then))
    minutes = F.floor(s / 60)
    hours = F.floor(minutes / 60)
    return F.when(s < 90, "under a minute").when(minutes < 90, F.concat(minutes, F.lit(" minutes"))).when(hours < 48, F.concat(hours, F.when(hours == 1, " hour").otherwise(" hours"))).otherwise(F.concat(F.floor(hours / 24), F.lit(" days")))


def last_build(now: Column) -> Column:
    """The most recent weekday 22:30 at or before now (timestamps without zone, UTC)."""
    today = F.date_trunc("DAY", now).cast("timestamp_ntz") + F.expr("INTERVAL '22:30' HOUR TO MINUTE")
    at = F.when(today <= now, today).otherwise(today - F.expr("INTERVAL 1 DAY"))
    back = F.when(F.dayofweek(at) == 7, 1).when(F.dayofweek(at) == 1, 2).otherwise(0)
    return at - F.make_dt_interval(days=back)


def parse_news_time(raw: Column) -> Column:
    """UTC instants from epoch seconds, ISO text, or compact Eastern time (yyyyMMddTHHmmss); null for anything else."""
    eastern = F.to_utc_timestamp(F.try_to_timestamp(F.when(raw.rlike(r"^\d{8}T\d{6}$"), raw), F.lit("yyyyMMdd'T'HHmmss")), "America/New_York")
    return F.when(raw.rlike(r"^\d{9,10}$"), F.timestamp_seconds(raw.cast("long"))).when(raw.rlike(r"^\d{8}T\d{6}$"), eastern).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(raw))


def month_windows(end: Column, months: int = 24) -> Column:
    """Consecutive [start, end) months, oldest first, the last one ending at `end`."""
    return F.transform(F.sequence(F.lit(months), F.lit(1), F.lit(-1)), lambda k: F.struct(F.add_months(end, -k).alias("start"), F.add_months(end, 1 - k).alias("end")))
