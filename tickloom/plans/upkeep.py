"""Queries of sinks, retention, refresh rules and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import upkeep as U
from tickloom.plans import feed
from tickloom.plans.registry import query
from tickloom.sources import views as V
from tickloom.sources.views import with_views

NOW = "TIMESTAMP '1997-12-31 12:00:00'"


def now():
    return F.lit("1997-12-31 12:00:00").cast("timestamp_ntz")


@query("dedupe_last", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def dedupe_last(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return U.dedupe_last(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("replace_range", with_views("ticks bars", "SELECT symbol, session, round(close, 8) AS close FROM bars WHERE session NOT BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' UNION ALL SELECT symbol, session, round(close + 1, 8) FROM bars WHERE session BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND day(session) % 2 = 0"))
def replace_range(spark, d):
    """Half a year of bars is replaced by a batch that has its even days only, some of them twice."""
    b = V.bars_daily(spark, d).select("symbol", "session", "close")
    span = F.col("session").between(F.lit("1996-01-01").cast("date"), F.lit("1996-06-30").cast("date"))
    batch = b.where(span & (F.dayofmonth("session") % 2 == 0)).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("close", F.col("close") + F.col("seq"))
    got = U.replace_range(b.withColumn("seq", F.lit(0)), batch, ["symbol", "session"], ["seq"], span)
    return got.select("symbol", "session", F.round("close", 8).alias("close"))


@query("upsert_events", with_views("articles corp", "SELECT symbol, event_date, kind, CASE WHEN month(event_date) = 1 THEN 'revised' ELSE 'first' END AS label FROM corp UNION ALL SELECT symbol, event_date + 1, kind, 'revised' FROM corp WHERE month(event_date) = 1"))
def upsert_events(spark, d):
    old = V.earnings(spark, d).withColumn("label", F.lit("first"))
    january = V.earnings(spark, d).where(F.month("event_date") == 1)
    batch = january.unionByName(january.withColumn("event_date", F.date_add("event_date", 1))).withColumn("label", F.lit("revised"))
    return U.upsert(old, batch, ["symbol", "event_date", "kind"], ["label"])


@query("upsert_articles", "SELECT key, array_to_string(list_sort(list_distinct(flatten(list(symbols)))), ',') AS symbols, arg_min(title, rank) AS title FROM (SELECT 'k' || (o_orderkey % 5000) AS key, [o_orderstatus] AS symbols, o_orderpriority AS title, [CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey] AS rank FROM orders) GROUP BY key")
def upsert_articles(spark, d):
    """Known stories gain symbols and keep the rest; new ones take the earliest row."""
    o = V.table(spark, d, "orders").select(F.concat(F.lit("k"), (F.col("o_orderkey") % 5000).cast("string")).alias("key"), F.array("o_orderstatus").alias("symbols"), F.col("o_orderkey").alias("published_at"), F.col("o_orderpriority").alias("title"))
    got = U.upsert_articles(o.where("published_at % 2 = 0"), o.where("published_at % 2 = 1"))
    return got.select("key", F.array_join("symbols", ",").alias("symbols"), "title")


@query("append_similar", """WITH dup AS (SELECT o_custkey % 300 AS head, o_orderkey, o_orderdate FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY o_orderdate DESC, 'd' || o_orderkey) AS n, count(*) OVER (PARTITION BY head) AS c FROM dup)
    SELECT 'h' || head AS key, string_agg('d' || o_orderkey, ',' ORDER BY n) AS similar, CAST(max(c) AS INTEGER) AS similar_count FROM r WHERE n <= 10 GROUP BY head""")
def append_similar(spark, d):
    """Look-alikes come in two batches that overlap; the list shows ten, the count has all."""
    o = V.table(spark, d, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 300).cast("string")).alias("head"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("dup_key"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("title"), "o_orderkey")
    none = F.array().cast("array<struct<published_at:timestamp_ntz,dup_key:string,title:string>>")
    heads = o.select(F.col("head").alias("key")).distinct().select("key", none.alias("similar"), F.array().cast("array<string>").alias("similar_keys"), F.lit(0).alias("similar_count"))
    one = U.append_similar(heads, o.where("o_orderkey % 3 <> 0").drop("o_orderkey"))
    two = U.append_similar(one, o.where("o_orderkey % 3 <> 1").drop("o_orderkey"))
    return two.select("key", F.array_join(F.transform("similar", lambda x: x["dup_key"]), ",").alias("similar"), "similar_count")


@query("capped_set_add", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A,B' WHEN c_custkey % 3 = 1 THEN 'A,B,C' ELSE 'A,N' END AS symbols FROM customer")
def capped_set_add(spark, d):
    k = F.col("c_custkey") % 3
    have = F.when(k == 0, F.array(F.lit("A"), F.lit("B"))).when(k == 1, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("A")))
    new = F.when(k == 0, "B").otherwise("N")
    return V.table(spark, d, "customer").select("c_custkey", F.array_join(U.capped_add(have, new, 3), ",").alias("symbols"))


@query("reflag", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice > 400000 ELSE o_totalprice > 300000 END AS flag, 2 AS version FROM orders")
def reflag(spark, d):
    """Rows flagged under an older version of a rule are flagged anew; rows of the current version keep their flag."""
    o = V.table(spark, d, "orders").withColumns({"version": F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1), "flag": F.col("o_totalprice") > 400000})
    return o.select("o_orderkey", F.when(F.col("version") < 2, F.col("o_totalprice") > 300000).otherwise(F.col("flag")).alias("flag"), F.lit(2).alias("version"))


@query("unlink_symbol", with_views("articles", f", {feed.STORED_SQL} SELECT key, array_to_string(list_filter(symbols, lambda s: s <> 'A'), ',') AS symbols FROM sa WHERE len(list_filter(symbols, lambda s: s <> 'A')) > 0"))
def unlink_symbol(spark, d):
    return U.unlink_symbol(feed.stored(spark, d), "A").select("key", F.array_join("symbols", ",").alias("symbols"))


@query("distinct_symbols", with_views("articles", f", {feed.STORED_SQL} SELECT DISTINCT unnest(symbols) AS symbol FROM sa"))
def distinct_symbols(spark, d):
    return feed.stored(spark, d).select(F.explode("symbols").alias("symbol")).distinct()


@query("idle_symbols", "SELECT p_partkey AS symbol, max(l_shipdate) AS last_fetched FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey HAVING max(l_shipdate) < TIMESTAMP '2001-06-01'")
def idle_symbols(spark, d):
    return _idle(spark, d)


def _idle(spark, d):
    li = V.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_fetched"))
    return V.table(spark, d, "part").join(li, F.col("l_partkey") == F.col("p_partkey")).where(F.col("last_fetched") < F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("p_partkey").alias("symbol"), "last_fetched")


@query("prune_orphans", "SELECT p_partkey AS symbol FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY p_partkey HAVING max(l_shipdate) < TIMESTAMP '2001-06-01'")
def prune_orphans(spark, d):
    """Idle symbols that no watchlist and no screener list holds."""
    held = V.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("symbol")).union(V.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long")))
    return _idle(spark, d).select("symbol").join(held, "symbol", "left_anti")


@query("prune_news", with_views("articles", f"SELECT article_id, symbol FROM articles WHERE published_at >= {NOW} - INTERVAL 25 MONTH"))
def prune_news(spark, d):
    cut = F.add_months(now().cast("date"), -25).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    return V.articles(spark, d).where(F.col("published_at") >= cut).select("article_id", "symbol")


@query("last_session", with_views("ticks bench sessions", f"SELECT max(session) AS last_session, max(close_utc) AS last_close FROM sessions WHERE close_utc <= {NOW}"))
def last_session(spark, d):
    return U.last_session(V.sessions(spark, d), now())


@query("completed_bars", with_views("ticks bars bench sessions", f"SELECT symbol, session, round(close, 8) AS close FROM bars WHERE session <= (SELECT max(session) FROM sessions WHERE close_utc <= {NOW})"))
def completed_bars(spark, d):
    return U.completed_bars(V.bars_daily(spark, d), U.last_session(V.sessions(spark, d), now())).select("symbol", "session", F.round("close", 8).alias("close"))


@query("session_open", with_views("ticks bench sessions", "SELECT event_id, CAST(ts AS TIME) >= TIME '14:30:00' AND CAST(ts AS TIME) < TIME '21:00:00' AND dayofweek(ts) BETWEEN 1 AND 5 AS is_open FROM events"))
def session_open(spark, d):
    """Whether the exchange is open at each event: weekdays from 14:30 to 21:00 UTC."""
    ts = F.col("ts")
    since = F.hour(ts) * 60 + F.minute(ts)
    return V.table(spark, d, "events").select("event_id", (since.between(14 * 60 + 30, 21 * 60 - 1) & F.dayofweek(ts).between(2, 6)).alias("is_open"))


@query("needs_refresh", with_views("articles ticks bench sessions", f""", ls AS (SELECT max(session) AS ls, max(close_utc) AS lc FROM sessions WHERE close_utc <= {NOW}), st AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE {NOW} - INTERVAL 10 MINUTE * (c_custkey % 300) END AS fetched, {NOW} - INTERVAL 1100 DAY + INTERVAL 1 DAY * (c_custkey % 9) AS covered, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {NOW} - INTERVAL 1 DAY * (c_custkey % 4) END AS bar FROM customer)
    SELECT c_custkey, CASE WHEN fetched IS NULL OR covered > {NOW} - INTERVAL 1100 DAY + INTERVAL 7 DAY THEN TRUE WHEN fetched < lc THEN TRUE WHEN fetched + INTERVAL 15 MINUTE > {NOW} THEN FALSE ELSE bar IS NULL OR CAST(bar AS DATE) < ls OR c_custkey % 4 = 1 END AS needs_refresh FROM st, ls"""))
def needs_refresh(spark, d):
    k = F.col("c_custkey").cast("int")
    start = now() - F.expr("INTERVAL 1100 DAYS")
    state = V.table(spark, d, "customer").select("c_custkey", F.when(k % 6 != 0, now() - F.make_dt_interval(mins=k % 300 * 10)).alias("last_fetched_at"), (start + F.make_dt_interval(days=k % 9)).alias("covered_start"), F.when(k % 5 != 0, now() - F.make_dt_interval(days=k % 4)).alias("last_bar_at"))
    live = (k % 2 == 1) & (k % 4 < 2)  # every other symbol has hourly bars, every other pair's exchange is open
    return U.needs_refresh(state, U.last_session(V.sessions(spark, d), now()), start=start, now=now(), live=live).select("c_custkey", "needs_refresh")


TICKERS = ["D05.SI", "^STI", "brk-b", "BRK-B", "A", "", "A B", ".X", "-X", "ABCDEFGHIJKLMNO", "ABCDEFGHIJKLMNOP", "7203"]


@query("symbol_grammar", f"SELECT o_orderkey, coalesce(regexp_full_match(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE ({TICKERS})[1 + o_orderkey % 12] END, '[A-Z0-9^][A-Z0-9.^-]{{0,14}}'), FALSE) AS valid FROM orders")
def symbol_grammar(spark, d):
    k = F.col("o_orderkey")
    ticker = F.when(k % 17 != 0, F.element_at(F.array(*map(F.lit, TICKERS)), (k % 12 + 1).cast("int")))
    return V.table(spark, d, "orders").select("o_orderkey", U.valid_symbol(ticker).alias("valid"))


@query("history_start", "SELECT event_id, date_trunc('day', ts - INTERVAL 1100 DAY) AS daily, ts - INTERVAL 60 DAY AS hourly FROM events")
def history_start(spark, d):
    """What each width of bars would be kept from, as of every event."""
    at = lambda i: U.history_start(F.lit(i), F.col("ts"))
    return V.table(spark, d, "events").select("event_id", at("1d").alias("daily"), at("1h").alias("hourly"))


@query("build_overdue", "SELECT event_id, b AS last_build, ts - b > INTERVAL 1 DAY + INTERVAL 1 HOUR AS overdue FROM (SELECT event_id, ts, a - INTERVAL 1 DAY * (CASE dayofweek(a) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END) AS b FROM (SELECT event_id, ts, CASE WHEN date_trunc('day', ts) + INTERVAL 1350 MINUTE <= ts THEN date_trunc('day', ts) + INTERVAL 1350 MINUTE ELSE date_trunc('day', ts) - INTERVAL 90 MINUTE END AS a FROM events))")
def build_overdue(spark, d):
    e = V.table(spark, d, "events").select("event_id", "ts", U.last_build(F.col("ts")).alias("last_build"))
    return e.select("event_id", "last_build", (F.col("ts") > F.col("last_build") + F.expr("INTERVAL 25 HOURS")).alias("overdue"))


@query("cache_freshness", f"SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 1 DAY > {NOW} THEN 'fresh' WHEN o_orderdate + INTERVAL 8 DAY > {NOW} THEN 'stale' ELSE 'gone' END AS state FROM orders")
def cache_freshness(spark, d):
    o = V.table(spark, d, "orders").withColumns({"expires_at": F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), "stale_until": F.col("o_orderdate") + F.expr("INTERVAL 8 DAYS")})
    return o.select("o_orderkey", U.cache_state(now()).alias("state"))


@query("age_phrase", "SELECT event_id, CASE WHEN s < 90 THEN 'under a minute' WHEN s // 60 < 90 THEN (s // 60) || ' minutes' WHEN s // 3600 < 48 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour' ELSE ' hours' END ELSE (s // 86400) || ' days' END AS age FROM (SELECT event_id, greatest(0, 1706659200 - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events)")
def age_phrase(spark, d):
    ts = F.col("ts").cast("timestamp")
    return V.table(spark, d, "events").select("event_id", U.age_phrase(ts, F.timestamp_seconds(F.lit(1706659200))).alias("age"))


@query("exchange_of", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'SGX' ELSE 'US' END AS exchange, 'P' || p_partkey AS root FROM part")
def exchange_of(spark, d):
    s = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".si").otherwise(""))
    return V.table(spark, d, "part").select("p_partkey", U.exchange_of(s).alias("exchange"), U.root_ticker(s).alias("root"))


@query("months_before", "SELECT o_orderkey, CAST(o_orderdate - to_months(CAST(o_orderkey % 25 AS INTEGER)) AS DATE) AS day FROM orders")
def months_before(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", F.add_months("o_orderdate", -(F.col("o_orderkey") % 25).cast("int")).alias("day"))


@query("parse_news_ts", "SELECT event_id, CASE event_id % 4 WHEN 3 THEN -1 WHEN 2 THEN CAST(floor(epoch(ts)) AS BIGINT) + 5 * 3600 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events")
def parse_news_ts(spark, d):
    """Epoch seconds, ISO, compact Eastern time (five hours behind in January) and junk."""
    k, ts = F.col("event_id") % 4, F.col("ts")
    raw = F.when(k == 0, F.unix_timestamp(ts.cast("timestamp")).cast("string")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(ts, "yyyyMMdd'T'HHmmss")).otherwise("soon")
    return V.table(spark, d, "events").select("event_id", F.coalesce(F.unix_timestamp(U.parse_news_time(raw)), F.lit(-1)).alias("seconds"))


@query("skip_bad_rows", "SELECT event_id, CAST(value AS DOUBLE) AS value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def skip_bad_rows(spark, d):
    """Rows that do not convert go, one by one: damaged JSON and values that are no numbers."""
    k = F.col("event_id")
    raw = V.table(spark, d, "events").select("event_id", F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"v": "'), F.when(k % 11 == 0, "n/a").otherwise(F.col("value").cast("string")), F.lit('"}'))).alias("json"))
    return raw.select("event_id", F.from_json("json", "v string").alias("j")).select("event_id", F.col("j.v").try_cast("double").alias("value")).where("value is not null")
