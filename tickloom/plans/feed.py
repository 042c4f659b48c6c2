"""Queries of the news feed, screener, overview, tables and charts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.series import rounded
from tickloom.operators import alignment as A
from tickloom.operators import reading as R
from tickloom.operators import screening as C
from tickloom.operators import upkeep as U
from tickloom.plans import macro as M
from tickloom.plans.registry import query
from tickloom.plans.technical import PATTERN_SQL
from tickloom.operators import patterns as P
from tickloom.sources import views as V
from tickloom.sources.views import with_views

#: Stored articles over orders: symbols, flags (null at times) and addresses of three kinds.
STORED_SQL = """sa AS (SELECT o_orderkey, 'k' || o_orderkey AS key, CASE WHEN o_custkey % 4 = 0 THEN [symbol, 'X'] ELSE [symbol] END AS symbols, symbol, published_at, CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS low_value,
    CASE o_orderkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS recap, CASE o_orderkey % 11 WHEN 0 THEN 'ftp://a/' ELSE 'https://n.example/' END || o_orderkey AS url, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE score END AS score
    FROM articles JOIN orders ON o_orderkey = article_id)"""
SHOWN = "NOT coalesce(low_value, FALSE) AND NOT coalesce(recap, FALSE)"


def stored(spark, d):
    a = V.articles(spark, d)
    k, o = F.col("article_id"), V.table(spark, d, "orders").select(F.col("o_orderkey").alias("__k"), "o_custkey")
    flag = lambda n: F.when(k % n == 0, True).when(k % n != 1, False)
    return a.join(o, k == F.col("__k")).select(
        k.alias("o_orderkey"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.when(F.col("o_custkey") % 4 == 0, F.array("symbol", F.lit("X"))).otherwise(F.array("symbol")).alias("symbols"), "symbol", "published_at",
        flag(5).alias("low_value"), flag(7).alias("recap"), F.concat(F.when(k % 11 == 0, "ftp://a/").otherwise("https://n.example/"), k.cast("string")).alias("url"), F.when(k % 9 != 0, F.col("score")).alias("score"),
    )


def shown(df):
    return df.where(~F.coalesce("low_value", F.lit(False)) & ~F.coalesce("recap", F.lit(False)))


@query("news_showable", with_views("articles", f", {STORED_SQL} SELECT key, symbol FROM sa WHERE {SHOWN}"))
def news_showable(spark, d):
    return shown(stored(spark, d)).select("key", "symbol")


@query("news_page", with_views("articles", f", {STORED_SQL}, pg AS (SELECT key, published_at, row_number() OVER (ORDER BY published_at DESC, key DESC) AS place FROM sa WHERE list_contains(symbols, 'A') AND {SHOWN} AND url LIKE 'http%' AND published_at >= TIMESTAMP '1995-01-01' AND (published_at < TIMESTAMP '1997-06-15 05:00:00' OR (published_at = TIMESTAMP '1997-06-15 05:00:00' AND key < 'k5'))) SELECT key, published_at, CAST(place AS INTEGER) AS place, place > 20 AS more FROM pg WHERE place <= 21"))
def news_page(spark, d):
    at = F.lit("1997-06-15 05:00:00").cast("timestamp_ntz")
    return C.news_page(stored(spark, d), "A", before=(at, "k5"), since=F.lit("1995-01-01").cast("timestamp_ntz")).select("key", "published_at", "place", "more")


ZONE = "America/New_York"


@query("month_counts", with_views("articles", f", {STORED_SQL} SELECT symbol, strftime(published_at AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m') AS month, count(*) AS articles FROM sa WHERE {SHOWN} GROUP BY ALL"))
def month_counts(spark, d):
    """Showable articles by the exchange's month, summer time included."""
    return shown(stored(spark, d)).groupBy("symbol", R.local_month(F.col("published_at"), ZONE).alias("month")).agg(F.count("*").alias("articles"))


@query("month_window", with_views("articles", f"""SELECT DISTINCT strftime(m, '%Y-%m') AS month, greatest(m AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC', TIMESTAMP '1995-03-10') AS start_utc, (m + INTERVAL 1 MONTH) AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC' AS end_utc
    FROM (SELECT date_trunc('month', published_at) AS m FROM articles) WHERE (m + INTERVAL 1 MONTH) AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC' > TIMESTAMP '1995-03-10' AND m AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC' <= TIMESTAMP '1998-02-10'"""))
def month_window(spark, d):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    months = V.articles(spark, d).select(F.date_format("published_at", "yyyy-MM").alias("month")).distinct()
    w = months.select("month", R.month_bounds(F.col("month"), ZONE, since=at("1995-03-10"), now=at("1998-02-10")).alias("w"))
    return w.where("w is not null").select("month", F.col("w.start").alias("start_utc"), F.col("w.end").alias("end_utc"))


@query("month_windows", with_views("articles", ", e AS (SELECT symbol, CAST(max(published_at) AS DATE) AS e FROM articles GROUP BY symbol) SELECT symbol, CAST(e - to_months(CAST(k AS INTEGER)) AS DATE) AS \"start\", CAST(e - to_months(CAST(k - 1 AS INTEGER)) AS DATE) AS \"end\" FROM e, range(1, 25) r(k)"))
def month_windows(spark, d):
    e = V.articles(spark, d).groupBy("symbol").agg(F.max("published_at").cast("date").alias("e"))
    return e.select("symbol", F.explode(U.month_windows(F.col("e"))).alias("w")).select("symbol", "w.start", "w.end")


@query("missing_months", with_views("articles", ", h AS (SELECT symbol, strftime(published_at, '%Y-%m') AS month, count(*) AS n FROM articles GROUP BY ALL), al AS (SELECT DISTINCT s.symbol, m.month FROM h s, (SELECT DISTINCT month FROM h) m) SELECT symbol, month FROM al WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = al.symbol AND h.month = al.month AND h.n % 2 = 0)"))
def missing_months(spark, d):
    """Months that a symbol has not done yet; done are those with an even number of articles."""
    h = V.articles(spark, d).groupBy("symbol", F.date_format("published_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    every = h.agg(F.array_sort(F.collect_set("month")).alias("months"))  # one row: the calendar's months
    windows = h.select("symbol").distinct().crossJoin(F.broadcast(every)).select("symbol", F.explode("months").alias("month"))
    return windows.join(h.where("n % 2 = 0"), ["symbol", "month"], "left_anti")


@query("news_groups", with_views("articles", f", {STORED_SQL} SELECT symbol, CAST(published_at AS DATE) AS day, count(*) AS members, round(avg(score), 8) AS score, CASE WHEN avg(score) > 0.3 THEN 'positive' WHEN avg(score) < -0.3 THEN 'negative' WHEN avg(score) IS NULL THEN 'not_scored' ELSE 'neutral' END AS label FROM sa WHERE {SHOWN} GROUP BY ALL"))
def news_groups(spark, d):
    g = shown(stored(spark, d)).groupBy("symbol", F.col("published_at").cast("date").alias("day")).agg(F.count("*").alias("members"), F.avg("score").alias("s"))
    return g.select("symbol", "day", "members", F.round("s", 8).alias("score"), F.coalesce(A.bucket_of(F.col("s")), F.lit("not_scored")).alias("label"))


@query("news_new_keys", with_views("articles", f", {STORED_SQL} SELECT 'k' || (2 * o_orderkey) AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM sa WHERE sa.key = 'k' || (2 * orders.o_orderkey))"))
def news_new_keys(spark, d):
    fetched = V.table(spark, d, "orders").select(F.concat(F.lit("k"), (2 * F.col("o_orderkey")).cast("string")).alias("key"))
    return fetched.join(stored(spark, d).select("key"), "key", "left_anti")


PRESETS = {
    "screen_movers": C.Preset("US", 20_000, 28_000, 20, "week_move", no_funds=True),
    "screen_value": C.Preset("US", 15_000, 40_000, 20, "pe", max_pe=15.0, no_funds=True),
    "screen_sg": C.Preset("SGX", 15_000, 60_000, 5, "traded_value"),
}
#: A part's weekly move is that of its shipments' prices.
MOVE_SQL = "mv AS (SELECT l_partkey, (arg_max(l_extendedprice, [CAST(epoch(l_shipdate) AS DOUBLE), l_orderkey, l_linenumber, l_suppkey, l_extendedprice]) / arg_min(l_extendedprice, [CAST(epoch(l_shipdate) AS DOUBLE), l_orderkey, l_linenumber, l_suppkey, l_extendedprice]) - 1) * 100 AS week_move FROM lineitem GROUP BY l_partkey)"


def _quotes(spark, d):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    move = V.table(spark, d, "lineitem").groupBy("l_partkey").agg(((F.max_by("l_extendedprice", order) / F.min_by("l_extendedprice", order) - 1) * 100).alias("week_move"))
    return V.quotes(spark, d).join(move, F.col("symbol") == F.col("l_partkey"), "left").drop("l_partkey")


def _screen(name, preset):
    key = {"pe": "CAST(pe_ratio AS DOUBLE)", "traded_value": "-(avg_volume_3m * price)", "week_move": "coalesce(-abs(week_move), 'inf'::DOUBLE)"}[preset.rank]
    more = (f" AND pe_ratio > 0 AND pe_ratio <= {preset.max_pe}" if preset.max_pe else "") + (" AND NOT regexp_matches(name, '(?i)\\b(fund|etf)\\b')" if preset.no_funds else "")
    sql = with_views("quotes", f", {MOVE_SQL}, q AS (SELECT *, row_number() OVER (ORDER BY {key}, symbol) AS place FROM quotes LEFT JOIN mv ON l_partkey = symbol WHERE exchange = '{preset.region}' AND market_cap BETWEEN {preset.min_cap} AND {preset.max_cap} AND avg_volume_3m >= {preset.min_volume}{more}) SELECT symbol, name, CAST(place AS INTEGER) AS place, round(price, 8) AS price, round(avg_volume_3m * price, 6) AS traded_value FROM q WHERE place <= 10")

    @query(name, sql)
    def run(spark, d, preset=preset):
        """A list of ten is the feature."""
        return C.screen(_quotes(spark, d), preset).select("symbol", "name", "place", F.round("price", 8).alias("price"), F.round(C.traded_value(), 6).alias("traded_value"))

    return run


screen_movers, screen_value, screen_sg = (_screen(*x) for x in PRESETS.items())


#: Names, industries and headcounts that tell funds from managers and trusts, by number.
_NAMED = ["Growth Fund", "Yield ETF", "Fundamental Corp", "Bank Trust", "Property Trust", "Hill", "Municipal Income", "Opportunities"]
_FILED = ["Asset Management", "Banks", "Asset Management", None]


@query("screen_fund_filter", f"""WITH q AS (SELECT p_partkey AS symbol, ({_NAMED})[1 + p_partkey % 8] AS kind, ([{", ".join("NULL" if x is None else f"'{x}'" for x in _FILED)}])[1 + p_size % 4] AS industry, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS employees FROM part)
    SELECT symbol, kind IN ('Growth Fund', 'Yield ETF') OR coalesce(industry = 'Asset Management' AND (employees IS NULL OR kind IN ('Bank Trust', 'Property Trust', 'Municipal Income', 'Opportunities')), FALSE) AS fund FROM q""")
def screen_fund_filter(spark, d):
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n + 1).cast("int"))
    name = F.concat_ws(" ", "p_name", pick(_NAMED, F.col("p_partkey") % 8))
    employees = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), C.is_fund(name, pick(_FILED, F.col("p_size") % 4), employees).alias("fund"))


@query("overview_rows", with_views("ticks bars watchers", """, r AS (SELECT symbol, close, lag(close, 5) OVER (PARTITION BY symbol ORDER BY session) AS c5, session, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS n FROM bars),
    w AS (SELECT owner_id, country, CASE owner_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'Z' END AS symbol FROM watchers)
    SELECT owner_id, w.symbol, country, round(close, 8) AS last_price, round((close / nullif(c5, 0) - 1) * 100, 8) AS change_1w_pct, CASE WHEN close IS NULL THEN 'unavailable' ELSE 'ok' END AS status FROM w LEFT JOIN r ON r.symbol = w.symbol AND n = 1"""))
def overview_rows(spark, d):
    """Watchlists with each symbol's last price and week; symbols without data stay, with a status."""
    w5 = Window.partitionBy("symbol").orderBy("session")
    b = V.bars_daily(spark, d).withColumn("c5", F.lag("close", 5).over(w5)).groupBy("symbol").agg(F.max_by(F.struct("close", "c5"), "session").alias("b"))
    k = F.col("owner_id") % 4
    w = V.watchers(spark, d).select("owner_id", "country", F.when(k == 0, "A").when(k == 1, "N").when(k == 2, "R").otherwise("Z").alias("symbol"))
    o = w.join(b, "symbol", "left")
    return o.select("owner_id", "symbol", "country", F.round("b.close", 8).alias("last_price"), F.round((F.try_divide("b.close", "b.c5") - 1) * 100, 8).alias("change_1w_pct"), F.when(F.col("b").isNull(), "unavailable").otherwise("ok").alias("status"))


@query("table_sort", with_views("quotes", "SELECT symbol, row_number() OVER (ORDER BY pe_ratio DESC NULLS LAST, symbol) AS place FROM quotes"))
def table_sort(spark, d):
    """Places in the order of P/E, highest first, unknown last: a range sort, then each partition's offset from its counts."""
    return C.with_places(C.table_sort(V.quotes(spark, d).withColumn("id", F.col("symbol")), "pe_ratio", descending=True).select("symbol"))


@query("country_options", with_views("watchers", "SELECT country, count(DISTINCT owner_id) AS owners, lower(country) AS sort_key FROM watchers GROUP BY country"))
def country_options(spark, d):
    return V.watchers(spark, d).dropDuplicates(["owner_id"]).groupBy("country").agg(F.count("*").alias("owners")).select("country", "owners", F.lower("country").alias("sort_key"))


@query("sentiment_scale", with_views(M.VIEWS, f", {M.DAILY_SQL}, wk AS (SELECT symbol, session + CAST((12 - dayofweek(session)) % 7 AS INTEGER) AS week_end, sum(mean_score * article_count) / sum(article_count) AS m FROM ds GROUP BY ALL) SELECT symbol, round(quantile_cont(abs(m), 0.95), 8) AS scale FROM wk GROUP BY symbol"))
def sentiment_scale(spark, d):
    w = A.weekly_timeline(A.daily_sentiment(A.asof_session(V.articles(spark, d), V.sessions(spark, d))))
    return w.groupBy("symbol").agg(F.round(F.percentile(F.abs("mean_score"), 0.95), 8).alias("scale"))


@query("status_combine", """WITH st AS (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'stale' ELSE 'ok' END AS state, CASE o_orderkey % 5 WHEN 0 THEN 'down' WHEN 1 THEN 'old' END AS reason, o_orderdate AS as_of FROM orders)
    SELECT o_custkey, CASE WHEN bool_and(state = 'unavailable') THEN 'unavailable' WHEN bool_or(state = 'unavailable') THEN 'partial' WHEN bool_or(state = 'stale') THEN 'stale' ELSE 'ok' END AS state, min(as_of) AS as_of, string_agg(DISTINCT reason, ' ' ORDER BY reason) AS reason FROM st GROUP BY o_custkey""")
def status_combine(spark, d):
    k = F.col("o_orderkey") % 5
    s = V.table(spark, d, "orders").select("o_custkey", F.when(k == 0, "unavailable").when(k == 1, "stale").otherwise("ok").alias("state"), F.when(k == 0, "down").when(k == 1, "old").alias("reason"), F.col("o_orderdate").alias("as_of"))
    return C.status_combine(s, ["o_custkey"])


@query("search_symbols", "SELECT symbol, name FROM (SELECT p_partkey AS symbol, p_name AS name, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_name LIKE 'red%' AND p_brand IS NOT NULL) WHERE n <= 8")
def search_symbols(spark, d):
    """The first eight matches are the feature."""
    return V.table(spark, d, "part").where(F.col("p_name").startswith("red") & F.col("p_brand").isNotNull()).orderBy("p_partkey").limit(8).select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"))


@query("quote_change", with_views("ticks bars", ", r AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY session) AS before, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS n FROM bars) SELECT symbol, round(close, 8) AS price, round(before, 8) AS previous_close, round((close / nullif(before, 0) - 1) * 100, 8) AS change_pct FROM r WHERE n = 1"))
def quote_change(spark, d):
    b = V.bars_daily(spark, d).withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("session"))).groupBy("symbol").agg(F.max_by(F.struct("close", "before"), "session").alias("b"))
    return b.select("symbol", F.round("b.close", 8).alias("price"), F.round("b.before", 8).alias("previous_close"), F.round((F.try_divide("b.close", "b.before") - 1) * 100, 8).alias("change_pct"))


@query("profile_clean", "SELECT s_suppkey, nullif(trim(CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE ' ' || s_name || ' ' END), '') AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 END AS dividend FROM supplier")
def profile_clean(spark, d):
    """Text trimmed or null; NaN and negative percentages are null, the rest become fractions."""
    raw = F.when(F.col("s_suppkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))
    pct = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan")))
    return V.table(spark, d, "supplier").select("s_suppkey", F.nullif(F.trim(raw), F.lit("")).alias("name"), F.when(~F.isnan(pct), pct / 100).alias("dividend"))


CORPORATE_SQL = """ce AS (SELECT symbol, event_date AS date, kind, 'Earnings' AS label, CAST(NULL AS DOUBLE) AS value FROM corp UNION ALL
    SELECT l_returnflag, CAST(l_shipdate AS DATE), 'dividend', 'Dividend ' || printf('%.2f', max(l_tax)), max(l_tax) FROM lineitem WHERE l_quantity = 50 GROUP BY ALL UNION ALL
    SELECT l_returnflag, CAST(l_shipdate AS DATE), 'split', 'Split', CAST(2 AS DOUBLE) FROM lineitem WHERE l_quantity = 49 AND l_discount >= 0.1 GROUP BY ALL)"""


def _corporate(spark, d):
    li = V.table(spark, d, "lineitem")
    day = [F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")]
    earn = V.earnings(spark, d).select("symbol", F.col("event_date").alias("date"), "kind", F.lit("Earnings").alias("label"), F.lit(None).cast("double").alias("value"))
    paid = li.where("l_quantity = 50").groupBy(*day).agg(F.max("l_tax").alias("value")).select("symbol", "date", F.lit("dividend").alias("kind"), F.format_string("Dividend %.2f", "value").alias("label"), "value")
    split = li.where("l_quantity = 49 and l_discount >= 0.1").groupBy(*day).agg(F.lit(2.0).alias("value")).select("symbol", "date", F.lit("split").alias("kind"), F.lit("Split").alias("label"), "value")
    return earn.unionByName(paid).unionByName(split)


@query("union_events", with_views("articles corp", f", {CORPORATE_SQL} SELECT kind, count(*) AS n, min(date) AS first, max(date) AS last FROM ce GROUP BY kind"))
def union_events(spark, d):
    return _corporate(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("corporate_events", with_views("articles corp", f", {CORPORATE_SQL} SELECT * FROM ce WHERE date BETWEEN DATE '1995-03-01' AND DATE '1997-12-31'"))
def corporate_events(spark, d):
    return _corporate(spark, d).where(F.col("date").between(F.lit("1995-03-01").cast("date"), F.lit("1997-12-31").cast("date")))


@query("props_json", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def props_json(spark, d):
    e = V.table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


MARKERS_SQL = f"{PATTERN_SQL}, mk AS (SELECT symbol, session, 'pattern' AS kind, key AS what FROM hits WHERE bias <> 'neutral' UNION ALL SELECT symbol, event_date, 'earnings', kind FROM corp)"


def _markers(spark, d):
    hits = P.detect(P.prepare(V.bars_daily(spark, d))).where("bias <> 'neutral'").select("symbol", "session", F.lit("pattern").alias("kind"), F.col("key").alias("what"))
    return hits.unionByName(V.earnings(spark, d).select("symbol", F.col("event_date").alias("session"), F.lit("earnings").alias("kind"), F.col("kind").alias("what")))


@query("chart_markers", with_views(M.VIEWS, f", {MARKERS_SQL} SELECT m.symbol, m.session, m.kind, what, round(b.high, 8) AS at FROM mk m JOIN bars b ON b.symbol = m.symbol AND b.session = m.session"))
def chart_markers(spark, d):
    """Markers on bars; those of days without a bar are not drawn."""
    b = V.bars_daily(spark, d).select("symbol", "session", F.round("high", 8).alias("at"))
    return _markers(spark, d).join(b, ["symbol", "session"]).select("symbol", "session", "kind", "what", "at")


@query("marker_counts", with_views(M.VIEWS, f", {MARKERS_SQL}, vf AS (SELECT symbol, max(session) - 730 AS since FROM bars GROUP BY symbol), kd AS (SELECT symbol, since, unnest(['pattern', 'earnings', 'news']) AS kind FROM vf) SELECT kd.symbol, kd.kind, count(mk.session) AS n FROM kd LEFT JOIN mk ON mk.symbol = kd.symbol AND mk.kind = kd.kind AND mk.session >= since GROUP BY ALL"))
def marker_counts(spark, d):
    """Markers by kind over the last two years of bars; kinds without one count 0."""
    since = V.bars_daily(spark, d).groupBy("symbol").agg(F.date_sub(F.max("session"), 730).alias("since"))
    seen = _markers(spark, d).join(since, "symbol").where(F.col("session") >= F.col("since")).groupBy("symbol", "kind").agg(F.count("*").alias("n"))
    kinds = since.select("symbol", F.explode(F.array(*map(F.lit, ("pattern", "earnings", "news")))).alias("kind"))
    return kinds.join(seen, ["symbol", "kind"], "left").select("symbol", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("marker_size", with_views(M.VIEWS, f", {M.EVENTS_SQL} SELECT symbol, session, CASE WHEN abs(car_0_1) >= 0.03 THEN 3 WHEN abs(car_0_1) >= 0.01 THEN 2 WHEN car_0_1 IS NOT NULL THEN 1 END AS size FROM ev", recursive=True))
def marker_size(spark, d):
    return M._events(spark, d).select("symbol", "session", C.marker_size(F.col("car_0_1")).alias("size"))


@query("softmax", "SELECT l_orderkey, l_linenumber, l_partkey, round(exp(l_discount - m) / t, 8) AS p0, round(exp(l_tax - m) / t, 8) AS p1, round(exp(0.05 - m) / t, 8) AS p2 FROM (SELECT *, greatest(l_discount, l_tax, 0.05) AS m, exp(l_discount - greatest(l_discount, l_tax, 0.05)) + exp(l_tax - greatest(l_discount, l_tax, 0.05)) + exp(0.05 - greatest(l_discount, l_tax, 0.05)) AS t FROM lineitem)")
def softmax(spark, d):
    p = V.table(spark, d, "lineitem").withColumn("p", C.softmax(F.array("l_discount", "l_tax", F.lit(0.05))))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col("p")[i], 8).alias(f"p{i}") for i in range(3)])
