"""Queries of stored news as it is read, of coverage and of lists that outlive a failed build."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import reading as R
from tickloom.plans import feed
from tickloom.plans.registry import query
from tickloom.sources import views as V
from tickloom.sources.views import with_views


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


@query("scored_articles", with_views("articles", f", {feed.STORED_SQL} SELECT key, symbol, round(score, 8) AS score FROM sa WHERE score IS NOT NULL AND NOT coalesce(low_value, FALSE) AND published_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-06-30'"))
def scored_articles(spark, d):
    s = R.scored(feed.stored(spark, d), start=_at("1995-01-01"), end=_at("1997-06-30"))
    return s.select("key", "symbol", F.round("score", 8).alias("score"))


def _texts(spark, d):
    """Stored articles with a title and, two times out of three, a summary."""
    k = F.col("o_orderkey")
    return feed.stored(spark, d).withColumns({"title": F.concat(F.lit("Title "), (k % 97).cast("string")), "summary": F.when(k % 3 != 0, F.concat(F.lit("gains "), (k % 5).cast("string"))), "model_version": F.when(F.col("score").isNotNull(), "v1")})


TEXT_SQL = "tx AS (SELECT *, trim('Title ' || (o_orderkey % 97) || '. ' || CASE WHEN o_orderkey % 3 <> 0 THEN 'gains ' || (o_orderkey % 5) ELSE '' END) AS text FROM sa)"


@query("unscored_articles", with_views("articles", f", {feed.STORED_SQL}, {TEXT_SQL} SELECT key, text FROM tx WHERE score IS NULL"))
def unscored_articles(spark, d):
    return R.unscored(_texts(spark, d))


@query("save_scores", with_views("articles", f", {feed.STORED_SQL}, {TEXT_SQL} SELECT key, round(coalesce(score, length(text) / 100.0), 8) AS score, CASE WHEN score IS NULL THEN 'v2' ELSE 'v1' END AS model_version FROM tx"))
def save_scores(spark, d):
    """Unscored articles get a caller's score - here the text's length - and an older version of it, which loses."""
    a = _texts(spark, d)
    new, old = R.score_with(R.unscored(a), lambda t: F.length(t) / 100, "v2"), R.score_with(R.unscored(a), lambda t: F.length(t) * 0.0, "v0")
    return R.save_scores(a, new.unionByName(old)).select("key", F.round("score", 8).alias("score"), "model_version")


@query("cursor_codec", with_views("articles", f""", {feed.STORED_SQL}, c AS (SELECT key, published_at + INTERVAL 10 YEAR AS t FROM sa)
    SELECT key, replace(replace(rtrim(base64(encode('{{"t":"' || strftime(t, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","k":"' || key || '"}}')), '='), '+', '-'), '/', '_') AS "cursor",
        CASE WHEN t <= TIMESTAMP '2005-01-02' THEN t END AS back, CASE WHEN t <= TIMESTAMP '2005-01-02' THEN key END AS back_key FROM c"""))
def cursor_codec(spark, d):
    """Positions there and back; those over a day in the future are refused."""
    a = feed.stored(spark, d).select("key", R.encode_cursor(F.col("published_at") + F.expr("INTERVAL 10 YEARS"), F.col("key")).alias("cursor"))
    back = a.withColumn("b", R.decode_cursor(F.col("cursor"), now=_at("2005-01-01")))
    return back.select("key", "cursor", F.col("b.published_at").alias("back"), F.col("b.key").alias("back_key"))


@query("page_groups", with_views("articles", f""", {feed.STORED_SQL}, r AS (SELECT symbol, strftime(published_at, '%Y-%m') AS month, 'h' || (day(published_at) % 5) AS head, o_orderkey, key, published_at, score FROM sa WHERE {feed.SHOWN}),
    m AS (SELECT *, row_number() OVER (PARTITION BY symbol, month, head ORDER BY published_at DESC, key DESC) AS n, avg(score) OVER (PARTITION BY symbol, month, head) AS mean FROM r),
    t AS (SELECT symbol, month, head, published_at AS mp, key AS mk, 1 AS told, 'k' || (o_orderkey + 1) AS dup, published_at - INTERVAL 1 DAY AS pt FROM r WHERE o_orderkey % 3 = 0
        UNION ALL SELECT symbol, month, head, published_at, key, 1, 'd' || (o_orderkey % 50), published_at - INTERVAL 2 DAY FROM r WHERE o_orderkey % 3 = 0),
    e AS (SELECT symbol, month, head, published_at AS mp, key AS mk, 0 AS told, key AS dup, published_at AS pt FROM r
        UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symbol = t.symbol AND r.month = t.month AND r.key = t.dup)),
    o AS (SELECT *, row_number() OVER (PARTITION BY symbol, month, head, dup ORDER BY told, mp DESC, mk DESC, pt DESC) AS n FROM e)
    SELECT m.symbol, m.month, m.head, m.key, round(any_value(m.mean), 12) AS score, CASE WHEN any_value(m.mean) > 0.3 THEN 'positive' WHEN any_value(m.mean) < -0.3 THEN 'negative' WHEN any_value(m.mean) IS NULL THEN 'not_scored' ELSE 'neutral' END AS label,
        coalesce(string_agg(o.dup, ',' ORDER BY o.pt DESC, o.dup DESC), '') AS similar
    FROM m LEFT JOIN o ON o.symbol = m.symbol AND o.month = m.month AND o.head = m.head AND o.n = 1 AND o.dup <> m.key WHERE m.n = 1 GROUP BY m.symbol, m.month, m.head, m.key"""))
def page_groups(spark, d):
    """A symbol's month as a page, five groups on it; every third article has two look-alikes on record."""
    k, at = F.col("o_orderkey"), F.col("published_at")
    other = lambda days, key: F.struct((at - F.make_dt_interval(days=F.lit(days))).alias("published_at"), key.alias("dup_key"), F.lit("x").alias("title"))
    similar = F.when(k % 3 == 0, F.array(other(1, F.concat(F.lit("k"), (k + 1).cast("string"))), other(2, F.concat(F.lit("d"), (k % 50).cast("string")))))
    rows = feed.shown(feed.stored(spark, d)).select("symbol", F.date_format("published_at", "yyyy-MM").alias("month"), F.concat(F.lit("h"), (F.dayofmonth("published_at") % 5).cast("string")).alias("head"), "key", "published_at", F.col("key").alias("title"), "score", similar.alias("similar"))
    g = R.group_page(rows, ["symbol", "month"])
    return g.select("symbol", "month", "head", "key", F.round("score", 12).alias("score"), "label", F.array_join(F.transform("similar", lambda x: x["dup_key"]), ",").alias("similar"))


@query("retro_fold", """WITH dup AS (SELECT o_custkey % 300 AS c, 'd' || o_orderkey AS dup, o_orderdate AS pt FROM orders), hd AS (SELECT c, max(pt) AS pt FROM dup GROUP BY c),
    mv AS (SELECT c, CASE WHEN c % 3 = 1 AND c - 1 IN (SELECT c FROM hd) THEN c - 1 ELSE c END AS h FROM hd),
    al AS (SELECT h, dup, pt FROM dup JOIN mv USING (c) UNION ALL SELECT h, 'h' || c, pt FROM mv JOIN hd USING (c) WHERE h <> c),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY pt DESC, dup) AS n, count(*) OVER (PARTITION BY h) AS k FROM al)
    SELECT 'h' || h AS key, string_agg(dup, ',' ORDER BY n) AS similar, CAST(max(k) AS INTEGER) AS similar_count FROM r WHERE n <= 10 GROUP BY h""")
def retro_fold(spark, d):
    """Every third head turns out to repeat the one before it."""
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    o = V.table(spark, d, "orders").select((F.col("o_custkey") % 300).alias("c"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("dup_key"), F.col("o_orderdate").alias("published_at"))
    newest = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("published_at"), "dup_key"))
    g = o.withColumn("n", newest).groupBy("c").agg(F.max("published_at").alias("published_at"), F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.struct("n", "published_at", "dup_key")))).alias("top"), F.array_sort(F.collect_set("dup_key")).alias("similar_keys"))
    similar = F.transform("top", lambda x: F.struct(x["published_at"].alias("published_at"), x["dup_key"].alias("dup_key"), F.lit("x").alias("title")))
    heads = g.select(name(F.col("c")).alias("key"), "published_at", F.lit("x").alias("title"), similar.alias("similar"), "similar_keys", F.size("similar_keys").alias("similar_count"))
    first = g.select((F.col("c") + 1).alias("c"))
    moves = g.where("c % 3 = 1").join(first, "c", "left_semi").select(name(F.col("c")).alias("key"), name(F.col("c") - 1).alias("head"))
    return R.fold_into(heads, moves).select("key", F.array_join(F.transform("similar", lambda x: x["dup_key"]), ",").alias("similar"), "similar_count")


@query("coverage_state", "SELECT l_partkey, min(l_shipdate) AS covered_start, max(CASE WHEN l_linenumber <> 4 THEN l_shipdate END) AS last_bar_at, max(l_shipdate) AS last_fetched_at FROM lineitem GROUP BY l_partkey")
def coverage_state(spark, d):
    """State of earlier fetches, and a batch of fetches of which some brought no bars."""
    bar = F.when(F.col("l_linenumber") != 4, F.col("l_shipdate"))
    li = V.table(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.col("l_shipdate").alias("covered_start"), bar.alias("last_bar_at"), F.col("l_shipdate").alias("last_fetched_at"))
    return R.widen_coverage(li.where("l_linenumber <= 3").drop("l_linenumber"), li.where("l_linenumber > 3"), ["l_partkey"])


@query("keep_stale", """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS failed, s_suppkey % 4 = 0 AS nothing, TIMESTAMP '2024-06-30' - INTERVAL 1 DAY * (s_suppkey % 20) AS was FROM supplier)
    SELECT id, CASE WHEN NOT failed THEN 'new' WHEN NOT nothing AND was >= TIMESTAMP '2024-06-23' THEN 'old' ELSE '' END AS list, CASE WHEN NOT failed AND id % 5 <> 0 THEN 'ok' WHEN NOT failed OR NOT nothing AND was >= TIMESTAMP '2024-06-23' THEN 'stale' ELSE 'unavailable' END AS state,
        CASE WHEN NOT failed THEN TIMESTAMP '2024-06-30' WHEN NOT nothing AND was >= TIMESTAMP '2024-06-23' THEN was END AS as_of FROM s""")
def keep_stale(spark, d):
    """Lists of which every third build failed; old ones are up to 20 days old, some of them empty."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    k, now = F.col("id"), _at("2024-06-30")
    built = s.select("id", F.when(k % 3 != 0, F.array(F.lit("new"))).alias("rows"), (k % 5 != 0).alias("complete"))
    old = s.select("id", F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("old"))).alias("rows"), (now - F.make_dt_interval(days=(k % 20).cast("int"))).alias("as_of"))
    return R.keep_stale(built, old, now=now, keep_days=7).select("id", F.array_join("rows", ",").alias("list"), "state", "as_of")


@query("sparkline_rows", with_views("ticks bars watchers", """, l AS (SELECT symbol, string_agg(printf('%.6f', close), ',' ORDER BY session) AS sparkline, max(session) AS as_of FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS n FROM bars) WHERE n <= 20 GROUP BY symbol)
    SELECT owner_id, w.symbol, segment AS sector, sparkline, as_of, CASE WHEN as_of IS NULL THEN 'No price history.' END AS reason FROM (SELECT *, CASE owner_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'Z' END AS symbol FROM watchers) w LEFT JOIN l ON l.symbol = w.symbol"""))
def sparkline_rows(spark, d):
    """Overview rows: the last 20 closes, oldest first, the sector, and why a row has none.  One small row a symbol is joined."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    last = V.bars_daily(spark, d).withColumn("n", newest).where("n <= 20").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("session", "close"))).alias("b"), F.max("session").alias("as_of"))
    k = F.col("owner_id") % 4
    w = V.watchers(spark, d).select("owner_id", F.col("segment").alias("sector"), F.when(k == 0, "A").when(k == 1, "N").when(k == 2, "R").otherwise("Z").alias("symbol"))
    line = F.when(F.col("b").isNotNull(), F.array_join(F.transform("b", lambda x: F.format_string("%.6f", x["close"])), ","))
    return w.join(last, "symbol", "left").select("owner_id", "symbol", "sector", line.alias("sparkline"), "as_of", F.when(F.col("as_of").isNull(), "No price history.").alias("reason"))
