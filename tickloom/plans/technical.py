"""Queries of the technical analysis."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.series import by_symbol, rounded, wilson
from tickloom.operators import indicators as I
from tickloom.operators import scan as N
from tickloom.operators import patterns as P
from tickloom.plans.registry import query
from tickloom.sources import views as V
from tickloom.sources.views import with_views


def fold_sql(name: str, source: str, x: str, n: int, alpha: str) -> str:
    """A CTE (symbol, pos, y): exponential smoothing of x, seeded with the mean of its first n values."""
    return f"""{name} AS (SELECT symbol, p0 + unnest(range({n} - 1, len(xs))) AS pos, unnest(list_reduce(list_transform(xs[{n + 1}:], lambda v: [v]), lambda acc, v: list_append(acc, acc[-1] + {alpha} * (v[1] - acc[-1])), [list_avg(xs[1:{n}])])) AS y
        FROM (SELECT symbol, min(pos) AS p0, list({x} ORDER BY pos) AS xs FROM {source} WHERE {x} IS NOT NULL GROUP BY symbol) WHERE len(xs) >= {n})"""


BARS = "ticks bars"
SMA_SQL = lambda n, x="close": f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY session ROWS {n - 1} PRECEDING) = {n} THEN avg({x}) OVER (PARTITION BY symbol ORDER BY session ROWS {n - 1} PRECEDING) END"
W = "(PARTITION BY symbol ORDER BY session)"


@query("scan_bars", with_views(BARS, "SELECT symbol, session, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM bars WHERE session BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"))
def scan_bars(spark, d):
    """Bars of an inclusive date range; the filter is on the grouping key and reaches the scan."""
    b = V.bars_daily(spark, d).where(F.col("session").between(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date")))
    return b.select("symbol", "session", *rounded(["open", "high", "low", "close"], 8), "volume")


@query("bars_frame", with_views(BARS, "SELECT symbol, session, round(open, 8) AS open, round(close, 8) AS close, pos FROM bars"))
def bars_frame(spark, d):
    """Bars with all prices there, numbered by symbol."""
    b = I.check_bars(V.bars_daily(spark, d)).withColumn("pos", (F.row_number().over(by_symbol()) - 1).cast("long"))
    return b.select("symbol", "session", *rounded(["open", "close"], 8), "pos")


@query("sma", with_views(BARS, f"SELECT symbol, session, round({SMA_SQL(20)}, 8) AS sma20 FROM bars"))
def sma(spark, d):
    return I.with_sma(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["sma20"], 8))


@query("bollinger", with_views(BARS, f""", b AS (SELECT symbol, session, {SMA_SQL(20)} AS m, stddev_pop(close) OVER (PARTITION BY symbol ORDER BY session ROWS 19 PRECEDING) AS s FROM bars)
    SELECT symbol, session, round(m, 8) AS middle, round(m + 2 * s, 8) AS upper, round(m - 2 * s, 8) AS lower FROM b"""))
def bollinger(spark, d):
    return I.with_bollinger(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["middle", "upper", "lower"], 8))


@query("returns", with_views(BARS, f"SELECT symbol, session, round(close / lag(close) OVER {W} - 1, 8) AS ret FROM bars"))
def returns(spark, d):
    return V.bars_daily(spark, d).select("symbol", "session", F.round(F.col("close") / F.lag("close").over(by_symbol()) - 1, 8).alias("ret"))


@query("forward_return", with_views(BARS, f"SELECT symbol, session, round(lead(close, 5) OVER {W} / lead(open, 1) OVER {W} - 1, 8) AS forward_return FROM bars"))
def forward_return(spark, d):
    return I.with_forward_return(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["forward_return"], 8))


@query("week_change", with_views(BARS, f"SELECT symbol, session, round((close / nullif(lag(close, 5) OVER {W}, 0) - 1) * 100, 8) AS change_1w_pct FROM bars"))
def week_change(spark, d):
    c = (F.try_divide(F.col("close"), F.lag("close", 5).over(by_symbol())) - 1) * 100
    return V.bars_daily(spark, d).select("symbol", "session", F.round(c, 8).alias("change_1w_pct"))


@query("session_vwap", with_views("hourly", """SELECT symbol, ts, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 8) AS vwap FROM hourly
    WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)"""))
def session_vwap(spark, d):
    return I.with_session_vwap(V.bars_hourly(spark, d)).select("symbol", "ts", *rounded(["vwap"], 8))


@query("anchored_vwap", with_views(BARS, """SELECT symbol, session, CASE WHEN session >= DATE '1995-06-01' THEN round(sum(CASE WHEN session >= DATE '1995-06-01' THEN (high + low + close) / 3 * volume END) OVER w
    / nullif(sum(CASE WHEN session >= DATE '1995-06-01' THEN volume END) OVER w, 0), 8) END AS vwap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING)"""))
def anchored_vwap(spark, d):
    return I.with_anchored_vwap(V.bars_daily(spark, d), F.lit("1995-06-01").cast("date")).select("symbol", "session", *rounded(["vwap"], 8))


TREND_SQL = f"""sm AS (SELECT *, {SMA_SQL(10)} AS s10 FROM bars), tr AS (SELECT *, lag(s10, 6) OVER {W} AS s6, lag(s10) OVER {W} AS s1, lag(close) OVER {W} AS c1 FROM sm),
    trend AS (SELECT *, CASE WHEN s6 IS NULL THEN NULL WHEN c1 > s1 AND s1 > s6 THEN 'up' WHEN c1 < s1 AND s1 < s6 THEN 'down' ELSE 'none' END AS trend FROM tr)"""


@query("trend_context", with_views(BARS, f", {TREND_SQL} SELECT symbol, session, trend FROM trend"))
def trend_context(spark, d):
    return I.with_trend(V.bars_daily(spark, d)).select("symbol", "session", "trend")


@query("bar_change", with_views(BARS, f", c AS (SELECT symbol, session, close, coalesce(lag(close) OVER {W}, open) AS base FROM bars) SELECT symbol, session, round(close - base, 8) AS change, round((close / nullif(base, 0) - 1) * 100, 8) AS change_pct FROM c"))
def bar_change(spark, d):
    base = F.coalesce(F.lag("close").over(by_symbol()), F.col("open"))
    b = V.bars_daily(spark, d).withColumn("base", base)
    return b.select("symbol", "session", F.round(F.col("close") - F.col("base"), 8).alias("change"), F.round((F.try_divide("close", "base") - 1) * 100, 8).alias("change_pct"))


@query("period_change", with_views(BARS, "SELECT symbol, round(arg_max(close, session) / arg_min(open, session) - 1, 8) AS change FROM bars GROUP BY symbol"))
def period_change(spark, d):
    return V.bars_daily(spark, d).groupBy("symbol").agg(F.round(F.max_by("close", "session") / F.min_by("open", "session") - 1, 8).alias("change"))


@query("sparkline", with_views(BARS, ", r AS (SELECT symbol, session, close, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS n FROM bars) SELECT symbol, array_to_string(list(CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR) ORDER BY session), ',') AS closes FROM r WHERE n <= 20 GROUP BY symbol"))
def sparkline(spark, d):
    """Last 20 closes; the row-number filter is a top-k of each symbol that Spark applies before the exchange too."""
    r = V.bars_daily(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))).where("n <= 20")
    last = F.sort_array(F.collect_list(F.struct("session", F.round(F.col("close") * 100).cast("long").alias("c"))))
    return r.groupBy("symbol").agg(F.array_join(F.transform(last, lambda x: x["c"].cast("string")), ",").alias("closes"))


@query("visible_from", with_views(BARS, ", r AS (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS n, max(session) OVER (PARTITION BY symbol) AS last FROM bars) SELECT symbol, min(CASE WHEN n <= 5 THEN session END) AS week, min(CASE WHEN n <= 22 THEN session END) AS month, min(CASE WHEN session >= last - INTERVAL 365 DAY THEN session END) AS year FROM r GROUP BY symbol"))
def visible_from(spark, d):
    """First visible session of the ranges 1W and 1M (sessions) and 1Y (calendar days)."""
    b = V.bars_daily(spark, d).select("symbol", "session")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session")))
    last = b.groupBy("symbol").agg(F.max("session").alias("last"))
    r = b.withColumn("n", n).join(last, "symbol")
    return r.groupBy("symbol").agg(F.min(F.when(F.col("n") <= 5, F.col("session"))).alias("week"), F.min(F.when(F.col("n") <= 22, F.col("session"))).alias("month"), F.min(F.when(F.col("session") >= F.date_sub("last", 365), F.col("session"))).alias("year"))


@query("ema", with_views(BARS, f", {fold_sql('f', 'bars', 'close', 9, '0.2')}, {fold_sql('s', 'bars', 'close', 21, '(2.0 / 22)')} SELECT b.symbol, b.session, round(f.y, 8) AS ema9, round(s.y, 8) AS ema21 FROM bars b LEFT JOIN f USING (symbol, pos) LEFT JOIN s USING (symbol, pos)"))
def ema(spark, d):
    return N.with_recursive(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["ema9", "ema21"], 8))


RSI_SQL = f"""dl AS (SELECT symbol, pos, greatest(close - lag(close) OVER {W}, 0) AS g, greatest(lag(close) OVER {W} - close, 0) AS l FROM bars), dz AS (SELECT symbol, pos, CASE WHEN pos > 0 THEN g END AS g, CASE WHEN pos > 0 THEN l END AS l FROM dl),
    {fold_sql("gs", "dz", "g", 14, "(1.0 / 14)")}, {fold_sql("ls", "dz", "l", 14, "(1.0 / 14)")}, rsi AS (SELECT gs.symbol, gs.pos, CASE WHEN ls.y = 0 THEN CASE WHEN gs.y = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + gs.y / ls.y) END AS rsi FROM gs JOIN ls USING (symbol, pos))"""
MACD_SQL = f"""{fold_sql("m12", "bars", "close", 12, "(2.0 / 13)")}, {fold_sql("m26", "bars", "close", 26, "(2.0 / 27)")}, ml AS (SELECT symbol, pos, m12.y - m26.y AS line FROM m12 JOIN m26 USING (symbol, pos)), {fold_sql("ms", "ml", "line", 9, "0.2")}"""
ATR_SQL = f"""tru AS (SELECT symbol, pos, greatest(high - low, coalesce(abs(high - lag(close) OVER {W}), 0), coalesce(abs(low - lag(close) OVER {W}), 0)) AS tr FROM bars), {fold_sql("ar", "tru", "tr", 14, "(1.0 / 14)")}"""


@query("rsi", with_views(BARS, f", {RSI_SQL} SELECT b.symbol, b.session, round(rsi, 8) AS rsi14 FROM bars b LEFT JOIN rsi USING (symbol, pos)"))
def rsi(spark, d):
    return N.with_recursive(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["rsi14"], 8))


@query("macd", with_views(BARS, f", {MACD_SQL} SELECT b.symbol, b.session, round(ml.line, 8) AS macd, round(ms.y, 8) AS signal, round(ml.line - ms.y, 8) AS histogram FROM bars b LEFT JOIN ml USING (symbol, pos) LEFT JOIN ms USING (symbol, pos)"))
def macd(spark, d):
    return N.with_recursive(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["macd", "signal", "histogram"], 8))


@query("atr", with_views(BARS, f", {ATR_SQL} SELECT b.symbol, b.session, round(ar.y, 8) AS atr14 FROM bars b LEFT JOIN ar USING (symbol, pos)"))
def atr(spark, d):
    return N.with_recursive(V.bars_daily(spark, d)).select("symbol", "session", *rounded(["atr14"], 8))


@query("extend_indicators", with_views(BARS, f", {MACD_SQL}, {RSI_SQL}, {ATR_SQL} SELECT b.symbol, b.session, round(rsi, 8) AS rsi14, round(ms.y, 8) AS signal, round(ar.y, 8) AS atr14 FROM bars b LEFT JOIN rsi USING (symbol, pos) LEFT JOIN ms USING (symbol, pos) LEFT JOIN ar USING (symbol, pos) WHERE b.session > DATE '1996-12-31'"))
def extend_indicators(spark, d):
    """Bars since 1997 in two batches, from the state of those before: the same values as over the whole history."""
    b = V.bars_daily(spark, d)
    day = lambda x: F.lit(x).cast("date")
    state = N.state(b.where(F.col("session") <= day("1996-12-31")))
    one, state = N.extend(state, b.where(F.col("session") <= day("1997-06-30")))
    two, _ = N.extend(state, b)
    return one.unionByName(two).select("symbol", "session", *rounded(["rsi14", "signal", "atr14"], 8))


@query("ema_cross", with_views(BARS, f""", {fold_sql('f', 'bars', 'close', 9, '0.2')}, {fold_sql('s', 'bars', 'close', 21, '(2.0 / 22)')}, c AS (SELECT symbol, pos, CASE WHEN abs(f.y - s.y) <= 1e-9 * greatest(abs(s.y), 1) THEN 0 WHEN f.y > s.y THEN 1 ELSE -1 END AS side FROM f JOIN s USING (symbol, pos)),
    x AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY symbol ORDER BY pos) <> side THEN 1 ELSE 0 END AS ch FROM c), y AS (SELECT *, max(ch) OVER (PARTITION BY symbol ORDER BY pos ROWS 2 PRECEDING) = 1 AS fresh FROM x)
    SELECT b.symbol, b.session, y.side AS ema_side, coalesce(y.fresh, FALSE) AS fresh_cross FROM bars b LEFT JOIN y USING (symbol, pos)"""))
def ema_cross(spark, d):
    return I.with_ema_cross(N.with_recursive(V.bars_daily(spark, d))).select("symbol", "session", "ema_side", "fresh_cross")


@query("expected_range", with_views(BARS, f", {ATR_SQL}, r AS (SELECT b.*, ar.y AS a, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS n FROM bars b LEFT JOIN ar USING (symbol, pos)) SELECT symbol, round(close - a * sqrt(5), 8) AS low, round(close + a * sqrt(5), 8) AS high FROM r WHERE n = 1"))
def expected_range(spark, d):
    last = N.with_recursive(V.bars_daily(spark, d)).groupBy("symbol").agg(F.max_by(F.struct("close", "atr14"), "session").alias("b"))
    spread = F.col("b.atr14") * 5**0.5
    return last.select("symbol", F.round(F.col("b.close") - spread, 8).alias("low"), F.round(F.col("b.close") + spread, 8).alias("high"))


def _pattern_sql() -> str:
    """Hits from the rules' definitions over lagged columns: c0 is the last candle."""
    lags = ", ".join(f"lag({c}, {k}) OVER {W} AS {c[0]}{k}" for k in (1, 2) for c in ("open", "high", "low", "close"))
    parts = ", ".join(f"abs(c{k} - o{k}) AS b{k}, h{k} - l{k} AS r{k}, h{k} - greatest(o{k}, c{k}) AS u{k}, least(o{k}, c{k}) - l{k} AS d{k}, (o{k} + c{k}) / 2 AS m{k}" for k in (0, 1, 2))
    long_ = lambda k, a: f"b{k} >= 0.5 * a{a}"
    hammer, inverted = "b0 > 0.1 * r0 AND d0 >= 2 * b0 AND u0 <= 0.1 * r0", "b0 > 0.1 * r0 AND u0 >= 2 * b0 AND d0 <= 0.1 * r0"
    rules = {
        "doji": "r0 > 0 AND b0 <= 0.1 * r0 AND r0 >= 0.3 * a1",
        "hammer": f"t0 = 'down' AND {hammer}",
        "hanging_man": f"t0 = 'up' AND {hammer}",
        "inverted_hammer": f"t0 = 'down' AND {inverted}",
        "shooting_star": f"t0 = 'up' AND {inverted}",
        "bullish_engulfing": "t1 = 'down' AND c1 < o1 AND c0 > o0 AND o0 <= c1 AND c0 >= o1 AND b0 > b1 AND b0 >= 0.3 * a2",
        "bearish_engulfing": "t1 = 'up' AND c1 > o1 AND c0 < o0 AND o0 >= c1 AND c0 <= o1 AND b0 > b1 AND b0 >= 0.3 * a2",
        "bullish_harami": f"t1 = 'down' AND c1 < o1 AND {long_(1, 2)} AND c0 > o0 AND c0 <= o1 AND o0 >= c1 AND b0 < b1",
        "bearish_harami": f"t1 = 'up' AND c1 > o1 AND {long_(1, 2)} AND c0 < o0 AND o0 <= c1 AND c0 >= o1 AND b0 < b1",
        "piercing_line": f"t1 = 'down' AND c1 < o1 AND {long_(1, 2)} AND c0 > o0 AND o0 <= c1 AND m1 < c0 AND c0 < o1",
        "dark_cloud_cover": f"t1 = 'up' AND c1 > o1 AND {long_(1, 2)} AND c0 < o0 AND o0 >= c1 AND o1 < c0 AND c0 < m1",
        "morning_star": f"t2 = 'down' AND c2 < o2 AND {long_(2, 3)} AND b1 <= 0.3 * b2 AND m1 < c2 AND c0 > o0 AND c0 > m2",
        "evening_star": f"t2 = 'up' AND c2 > o2 AND {long_(2, 3)} AND b1 <= 0.3 * b2 AND m1 > c2 AND c0 < o0 AND c0 < m2",
        "three_white_soldiers": "t2 IN ('down', 'none') AND " + " AND ".join(f"c{k} > o{k} AND {long_(k, 3)} AND u{k} <= 0.3 * b{k}" for k in (0, 1, 2)) + " AND c1 > c2 AND o1 BETWEEN o2 AND c2 AND c0 > c1 AND o0 BETWEEN o1 AND c1",
        "three_black_crows": "t2 IN ('up', 'none') AND " + " AND ".join(f"c{k} < o{k} AND {long_(k, 3)} AND d{k} <= 0.3 * b{k}" for k in (0, 1, 2)) + " AND c1 < c2 AND o1 BETWEEN c2 AND o2 AND c0 < c1 AND o0 BETWEEN c1 AND o1",
    }
    hits = " UNION ALL ".join(f"SELECT symbol, session, pos, '{k}' AS key, '{b}' AS bias, {n} AS candles, fr FROM cd WHERE {rules[k]}" for k, b, n, _ in P.SPECS)
    return f"""{TREND_SQL}, {ATR_SQL}, la AS (SELECT t.symbol, t.session, t.pos, open AS o0, high AS h0, low AS l0, close AS c0, {lags}, trend AS t0, lag(trend) OVER {W} AS t1, lag(trend, 2) OVER {W} AS t2,
        lag(ar.y) OVER {W} AS a1, lag(ar.y, 2) OVER {W} AS a2, lag(ar.y, 3) OVER {W} AS a3, lead(close, 5) OVER {W} / lead(open) OVER {W} - 1 AS fr FROM trend t LEFT JOIN ar USING (symbol, pos)),
        cd AS (SELECT *, {parts} FROM la), hits AS ({hits})"""


PATTERN_SQL = _pattern_sql()
STATS_SQL = f"""{PATTERN_SQL}, hl AS (SELECT symbol, key, list(pos ORDER BY pos) AS ps FROM hits WHERE fr IS NOT NULL GROUP BY symbol, key),
    kp AS (SELECT symbol, key, unnest(list_reduce(list_transform(ps[2:], lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[-1] >= 5 THEN list_append(acc, v[1]) ELSE acc END, [ps[1]])) AS pos FROM hl),
    cn AS (SELECT k.symbol, k.key, count(*) AS n, count(*) FILTER (fr > 0) AS up, count(*) FILTER (fr < 0) AS dn, avg(fr) AS mean, median(fr) AS med FROM kp k JOIN hits h ON k.symbol = h.symbol AND k.key = h.key AND k.pos = h.pos GROUP BY k.symbol, k.key),
    need(key, trend) AS (VALUES {", ".join(f"('{k}', '{t}')" for k, _, _, need in P.SPECS if need for t in need)}), sp(key, bias) AS (VALUES {", ".join(f"('{k}', '{b}')" for k, b, _, _ in P.SPECS)}),
    br AS (SELECT symbol, s.key, avg(CASE WHEN fr > 0 THEN 1.0 ELSE 0 END) AS bu, avg(CASE WHEN fr < 0 THEN 1.0 ELSE 0 END) AS bd, count(*) AS bn FROM cd, sp s WHERE fr IS NOT NULL AND (s.key = 'doji' OR EXISTS (SELECT 1 FROM need x WHERE x.key = s.key AND x.trend = cd.t0)) GROUP BY symbol, s.key),
    st AS (SELECT d.symbol, d.key, d.bias, coalesce(n, 0) AS n, coalesce(up, 0) AS up, CASE d.bias WHEN 'bullish' THEN coalesce(up, 0) WHEN 'bearish' THEN coalesce(dn, 0) END AS ok, mean, med, bu, bd, bn FROM (SELECT DISTINCT symbol, key, bias FROM hits) d LEFT JOIN cn USING (symbol, key) LEFT JOIN br USING (symbol, key)),
    st2 AS (SELECT *, CASE bias WHEN 'bullish' THEN bu WHEN 'bearish' THEN bd END AS base, CASE WHEN n > 0 THEN ok / n END AS hit FROM st),
    st3 AS (SELECT *, (hit + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(hit * (1 - hit) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS wl, (hit + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(hit * (1 - hit) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS wh FROM st2)"""


def _patterns(name, sizes):
    @query(name, with_views(BARS, f", {PATTERN_SQL} SELECT symbol, session, key, bias FROM hits WHERE candles IN ({', '.join(map(str, sizes))})"))
    def run(spark, d, sizes=tuple(sizes)):
        return P.detect(P.prepare(V.bars_daily(spark, d)), sizes).select("symbol", "session", "key", "bias")

    return run


patterns_1, patterns_2, patterns_3, detect_patterns = (_patterns(*x) for x in (("patterns_1", [1]), ("patterns_2", [2]), ("patterns_3", [3]), ("detect_patterns", [1, 2, 3])))


@query("wilson", """SELECT l_linenumber, n, k, round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 8) AS low,
    round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 8) AS high
    FROM (SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY l_linenumber)""")
def wilson_query(spark, d):
    g = V.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("l_linenumber", "n", "k", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("base_rates", with_views(BARS, f", {STATS_SQL} SELECT symbol, key, round(bu, 8) AS base_up, round(bd, 8) AS base_down, bn AS base_n FROM br"))
def base_rates(spark, d):
    return P.base_rates(P.prepare(V.bars_daily(spark, d))).select("symbol", "key", *rounded(["base_up", "base_down"], 8), "base_n")


@query("pattern_reliability", with_views(BARS, f", {STATS_SQL} SELECT symbol, key, bias, n, up AS up_count, ok AS success_count, round(hit, 8) AS hit_rate, round(CASE WHEN n > 0 AND ok IS NOT NULL THEN greatest(0, wl) END, 8) AS wilson_low, round(CASE WHEN n > 0 AND ok IS NOT NULL THEN least(1, wh) END, 8) AS wilson_high, round(mean, 8) AS mean_return, round(med, 8) AS median_return, round(base, 8) AS base_rate, round(hit - base, 8) AS edge, bn AS base_n, n >= 15 AS sufficient FROM st3"))
def pattern_reliability(spark, d):
    p, hits = P.analysed(V.bars_daily(spark, d))
    s = P.reliability(p, hits)
    return s.select("symbol", "key", "bias", "n", "up_count", "success_count", *rounded(["hit_rate", "wilson_low", "wilson_high", "mean_return", "median_return", "base_rate", "edge"], 8), "base_n", "sufficient")


@query("recent_patterns", with_views(BARS, f", {STATS_SQL}, lp AS (SELECT symbol, max(pos) AS lp FROM bars GROUP BY symbol) SELECT h.symbol, h.session, h.key, lp - pos AS sessions_ago, st3.n, round(hit - base, 8) AS edge FROM hits h JOIN lp ON lp.symbol = h.symbol LEFT JOIN st3 ON st3.symbol = h.symbol AND st3.key = h.key WHERE lp - pos < 3"))
def recent_patterns(spark, d):
    p, hits = P.analysed(V.bars_daily(spark, d))
    return P.recent(p, hits, P.reliability(p, hits)).select("symbol", "session", "key", "sessions_ago", "n", *rounded(["edge"], 8))


_RATE = lambda c: f"CAST(CAST(round_even({c} * 100, 0) AS INTEGER) AS VARCHAR) || '%'"


@query("pattern_sentence", with_views(BARS, f""", {STATS_SQL} SELECT symbol, key, upper(substr(key, 1, 1)) || replace(substr(key, 2), '_', ' ') AS label, CASE WHEN n < 15 THEN 'Seen ' || n || CASE WHEN n = 1 THEN ' time' ELSE ' times' END || ', too few to judge (fewer than 15)' WHEN bias = 'neutral' THEN 'Seen ' || n || ' times; it points neither way'
    ELSE 'Closed ' || CASE bias WHEN 'bullish' THEN 'higher' ELSE 'lower' END || ' a week later in ' || {_RATE('hit')} || ' of ' || n || ' cases, against ' || coalesce({_RATE('base')}, 'an unknown share') || ' of comparable days' END AS sentence FROM st3"""))
def pattern_sentence(spark, d):
    p, hits = P.analysed(V.bars_daily(spark, d))
    return P.reliability(p, hits).select("symbol", "key", P.label(F.col("key")).alias("label"), P.sentence().alias("sentence"))


OUTLOOK_SQL = f"""{STATS_SQL}, {RSI_SQL}, {MACD_SQL}, {fold_sql('e9', 'bars', 'close', 9, '0.2')}, {fold_sql('e21', 'bars', 'close', 21, '(2.0 / 22)')}, lp AS (SELECT symbol, max(pos) AS lp FROM bars GROUP BY symbol),
    pm AS (SELECT h.symbol, avg(least((hit - base) / 0.2, 1) * CASE st3.bias WHEN 'bullish' THEN 1 ELSE -1 END) AS mean FROM hits h JOIN lp ON lp.symbol = h.symbol JOIN st3 ON st3.symbol = h.symbol AND st3.key = h.key WHERE lp - pos < 3 AND n >= 15 AND base IS NOT NULL AND wl > base AND st3.bias <> 'neutral' GROUP BY h.symbol),
    vw AS (SELECT b.symbol, sum((high + low + close) / 3 * volume) / sum(volume) AS v FROM bars b JOIN lp ON lp.symbol = b.symbol AND b.pos >= lp - 4 GROUP BY b.symbol),
    sg AS (SELECT b.symbol, b.session, b.close, ar.y AS a, coalesce(pm.mean, 0) AS mean, CASE WHEN rsi > 70 THEN -1 WHEN rsi < 30 THEN 1 WHEN rsi IS NOT NULL THEN 0 END AS r, sign(e9.y - e21.y) AS e, sign(b.close - vw.v) AS v, sign((ml.line - ms.y) - (ml2.line - ms2.y)) AS m
        FROM bars b JOIN lp ON lp.symbol = b.symbol AND lp.lp = b.pos LEFT JOIN pm ON pm.symbol = b.symbol LEFT JOIN vw ON vw.symbol = b.symbol LEFT JOIN rsi ON rsi.symbol = b.symbol AND rsi.pos = b.pos LEFT JOIN ar ON ar.symbol = b.symbol AND ar.pos = b.pos
        LEFT JOIN e9 ON e9.symbol = b.symbol AND e9.pos = b.pos LEFT JOIN e21 ON e21.symbol = b.symbol AND e21.pos = b.pos LEFT JOIN ml ON ml.symbol = b.symbol AND ml.pos = b.pos LEFT JOIN ms ON ms.symbol = b.symbol AND ms.pos = b.pos
        LEFT JOIN ml ml2 ON ml2.symbol = b.symbol AND ml2.pos = b.pos - 1 LEFT JOIN ms ms2 ON ms2.symbol = b.symbol AND ms2.pos = b.pos - 1),
    sc AS (SELECT *, (mean + coalesce(0.75 * r, 0) + coalesce(0.75 * e, 0) + coalesce(0.5 * v, 0) + coalesce(0.5 * m, 0)) / nullif(abs(mean) + CASE WHEN r IS NULL THEN 0 ELSE 0.75 END + CASE WHEN e IS NULL THEN 0 ELSE 0.75 END + CASE WHEN v IS NULL THEN 0 ELSE 0.5 END + CASE WHEN m IS NULL THEN 0 ELSE 0.5 END, 0) AS s FROM sg)
    SELECT symbol, session AS as_of, round(close, 8) AS last_close, CASE WHEN coalesce(s, 0) >= 0.25 THEN 'bullish' WHEN coalesce(s, 0) <= -0.25 THEN 'bearish' ELSE 'neutral' END AS lean, round(coalesce(s, 0), 8) AS score, round(close - a * sqrt(5), 8) AS range_low, round(close + a * sqrt(5), 8) AS range_high FROM sc"""


@query("outlook", with_views(BARS, f", {OUTLOOK_SQL}"))
def outlook(spark, d):
    p, hits = P.analysed(V.bars_daily(spark, d))
    o = P.outlook(p, P.recent(p, hits, P.reliability(p, hits)))
    return o.select("symbol", "as_of", *rounded(["last_close"], 8), "lean", *rounded(["score"], 8), *rounded(["range_low", "range_high"], 8))


@query("technical_signals", with_views(BARS, f""", {OUTLOOK_SQL.rsplit("SELECT symbol, session AS as_of", 1)[0]} , x AS (SELECT symbol, unnest([{{'key': 'patterns', 'direction': sign(mean), 'weight': abs(mean)}}, {{'key': 'rsi14', 'direction': CAST(r AS DOUBLE), 'weight': 0.75}}, {{'key': 'ema_cross', 'direction': CAST(e AS DOUBLE), 'weight': 0.75}}, {{'key': 'vwap', 'direction': CAST(v AS DOUBLE), 'weight': 0.5}}, {{'key': 'macd_momentum', 'direction': CAST(m AS DOUBLE), 'weight': 0.5}}]) AS s FROM sc)
    SELECT symbol, s.key AS key, CAST(s.direction AS INTEGER) AS direction, round(s.weight, 8) AS weight FROM x WHERE s.direction IS NOT NULL"""))
def technical_signals(spark, d):
    """The signals of every symbol's outlook, one a row."""
    r = P.technical_report(V.bars_daily(spark, d))
    return r.select("symbol", F.explode("signals").alias("s")).select("symbol", "s.key", "s.direction", F.round("s.weight", 8).alias("weight"))


@query("technical_report", with_views(BARS, f", {OUTLOOK_SQL}".replace("SELECT symbol, session AS as_of, round(close, 8) AS last_close,", "SELECT symbol, session AS as_of, round(close, 8) AS last_close, 0.9 AS expected_range_coverage, CAST((SELECT count(*) FROM hits h JOIN lp ON lp.symbol = h.symbol WHERE h.symbol = sc.symbol AND lp - pos < 3) AS INTEGER) AS n_recent,")))
def technical_report(spark, d):
    """The flagship: every symbol's report in one plan."""
    r = P.technical_report(V.bars_daily(spark, d))
    return r.select("symbol", "as_of", *rounded(["last_close"], 8), "expected_range_coverage", F.coalesce(F.array_size("recent_patterns"), F.lit(0)).alias("n_recent"), "lean", *rounded(["score"], 8), *rounded(["range_low", "range_high"], 8))


CHART_SQL = f", s AS (SELECT symbol, session, {SMA_SQL(20)} AS sma20 FROM bars), e AS (SELECT * FROM s) SELECT symbol, strftime(session, '%Y-%m-%d') AS time, 'sma20' AS series, round(sma20, 8) AS value FROM e WHERE sma20 IS NOT NULL UNION ALL SELECT symbol, strftime(session, '%Y-%m-%d'), 'close', round(close, 8) FROM bars"


@query("chart_points", with_views(BARS, CHART_SQL))
def chart_points(spark, d):
    """Indicator lines as (time, series, value), NULLs dropped."""
    b = I.with_sma(V.bars_daily(spark, d)).select("symbol", F.date_format("session", "yyyy-MM-dd").alias("time"), "sma20", "close")
    return b.unpivot(["symbol", "time"], ["sma20", "close"], "series", "value").where("value is not null").select("symbol", "time", "series", F.round("value", 8).alias("value"))
