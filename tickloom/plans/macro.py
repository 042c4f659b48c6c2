"""Queries of the news event study."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.series import rounded
from tickloom.functions.storage import stored
from tickloom.operators import alignment as A
from tickloom.operators import event_study as E
from tickloom.operators import statistics as S
from tickloom.plans.registry import query
from tickloom.sources import views as V
from tickloom.sources.views import with_views

W = "(PARTITION BY symbol ORDER BY session)"
VIEWS = "ticks bars bench sessions articles corp"
DAILY_SQL = """aligned AS (SELECT a.article_id, a.symbol, a.published_at, a.score, s.session FROM articles a ASOF LEFT JOIN sessions s ON a.published_at < s.close_utc),
    ds AS (SELECT symbol, session, avg(score) AS mean_score, count(*) AS article_count, max(abs(score)) AS max_abs_score FROM aligned WHERE session IS NOT NULL GROUP BY symbol, session)"""
RETURNS_SQL = f"""j0 AS (SELECT b.symbol, b.session, b.close, m.close AS bench FROM bars b JOIN bench m ON m.session = b.session),
    j AS (SELECT *, row_number() OVER {W} - 1 AS pos, close / lag(close) OVER {W} - 1 AS rs, bench / lag(bench) OVER {W} - 1 AS rm FROM j0)"""
EARN_SQL = "ee AS (SELECT c.symbol, c.event_date, min(j.session) AS session FROM corp c JOIN j ON j.symbol = c.symbol AND j.session >= c.event_date GROUP BY c.symbol, c.event_date)"
MARK_SQL = f"""fl AS (SELECT j.*, CASE WHEN e.session IS NULL THEN 0 ELSE 1 END AS f FROM j LEFT JOIN (SELECT DISTINCT symbol, session FROM ee) e ON e.symbol = j.symbol AND e.session = j.session),
    mk AS (SELECT *, max(f) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS masked, max(f) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1 AS near FROM fl)"""
_EST = "OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 250 PRECEDING AND 20 PRECEDING)"
MODEL_SQL = f"""mi AS (SELECT *, CASE WHEN NOT masked THEN rs END AS y, CASE WHEN NOT masked THEN rm END AS x FROM mk),
    mo AS (SELECT *, regr_count(y, x) {_EST} AS n, regr_slope(y, x) {_EST} AS b0, regr_intercept(y, x) {_EST} AS a0 FROM mi),
    mm AS (SELECT *, CASE WHEN n >= 60 THEN b0 END AS beta, CASE WHEN n >= 60 THEN a0 END AS alpha FROM mo)"""


def _car_sql() -> str:
    """Abnormal returns of the neighbouring sessions, one by one, with the event's own coefficients."""
    parts = []
    for name, (a, b) in E.CAR_WINDOWS.items():
        at = lambda c, k: f"{'lead' if k >= 0 else 'lag'}({c}, {abs(k)}) OVER {W}"
        parts.append(" + ".join(f"({at('rs', k)} - (alpha + beta * {at('rm', k)}))" for k in range(a, b + 1)) + f" AS {name}")
    return f"ca AS (SELECT *, {', '.join(parts)} FROM mm)"


PICK_SQL = """np AS (SELECT d.symbol, d.session, d.mean_score, d.article_count, j.pos, abs(d.mean_score) * ln(1 + d.article_count) AS sal FROM ds d JOIN j ON j.symbol = d.symbol AND j.session = d.session),
    bw AS (SELECT a.symbol, a.pos, arg_max(b.pos, [b.sal, -b.pos]) AS best FROM np a JOIN np b ON b.symbol = a.symbol AND b.pos BETWEEN a.pos AND a.pos + 5 GROUP BY a.symbol, a.pos),
    nx AS (SELECT w.symbol, w.pos, w.best, (SELECT min(n.pos) FROM np n WHERE n.symbol = w.symbol AND n.pos > w.best + 5) AS following FROM bw w),
    ch AS (SELECT symbol, min(pos) AS pos FROM np GROUP BY symbol UNION ALL SELECT ch.symbol, nx.following FROM ch JOIN nx ON nx.symbol = ch.symbol AND nx.pos = ch.pos WHERE nx.following IS NOT NULL),
    pk AS (SELECT np.* FROM ch JOIN nx ON nx.symbol = ch.symbol AND nx.pos = ch.pos JOIN np ON np.symbol = nx.symbol AND np.pos = nx.best)"""
EVENTS_SQL = f"""{DAILY_SQL}, {RETURNS_SQL}, {EARN_SQL}, {MARK_SQL}, {MODEL_SQL}, {_car_sql()}, {PICK_SQL},
    ev AS (SELECT p.symbol, p.session, p.mean_score AS sentiment, p.article_count, c.alpha, c.beta, c.car_0_0, c.car_0_1, c.car_0_5, c.car_pre_5, c.near AS near_earnings, CASE WHEN c.alpha IS NULL THEN 'insufficient_estimation' ELSE 'ok' END AS status
        FROM pk p JOIN ca c ON c.symbol = p.symbol AND c.session = p.session)"""
SCOPED_SQL = f"""{EVENTS_SQL}, us AS (SELECT *, CASE WHEN sentiment > 0.3 THEN 'positive' WHEN sentiment < -0.3 THEN 'negative' ELSE 'neutral' END AS bucket FROM ev WHERE status = 'ok' AND car_0_1 IS NOT NULL),
    sc AS (SELECT *, 'all' AS scope FROM us UNION ALL SELECT *, 'ex' FROM us WHERE NOT near_earnings),
    bf AS (SELECT DISTINCT symbol, scope, unnest(['positive', 'neutral', 'negative']) AS bucket FROM sc),
    bg AS (SELECT symbol, scope, bucket, count(*) AS n, avg(car_0_1) AS m1, median(car_0_1) AS md1, count(car_0_5) AS n5, avg(car_0_5) AS m5, median(car_0_5) AS md5, count(car_pre_5) AS np5, avg(car_pre_5) AS mp5, stddev_samp(car_0_1) AS sd, var_samp(car_0_1) AS va FROM sc GROUP BY symbol, scope, bucket),
    bs AS (SELECT f.symbol, f.scope, f.bucket, coalesce(n, 0) AS n, m1, md1, coalesce(n5, 0) AS n5, m5, md5, coalesce(np5, 0) AS np5, mp5, sd, va FROM bf f LEFT JOIN bg g ON g.symbol = f.symbol AND g.scope = f.scope AND g.bucket = f.bucket),
    wt AS (SELECT p.symbol, p.scope, p.m1 - q.m1 AS diff, (p.m1 - q.m1) / sqrt(p.va / p.n + q.va / q.n) AS t, (p.va / p.n + q.va / q.n) * (p.va / p.n + q.va / q.n) / ((p.va / p.n) * (p.va / p.n) / (p.n - 1) + (q.va / q.n) * (q.va / q.n) / (q.n - 1)) AS df, p.n AS n_pos, q.n AS n_neg
        FROM bs p JOIN bs q ON q.symbol = p.symbol AND q.scope = p.scope AND p.bucket = 'positive' AND q.bucket = 'negative' WHERE p.n >= 10 AND q.n >= 10)"""


def p_sql(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided Student p by Simpson's rule over the density's angle form: an independent way to the same number."""
    f = f"power(cos(i * atan(abs({t}) / sqrt({df})) / {steps}), {df} - 1)"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {f} * CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) * atan(abs({t}) / sqrt({df})) / {steps} / 3"
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {area})"


def label_sql(p: str) -> str:
    return f"CASE WHEN greatest(1, round_even({p} * 100, 0)) < 5 THEN 'clear_effect' WHEN greatest(1, round_even({p} * 100, 0)) < 20 THEN 'possible_effect' ELSE 'no_clear_effect' END"


TESTS_SQL = f"""{SCOPED_SQL}, b1 AS (SELECT *, m1 / (sd / sqrt(n)) AS t, n - 1.0 AS df FROM bs WHERE n >= 10), b2 AS (SELECT *, {p_sql("t", "df")} AS p FROM b1), w2 AS (SELECT *, {p_sql("t", "df")} AS p FROM wt)"""


def _daily(spark, d):
    return A.daily_sentiment(A.asof_session(V.articles(spark, d), V.sessions(spark, d)))


def _events(spark, d):
    return E.event_study(V.bars_daily(spark, d), V.bench_daily(spark, d), _daily(spark, d), V.earnings(spark, d))


def _study(spark, d):
    """Daily sentiment and events, each made once and stored: what reads them several times scans nothing again."""
    daily = stored(_daily(spark, d))
    return daily, stored(E.event_study(V.bars_daily(spark, d), V.bench_daily(spark, d), daily, V.earnings(spark, d)))


def _as_of(spark, d):
    """The test tables' bars go on for years after the last article, so a symbol's report is as of its last news."""
    return _daily(spark, d).groupBy("symbol").agg(F.max("session").alias("as_of"))


@query("sessions_dim", with_views("ticks bench sessions", "SELECT session, close_utc, pos FROM sessions"))
def sessions_dim(spark, d):
    return V.sessions(spark, d)


@query("asof_session", with_views(VIEWS, f", {DAILY_SQL} SELECT article_id, symbol, session FROM aligned"))
def asof_session(spark, d):
    return A.asof_session(V.articles(spark, d), V.sessions(spark, d)).select("article_id", "symbol", "session")


@query("asof_earnings", with_views(VIEWS, f", {RETURNS_SQL}, {EARN_SQL} SELECT symbol, event_date, session FROM ee"))
def asof_earnings(spark, d):
    return A.sessions_on_or_after(V.earnings(spark, d).select("symbol", "event_date"), V.bars_daily(spark, d)).select("symbol", "event_date", "session")


@query("earnings_mask", with_views(VIEWS, f", {RETURNS_SQL}, {EARN_SQL}, {MARK_SQL} SELECT symbol, session, masked FROM mk"))
def earnings_mask(spark, d):
    return E.mark_earnings(E.join_returns(V.bars_daily(spark, d), V.bench_daily(spark, d)), V.earnings(spark, d)).select("symbol", "session", "masked")


@query("near_earnings", with_views(VIEWS, f", {RETURNS_SQL}, {EARN_SQL}, {MARK_SQL} SELECT symbol, session FROM mk WHERE near"))
def near_earnings(spark, d):
    return E.mark_earnings(E.join_returns(V.bars_daily(spark, d), V.bench_daily(spark, d)), V.earnings(spark, d)).where("near_earnings").select("symbol", "session")


@query("semi_sessions", with_views(VIEWS, f", {DAILY_SQL} SELECT symbol, session, article_count FROM ds WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = ds.symbol AND b.session = ds.session)"))
def semi_sessions(spark, d):
    return _daily(spark, d).join(V.bars_daily(spark, d).select("symbol", "session"), ["symbol", "session"], "left_semi").select("symbol", "session", "article_count")


@query("daily_sentiment", with_views(VIEWS, f", {DAILY_SQL} SELECT symbol, session, round(mean_score, 8) AS mean_score, article_count, round(max_abs_score, 8) AS max_abs_score FROM ds"))
def daily_sentiment(spark, d):
    return _daily(spark, d).select("symbol", "session", *rounded(["mean_score"], 8), "article_count", *rounded(["max_abs_score"], 8))


@query("bucket_of", with_views(VIEWS, f", {DAILY_SQL} SELECT symbol, CASE WHEN mean_score > 0.3 THEN 'positive' WHEN mean_score < -0.3 THEN 'negative' ELSE 'neutral' END AS bucket, count(*) AS sessions FROM ds GROUP BY ALL"))
def bucket_of(spark, d):
    return _daily(spark, d).groupBy("symbol", A.bucket_of(F.col("mean_score")).alias("bucket")).agg(F.count("*").alias("sessions"))


@query("weekly_timeline", with_views(VIEWS, f", {DAILY_SQL} SELECT symbol, session + CAST((12 - dayofweek(session)) % 7 AS INTEGER) AS week_end, round(sum(mean_score * article_count) / sum(article_count), 8) AS mean_score, CAST(sum(article_count) AS BIGINT) AS article_count FROM ds GROUP BY ALL"))
def weekly_timeline(spark, d):
    return A.weekly_timeline(_daily(spark, d)).select("symbol", "week_end", *rounded(["mean_score"], 8), "article_count")


BLOCKS_SQL = f"{DAILY_SQL}, ao AS (SELECT symbol, max(session) AS as_of FROM ds GROUP BY symbol), bl AS (SELECT symbol, CAST(floor((as_of - session) / 30) AS INTEGER) AS block, sum(mean_score * article_count) / sum(article_count) AS mean, CAST(sum(article_count) AS BIGINT) AS articles FROM ds JOIN ao USING (symbol) WHERE session <= as_of GROUP BY ALL)"
REGIME_SQL = f"""{BLOCKS_SQL}, rg0 AS (SELECT symbol, max(CASE WHEN block = 0 THEN mean END) AS recent_mean, avg(CASE WHEN block > 0 THEN mean END) AS baseline_mean, stddev_samp(CASE WHEN block > 0 THEN mean END) AS sd, count(*) FILTER (block > 0) AS nb, max(CASE WHEN block = 0 THEN articles END) AS recent_articles FROM bl GROUP BY symbol),
    rg AS (SELECT *, (recent_mean - baseline_mean) / sd AS z FROM rg0 WHERE nb >= 8 AND sd > 1e-12 AND recent_mean IS NOT NULL)"""


@query("regime_blocks", with_views(VIEWS, f", {BLOCKS_SQL} SELECT symbol, block, round(mean, 8) AS mean, articles FROM bl"))
def regime_blocks(spark, d):
    return A.regime_blocks(_daily(spark, d), _as_of(spark, d)).select("symbol", "block", *rounded(["mean"], 8), "articles")


@query("sentiment_regime", with_views(VIEWS, f", {REGIME_SQL} SELECT symbol, round(recent_mean, 8) AS recent_mean, round(baseline_mean, 8) AS baseline_mean, round(z, 8) AS z, recent_articles, CASE WHEN z >= 1 THEN 'more_positive_than_usual' WHEN z <= -1 THEN 'more_negative_than_usual' ELSE 'typical' END AS label FROM rg"))
def sentiment_regime(spark, d):
    return A.sentiment_regime(_daily(spark, d), _as_of(spark, d)).select("symbol", *rounded(["recent_mean", "baseline_mean", "z"], 8), "recent_articles", "label")


@query("join_stock_bench", with_views(VIEWS, f", {RETURNS_SQL} SELECT symbol, session, pos, round(rs, 8) AS r_s, round(rm, 8) AS r_m FROM j"))
def join_stock_bench(spark, d):
    return E.join_returns(V.bars_daily(spark, d), V.bench_daily(spark, d)).select("symbol", "session", "pos", *rounded(["r_s", "r_m"], 8))


@query("select_events", with_views(VIEWS, f", {DAILY_SQL}, {RETURNS_SQL}, {PICK_SQL} SELECT symbol, session, round(mean_score, 8) AS sentiment, article_count FROM pk", recursive=True))
def select_events(spark, d):
    e = E.select_events(_daily(spark, d), E.join_returns(V.bars_daily(spark, d), V.bench_daily(spark, d)))
    return e.select("symbol", "session", *rounded(["sentiment"], 8), "article_count")


@query("market_model", with_views(VIEWS, f", {RETURNS_SQL}, {EARN_SQL}, {MARK_SQL}, {MODEL_SQL} SELECT symbol, session, round(alpha, 8) AS alpha, round(beta, 7) AS beta FROM mm"))
def market_model(spark, d):
    m = E.market_model(E.mark_earnings(E.join_returns(V.bars_daily(spark, d), V.bench_daily(spark, d)), V.earnings(spark, d)))
    return m.select("symbol", "session", F.round("alpha", 8).alias("alpha"), F.round("beta", 7).alias("beta"))


@query("event_cars", with_views(VIEWS, f", {EVENTS_SQL} SELECT symbol, session, round(car_0_0, 8) AS car_0_0, round(car_0_1, 8) AS car_0_1, round(car_0_5, 8) AS car_0_5, round(car_pre_5, 8) AS car_pre_5, near_earnings, status FROM ev", recursive=True))
def event_cars(spark, d):
    return _events(spark, d).select("symbol", "session", *rounded(list(E.CAR_WINDOWS), 8), "near_earnings", "status")


@query("event_scope", with_views(VIEWS, f", {SCOPED_SQL} SELECT symbol, scope, bucket, count(*) AS n, min(session) AS first_event, max(session) AS last_event FROM sc GROUP BY ALL", recursive=True))
def event_scope(spark, d):
    return S.scoped(_events(spark, d)).groupBy("symbol", "scope", "bucket").agg(F.count("*").alias("n"), F.min("session").alias("first_event"), F.max("session").alias("last_event"))


@query("event_counts", with_views(VIEWS, f", {EVENTS_SQL} SELECT symbol, count(*) AS total, count(*) FILTER (status <> 'ok') AS insufficient FROM ev GROUP BY symbol", recursive=True))
def event_counts(spark, d):
    return _events(spark, d).groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "ok").alias("insufficient"))


@query("bucket_stats", with_views(VIEWS, f", {SCOPED_SQL} SELECT symbol, scope, bucket, n, round(m1, 8) AS mean_car_0_1, round(md1, 8) AS median_car_0_1, n5 AS n_car_0_5, round(m5, 8) AS mean_car_0_5, round(md5, 8) AS median_car_0_5, np5 AS n_car_pre_5, round(mp5, 8) AS mean_car_pre_5 FROM bs", recursive=True))
def bucket_stats(spark, d):
    s = S.bucket_stats(S.scoped(_events(spark, d)))
    return s.select("symbol", "scope", "bucket", "n", *rounded(["mean_car_0_1", "median_car_0_1"], 8), "n_car_0_5", *rounded(["mean_car_0_5", "median_car_0_5"], 8), "n_car_pre_5", *rounded(["mean_car_pre_5"], 8))


@query("bucket_ttest", with_views(VIEWS, f", {TESTS_SQL} SELECT symbol, scope, bucket, n, round(t, 6) AS t, round(p, 6) AS p_value, {label_sql('p')} AS label FROM b2", recursive=True))
def bucket_ttest(spark, d):
    s = S.with_bucket_test(S.bucket_stats(S.scoped(_events(spark, d)))).where("t is not null")
    return s.select("symbol", "scope", "bucket", "n", *rounded(["t", "p_value"]), "label")


@query("welch_test", with_views(VIEWS, f", {TESTS_SQL} SELECT symbol, scope, round(diff, 8) AS mean_diff, round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p_value, {label_sql('p')} AS label, n_pos, n_neg FROM w2", recursive=True))
def welch_test(spark, d):
    w = S.welch(S.bucket_stats(S.scoped(_events(spark, d))))
    return w.select("symbol", "scope", *rounded(["mean_diff"], 8), *rounded(["t", "df", "p_value"]), "label", "n_pos", "n_neg")


SPEARMAN_SQL = f"""{SCOPED_SQL}, rk AS (SELECT symbol, scope, rank() OVER (PARTITION BY symbol, scope ORDER BY sentiment) + (count(*) OVER (PARTITION BY symbol, scope, sentiment) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol, scope ORDER BY car_0_1) + (count(*) OVER (PARTITION BY symbol, scope, car_0_1) - 1) / 2 AS b FROM sc),
    rc AS (SELECT symbol, scope, corr(a, b) AS rho, count(*) AS n, count(*) - 2.0 AS df FROM rk GROUP BY symbol, scope HAVING count(*) >= 10), rt AS (SELECT *, rho * sqrt(df / (1 - rho * rho)) AS t FROM rc), rp AS (SELECT *, {p_sql("t", "df")} AS p FROM rt)"""


@query("spearman", with_views(VIEWS, f", {SPEARMAN_SQL} SELECT symbol, scope, round(rho, 8) AS rho, round(t, 6) AS t, round(p, 6) AS p_value, n, CASE WHEN p < 0.05 THEN 'clear_effect' WHEN p < 0.2 THEN 'possible_effect' ELSE 'no_clear_effect' END AS label FROM rp", recursive=True))
def spearman(spark, d):
    return S.spearman(S.scoped(_events(spark, d))).select("symbol", "scope", *rounded(["rho"], 8), *rounded(["t", "p_value"]), "n", "label")


@query("macro_stats", with_views(VIEWS, f", {SCOPED_SQL} SELECT symbol, scope, count(*) AS n_used, min(session) AS first_event, max(session) AS last_event, round(avg(car_0_1), 8) AS mean_car_0_1 FROM sc GROUP BY symbol, scope", recursive=True))
def macro_stats(spark, d):
    return S.scoped(_events(spark, d)).groupBy("symbol", "scope").agg(F.count("*").alias("n_used"), F.min("session").alias("first_event"), F.max("session").alias("last_event"), F.round(F.avg("car_0_1"), 8).alias("mean_car_0_1"))


P_SQL = "SELECT o_orderkey AS id, (o_totalprice % 1000) / 1000 AS p FROM orders"


@query("shown_label", f"SELECT id, CAST(greatest(1, round_even(p * 100, 0)) AS INTEGER) AS in_100, {label_sql('p')} AS label FROM ({P_SQL})")
def shown_label(spark, d):
    """Half-even rounding of the shown figure over many p-values; the label is that of the figure."""
    p = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_totalprice") % 1000) / 1000).alias("p"))
    return p.select("id", S.shown_in_100(F.col("p")).alias("in_100"), S.shown_label(F.col("p")).alias("label"))


@query("pct_text", "SELECT o_orderkey AS id, CAST(sign(round_even(x * 1000, 0)) AS INTEGER) AS direction, CASE WHEN round_even(x * 1000, 0) > 0 THEN '+' WHEN round_even(x * 1000, 0) < 0 THEN '-' ELSE '' END || printf('%.1f%%', abs(round_even(x * 1000, 0)) / 10) AS text FROM (SELECT o_orderkey, (o_totalprice - 250000) / 2500000 AS x FROM orders)")
def pct_text(spark, d):
    x = V.table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 250000) / 2500000).alias("x"))
    return x.select(F.col("o_orderkey").alias("id"), S.direction(F.col("x")).alias("direction"), S.percent(F.col("x"), True).alias("text"))


def _tested(spark, d):
    used = stored(S.scoped(_events(spark, d)))
    stats = stored(S.bucket_stats(used))
    return used, S.with_bucket_test(stats), S.welch(stats)


@query("findings")
def findings(spark, d):
    """Sentences of our own wording; tests hold their numbers against the statistics."""
    used, tested, gap = _tested(spark, d)
    return S.findings(tested, gap, S.spearman(used))


def kind_sql(label: str, seen: str, expected: int) -> str:
    return f"CASE WHEN {label} IS NULL THEN 'insufficient' WHEN {label} = 'no_clear_effect' OR {seen} = 0 THEN 'none' WHEN {seen} <> {expected} THEN CASE WHEN {label} = 'clear_effect' THEN 'opposite' ELSE 'none' END WHEN {label} = 'clear_effect' THEN 'clear' ELSE 'possible' END"


VERDICT_SQL = f"""{TESTS_SQL}, bt AS (SELECT s.symbol, s.scope, s.bucket, CAST(sign(round_even(s.m1 * 1000, 0)) AS INTEGER) AS seen, CASE WHEN b2.p IS NOT NULL THEN {label_sql('b2.p')} END AS label FROM bs s LEFT JOIN b2 ON b2.symbol = s.symbol AND b2.scope = s.scope AND b2.bucket = s.bucket),
    wl AS (SELECT f.symbol, f.scope, CAST(sign(round_even(diff * 1000, 0)) AS INTEGER) AS seen, CASE WHEN p IS NOT NULL THEN {label_sql('p')} END AS label FROM (SELECT DISTINCT symbol, scope FROM bs) f LEFT JOIN w2 ON w2.symbol = f.symbol AND w2.scope = f.scope),
    vd AS (SELECT symbol, scope, 'good_news' AS id, {kind_sql('label', 'seen', 1)} AS answer_kind FROM bt WHERE bucket = 'positive' UNION ALL SELECT symbol, scope, 'bad_news', {kind_sql('label', 'seen', -1)} FROM bt WHERE bucket = 'negative' UNION ALL SELECT symbol, scope, 'overall', {kind_sql('label', 'seen', 1)} FROM wl)"""


@query("verdicts", with_views(VIEWS, f", {VERDICT_SQL} SELECT * FROM vd", recursive=True))
def verdicts(spark, d):
    _, tested, gap = _tested(spark, d)
    return S.verdicts(tested, gap).select("symbol", "scope", "id", "answer_kind")


TOP_SQL = f"""{EVENTS_SQL}, ao AS (SELECT symbol, max(session) AS as_of FROM ds GROUP BY symbol), te AS (SELECT e.*, row_number() OVER (PARTITION BY symbol ORDER BY abs(round(car_0_1, 10)) DESC, session) AS place FROM ev e JOIN ao USING (symbol) WHERE status = 'ok' AND car_0_1 IS NOT NULL AND session >= as_of - INTERVAL 3 MONTH),
    hl AS (SELECT symbol, session, article_id, row_number() OVER (PARTITION BY symbol, session ORDER BY abs(score) DESC, published_at, article_id) AS h FROM aligned WHERE session IS NOT NULL)"""


def _headlines(spark, d, most):
    a = A.asof_session(V.articles(spark, d), V.sessions(spark, d)).where("session is not null")
    w = Window.partitionBy("symbol", "session").orderBy(F.desc(F.abs("score")), "published_at", "article_id")
    return a.withColumn("h", F.row_number().over(w)).where(F.col("h") <= most).select("symbol", "session", "article_id", "h")


@query("top_events", with_views(VIEWS, f", {TOP_SQL} SELECT t.symbol, t.session, t.place, round(car_0_1, 8) AS car_0_1, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY h) AS headlines FROM te t LEFT JOIN hl ON hl.symbol = t.symbol AND hl.session = t.session AND h <= 3 WHERE place <= 10 GROUP BY ALL", recursive=True))
def top_events(spark, d):
    """The ten largest moves of the last three months of each symbol, with the three most extreme articles of the day."""
    daily, events = _study(spark, d)
    e = events.join(daily.groupBy("symbol").agg(F.max("session").alias("as_of")), "symbol").where((F.col("status") == "ok") & F.col("car_0_1").isNotNull() & (F.col("session") >= F.add_months("as_of", -3)))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.abs(F.round("car_0_1", 10))), "session"))
    e = e.withColumn("place", place).where("place <= 10")
    h = _headlines(spark, d, 3).groupBy("symbol", "session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "article_id"))), lambda x: x["article_id"].cast("string")), ",").alias("headlines"))
    return e.join(h, ["symbol", "session"], "left").select("symbol", "session", "place", *rounded(["car_0_1"], 8), "headlines")


@query("event_points", with_views(VIEWS, f", {TOP_SQL} SELECT e.symbol, e.session, round(car_0_1, 8) AS car_0_1, round(sentiment, 8) AS sentiment, article_count, near_earnings, hl.article_id AS headline FROM ev e LEFT JOIN hl ON hl.symbol = e.symbol AND hl.session = e.session AND h = 1 WHERE status = 'ok' AND car_0_1 IS NOT NULL", recursive=True))
def event_points(spark, d):
    e = _events(spark, d).where((F.col("status") == "ok") & F.col("car_0_1").isNotNull())
    h = _headlines(spark, d, 1).select("symbol", "session", F.col("article_id").alias("headline"))
    return e.join(h, ["symbol", "session"], "left").select("symbol", "session", *rounded(["car_0_1", "sentiment"], 8), "article_count", "near_earnings", "headline")


REPORT_SQL = f"""{VERDICT_SQL}, {REGIME_SQL.replace(DAILY_SQL + ', ', '')}, en AS (SELECT symbol, count(DISTINCT scope) AS scopes, count(*) FILTER (scope = 'all' AND label = 'clear_effect') AS ca, count(*) FILTER (scope = 'ex' AND label = 'clear_effect') AS ce FROM (SELECT symbol, scope, label FROM bt UNION ALL SELECT symbol, scope, label FROM wl) GROUP BY symbol), nu AS (SELECT e.symbol, count(*) AS events_total, count(*) FILTER (status <> 'ok') AS events_insufficient, count(*) FILTER (status = 'ok' AND car_0_1 IS NOT NULL) AS n_all, count(*) FILTER (status = 'ok' AND car_0_1 IS NOT NULL AND NOT near_earnings) AS n_ex FROM ev e GROUP BY e.symbol)
    SELECT nu.symbol, events_total, events_insufficient, n_all, n_ex, n_all <> n_ex AND coalesce(ca > 0 AND ce = 0 AND scopes = 2, FALSE) AS earnings_note, CASE WHEN n_all = n_ex THEN 'all_events' ELSE 'excluding_earnings' END AS primary_scope, CASE WHEN n_all <> n_ex THEN 'all_events' END AS secondary_scope,
        CASE WHEN rg.z >= 1 THEN 'more_positive_than_usual' WHEN rg.z <= -1 THEN 'more_negative_than_usual' WHEN rg.z IS NOT NULL THEN 'typical' END AS regime,
        max(CASE WHEN id = 'good_news' THEN answer_kind END) AS good_news, max(CASE WHEN id = 'bad_news' THEN answer_kind END) AS bad_news, max(CASE WHEN id = 'overall' THEN answer_kind END) AS overall
    FROM nu LEFT JOIN en ON en.symbol = nu.symbol LEFT JOIN rg ON rg.symbol = nu.symbol LEFT JOIN vd ON vd.symbol = nu.symbol AND vd.scope = CASE WHEN n_all = n_ex THEN 'all' ELSE 'ex' END GROUP BY ALL"""


@query("macro_report", with_views(VIEWS, f", {REPORT_SQL}", recursive=True))
def macro_report(spark, d):
    """Every symbol's report: counts, scopes, regime, the answers of the primary scope and whether the effect comes from earnings."""
    daily, events = _study(spark, d)
    used = (F.col("status") == "ok") & F.col("car_0_1").isNotNull()
    n = events.groupBy("symbol").agg(F.count("*").alias("events_total"), F.count_if(F.col("status") != "ok").alias("events_insufficient"), F.count_if(used).alias("n_all"), F.count_if(used & ~F.col("near_earnings")).alias("n_ex"))
    same = F.col("n_all") == F.col("n_ex")
    n = n.withColumns({"primary_scope": F.when(same, "all_events").otherwise("excluding_earnings"), "secondary_scope": F.when(~same, "all_events"), "scope": F.when(same, "all").otherwise("ex")})
    stats = stored(S.bucket_stats(S.scoped(events)))
    tested, gap = stored(S.with_bucket_test(stats)), stored(S.welch(stats))  # some rows a symbol
    note = S.earnings_note(tested, gap).select("symbol", F.col("earnings_note").isNotNull().alias("noted"))
    said = S.verdicts(tested, gap).groupBy("symbol", "scope").agg(*[F.max(F.when(F.col("id") == k, F.col("answer_kind"))).alias(k) for k in ("good_news", "bad_news", "overall")])
    as_of = daily.groupBy("symbol").agg(F.max("session").alias("as_of"))
    regime = A.sentiment_regime(daily, as_of).select("symbol", F.col("label").alias("regime"))
    out = n.join(regime, "symbol", "left").join(said, ["symbol", "scope"], "left").join(note, "symbol", "left").drop("scope")
    return out.withColumn("earnings_note", ~same & F.coalesce("noted", F.lit(False))).drop("noted")
