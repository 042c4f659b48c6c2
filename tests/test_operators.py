"""Hand values, plain procedures and properties of the operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.series import wilson
from tickloom.operators import alignment as A
from tickloom.operators import event_study as E
from tickloom.operators import headlines as H
from tickloom.operators import indicators as I
from tickloom.operators import scan as N
from tickloom.operators import screening as C
from tickloom.operators import statistics as S


def bars(spark, n, symbols=("A",), seed=1, start=0):
    out = []
    for s in symbols:
        rng = random.Random(f"{seed}{s}")
        close = 100.0
        for i in range(n):
            o = close
            close = max(1.0, close + rng.uniform(-2, 2))
            if i >= start:
                out.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), o, max(o, close) + rng.random(), min(o, close) - rng.random(), close, float(rng.randint(0, 5))))
    return spark.createDataFrame(out, "symbol string, session date, open double, high double, low double, close double, volume double")


def near(a, b, digits=6):
    return [None if x is None or x != x else round(x, digits) for x in a] == [None if x is None else round(x, digits) for x in b]


def test_wilson_by_hand(spark):
    df = spark.createDataFrame([(9, 12), (15, 15), (0, 10), (0, 0)], "k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    got = [(round(r[0], 6), round(r[1], 6)) for r in df.select(low, high).collect()]
    assert got == [(0.46769, 0.91106), (0.796111, 1.0), (0.0, 0.27754), (0.0, 1.0)]


@pytest.mark.parametrize(("t", "df", "p"), [(2.262157, 9, 0.05), (2, 17.3, 0.061452), (0.5, 8, 0.630536)])
def test_student_by_hand(t, df, p):
    assert round(S.t_two_sided(t, df), 6) == p
    assert abs(S.t_quantile(9) - 2.262157) < 1e-6
    assert S.t_two_sided(None, 3) is None and S.t_two_sided(1.0, 0) is None


POS = [0.01, 0.02, 0.015, 0.03, -0.005, 0.012, 0.008, 0.02, 0.018, 0.001]
NEG = [-0.01, 0.0, -0.02, 0.004, -0.015, -0.006, 0.003, -0.011, -0.02, 0.001]


@pytest.fixture(scope="module")
def events(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", day + dt.timedelta(days=i), s, x, None, None, None, False, "ok") for i, (s, x) in enumerate([(0.5, x) for x in POS] + [(-0.5, x) for x in NEG])]
    rows += [("A", day, 0.1, None, None, None, None, False, "insufficient_estimation")]
    return spark.createDataFrame(rows, "symbol string, session date, sentiment double, car_0_1 double, car_0_0 double, car_0_5 double, car_pre_5 double, near_earnings boolean, status string")


def test_tests_by_hand(spark, events):
    used = S.scoped(events)
    stats = S.bucket_stats(used)
    one = S.with_bucket_test(stats).where("scope = 'all' and bucket = 'positive'").first()
    assert [round(x, 6) for x in (one.t, one.p_value, one.ci_low, one.ci_high)] == [4.037168, 0.002941, 0.005672, 0.020128]
    gap = S.welch(stats).where("scope = 'all'").first()
    assert [round(x, 6) for x in (gap.mean_diff, gap.t, gap.df, gap.p_value)] == [0.0203, 4.699516, 17.841064, 0.000183]
    empty = stats.where("bucket = 'neutral' and scope = 'all'").first()
    assert empty.n == 0 and empty.mean_car_0_1 is None
    said = {(r.kind, r.bucket): r for r in S.findings(S.with_bucket_test(stats), S.welch(stats), S.spearman(used)).where("scope = 'all'").collect()}
    assert "1.3% above" in said["move", "positive"].text and said["gap", None].based_on == 20
    kinds = {r.id: r.answer_kind for r in S.verdicts(S.with_bucket_test(stats), S.welch(stats)).where("scope = 'all'").collect()}
    assert kinds["good_news"] == "clear" and kinds["overall"] == "clear"


def test_rank_correlation_by_hand(spark):
    rows = [("A", "all", a, b) for a, b in zip(POS, NEG, strict=True)]
    r = S.spearman(spark.createDataFrame(rows, "symbol string, scope string, sentiment double, car_0_1 double")).first()
    assert [round(x, 6) for x in (r.rho, r.t, r.p_value)] == [0.079268, 0.224912, 0.827686]


def plain_choice(pos, salience, exclusion=5):
    """The definition, one session after another."""
    out, last, i = [], -exclusion - 1, 0
    while i < len(pos):
        if pos[i] > last + exclusion:
            window = [k for k in range(i, len(pos)) if pos[k] <= pos[i] + exclusion]
            best = max(window, key=lambda k: (salience[k], -k))
            out.append(best)
            last = pos[best]
            i = window[-1] + 1
        else:
            i += 1
    return out


def test_event_choice_equals_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        pos = np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.int64)
        salience = np.array([rng.choice([0.1, 0.2, 0.3, rng.random()]) for _ in pos])
        assert E.choose(pos, salience) == plain_choice(pos.tolist(), salience.tolist())


def test_market_model_finds_exact_coefficients(spark):
    rng = random.Random(5)
    bench, stock, rows, market = 100.0, 50.0, [], []
    for i in range(330):
        m = rng.gauss(0, 0.01)
        bench *= 1 + m
        stock *= 1 + 0.0002 + 1.5 * m
        day = dt.date(2023, 1, 1) + dt.timedelta(days=i)
        rows.append(("A", day, stock))
        market.append((day, bench))
    j = E.join_returns(spark.createDataFrame(rows, "symbol string, session date, close double"), spark.createDataFrame(market, "session date, close double"))
    earn = spark.createDataFrame([("A", dt.date(2022, 1, 1)), ("A", dt.date(2030, 1, 1))], "symbol string, event_date date")
    marked = E.mark_earnings(j, earn)
    assert [r.pos for r in marked.where("masked").orderBy("pos").collect()] == [0, 1]  # a date before the data is its first session
    got = E.with_cars(E.market_model(marked)).orderBy("pos").collect()
    assert got[80].alpha is None and abs(got[329].beta - 1.5) < 1e-9 and abs(got[329].alpha - 0.0002) < 1e-9
    assert abs(got[200].car_0_5) < 1e-9 and got[327].car_0_5 is None and got[327].car_0_1 is not None


def test_article_at_the_close_belongs_to_the_next_session(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 21)), (dt.date(2024, 1, 8), dt.datetime(2024, 1, 8, 21))], "session date, close_utc timestamp_ntz")
    a = spark.createDataFrame([(1, dt.datetime(2024, 1, 5, 20, 59)), (2, dt.datetime(2024, 1, 5, 21)), (3, dt.datetime(2024, 1, 6, 3)), (4, dt.datetime(2024, 1, 8, 21)), (5, dt.datetime(2020, 1, 1)), (6, None)], "id int, published_at timestamp_ntz")
    got = {r.id: r.session and r.session.day for r in A.asof_session(a, s).collect()}
    assert got == {1: 5, 2: 8, 3: 8, 4: None, 5: 5, 6: None}


def test_buckets_and_labels_at_their_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.31,), (-0.3,), (-0.31,), (None,)], "x double")
    assert [r[0] for r in df.select(A.bucket_of(F.col("x"))).collect()] == ["neutral", "positive", "neutral", "negative", None]
    p = spark.createDataFrame([(0.0001,), (0.044,), (0.045,), (0.055,), (0.195,), (None,)], "p double")
    assert [r[0] for r in p.select(S.shown_label(F.col("p"))).collect()] == ["clear_effect", "clear_effect", "clear_effect", "possible_effect", "no_clear_effect", None]


def test_indicators_do_not_look_ahead_and_keep_symbols_apart(spark):
    cols = ["symbol", "session", "sma20", "ema9", "rsi14", "macd", "atr14", "trend"]
    f = lambda b: {(r.symbol, r.session): tuple(r)[2:] for r in I.with_trend(I.with_sma(N.with_recursive(b))).select(*cols).collect()}
    short, long_, two = f(bars(spark, 60)), f(bars(spark, 80)), f(bars(spark, 60, ("A", "B")).repartition(7))
    assert all(long_[k] == v for k, v in short.items())
    assert all(two[k] == v for k, v in short.items())


def test_stems(spark):
    words = "shares launches loss pushing news rising gains boxes passes class using".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(H.stem(F.col("w"))).collect()]
    assert got == [H.plain_stem(w) for w in words] == "share launch loss push news ris gain box pass class using".split()


def test_places_of_a_large_table_are_whole(spark, tmp_path):
    """A range sort cuts by a sample: counts and numbers must come from one and the same sort."""
    from tickloom.plans import QUERIES

    n = F.col("id")
    parts = spark.range(120_000).select(n.alias("p_partkey"), F.lit("x").alias("p_name"), (F.xxhash64(n) % 1000).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    parts.repartition(7).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(300).select(n.alias("l_partkey"), F.lit(2.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as a large table has
    try:
        got = {r.symbol: r.place for r in QUERIES["table_sort"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    size = {r.p_partkey: r.p_size for r in parts.collect()}
    order = sorted(size, key=lambda k: (size[k] % 5 == 0, -size[k] if size[k] % 5 else 0, k))
    assert got == {k: i + 1 for i, k in enumerate(order)}
