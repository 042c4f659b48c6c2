"""Statistics of events by scope and sentiment bucket: means, t tests, Welch's test, rank correlation, findings and verdicts.

Tests are closed formulas over grouped moments; only Student's t needs Python, on the few rows that statistics have.
"""

from __future__ import annotations

from math import exp, isfinite, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tickloom.operators.alignment import BUCKETS, bucket_of

KEYS = ["symbol", "scope"]


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) * f / a


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t; None for missing input or no degrees of freedom."""
    if t is None or df is None or not isfinite(t) or not df > 0:
        return None
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(df: float, level: float = 0.95) -> float:
    """The t beyond which two-sided mass is 1 - level, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(float(x)) if x > 0 else None for x in df], dtype="float64")


def scoped(events: DataFrame) -> DataFrame:
    """Usable events (status ok, car_0_1 there) once for scope all and, if not near earnings, once for scope ex."""
    used = events.where((F.col("status") == "ok") & F.col("car_0_1").isNotNull())
    scopes = F.when(F.col("near_earnings"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("ex")))
    return used.withColumn("scope", F.explode(scopes)).withColumn("bucket", bucket_of(F.col("sentiment")))


def bucket_stats(used: DataFrame) -> DataFrame:
    """Per symbol, scope and each of the three buckets: counts, means and medians; a bucket without events has n 0 and nulls."""
    g = used.groupBy(*KEYS, "bucket").agg(
        F.count("*").alias("n"), F.avg("car_0_1").alias("mean_car_0_1"), F.median("car_0_1").alias("median_car_0_1"), F.count("car_0_5").alias("n_car_0_5"), F.avg("car_0_5").alias("mean_car_0_5"),
        F.median("car_0_5").alias("median_car_0_5"), F.count("car_pre_5").alias("n_car_pre_5"), F.avg("car_pre_5").alias("mean_car_pre_5"),
        F.stddev_samp("car_0_1").alias("sd"), (F.max("car_0_1") > F.min("car_0_1")).alias("spread"), F.var_samp("car_0_1").alias("var"),
    )
    frame = used.select(*KEYS).distinct().withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    return frame.join(g, [*KEYS, "bucket"], "left").fillna(0, subset=["n", "n_car_0_5", "n_car_pre_5"])


def with_bucket_test(stats: DataFrame, min_n: int = 10) -> DataFrame:
    """Adds t, p_value, label and the 95% interval of the mean; null below min_n or without spread."""
    fit = (F.col("n") >= max(min_n, 2)) & F.coalesce("spread", F.lit(False))
    se = F.col("sd") / F.sqrt("n")
    s = stats.withColumn("t", F.when(fit, F.try_divide(F.col("mean_car_0_1"), se))).withColumn("p_value", p_value(F.col("t"), (F.col("n") - 1).cast("double")))
    half = F.when(fit, t_critical(F.greatest(F.col("n") - 1, F.lit(1)).cast("double")) * se)
    return s.withColumns({"label": shown_label(F.col("p_value")), "ci_low": F.col("mean_car_0_1") - half, "ci_high": F.col("mean_car_0_1") + half})


def welch(stats: DataFrame, min_n: int = 10) -> DataFrame:
    """(symbol, scope, mean_diff, t, df, p_value, label, n_pos, n_neg): positive against negative days, where both have min_n."""
    side = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    g = stats.groupBy(*KEYS).agg(*[side(b, c).alias(f"{c}_{b[:3]}") for b in ("positive", "negative") for c in ("n", "mean_car_0_1", "var", "spread")])
    g = g.where((F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n) & (F.col("spread_pos") | F.col("spread_neg")))
    a, b = F.col("var_pos") / F.col("n_pos"), F.col("var_neg") / F.col("n_neg")
    g = g.withColumns({"mean_diff": F.col("mean_car_0_1_pos") - F.col("mean_car_0_1_neg"), "__v": a + b, "df": (a + b) * (a + b) / (a * a / (F.col("n_pos") - 1) + b * b / (F.col("n_neg") - 1))})
    g = g.withColumn("t", F.col("mean_diff") / F.sqrt("__v")).withColumn("p_value", p_value("t", "df"))
    return g.select(*KEYS, "mean_diff", "t", "df", "p_value", shown_label(F.col("p_value")).alias("label"), "n_pos", "n_neg")


def spearman(used: DataFrame, min_n: int = 10) -> DataFrame:
    """(symbol, scope, rho, t, p_value, n, label): rank correlation of sentiment and car_0_1; its label is from the unrounded p."""

    def ranks(c: str) -> Column:
        ties = F.count("*").over(Window.partitionBy(*KEYS, c))
        return F.rank().over(Window.partitionBy(*KEYS).orderBy(c)) + (ties - 1) / 2

    r = used.withColumns({"__a": ranks("sentiment"), "__b": ranks("car_0_1")})
    g = r.groupBy(*KEYS).agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"), (F.max("sentiment") > F.min("sentiment")).alias("x"), (F.max("car_0_1") > F.min("car_0_1")).alias("y"))
    g = g.where((F.col("n") >= min_n) & F.col("x") & F.col("y")).withColumn("t", F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("rho") * F.col("rho"))))
    g = g.withColumn("p_value", F.when(F.abs("rho") >= 1, 0.0).otherwise(p_value(F.col("t"), (F.col("n") - 2).cast("double"))))
    return g.select(*KEYS, "rho", "t", "p_value", "n", reliability_label(F.col("p_value")).alias("label"))


def reliability_label(p: Column) -> Column:
    return F.when(p < 0.05, "clear_effect").when(p < 0.2, "possible_effect").when(p.isNotNull(), "no_clear_effect")


def shown_in_100(p: Column) -> Column:
    """The figure that is shown: p in percent, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(p * 100).cast("int"))


def shown_label(p: Column) -> Column:
    """Label of the shown figure, so that text and label agree; null p gives null."""
    return F.when(p.isNotNull(), reliability_label(shown_in_100(p) / 100))


def direction(x: Column) -> Column:
    """-1, 0 or 1 once x is rounded to a tenth of a percent."""
    return F.signum(F.bround(x * 1000)).cast("int")


def percent(x: Column, signed: bool = False) -> Column:
    """One-decimal percent of the absolute or signed value."""
    tenth = F.bround(x * 1000) / 10
    sign = F.when(tenth > 0, "+").when(tenth < 0, "-").otherwise("") if signed else F.lit("")
    return F.concat(sign, F.format_string("%.1f%%", F.abs(tenth)))


def answer_kind(label: Column, seen: Column, expected: int) -> Column:
    """clear, possible, none or opposite; insufficient without a test."""
    wrong = F.when(label == "clear_effect", "opposite").otherwise("none")
    return F.when(label.isNull() | seen.isNull(), "insufficient").when((label == "no_clear_effect") | (seen == 0), "none").when(seen != expected, wrong).when(label == "clear_effect", "clear").otherwise("possible")


def verdicts(tested: DataFrame, difference: DataFrame) -> DataFrame:
    """(symbol, scope, id, answer_kind, detail): does good news lift, does bad news drag, do good days beat bad days."""
    one = tested.where("bucket <> 'neutral'")
    expected = F.when(F.col("bucket") == "positive", 1).otherwise(-1)
    move = F.col("mean_car_0_1")
    kind = F.when(F.col("bucket") == "positive", answer_kind(F.col("label"), direction(move), 1)).otherwise(answer_kind(F.col("label"), direction(move), -1))
    detail = F.when(F.col("label").isNull(), F.concat(F.lit("Too few days to tell: "), "n")).otherwise(F.concat(percent(move, True), F.lit(" against the market over two days, days: "), "n"))
    buckets = one.select(*KEYS, F.when(expected == 1, "good_news").otherwise("bad_news").alias("id"), kind.alias("answer_kind"), detail.alias("detail"))
    both = one.select(*KEYS).distinct().join(difference, KEYS, "left")
    gap = F.when(F.col("label").isNull(), F.lit("Too few days of both kinds to compare")).otherwise(F.concat(percent(F.col("mean_diff"), True), F.lit(" between good and bad days")))
    overall = both.select(*KEYS, F.lit("overall").alias("id"), answer_kind(F.col("label"), direction(F.col("mean_diff")), 1).alias("answer_kind"), gap.alias("detail"))
    return buckets.unionByName(overall)


EARNINGS_NOTE = "Most of the effect comes from news around earnings: without those days no clear effect is left."


def earnings_note(tested: DataFrame, difference: DataFrame) -> DataFrame:
    """(symbol, earnings_note): set where some test of all events, of a bucket or of the difference, is clear and none of the events away
    from earnings is; null otherwise, and where a symbol has one of the scopes only."""
    labels = tested.select(*KEYS, "label").unionByName(difference.select(*KEYS, "label"))
    clear = lambda scope: F.count_if((F.col("scope") == scope) & (F.col("label") == "clear_effect"))
    both = F.count_distinct("scope") == 2
    return labels.groupBy("symbol").agg(F.when(both & (clear("all") > 0) & (clear("ex") == 0), EARNINGS_NOTE).alias("earnings_note"))


def findings(tested: DataFrame, difference: DataFrame, correlation: DataFrame, min_link: float = 0.1, caveat: float = 0.01) -> DataFrame:
    """(symbol, scope, kind, bucket, based_on, label, text): a sentence for every tested bucket, its moves before the news, the gap and the link."""
    move, pre = F.col("mean_car_0_1"), F.col("mean_car_pre_5")
    chance = F.concat(F.lit(" (chance alone gives this about "), shown_in_100(F.col("p_value")).cast("string"), F.lit(" times in 100)"))
    better = lambda x: F.when(direction(x) == 0, F.lit("as expected")).otherwise(F.concat(percent(x), F.when(x > 0, " above").otherwise(" below"), F.lit(" what was expected")))
    b = tested.where("bucket <> 'neutral'")
    row = lambda df, kind, bucket, n, label, text: df.select(*KEYS, F.lit(kind).alias("kind"), bucket.alias("bucket"), n.cast("long").alias("based_on"), label.alias("label"), text.alias("text"))
    none = F.lit(None).cast("string")
    moved = row(b.where("p_value is not null"), "move", F.col("bucket"), F.col("n"), F.col("label"), F.concat(F.lit("After "), "bucket", F.lit(" news the stock closed "), better(move), chance))
    thin = row(b.where("p_value is null"), "untested", F.col("bucket"), F.col("n"), none, F.concat(F.lit("Too few "), "bucket", F.lit(" news days: "), "n"))
    early = row(b.where((F.col("p_value").isNotNull()) & (F.abs(pre) >= caveat)), "early_move", F.col("bucket"), F.col("n_car_pre_5"), none, F.concat(F.lit("In the five sessions before, it stood "), better(pre), F.when((direction(move) != 0) & ((pre > 0) == (move > 0)), "; part of the move came first").otherwise("")))
    gap = row(difference, "gap", none, F.col("n_pos") + F.col("n_neg"), F.col("label"), F.concat(F.lit("Good days against bad days: "), percent(F.col("mean_diff"), True), chance))
    linked = (F.col("label") != "no_clear_effect") & (F.abs("rho") >= min_link)
    link = row(correlation, "link", none, F.col("n"), F.col("label"), F.concat(F.when(~linked, "No clear link between tone and move").when(F.col("rho") > 0, "Better news went with better moves").otherwise("Better news went with worse moves"), chance))
    return moved.unionByName(thin).unionByName(early).unionByName(gap).unionByName(link)

