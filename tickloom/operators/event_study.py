"""News event study: which sessions count as events, what the market model expected, and what was left over (CAR).

All is set-based over every symbol.  A symbol's history of sessions bounds each window and each group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import by_symbol
from tickloom.operators.alignment import sessions_on_or_after


def join_returns(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """(symbol, session, close, bench, pos, r_s, r_m): closes of sessions that both have; returns are taken after the join."""
    m = bench.select(F.col("session").alias("__m"), F.col("close").alias("bench"))
    j = bars.select("symbol", "session", "close").join(m, F.col("session") == F.col("__m")).drop("__m").dropna(subset=["close", "bench"])
    w = by_symbol()
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    return j.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "r_s": change("close"), "r_m": change("bench")})


def mark_earnings(joined: DataFrame, earnings: DataFrame, mask: int = 1, near: int = 5) -> DataFrame:
    """Adds masked (within `mask` sessions of an earnings session) and near_earnings (within `near`)."""
    on = sessions_on_or_after(earnings.select("symbol", "event_date"), joined).select(F.col("symbol").alias("__es"), F.col("session").alias("__e")).distinct()
    j = joined.join(on, (F.col("symbol") == F.col("__es")) & (F.col("session") == F.col("__e")), "left").withColumn("__flag", F.col("__e").isNotNull().cast("int"))
    w = by_symbol()
    around = lambda n: F.max("__flag").over(w.rowsBetween(-n, n)) == 1
    return j.withColumns({"masked": around(mask), "near_earnings": around(near)}).drop("__es", "__e", "__flag")


def market_model(marked: DataFrame, start: int = 250, end: int = 20, min_obs: int = 60) -> DataFrame:
    """Adds alpha and beta of OLS over positions [t - start, t - end], masked sessions left out; null below min_obs or without variance."""
    w = by_symbol().rowsBetween(-start, -end)
    y, x = F.when(~F.col("masked"), F.col("r_s")), F.when(~F.col("masked"), F.col("r_m"))
    m = marked.withColumns({"__n": F.regr_count(y, x).over(w), "__sxx": F.regr_sxx(y, x).over(w), "beta": F.regr_slope(y, x).over(w), "alpha": F.regr_intercept(y, x).over(w)})
    fit = (F.col("__n") >= min_obs) & (F.col("__sxx") > 0)
    return m.withColumns({c: F.when(fit, F.col(c)) for c in ("alpha", "beta")}).drop("__n", "__sxx")


CAR_WINDOWS = {"car_0_0": (0, 0), "car_0_1": (0, 1), "car_0_5": (0, 5), "car_pre_5": (-5, -1)}


def with_cars(modelled: DataFrame) -> DataFrame:
    """Adds cumulative abnormal returns with each row's own coefficients: sums are linear, so windows of raw returns are enough."""
    out = {}
    for name, (a, b) in CAR_WINDOWS.items():
        w, k = by_symbol().rowsBetween(a, b), b - a + 1
        whole = F.count(F.when(F.col("r_s").isNotNull() & F.col("r_m").isNotNull(), 1)).over(w) == k
        out[name] = F.when(whole, F.sum("r_s").over(w) - k * F.col("alpha") - F.col("beta") * F.sum("r_m").over(w))
    return modelled.withColumns(out)


def choose(pos: np.ndarray, salience: np.ndarray, exclusion: int = 5) -> list[int]:
    """Indexes of the events among a symbol's news sessions in order of position: a window opens at the first session after the last
    event's reach, its most salient session (the earliest on ties) is the event."""
    out, at, last = [], 0, -exclusion - 1
    while at < len(pos):
        if pos[at] <= last + exclusion:
            at += 1
            continue
        to = int(np.searchsorted(pos, pos[at] + exclusion, side="right"))
        best = at + int(np.argmax(salience[at:to]))
        out.append(best)
        last, at = int(pos[best]), to
    return out


def select_events(daily: DataFrame, joined: DataFrame, exclusion: int = 5) -> DataFrame:
    """(symbol, session, sentiment, article_count) of the events; news on days the symbol did not trade is left out."""
    j = joined.select(F.col("symbol").alias("__s"), F.col("session").alias("__d"), "pos")
    news = daily.join(j, (F.col("symbol") == F.col("__s")) & (F.col("session") == F.col("__d")))
    rows = news.select("symbol", "session", "pos", (F.abs("mean_score") * F.log1p("article_count")).alias("salience"), F.col("mean_score").alias("sentiment"), "article_count")

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        kept = choose(table.column("pos").to_numpy(), table.column("salience").to_numpy(), exclusion)
        return table.take(pa.array(kept, pa.int64()))

    return rows.groupBy("symbol").applyInArrow(pick, rows.schema).drop("salience", "pos")


def event_study(bars: DataFrame, bench: DataFrame, daily: DataFrame, earnings: DataFrame) -> DataFrame:
    """One row per event: sentiment, count, alpha, beta, four CARs, near_earnings, status (ok or insufficient_estimation)."""
    joined = join_returns(bars, bench)
    events = select_events(daily, joined)
    study = with_cars(market_model(mark_earnings(joined, earnings))).select(F.col("symbol").alias("__s"), F.col("session").alias("__d"), "alpha", "beta", *CAR_WINDOWS, "near_earnings")
    e = events.join(study, (F.col("symbol") == F.col("__s")) & (F.col("session") == F.col("__d"))).drop("__s", "__d")
    return e.withColumn("status", F.when(F.col("alpha").isNull(), "insufficient_estimation").otherwise("ok"))
