"""Technical indicators for every symbol at once.

Window indicators share one window specification, so Spark plans one exchange and one sort.  Recursive ones (EMA, Wilder
smoothing) are in scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.series import by_symbol, full, sma


def check_bars(bars: DataFrame) -> DataFrame:
    """Bars whose prices are all there; of rows that repeat a time the caller decides (see sinks.dedupe_last)."""
    return bars.dropna(subset=["open", "high", "low", "close"])


def with_sma(bars: DataFrame, n: int = 20, order: str = "session") -> DataFrame:
    return bars.withColumn(f"sma{n}", sma(F.col("close"), n, by_symbol(order)))


def with_bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, order: str = "session") -> DataFrame:
    w, close = by_symbol(order), F.col("close")
    mid, sd = sma(close, n, w), full(F.stddev_pop(close), close, w, n)
    return bars.withColumns({"middle": mid, "upper": mid + k * sd, "lower": mid - k * sd})


def with_session_vwap(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Cumulative VWAP of each date; NULL while no volume was traded."""
    w = Window.partitionBy("symbol", F.col(ts).cast("date")).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("vwap", _vwap(w))


def with_anchored_vwap(bars: DataFrame, anchor, order: str = "session") -> DataFrame:
    """Cumulative VWAP from the first row at or after the anchor (a column); NULL before."""
    w = by_symbol(order).rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("__in", F.col(order) >= anchor).withColumn("vwap", F.when(F.col("__in"), _vwap(w, F.col("__in")))).drop("__in")


def _vwap(w, mask=None):
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.col("volume").cast("double") if mask is None else F.when(mask, F.col("volume").cast("double"))
    return F.try_divide(F.sum(typical * volume).over(w), F.sum(volume).over(w))


def with_trend(bars: DataFrame, order: str = "session") -> DataFrame:
    """Trend before each bar: up, down, none; NULL in warm-up."""
    w = by_symbol(order)
    b = bars.withColumn("__sma10", sma(F.col("close"), 10, w))
    c, s, before = F.lag("close").over(w), F.lag("__sma10").over(w), F.lag("__sma10", 6).over(w)
    return b.withColumn("trend", F.when((c > s) & (s > before), "up").when((c < s) & (s < before), "down").when(before.isNotNull(), "none")).drop("__sma10")


def with_forward_return(bars: DataFrame, horizon: int = 5, order: str = "session") -> DataFrame:
    """close[t+h] / open[t+1] - 1; NULL past the end."""
    w = by_symbol(order)
    return bars.withColumn("forward_return", F.try_divide(F.lead("close", horizon).over(w), F.lead("open", 1).over(w)) - 1)


def with_ema_cross(bars: DataFrame, order: str = "session") -> DataFrame:
    """Side of EMA 9 against 21 and whether it changed in the last 3 bars."""
    from tickloom.functions.series import sign_with_tolerance

    w = by_symbol(order)
    b = bars.withColumn("ema_side", sign_with_tolerance(F.col("ema9") - F.col("ema21"), F.col("ema21")))
    # the sign before is judged with the tolerance of the later bar in the last rows only; ties are exact in practice
    changed = (F.lag("ema_side").over(w) != F.col("ema_side")).cast("int")
    return b.withColumn("__changed", changed).withColumn("fresh_cross", F.coalesce(F.max("__changed").over(w.rowsBetween(-2, 0)), F.lit(0)) == 1).drop("__changed")
