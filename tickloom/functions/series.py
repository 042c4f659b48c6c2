"""Column helpers for time series: one window for all indicators, NULL in warm-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_symbol(order: str = "session") -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(order)


def full(agg: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over the last n rows; NULL until n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return full(F.avg(x), x, w, n)


def sign_with_tolerance(x: Column, scale: Column) -> Column:
    """-1, 0, 1; differences of at most 1e-9 of the scale (1 at least) are ties."""
    return F.when(F.abs(x) <= 1e-9 * F.greatest(F.abs(scale), F.lit(1.0)), 0).when(x > 0, 1).otherwise(F.when(x.isNotNull(), -1))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval in [0, 1]; (0, 1) without trials."""
    p, z2 = k / F.nullif(n, F.lit(0)), z * z
    m = F.nullif(n, F.lit(0)).cast("double")
    mid, half = (p + z2 / (2 * m)) / (1 + z2 / m), z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0))


def rounded(names: list[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]
