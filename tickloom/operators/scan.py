"""EMA, RSI, MACD and ATR as a scan of affine maps, on Spark's own expressions.

Exponential smoothing is y = d * y_before + (1 - d) * x: an affine map, and such maps compose.  A symbol's bars are numbered and dealt into
blocks, each a group of its own, so that a long history is spread over many tasks.  Inside a block a running sum of x * d^-j gives what the
block would be if nothing came before it.  The blocks' last values, one row a block, are put together into what enters each block, and one
join adds it, faded by d^(j + 1), to every bar.  The first n values are seeded with their mean.

`state` keeps of each symbol what the next bar needs: the smoothed values of its last bar, or its bars themselves while they are
too few for all seeds.  `extend` goes on from there and never reads the history again.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.storage import stored


class Smooth(NamedTuple):
    """One smoothing: its n values are first there at the n-th one from bar `first` on, and fade with `decay`."""

    n: int
    first: int
    decay: float

    @property
    def seed(self) -> int:
        return self.first + self.n - 1


def _ema(n: int, first: int = 0) -> Smooth:
    return Smooth(n, first, 1 - 2.0 / (n + 1))


#: Indicators that are smoothed from prices, and the signal, which is smoothed from the difference of two of them.
PRICE = {"ema9": _ema(9), "ema12": _ema(12), "ema21": _ema(21), "ema26": _ema(26), "gain": Smooth(14, 1, 1 - 1 / 14), "loss": Smooth(14, 1, 1 - 1 / 14), "tr": Smooth(14, 0, 1 - 1 / 14)}
SIGNAL = _ema(9, PRICE["ema26"].seed)
ALL = {**PRICE, "signal": SIGNAL}
WARM = max(s.seed for s in ALL.values()) + 1  # bars after which everything is seeded
RECURSIVE = ("ema9", "ema21", "rsi14", "macd", "signal", "histogram", "atr14")
BLOCK = 1024
LOST = 1e-40  # a share that no double can tell


def _numbered(bars: DataFrame, order: str) -> DataFrame:
    """Adds __pos, the bar's place among the symbol's bars with prices (null for others).  Places come from counts by year and the place
    within a year, so no task holds a symbol's whole history."""
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    b = bars.withColumns({"__ok": whole, "__year": F.year(order)})
    counts = b.where("__ok").groupBy(F.col("symbol").alias("__s"), F.col("__year").alias("__y")).agg(F.count("*").alias("__many"))
    earlier = Window.partitionBy("__s").orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__s", "__y", F.coalesce(F.sum("__many").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("symbol", "__year", "__ok").orderBy(order)) - 1
    j = b.withColumn("__nth", nth).join(before, F.col("symbol").eqNullSafe(F.col("__s")) & F.col("__year").eqNullSafe(F.col("__y")), "left")
    return j.withColumn("__pos", F.when(F.col("__ok"), F.col("__before") + F.col("__nth"))).drop("__s", "__y", "__before", "__nth", "__year", "__ok")


def _power(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent)


def _within_blocks(numbered: DataFrame, block: int, resumed: bool) -> DataFrame:
    """Adds __block, __j (place in the block) and, for every smoothing, what it is if nothing comes before the block.

    A block's last bar is also laid at the head of the next block, whose first bar needs its close."""
    pos = F.col("__pos")
    last = pos % block == block - 1
    rows = numbered.withColumn("__seam", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("__block", F.coalesce(F.floor(pos / block) + F.col("__seam"), F.lit(-1)).cast("long")).withColumn("__j", pos - F.col("__block") * block)
    w = Window.partitionBy("symbol", "__block").orderBy("__pos")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("close").over(w)
    if resumed:
        before = F.coalesce(before, F.when(pos == 0, F.col("__close")))
    delta = F.col("close") - before
    ranges = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    values = {"ema9": F.col("close"), "ema12": F.col("close"), "ema21": F.col("close"), "ema26": F.col("close"), "gain": F.greatest(delta, F.lit(0.0)), "loss": F.greatest(-delta, F.lit(0.0)), "tr": ranges}
    rows = rows.withColumns({f"__x_{k}": F.when(F.col("__seam") == 0, v) for k, v in values.items()})

    def local(name: str, s: Smooth) -> Column:
        x = F.col(f"__x_{name}")
        step = (1 - s.decay) * x
        if not resumed:  # the seed lies in the first block, as a block is longer than the warm-up
            seed = F.sum(F.when(pos >= s.first, x)).over(running) / s.n
            step = F.when((F.col("__block") > 0) | (pos > s.seed), step).when(pos == s.seed, seed)
        return F.coalesce(F.sum(step * _power(s.decay, -F.col("__j"))).over(running) * _power(s.decay, F.col("__j")), F.lit(0.0))

    rows = rows.withColumns({f"__l_{k}": local(k, s) for k, s in PRICE.items()}).drop(*[f"__x_{k}" for k in PRICE])
    line = F.col("__l_ema12") - F.col("__l_ema26")
    started = F.lit(True) if resumed else (F.col("__block") > 0) | (pos >= SIGNAL.first)
    rows = rows.withColumn("__x_signal", F.when((F.col("__seam") == 0) & started, line))
    return rows.withColumn("__l_signal", local("signal", SIGNAL)).where("__seam = 0").drop("__x_signal", "__seam")


def _spread(decay: float, j: Column) -> Column:
    """What a unit that enters a block has added to the signal after bar j, by way of a smoothing with this decay."""
    d = SIGNAL.decay
    return (1 - d) * decay * (_power(decay, j + 1) - _power(d, j + 1)) / (decay - d)


def _entering(blocks: DataFrame, block: int, resumed: bool) -> DataFrame:
    """(__cs, __cb, __c_name...): what enters each block, from the last values of full blocks (__es, __eb, __l_name...)."""
    w = Window.partitionBy("__es").orderBy("__eb")

    def gathered(own: Column, decay: float, name: str) -> Column:
        fade = decay**block
        reach = max(1, math.ceil(math.log(LOST) / math.log(fade))) if fade > 0 else 1
        recent = F.collect_list(own).over(w.rowsBetween(1 - reach, 0))
        total = F.aggregate(recent, F.lit(0.0), lambda sofar, x: sofar * fade + x)
        return total + F.col(f"__y_{name}") * _power(fade, F.col("__eb") + 1) if resumed else total

    after = blocks.withColumns({f"__c_{k}": gathered(F.col(f"__l_{k}"), s.decay, k) for k, s in PRICE.items()})
    # what entered the block itself moves its signal
    came = {k: F.coalesce(F.lag(f"__c_{k}").over(w), F.col(f"__y_{k}") if resumed else F.lit(0.0)) for k in ("ema12", "ema26")}
    end = F.lit(block - 1)
    moved = F.col("__l_signal") + came["ema12"] * _spread(PRICE["ema12"].decay, end) - came["ema26"] * _spread(PRICE["ema26"].decay, end)
    after = after.withColumn("__moved", moved).withColumn("__c_signal", gathered(F.col("__moved"), SIGNAL.decay, "signal"))
    return after.select(F.col("__es").alias("__cs"), (F.col("__eb") + 1).alias("__cb"), *[f"__c_{k}" for k in ALL])


def _smoothed(bars: DataFrame, order: str, block: int, resumed: bool) -> DataFrame:
    """Bars with __pos and a column __name for every smoothing."""
    if block < WARM:
        raise ValueError(f"a block must have {WARM} bars at least")
    rows = _within_blocks(_numbered(bars, order), block, resumed)
    kept = [c for c in rows.columns if c not in ("symbol", "__block")]
    # the blocks' last rows as whole rows: the same columns are asked for twice, so that both uses share one exchange
    ends = rows.groupBy(F.col("symbol").alias("__es"), F.col("__block").alias("__eb")).agg(F.max_by(F.struct(*kept), F.col("__pos")).alias("r")).where((F.col("r.__j") == block - 1) & (F.col("__eb") >= 0))
    ends = ends.select("__es", "__eb", *[F.col(f"r.__l_{k}").alias(f"__l_{k}") for k in ALL], *([F.col(f"r.__y_{k}").alias(f"__y_{k}") for k in ALL] if resumed else []))
    joined = rows.join(_entering(ends, block, resumed), F.col("symbol").eqNullSafe(F.col("__cs")) & (F.col("__block") == F.col("__cb")), "left")
    j = F.col("__j")
    first = (lambda k: F.when(F.col("__block") == 0, F.col(f"__y_{k}"))) if resumed else (lambda k: F.lit(None).cast("double"))
    came = {k: F.coalesce(F.col(f"__c_{k}"), first(k), F.lit(0.0)) for k in ALL}
    whole = {k: F.col(f"__l_{k}") + _power(s.decay, j + 1) * came[k] for k, s in ALL.items()}
    whole["signal"] = whole["signal"] + came["ema12"] * _spread(PRICE["ema12"].decay, j) - came["ema26"] * _spread(PRICE["ema26"].decay, j)
    there = (lambda s: F.col("__pos").isNotNull()) if resumed else (lambda s: F.col("__pos") >= s.seed)
    out = joined.withColumns({f"__{k}": F.when(there(s), whole[k]) for k, s in ALL.items()})
    return out.drop("__block", "__j", "__cs", "__cb", *[f"__{p}_{k}" for p in "lc" for k in ALL])


def _shown(smoothed: DataFrame) -> DataFrame:
    gain, loss = F.col("__gain"), F.col("__loss")
    rsi = F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    line = F.col("__ema12") - F.col("__ema26")
    shown = {"ema9": F.col("__ema9"), "ema21": F.col("__ema21"), "rsi14": rsi, "macd": line, "signal": F.col("__signal"), "histogram": line - F.col("__signal"), "atr14": F.col("__tr")}
    return smoothed.withColumns(shown)


def with_recursive(bars: DataFrame, order: str = "session", block: int = BLOCK) -> DataFrame:
    """Adds EMA 9 and 21, RSI 14, MACD (12, 26, 9) and ATR 14; null in warm-up.

    `order` is a date or time, unique by symbol.  A bar without high, low or close has no indicators and is passed over by the others'.
    """
    return _shown(_smoothed(bars.drop(*RECURSIVE), order, block, False)).drop("__pos", *[f"__{k}" for k in ALL])


def state(bars: DataFrame, order: str = "session", block: int = BLOCK) -> DataFrame:
    """(symbol, bars, last, close, values, head) after each symbol's bars: how many, the last one's time and close, its smoothed values;
    head has the bars themselves, in order, while there are fewer than WARM, and is empty afterwards."""
    return stored(_state(_smoothed(bars.drop(*RECURSIVE), order, block, False), order, F.lit(0)))


def _state(smoothed: DataFrame, order: str, known: Column) -> DataFrame:
    s = smoothed.where("__pos is not null")
    values = F.struct(*[F.col(f"__{k}").alias(k) for k in ALL])
    bar = F.struct(F.col(order).alias("at"), "high", "low", "close")
    early = F.collect_list(F.when(F.col("__pos") < WARM, bar))  # WARM rows at most
    g = s.withColumn("__known", known).groupBy("symbol").agg((F.max("__pos") + 1 + F.max("__known")).alias("bars"), F.max(order).alias("last"), F.max_by("close", order).alias("close"), F.max_by(values, order).alias("values"), F.array_sort(early).alias("head"))
    return g.withColumn("head", F.when(F.col("bars") < WARM, F.col("head")).otherwise(F.slice("head", 1, 0)))


def extend(before: DataFrame, bars: DataFrame, order: str = "session", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The new bars with their indicators, and the state after them, which is stored.

    New bars must be later than the state's last one; earlier or equal ones are left out, so a batch may come twice.  Symbols that the
    state does not know begin anew; those without new bars keep their state."""
    kept = before.select(F.col("symbol").alias("__k"), F.col("bars").alias("__bars"), F.col("last").alias("__last"), F.col("close").alias("__close"), F.col("values").alias("__values"))
    j = bars.drop(*RECURSIVE).join(kept, F.col("symbol").eqNullSafe(F.col("__k")), "left").where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__k")
    warm = F.coalesce(F.col("__bars") >= WARM, F.lit(False))
    resumed = j.where(warm).withColumns({f"__y_{k}": F.col(f"__values.{k}") for k in ALL})
    on = _smoothed(resumed, order, block, True)
    # short histories are run again from their first bar: WARM bars a symbol at most
    short = before.where(F.col("bars") < WARM).select("symbol", F.explode("head").alias("h"))
    fresh = j.where(~warm).drop("__bars", "__last", "__close", "__values")
    old = short.select("symbol", *[F.col("h.at" if c == order else f"h.{c}").alias(c) for c in (order, "high", "low", "close")])
    both = fresh.withColumn("__new", F.lit(True)).unionByName(old.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    anew = _smoothed(both, order, block, False)
    plain = lambda df: _shown(df).drop("__pos", "__new", "__bars", "__last", "__close", "__values", *[f"__{k}" for k in ALL], *[f"__y_{k}" for k in ALL])
    rows = plain(on).unionByName(plain(anew.where("__new")))
    moved = _state(on, order, F.col("__bars")).unionByName(_state(anew, order, F.lit(0)))
    moved = moved.withColumn("head", F.when(F.col("bars") < WARM, F.col("head")).otherwise(F.slice("head", 1, 0)))
    still = before.join(moved.select(F.col("symbol").alias("__m")), F.col("symbol").eqNullSafe(F.col("__m")), "left_anti")
    return rows, stored(still.unionByName(moved))  # one row a symbol
