"""Candlestick patterns as predicates over lagged candles, their reliability and the weighted outlook."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import by_symbol, sign_with_tolerance, wilson
from tickloom.functions.storage import stored
from tickloom.operators.indicators import with_anchored_vwap, with_ema_cross, with_forward_return, with_trend
from tickloom.operators.scan import with_recursive

#: key, bias, candles, trends allowed before the first candle (None: any, also unknown); fixed values, in registry order.
SPECS = [
    ("doji", "neutral", 1, None),
    ("hammer", "bullish", 1, ("down",)),
    ("hanging_man", "bearish", 1, ("up",)),
    ("inverted_hammer", "bullish", 1, ("down",)),
    ("shooting_star", "bearish", 1, ("up",)),
    ("bullish_engulfing", "bullish", 2, ("down",)),
    ("bearish_engulfing", "bearish", 2, ("up",)),
    ("bullish_harami", "bullish", 2, ("down",)),
    ("bearish_harami", "bearish", 2, ("up",)),
    ("piercing_line", "bullish", 2, ("down",)),
    ("dark_cloud_cover", "bearish", 2, ("up",)),
    ("morning_star", "bullish", 3, ("down",)),
    ("evening_star", "bearish", 3, ("up",)),
    ("three_white_soldiers", "bullish", 3, ("down", "none")),
    ("three_black_crows", "bearish", 3, ("up", "none")),
]


def label(key: Column) -> Column:
    """A pattern's name to show."""
    words = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


class Candle:
    """Expressions of the candle `back` rows ago."""

    def __init__(self, back: int, w) -> None:
        get = (lambda c: F.lag(c, back).over(w)) if back else F.col
        self.o, self.h, self.l, self.c = (get(x) for x in ("open", "high", "low", "close"))
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.body, self.range = F.abs(self.c - self.o), self.h - self.l
        self.upper, self.lower = self.h - self.top, self.bottom - self.l
        self.bull, self.bear, self.mid = self.c > self.o, self.c < self.o, (self.o + self.c) / 2


def _rules(w) -> dict[str, Column]:
    """Each pattern's shape with its last candle at the row; sizes are against the ATR known before the first candle."""
    z, b, a = Candle(0, w), Candle(1, w), Candle(2, w)
    atr = [F.lag("atr14", k).over(w) for k in (1, 2, 3)]
    both = lambda *x: reduce(lambda p, q: p & q, x)
    long_ = lambda c, k: c.body >= 0.5 * atr[k]
    hammer = both(z.body > 0.1 * z.range, z.lower >= 2 * z.body, z.upper <= 0.1 * z.range)
    inverted = both(z.body > 0.1 * z.range, z.upper >= 2 * z.body, z.lower <= 0.1 * z.range)
    engulfs = both(z.body > b.body, z.body >= 0.3 * atr[1])
    inside = both(long_(b, 1), z.top <= b.top, z.bottom >= b.bottom, z.body < b.body)
    star = both(long_(a, 2), b.body <= 0.3 * a.body)
    rows3 = lambda side, shadow: both(*[both(getattr(x, side), long_(x, 2), getattr(x, shadow) <= 0.3 * x.body) for x in (a, b, z)])
    opens = lambda p, x: both(x.o >= p.bottom, x.o <= p.top)
    return {
        "doji": both(z.range > 0, z.body <= 0.1 * z.range, z.range >= 0.3 * atr[0]),
        "hammer": hammer,
        "hanging_man": hammer,
        "inverted_hammer": inverted,
        "shooting_star": inverted,
        "bullish_engulfing": both(b.bear, z.bull, z.o <= b.c, z.c >= b.o, engulfs),
        "bearish_engulfing": both(b.bull, z.bear, z.o >= b.c, z.c <= b.o, engulfs),
        "bullish_harami": both(b.bear, z.bull, inside),
        "bearish_harami": both(b.bull, z.bear, inside),
        "piercing_line": both(b.bear, long_(b, 1), z.bull, z.o <= b.c, z.c > b.mid, z.c < b.o),
        "dark_cloud_cover": both(b.bull, long_(b, 1), z.bear, z.o >= b.c, z.c < b.mid, z.c > b.o),
        "morning_star": both(a.bear, star, b.mid < a.c, z.bull, z.c > a.mid),
        "evening_star": both(a.bull, star, b.mid > a.c, z.bear, z.c < a.mid),
        "three_white_soldiers": both(rows3("bull", "upper"), b.c > a.c, z.c > b.c, opens(a, b), opens(b, z)),
        "three_black_crows": both(rows3("bear", "lower"), b.c < a.c, z.c < b.c, opens(a, b), opens(b, z)),
    }


def prepare(bars: DataFrame) -> DataFrame:
    """Bars with position, trend, recursive indicators and forward return: what every technical operator reads."""
    w = by_symbol()
    return with_forward_return(with_trend(with_recursive(bars))).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def analysed(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prepared bars and the hits in them, both stored: what reads them several times neither folds nor scans again."""
    p = stored(prepare(bars))
    return p, stored(detect(p))


def detect(prepared: DataFrame, candles: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(symbol, session, pos, key, bias, forward_return): one row per hit; unknown values never match."""
    w = by_symbol()
    rules, found = _rules(w), []
    for i, (key, bias, n, need) in enumerate(SPECS):
        if n in candles:
            trend = F.lag("trend", n - 1).over(w) if n > 1 else F.col("trend")
            hit = rules[key] if need is None else rules[key] & trend.isin(*need)
            found.append(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(i).alias("place"), F.lit(key).alias("key"), F.lit(bias).alias("bias"))))
    flagged = prepared.select("symbol", "session", "pos", "forward_return", F.array_compact(F.array(*found)).alias("hits"))
    return flagged.select("symbol", "session", "pos", "forward_return", F.explode("hits").alias("h")).select("symbol", "session", "pos", "h.key", "h.bias", "forward_return")


def thin(hits: DataFrame, horizon: int = 5) -> DataFrame:
    """Hits that count: those with a return, each at least `horizon` bars after the last that counted, by symbol and pattern.

    A fold over the sorted positions of a symbol's pattern, bounded by the symbol's history."""
    rows = hits.where("forward_return is not null").groupBy("symbol", "key", "bias").agg(F.sort_array(F.collect_list(F.struct("pos", "forward_return"))).alias("all"))
    empty = F.array().cast("array<struct<pos:bigint,forward_return:double>>")
    kept = F.aggregate("all", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x["pos"] - F.element_at(acc, -1)["pos"] >= horizon), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select("symbol", "key", "bias", F.explode(kept).alias("k")).select("symbol", "key", "bias", "k.pos", F.col("k.forward_return").alias("forward_return"))


def base_rates(prepared: DataFrame) -> DataFrame:
    """(symbol, key, base_up, base_down, base_n): shares of rising and falling weeks among bars in the pattern's trend context."""
    known = prepared.where("forward_return is not null").groupBy("symbol", "trend").agg(F.count_if(F.col("forward_return") > 0).alias("up"), F.count_if(F.col("forward_return") < 0).alias("down"), F.count("*").alias("n"))
    spec = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, need)).alias("need") if need else F.lit(None).cast("array<string>").alias("need")) for k, _, _, need in SPECS]))
    # four trend rows a symbol meet fifteen patterns: the table stays tiny
    rows = known.select("symbol", "trend", "up", "down", "n", spec.alias("s")).where(F.col("s.need").isNull() | F.coalesce(F.array_contains("s.need", F.col("trend")), F.lit(False)))
    return rows.groupBy("symbol", F.col("s.key").alias("key")).agg((F.sum("up") / F.sum("n")).alias("base_up"), (F.sum("down") / F.sum("n")).alias("base_down"), F.sum("n").alias("base_n"))


def reliability(prepared: DataFrame, hits: DataFrame, min_samples: int = 15) -> DataFrame:
    """One row per symbol and pattern that occurred: counts, rates, Wilson bounds, returns, base rates, edge, sufficient."""
    thinned = thin(hits).groupBy("symbol", "key").agg(F.count("*").alias("n"), F.count_if(F.col("forward_return") > 0).alias("up_count"), F.count_if(F.col("forward_return") < 0).alias("down_count"), F.avg("forward_return").alias("mean_return"), F.median("forward_return").alias("median_return"))
    s = hits.select("symbol", "key", "bias").distinct().join(thinned, ["symbol", "key"], "left").join(base_rates(prepared), ["symbol", "key"], "left")
    s = s.fillna(0, subset=["n", "up_count", "down_count"])
    s = s.withColumn("success_count", F.when(F.col("bias") == "bullish", F.col("up_count")).when(F.col("bias") == "bearish", F.col("down_count")))
    s = s.withColumn("base_rate", F.when(F.col("bias") == "bullish", F.col("base_up")).when(F.col("bias") == "bearish", F.col("base_down")))
    low, high = wilson(F.col("success_count"), F.col("n"))
    known = F.col("success_count").isNotNull() & (F.col("n") > 0)
    s = s.withColumns({"hit_rate": F.when(known, F.col("success_count") / F.nullif("n", F.lit(0))), "wilson_low": F.when(known, low), "wilson_high": F.when(known, high)})
    return s.withColumn("edge", F.col("hit_rate") - F.col("base_rate")).withColumn("sufficient", F.col("n") >= min_samples).drop("down_count")


def sentence(min_samples: int = 15) -> Column:
    """A pattern's record in words, from columns bias, n, hit_rate, base_rate and sufficient: wording of ours."""
    rate = lambda c: F.concat(F.bround(F.col(c) * 100).cast("int"), F.lit("%"))
    way = F.when(F.col("bias") == "bullish", "higher").otherwise("lower")
    known = F.concat(F.lit("Closed "), way, F.lit(" a week later in "), rate("hit_rate"), F.lit(" of "), F.col("n"), F.lit(" cases, against "), F.coalesce(rate("base_rate"), F.lit("an unknown share")), F.lit(" of comparable days"))
    few = F.concat(F.lit("Seen "), F.coalesce("n", F.lit(0)), F.when(F.col("n") == 1, F.lit(" time")).otherwise(F.lit(" times")), F.lit(f", too few to judge (fewer than {min_samples})"))
    return F.when(~F.coalesce("sufficient", F.lit(False)), few).when(F.col("bias") == "neutral", F.concat(F.lit("Seen "), F.col("n"), F.lit(" times; it points neither way"))).otherwise(known)


def recent(prepared: DataFrame, hits: DataFrame, stats: DataFrame, sessions: int = 3) -> DataFrame:
    """Hits of each symbol's last sessions with their pattern's statistics, and how long ago they were."""
    last = prepared.groupBy("symbol").agg(F.max("pos").alias("last_pos"))
    r = hits.join(last, "symbol").withColumn("sessions_ago", F.col("last_pos") - F.col("pos")).where(F.col("sessions_ago") < sessions)
    return r.drop("last_pos", "forward_return").join(stats.drop("bias"), ["symbol", "key"], "left")


def last_bars(prepared: DataFrame) -> DataFrame:
    """Each symbol's last bar with EMA side and fresh cross, VWAP anchored at the fifth-last bar, and the histogram's change."""
    w = by_symbol()
    last = prepared.groupBy("symbol").agg(F.max("pos").alias("last_pos"))
    anchored = prepared.join(last, "symbol").withColumn("__anchor", F.greatest(F.col("last_pos") - 4, F.lit(0)))
    b = with_anchored_vwap(with_ema_cross(anchored), F.col("__anchor"), "pos")
    return b.withColumn("prev_histogram", F.lag("histogram").over(w)).where(F.col("pos") == F.col("last_pos")).drop("__anchor")


def outlook(prepared: DataFrame, recent_hits: DataFrame) -> DataFrame:
    """One row per symbol: weighted signals, score, lean, expected range."""
    credible = F.col("sufficient") & F.col("base_rate").isNotNull() & (F.col("wilson_low") > F.col("base_rate")) & (F.col("bias") != "neutral")
    strength = F.least((F.col("hit_rate") - F.col("base_rate")) / 0.2, F.lit(1.0)) * F.when(F.col("bias") == "bullish", 1).otherwise(-1)
    pattern = recent_hits.groupBy("symbol").agg(F.avg(F.when(credible, strength)).alias("pattern_mean"))
    b = last_bars(prepared).join(pattern, "symbol", "left")
    tie = lambda x, scale: sign_with_tolerance(x, scale)
    mean = F.coalesce("pattern_mean", F.lit(0.0))
    signal = lambda key, d, weight: F.struct(F.lit(key).alias("key"), d.cast("int").alias("direction"), weight.cast("double").alias("weight"))
    when = lambda known, s: F.when(known, s)
    signals = F.array_compact(
        F.array(
            signal("patterns", F.signum(mean), F.abs(mean)),
            when(F.col("rsi14").isNotNull(), signal("rsi14", F.when(F.col("rsi14") > 70, -1).when(F.col("rsi14") < 30, 1).otherwise(0), F.lit(0.75))),
            when(F.col("ema_side").isNotNull(), signal("ema_cross", F.col("ema_side"), F.lit(0.75))),
            when(F.col("vwap").isNotNull(), signal("vwap", tie(F.col("close") - F.col("vwap"), F.col("vwap")), F.lit(0.5))),
            when(F.col("prev_histogram").isNotNull() & F.col("histogram").isNotNull(), signal("macd_momentum", tie(F.col("histogram") - F.col("prev_histogram"), F.col("close")), F.lit(0.5))),
        )
    )
    total = F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["weight"])
    net = F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["weight"] * s["direction"])
    o = b.withColumn("signals", signals).withColumn("score", F.coalesce(F.try_divide(net, total), F.lit(0.0)))
    lean = F.when(F.col("score") >= 0.25, "bullish").when(F.col("score") <= -0.25, "bearish").otherwise("neutral")
    spread = F.col("atr14") * 5**0.5
    return o.select("symbol", F.col("session").alias("as_of"), F.col("close").alias("last_close"), lean.alias("lean"), "score", "signals", (F.col("close") - spread).alias("range_low"), (F.col("close") + spread).alias("range_high"), "fresh_cross")


def technical_report(bars: DataFrame) -> DataFrame:
    """The technical analysis of every symbol: outlook, patterns of the last three sessions newest first, else the latest older one."""
    p, hits = analysed(bars)
    stats = stored(reliability(p, hits))  # a row for each symbol and pattern
    rec = stored(recent(p, hits, stats))
    listed = rec.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("order"), "key", "bias", "session", "n", "hit_rate", "base_rate", "edge", "sufficient"))).alias("recent_patterns"))
    places = F.create_map(*[x for i, (key, *_) in enumerate(SPECS) for x in (F.lit(key), F.lit(-i))])  # of a session's hits the first in the registry is shown
    older = hits.groupBy("symbol").agg(F.max(F.struct("pos", F.element_at(places, F.col("key")).alias("place"), "session", "key", "bias")).alias("latest"))
    ends = p.groupBy("symbol").agg(F.max("pos").alias("last_pos"))
    o = outlook(p, rec).join(listed, "symbol", "left").join(older, "symbol", "left").join(ends, "symbol", "left")
    latest = F.struct(F.col("latest.session").alias("date"), F.col("latest.key").alias("key"), label(F.col("latest.key")).alias("label"), F.col("latest.bias").alias("bias"), (F.col("last_pos") - F.col("latest.pos")).alias("sessions_ago"))
    shown = F.when(F.col("recent_patterns").isNull() & F.col("latest").isNotNull(), latest)
    return o.withColumn("latest_pattern", shown).drop("latest", "last_pos").withColumn("expected_range_coverage", F.lit(0.9))
