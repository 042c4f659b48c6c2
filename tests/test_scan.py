"""The scan against the recursion, bar by bar."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import scan


def smooth(x, n, alpha):
    start = next((i for i, v in enumerate(x) if v is not None), len(x))
    out = [None] * len(x)
    if start + n <= len(x):
        out[start + n - 1] = sum(x[start : start + n]) / n
        for i in range(start + n, len(x)):
            out[i] = out[i - 1] + alpha * (x[i] - out[i - 1])
    return out


def ema(x, n):
    return smooth(x, n, 2 / (n + 1))


def rsi(close, n=14):
    delta = [None, *[b - a for a, b in zip(close, close[1:], strict=False)]]
    gain, loss = (smooth([None if d is None else max(0.0, s * d) for d in delta], n, 1 / n) for s in (1, -1))
    return [None if g is None else (50.0 if g == 0 else 100.0) if x == 0 else 100 - 100 / (1 + g / x) for g, x in zip(gain, loss, strict=True)]


def true_range(high, low, close):
    return [h - x if i == 0 else max(h - x, abs(h - close[i - 1]), abs(x - close[i - 1])) for i, (h, x) in enumerate(zip(high, low, strict=True))]


def recursion(rows):
    """rows (high, low, close) of a symbol in order -> the seven indicators of every row."""
    minus = lambda a, b: [None if p is None or q is None else p - q for p, q in zip(a, b, strict=True)]
    high, low, close = ([r[i] for r in rows] for i in range(3))
    line = minus(ema(close, 12), ema(close, 26))
    signal = ema(line, 9)
    return list(zip(ema(close, 9), ema(close, 21), rsi(close), line, signal, minus(line, signal), smooth(true_range(high, low, close), 14, 1 / 14), strict=True))


def test_recursions_by_hand():
    near = lambda a, b: [None if x is None else round(x, 6) for x in a] == b
    assert near(ema([1, 2, 3, 4, 8, 2.0], 3), [None, None, 2, 3, 5.5, 3.75])
    assert near(rsi([10, 11, 10.5, 11.5, 11, 12, 11], 3)[3:], [80, 61.538462, 77.272727, 47.887324])
    h, low, c = [10, 11, 12, 11.5, 13], [9, 10, 10.5, 10, 11.0], [9.5, 10.5, 11, 11, 12.5]
    assert near(true_range(h, low, c), [1, 1.5, 1.5, 1.5, 2])
    assert near(smooth(true_range(h, low, c), 3, 1 / 3)[2:], [1.333333, 1.388889, 1.592593])


def made(lengths, seed=1):
    rnd, rows = random.Random(seed), []
    for symbol, n in lengths.items():
        price = 100.0
        for i in range(n):
            price = max(1.0, price + (0 if symbol == "flat" else rnd.gauss(0, 2)))
            rows.append((symbol, datetime.date(2015, 1, 1) + datetime.timedelta(days=i * 3), price + (symbol != "flat") * rnd.random(), price - (symbol != "flat") * rnd.random(), price))
    rnd.shuffle(rows)
    return rows


SCHEMA = "symbol string, session date, high double, low double, close double"
LENGTHS = {"a": 300, "b": 1, "c": 34, "d": 33, "e": 35, "f": 14, "flat": 80, "g": 64, "h": 128, "i": 129, None: 40}


def by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def wanted(rows):
    return {(s, r[1]): v for s, own in by_symbol(rows).items() for r, v in zip(own, recursion([x[2:5] for x in own]), strict=True)}


def same(df, want):
    got = {(r.symbol, r.session): tuple(r[c] for c in scan.RECURSIVE) for r in df.collect()}
    assert set(got) == set(want)
    for k, values in want.items():
        for g, w in zip(got[k], values, strict=True):
            assert (g is None) == (w is None), k
            assert g is None or g == pytest.approx(w, rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("block", [40, 1024])
def test_equals_the_recursion(spark, block):
    rows = made(LENGTHS)
    same(scan.with_recursive(spark.createDataFrame(rows, SCHEMA), block=block), wanted(rows))


def test_no_python_in_the_plan(spark, capsys):
    scan.with_recursive(spark.createDataFrame(made({"a": 50}), SCHEMA)).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_blocks_too_short_for_the_warm_up(spark):
    with pytest.raises(ValueError):
        scan.with_recursive(spark.createDataFrame([], SCHEMA), block=20)


def test_bars_without_prices_are_passed_over(spark):
    rows = made({"a": 60})
    holes = [("a", datetime.date(2014, 1, 1), None, 1.0, 1.0), ("a", datetime.date(2015, 2, 1), 2.0, 1.0, None), ("z", datetime.date(2015, 2, 1), None, None, None)]
    got = scan.with_recursive(spark.createDataFrame(rows + holes, SCHEMA).withColumn("volume", F.lit(1)), block=40)
    same(got, wanted(rows) | {(r[0], r[1]): (None,) * 7 for r in holes})


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scan.with_recursive(empty).count() == 0
    rows, state = scan.extend(scan.state(empty), empty)
    assert rows.count() == 0 and state.count() == 0


@pytest.mark.parametrize("days", [30, 300])
def test_extending_a_state_equals_the_full_run(spark, days):
    rows = made(LENGTHS | {"later": 70})
    cut = datetime.date(2015, 1, 1) + datetime.timedelta(days=days)
    first = [r for r in rows if r[1] < cut and r[0] != "later"]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    full = wanted(rows)
    state = scan.state(df(first), block=64)
    second = [r for r in rows if r not in first and r[1] < cut + datetime.timedelta(days=200)]
    got, state = scan.extend(state, df(second + first[:20]), block=64)  # some bars come again
    same(got, {k: v for k, v in full.items() if k in {(r[0], r[1]) for r in second}})
    third = [r for r in rows if r not in first and r not in second]
    got, state = scan.extend(state, df(third), block=64)
    same(got, {k: v for k, v in full.items() if k in {(r[0], r[1]) for r in third}})
    assert {r.symbol: r.bars for r in state.collect()} == LENGTHS | {"later": 70}
    assert all((len(r.head) == r.bars) == (r.bars < scan.WARM) for r in state.collect())
