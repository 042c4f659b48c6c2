"""Stored news as it is read: hand values, nulls, ties and damaged input."""

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from tickloom.operators import reading as R

T = dt.datetime


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_cursors_are_refused_unless_whole(spark):
    def made(data):
        return base64.urlsafe_b64encode(json.dumps(data).encode()).decode().rstrip("=")

    good = {"t": "2024-05-06T09:08:07.000006+02:00", "k": "a?>~é"}
    bad = [{**good, "x": 1}, {"t": good["t"]}, {**good, "k": ""}, {**good, "t": "2024-05-06T09:08:07"}, {**good, "t": "1999-12-31T00:00:00+00:00"}, {**good, "t": "2025-01-03T00:00:01+00:00"}, {**good, "t": "soon"}]
    rows = [(made(good),), *[(made(b),) for b in bad], ("%%%",), ("",), (None,), ("a",)]
    got = [r.p for r in spark.createDataFrame(rows, "c string").select(R.decode_cursor(F.col("c"), now=at("2025-01-02")).alias("p")).collect()]
    assert (got[0].published_at, got[0].key) == (T(2024, 5, 6, 7, 8, 7, 6), "a?>~é")
    assert got[1:] == [None] * (len(rows) - 1)


def test_months_follow_the_exchange(spark):
    rows = [("2024-03",), ("2024-11",), ("2024-01",), ("2023-12",), ("2025-02",), ("2024-13",), ("24-01",), ("2024-01\n",), (None,)]
    w = R.month_bounds(F.col("m"), "America/New_York", since=at("2024-01-10"), now=at("2025-01-31"))
    got = [r.w and tuple(r.w) for r in spark.createDataFrame(rows, "m string").select(w.alias("w")).collect()]
    assert got[0] == (T(2024, 3, 1, 5), T(2024, 4, 1, 4)) and got[1] == (T(2024, 11, 1, 4), T(2024, 12, 1, 5))
    assert got[2] == (T(2024, 1, 10), T(2024, 2, 1, 5)) and got[3:] == [None] * 6
    months = spark.sql("SELECT explode(array(timestamp_ntz '2024-07-01 03:59:59', timestamp_ntz '2024-07-01 04:00:00')) AS t").select(R.local_month(F.col("t"), "America/New_York").alias("m"))
    assert [r.m for r in months.collect()] == ["2024-06", "2024-07"]


def test_scores_are_merged(spark):
    a = spark.createDataFrame([("a", None, None), ("b", 0.5, "v1"), ("c", None, None)], "key string, score double, model_version string")
    s = spark.createDataFrame([("a", 0.1, "v1"), ("a", 0.2, "v2"), ("a", 0.2, "v2"), ("z", 1.0, "v2")], "key string, score double, model_version string")
    assert sorted(map(tuple, R.save_scores(a, s).collect()), key=str) == [("a", 0.2, "v2"), ("b", 0.5, "v1"), ("c", None, None)]
    assert R.save_scores(a, s.limit(0)).count() == 3 and R.save_scores(a.limit(0), s).count() == 0
    texts = spark.createDataFrame([("a", None, None, None), ("b", "T", "s", None), ("c", "T", "s", 0.1)], "key string, title string, summary string, score double")
    assert sorted(map(tuple, R.unscored(texts).collect())) == [("a", "."), ("b", "T. s")]


def test_page_shows_each_story_once(spark):
    d = lambda n: T(2024, 1, n)
    rows = [
        ("p", "h", "new", d(5), "New", 0.9, [(d(1), "x", "X of new"), (d(2), "other", "shown as a row")]),
        ("p", "h", "old", d(4), "Old", None, [(d(3), "x", "X of old"), (d(3), "new", "the head itself")]),
        ("p", "g", "other", d(2), "Other", None, None),
    ]
    schema = "page string, head string, key string, published_at timestamp_ntz, title string, score double, similar array<struct<published_at: timestamp_ntz, dup_key: string, title: string>>"
    page = spark.createDataFrame(rows, schema)
    got = {r.head: r for r in R.group_page(page, ["page"]).collect()}
    assert (got["h"].key, got["h"].score, got["h"].label) == ("new", 0.9, "positive")
    assert [(s.dup_key, s.title) for s in got["h"].similar] == [("old", "Old"), ("x", "X of new")]
    assert (got["g"].score, got["g"].label, got["g"].similar) == (None, "not_scored", [])
    assert R.group_page(page.limit(0), ["page"]).count() == 0


def test_failed_lists_keep_their_rows_for_a_while(spark):
    built = spark.createDataFrame([(1, ["n"], True), (2, ["n"], False), (3, None, None), (4, None, None), (5, None, None), (6, [], True)], "id int, rows array<string>, complete boolean")
    old = spark.createDataFrame([(3, ["o"], T(2024, 1, 3)), (4, ["o"], T(2024, 1, 2, 23)), (1, ["o"], T(2024, 1, 9))], "id int, rows array<string>, as_of timestamp_ntz")
    got = {r.id: (r.rows, r.state, r.as_of) for r in R.keep_stale(built, old, now=at("2024-01-10"), keep_days=7).collect()}
    now = T(2024, 1, 10)
    assert got == {1: (["n"], "ok", now), 2: (["n"], "stale", now), 3: (["o"], "stale", T(2024, 1, 3)), 4: ([], "unavailable", None), 5: ([], "unavailable", None), 6: ([], "ok", now)}
