"""Stored news as it is read: scores, cursors, grouped pages, exchange-local months; coverage of bars; lists that outlive a failed build.

Times are UTC without zone.  All are joins and grouped aggregates; no row goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.alignment import bucket_of
from tickloom.operators.upkeep import append_similar, dedupe_last


def to_zone(ts: Column, zone: str) -> Column:
    """A zone's wall clock at a UTC time, summer time included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def from_zone(local: Column, zone: str) -> Column:
    """The UTC time of a zone's wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def local_month(ts: Column, zone: str) -> Column:
    """The month (yyyy-MM) that a zone's calendar shows at a UTC time."""
    return F.date_format(to_zone(ts, zone), "yyyy-MM")


def month_bounds(month: Column, zone: str, *, since: Column, now: Column) -> Column:
    """STRUCT<start, end>: the UTC bounds of a zone's month (yyyy-MM), starting at `since` at the earliest.  Null for other text and for
    months that end by `since` or begin after `now`."""
    day = F.when(month.rlike(r"\A[0-9]{4}-(0[1-9]|1[0-2])\z"), F.concat(month, F.lit("-01"))).try_cast("date")
    start, end = from_zone(day.cast("timestamp_ntz"), zone), from_zone(F.add_months(day, 1).cast("timestamp_ntz"), zone)
    return F.when((end > since) & (start <= now), F.struct(F.greatest(start, since).alias("start"), end.alias("end")))


def scored(articles: DataFrame, *, start: Column, end: Column) -> DataFrame:
    """Scored articles published in [start, end] that are not of low value; an unknown flag counts as not set."""
    return articles.where(F.col("score").isNotNull() & F.col("published_at").between(start, end) & ~F.coalesce("low_value", F.lit(False)))


def unscored(articles: DataFrame) -> DataFrame:
    """(key, text) of articles without a score: title and summary."""
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit(""))))
    return articles.where("score is null").select("key", text.alias("text"))


def score_with(texts: DataFrame, scorer: Callable[[Column], Column], version: str) -> DataFrame:
    """(key, score, model_version): the caller's scorer maps a text column to a score between -1 and 1."""
    return texts.select("key", scorer(F.col("text")).cast("double").alias("score"), F.lit(version).alias("model_version"))


def save_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """articles with score and model_version of scores (key, score, model_version).  Of several rows of one key the highest version, then
    the highest score counts; other articles keep theirs, and keys without an article are passed over."""
    new = dedupe_last(scores.select("key", "score", "model_version"), ["key"], ["model_version", "score"])
    new = new.select(F.col("key").alias("__key"), F.col("score").alias("__score"), F.col("model_version").alias("__version"))
    found = F.col("__key").isNotNull()
    joined = articles.join(new, F.col("key") == F.col("__key"), "left")
    renewed = {"score": F.when(found, F.col("__score")).otherwise(F.col("score")), "model_version": F.when(found, F.col("__version")).otherwise(F.col("model_version"))}
    return joined.withColumns(renewed).select(*articles.columns)


def encode_cursor(at: Column, key: Column) -> Column:
    """A page position as URL-safe base64, without padding, of {"t": time, "k": key}."""
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(stamp.alias("t"), key.alias("k"))).cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column, *, now: Column, earliest: str = "2000-01-01") -> Column:
    """STRUCT<published_at, key> of a cursor.  Null if it is damaged, has other fields, an empty key or a time without zone, or if its time
    is before `earliest` or more than a day after `now`."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.concat(plain, F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(plain), F.lit(4))))
    raw = F.try_to_binary(padded, F.lit("base64")).cast("string")
    got = F.from_json(raw, "t string, k string")
    whole = F.array_sort(F.json_object_keys(raw)) == F.array(F.lit("k"), F.lit("t"))
    moment = F.try_to_timestamp(F.when(got["t"].rlike(r"T.*(Z|[+-]\d\d:\d\d)$"), got["t"]))
    seconds = (F.unix_micros(moment).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    ok = whole & (got["k"] != "") & at.between(F.lit(earliest).cast("timestamp_ntz"), now + F.expr("INTERVAL 1 DAY"))
    return F.when(ok, F.struct(at.alias("published_at"), got["k"].alias("key")))


def group_page(rows: DataFrame, page: list[str]) -> DataFrame:
    """One row for each page and head (neither null): key, published_at and title of its newest article, the mean score of its articles,
    the label, and similar: its other articles and the look-alikes recorded on any of them, newest first, each once.

    rows has the page's columns, head, key, published_at, title, score and similar (published_at, dup_key, title).  A look-alike that
    the page shows as a row of its own is left out.  A group is at most a page with ten look-alikes a row."""
    on = [*page, "head"]
    main = rows.groupBy(*on).agg(F.max_by(F.struct("key", "published_at", "title"), F.struct("published_at", "key")).alias("main"), F.avg("score").alias("score"))
    member = [*on, F.col("published_at").alias("m_at"), F.col("key").alias("m_key")]
    own = rows.select(*member, F.lit(1).alias("own"), F.col("key").alias("dup_key"), "published_at", "title")
    told = rows.select(*member, F.explode("similar").alias("s")).select(*on, "m_at", "m_key", F.lit(0).alias("own"), "s.dup_key", "s.published_at", "s.title")
    told = told.join(rows.select(*page, F.col("key").alias("dup_key")), [*page, "dup_key"], "left_anti")
    once = own.unionByName(told).groupBy(*on, "dup_key").agg(F.max_by(F.struct("published_at", "title"), F.struct("own", "m_at", "m_key", "published_at", "title")).alias("s"))
    others = once.join(main.select(*on, F.col("main.key").alias("__main")), on).where("dup_key <> __main")
    listed = others.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("s.published_at", "dup_key", "s.title")), asc=False).alias("similar"))
    label = F.coalesce(bucket_of(F.col("score")), F.lit("not_scored"))
    none = F.array().cast(listed.schema["similar"].dataType)
    return main.join(listed, on, "left").select(*on, "main.key", "main.published_at", "main.title", "score", label.alias("label"), F.coalesce("similar", none).alias("similar"))


def fold_into(articles: DataFrame, moves: DataFrame, most: int = 10) -> DataFrame:
    """articles without those that moves (key, head) folds into another article, which takes over their look-alikes and lists them too.

    A key moves once, and a head does not move itself.  The list is cut to the newest `most`; keys and count are whole."""
    to = moves.select(F.col("key").alias("__key"), "head")
    gone = articles.join(to, F.col("key") == F.col("__key"))
    own = gone.select("head", F.col("key").alias("dup_key"), "published_at", "title")
    theirs = gone.select("head", F.explode("similar").alias("s")).select("head", "s.dup_key", "s.published_at", "s.title")
    stay = articles.join(moves.select("key"), "key", "left_anti").select(*articles.columns)
    shown = append_similar(stay, own.unionByName(theirs).where("dup_key <> head"), most)
    more = gone.select(F.col("head").alias("__head"), F.explode("similar_keys").alias("k")).where("k <> __head").groupBy("__head").agg(F.collect_set("k").alias("__more"))
    keys = F.array_sort(F.array_union("similar_keys", F.coalesce("__more", F.array().cast("array<string>"))))
    joined = shown.join(more, F.col("key") == F.col("__head"), "left").withColumn("similar_keys", keys)
    return joined.withColumn("similar_count", F.size("similar_keys")).select(*articles.columns)


def widen_coverage(state: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """State after a fetch, of (keys, covered_start, last_bar_at, last_fetched_at): the covered span only grows, the newest bar only moves
    forward.  A fetch without bars has a null last_bar_at, which changes nothing."""
    both = state.unionByName(fetched.select(*state.columns))
    return both.groupBy(*keys).agg(F.min("covered_start").alias("covered_start"), F.max("last_bar_at").alias("last_bar_at"), F.max("last_fetched_at").alias("last_fetched_at"))


def keep_stale(built: DataFrame, old: DataFrame, *, now: Column, keep_days: int) -> DataFrame:
    """(id, rows, state, as_of) of each list in built (id, rows, complete).  rows is null where the build failed: the old list (id, rows,
    as_of) then stays as stale for keep_days, and after that, or where it is empty, the list is empty and unavailable."""
    was = old.select(F.col("id").alias("__id"), F.col("rows").alias("__rows"), F.col("as_of").alias("__as_of"))
    made, usable = F.col("rows").isNotNull(), (F.size("__rows") > 0) & (F.col("__as_of") >= now - F.make_dt_interval(days=F.lit(keep_days)))
    joined = built.join(was, F.col("id") == F.col("__id"), "left")
    state = F.when(made & F.col("complete"), "ok").when(made | usable, "stale").otherwise("unavailable")
    none = F.array().cast(built.schema["rows"].dataType)
    rows = F.when(made, F.col("rows")).when(usable, F.col("__rows")).otherwise(none)
    return joined.select("id", rows.alias("rows"), state.alias("state"), F.when(made, now).when(usable, F.col("__as_of")).alias("as_of"))
