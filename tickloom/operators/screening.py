"""Screener lists, news pages, overview rows, tables and markers: filters, keyset pages and top lists over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.storage import stored


@dataclass(frozen=True)
class Preset:
    """A screener list; bounds are inclusive."""

    region: str
    min_cap: float
    max_cap: float
    min_volume: float
    rank: str  # pe, traded_value or week_move
    max_pe: float | None = None
    no_funds: bool = False


def traded_value() -> Column:
    """Average daily volume times price; null if either is."""
    return F.col("avg_volume_3m") * F.col("price")


#: Words that name a fund, words that name a fund's vehicle, and the industry that funds are filed under.
FUND_WORDS = ("fund", "etf")
VEHICLE_WORDS = ("trust", "income", "opportunity", "opportunities", "municipal", "portfolio", "fund")
MANAGERS = "Asset Management"


def is_fund(name: Column, industry: Column | None = None, employees: Column | None = None) -> Column:
    """Whether a share is a fund's: by a word of its name; or, where a profile files it under asset management, because nobody works there
    or its name is a vehicle's.  A trust by name alone stays, as banks and property companies are trusts too.  Unknown is no fund."""
    has = lambda words: name.rlike(rf"(?i)\b({'|'.join(words)})\b")
    found = F.coalesce(has(FUND_WORDS), F.lit(False))
    if industry is None or employees is None:
        return found
    return found | F.coalesce((industry == MANAGERS) & (employees.isNull() | has(VEHICLE_WORDS)), F.lit(False))


def screen(quotes: DataFrame, preset: Preset, size: int = 10) -> DataFrame:
    """The preset's best `size` rows with their place: quotes needs exchange, market_cap, avg_volume_3m, pe_ratio, price, name and, to
    rank by it, week_move; industry and employees tell funds better where they are there.  Rows that cannot be ranked are left out, but unknown moves come last.  Ties go to smaller symbols."""
    keep = (F.col("exchange") == preset.region) & F.col("market_cap").between(preset.min_cap, preset.max_cap) & (F.col("avg_volume_3m") >= preset.min_volume)
    if preset.max_pe is not None:
        keep &= (F.col("pe_ratio") > 0) & (F.col("pe_ratio") <= preset.max_pe)
    if preset.no_funds:
        known = {"industry", "employees"} <= set(quotes.columns)
        keep &= ~(is_fund(F.col("name"), F.col("industry"), F.col("employees")) if known else is_fund(F.col("name")))
    q = quotes.where(keep)
    if preset.rank == "pe":
        q = q.where("pe_ratio > 0").withColumn("__key", F.col("pe_ratio").cast("double"))
    elif preset.rank == "traded_value":
        q = q.withColumn("__key", -traded_value()).where("__key is not null")
    else:
        q = q.withColumn("__key", F.coalesce(-F.abs("week_move"), F.lit(float("inf"))))
    # the report is `size` rows, so the numbering window sees no more than that
    top = q.orderBy("__key", "symbol").limit(size)
    return top.withColumn("place", F.row_number().over(Window.orderBy("__key", "symbol"))).drop("__key")


def news_page(articles: DataFrame, symbol: str, *, before: tuple | None = None, limit: int = 20, since=None, until=None) -> DataFrame:
    """One page of a symbol's showable articles, newest first, strictly after the cursor (published_at, key); the row beyond the page
    is marked `more`.  Flags that are null count as not set; only http(s) addresses are shown."""
    shown = F.array_contains("symbols", symbol) & ~F.coalesce("low_value", F.lit(False)) & ~F.coalesce("recap", F.lit(False)) & F.col("url").rlike("^(?i:https?)://")
    if since is not None:
        shown &= F.col("published_at") >= since
    if until is not None:
        shown &= F.col("published_at") < until
    if before is not None:
        t, k = before
        shown &= (F.col("published_at") < t) | ((F.col("published_at") == t) & (F.col("key") < k))
    page = articles.where(shown).orderBy(F.desc("published_at"), F.desc("key")).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc("published_at"), F.desc("key")))  # over limit + 1 rows
    return page.withColumn("place", place).withColumn("more", F.col("place") > limit)


def table_sort(rows: DataFrame, column: str, descending: bool = False, ordinal: dict[str, int] | None = None) -> DataFrame:
    """Rows with their place in a column's order: missing values are last either way, text ignores case, ordinals have their own order.

    The place is global; sorting by ranges spreads the work, and the place is each row's offset in the sorted whole."""
    c = F.col(column)
    if ordinal is not None:
        c = F.coalesce(*[F.when(c == k, v) for k, v in ordinal.items()])
    elif dict(rows.dtypes)[column] == "string":
        c = F.lower(c)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id")


def with_places(ordered: DataFrame, place: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in rows that are ordered as a whole: its number in its partition and the rows of those before.

    The numbered rows are stored once: a sort that ran twice could cut its ranges elsewhere, and the counts would not fit the numbers."""
    at = stored(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, n = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("__p")).agg(F.count("*").alias("__rows"))  # a row for each partition
    before = counts.select("__p", F.coalesce(F.sum("__rows").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return at.join(F.broadcast(before), part == F.col("__p")).withColumn(place, F.col("__before") + n + 1).drop("__at", "__p", "__before")


def status_combine(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Worst state of a group (ok, stale, partial, unavailable); unavailable beside usable is partial; oldest as_of; distinct reasons."""
    rank = F.when(F.col("state") == "ok", 0).when(F.col("state") == "stale", 1).when(F.col("state") == "partial", 2).when(F.col("state") == "unavailable", 3)
    g = statuses.groupBy(*keys).agg(F.max(rank).alias("worst"), F.min(rank).alias("best"), F.min("as_of").alias("as_of"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") != "ok", F.col("reason")))), " ").alias("reason"))
    state = F.when((F.col("worst") == 3) & (F.col("best") < 3), "partial").otherwise(F.element_at(F.array(*map(F.lit, ("ok", "stale", "partial", "unavailable"))), F.col("worst") + 1))
    return g.select(*keys, state.alias("state"), "as_of", F.nullif(F.col("reason"), F.lit("")).alias("reason"))


def marker_size(car: Column) -> Column:
    """1, 2 or 3 by steps at one and three percent."""
    return F.when(F.abs(car) >= 0.03, 3).when(F.abs(car) >= 0.01, 2).when(car.isNotNull(), 1)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


#: Words of the stand-in scorer, fixed values: the model's weights are not public here.
GOOD = ["gain", "gains", "beat", "beats", "rise", "rises", "win", "wins", "strong", "growth"]
BAD = ["loss", "losses", "miss", "misses", "fall", "falls", "weak", "cut", "cuts", "fraud"]


def lexicon_score(title: Column) -> Column:
    """STRUCT<positive, negative, neutral, score>: a deterministic stand-in behind the same columns that a model's scorer would fill."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    count = lambda known: F.size(F.filter(words, lambda w: F.array_contains(F.array(*map(F.lit, known)), w))).cast("double")
    p = softmax(F.array(count(GOOD), count(BAD), F.lit(1.0)))
    return F.struct(p[0].alias("positive"), p[1].alias("negative"), p[2].alias("neutral"), (p[0] - p[1]).alias("score"))
