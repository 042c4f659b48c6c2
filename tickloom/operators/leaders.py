"""Greedy leaders in rounds: each title joins the first earlier leader that it is similar to, or leads.

The rule is sequential - whether a title leads depends on whether earlier ones do - but only along chains of similar titles.  A round takes
the first titles of every day that are not decided yet (more each round), and pairs the similar ones among them by joins on rare tokens.
Within it, what has no earlier partner left leads, its later partners follow, and so on until no pair is left.  Then all titles that are
not decided are held against the round's leaders only, so the many variants of one headline are never paired with each other.

No group is gathered: a day of any size is spread by its tokens.  Candidates are exact: similar sets of a and b tokens, a the fewer, share three
at least, and a third of a + b or four fifths of a.  So the rarest token that they share is among the first of either, how far depends on both
sizes, and each has few bits that the other lacks in a bitmap of 256 bits.  Both are judged on narrow rows; the tokens themselves
are only fetched for the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.storage import stored

LEAST_SHARED = 3
BITS = 4  # longs of a bitmap
FIRST_ROUND = 1024  # titles of a day; each later round takes so many times as many:
GROWTH = 8

Similar = Callable[[Column, Column], Column]


def _same(keys: list[str], mark: str = "_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys])


def _marked(df: DataFrame, mark: str = "_") -> list[Column]:
    return [F.col(c).alias(f"{mark}{c}") for c in df.columns]


def needed(a: Column, b: Column) -> Column:
    """How many tokens similar sets of these sizes share at least."""
    small = F.least(a, b)
    return F.greatest(F.lit(LEAST_SHARED), F.least(F.floor((a + b + 2) / 3), F.floor((4 * small + 4) / 5))).cast("int")


def _by_rarity(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rare, the tokens in order of how few titles of the day have them, and bits, their bitmap."""
    words = sets.select(*keys, "name", F.explode("tokens").alias("token"))
    often = words.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("token").alias("_token")).agg(F.count("*").alias("often"))
    met = words.join(often, _same(keys) & (F.col("token") == F.col("_token"))).withColumn("h", F.xxhash64("token"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    bits = [F.coalesce(F.bit_or(F.when(F.shiftright("h", 6).bitwiseAND(F.lit(BITS - 1)) == i, bit)), F.lit(0).cast("long")).alias(f"bits{i}") for i in range(BITS)]
    rare = met.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(F.struct("often", "token")))["token"].alias("rare"), *bits)
    named = rare.select(_marked(rare)).withColumnRenamed("_rare", "rare").withColumnsRenamed({f"_bits{i}": f"bits{i}" for i in range(BITS)})
    return sets.join(named, _same(keys) & (F.col("name") == F.col("_name"))).drop("_name", *[f"_{k}" for k in keys])


def _filed(df: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """A narrow row for each token by which a set can be the smaller one of two (few), or the larger one: token, its place at and the set's size."""
    n = F.size("rare")
    far = n - (needed(n, n) if few else F.lit(LEAST_SHARED)) + 1
    narrow = df.select(*keys, "name", "first", n.alias("n"), *[f"bits{i}" for i in range(BITS)], F.posexplode(F.slice("rare", F.lit(1), far)).alias("at", "token"))
    return narrow.withColumn("token", F.xxhash64("token", *keys))


def _pairs(titles: DataFrame, leaders: DataFrame, keys: list[str], similar: Similar) -> DataFrame:
    """(keys, name, first, head, head_first): titles with the earlier ones of `leaders` that they are similar to."""
    need, c = needed(F.col("n"), F.col("_n")), F.col
    lacks = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(c(f"{a}bits{i}").bitwiseAND(F.bitwise_not(c(f"{b}bits{i}")))) for i in range(BITS)])
    spare, _spare = c("n") - need, c("_n") - need
    may = (c("at") <= spare) & (c("_at") <= _spare) & (lacks("", "_") <= spare) & (lacks("_", "") <= _spare)
    on = (c("token") == c("_token")) & _same(keys) & (c("_first") < c("first")) & may

    def met(few: bool, sizes: Column) -> DataFrame:
        b = _filed(leaders, keys, not few)
        return _filed(titles, keys, few).join(b.select(_marked(b)), on & sizes).select(*keys, "name", c("_name").alias("head"))

    named = met(True, c("n") <= c("_n")).unionByName(met(False, c("n") > c("_n"))).distinct()
    of = lambda df, name, mark: df.select(*[c(k).alias(f"{mark}{k}") for k in keys], c("name").alias(f"{mark}{name}"), c("first").alias(f"{mark}first"), c("rare").alias(f"{mark}rare"))
    late = named.join(of(titles, "name", "a_"), _same(keys, "a_") & (c("name") == c("a_name")))
    both = late.join(of(leaders, "head", "b_"), _same(keys, "b_") & (c("head") == c("b_head")))
    return both.where(similar(c("a_rare"), c("b_rare"))).select(*keys, "name", c("a_first").alias("first"), "head", c("b_first").alias("head_first"))


def similar_pairs(sets: DataFrame, keys: list[str], similar: Similar) -> DataFrame:
    """(keys, name, first, head, head_first): every set with the earlier ones of its day that it is similar to; sets as for `lead`."""
    rows = stored(_by_rarity(stored(sets), keys))  # sets are read three times
    return _pairs(rows, rows, keys, similar)


def _without(df: DataFrame, names: DataFrame, keys: list[str], column: str) -> DataFrame:
    other = names.select(*[F.col(k).alias(f"x_{k}") for k in keys], F.col("name").alias("x_name"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys]) & (F.col(column) == F.col("x_name"))
    return df.join(other, on, "left_anti")


def _followers(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name) of the titles of some pairs (name after head) that do not lead."""
    found, edges = None, pairs.select(*keys, "name", "head")
    while edges.take(1):
        free = _without(edges.select(*keys, F.col("head").alias("name")).distinct(), edges, keys, "name")
        other = free.select(*[F.col(k).alias(f"x_{k}") for k in keys], F.col("name").alias("x_name"))
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys]) & (F.col("head") == F.col("x_name"))
        now = stored(edges.join(other, on, "left_semi").select(*keys, "name").distinct())
        edges = stored(_without(_without(edges, now, keys, "name"), now, keys, "head"))
        found = now if found is None else found.union(now)
    return pairs.select(*keys, "name").limit(0) if found is None else found


def lead(sets: DataFrame, keys: list[str], similar: Similar, first_round: int = FIRST_ROUND) -> DataFrame:
    """(keys, name, head): sets has keys, name (unique in its day), first (what it is ordered by, unique in its day) and tokens, a set.

    Sets of fewer than three tokens must not be among them: they are similar to nothing."""
    rest, size = stored(_by_rarity(sets, keys)), first_round
    answers: list[DataFrame] = []
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    while rest.take(1):
        # tasks hand on the first ones of their own rows only
        batch = stored(rest.withColumn("nth", nth).where(F.col("nth") <= size).drop("nth"))
        pairs = stored(_pairs(batch, batch, keys, similar))
        followers = _followers(pairs, keys)
        leaders = stored(_without(batch, followers, keys, "name"))
        rest = _without(rest, batch, keys, "name")
        told = _pairs(rest, leaders, keys, similar).unionByName(_without(pairs, followers, keys, "head"))
        joined = stored(told.groupBy(*keys, "name").agg(F.min_by("head", "head_first").alias("head")))
        answers += [leaders.select(*keys, "name", F.col("name").alias("head")), joined]
        rest, size = stored(_without(rest, joined, keys, "name")), size * GROWTH
    return reduce(DataFrame.unionByName, answers) if answers else sets.select(*keys, "name", F.col("name").alias("head"))
