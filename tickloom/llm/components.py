"""Connected components of a graph given as links, by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Every step is a grouped minimum (pre-aggregated before the shuffle) and an equi-join, which Spark splits
where a hub makes it skewed.  Each round is checkpointed, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u with the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    joined = both.join(_to_minimum(both), F.col("u") == F.col("w")).where("v > u")
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    joined = down.join(_to_minimum(down), F.col("u") == F.col("w"))
    out = joined.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
    return out.select("e.a", "e.b").where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node that can be reached.  Nodes without a link are absent.

    Null ends and links of a node to itself are ignored; repeated links count once; no links give an empty table.
    """
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, edges = mark, cut(_small_star(_large_star(edges)))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
