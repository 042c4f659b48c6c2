"""Headline filters that learn from labelled headlines: reports of a price's past move, and machine-made reports of a fund's holding.

A headline is its words, pairs of neighbours and whether they stand first, in lower case; figures are read by their look (a percentage, an
amount, a count), tickers too.  Each feature's weight is the logarithm of how much more often headlines of the kind have it than others, with
additive smoothing: naive Bayes on features that are there.  Weights are counted by Spark and joined to the features of what is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 0.5

#: What is read by its look, in order.
LOOKS = [(r"\(([A-Za-z]+: ?)?[$]?([A-Z][A-Z0-9.]*)\)", " _tick "), (r"[$][A-Z]{1,5}\b", " _tick "), (r"[$€£][0-9][0-9.,]*( ?(million|billion|[mb]n?)\b)?", " _sum "), (r"[0-9][0-9.,]* ?(%|percent\b|per cent\b)", " _rate "), (r"\b[0-9][0-9.,]*\b", " _count "), (r"[‘’']s\b", ""), (r"[,;:|–—?]", " _mark "), (r"[^A-Za-z_]+", " ")]


def words(title: Column) -> Column:
    """Words and looks of a headline in order; null is empty."""
    t = F.coalesce(title, F.lit(""))
    for pattern, by in LOOKS:
        t = F.regexp_replace(t, pattern, by)
    return F.filter(F.split(F.lower(t), " "), lambda w: w != "")


def features(title: Column) -> Column:
    """Distinct words, and pairs of neighbours with the headline's edges."""
    return features_of(words(title))


def features_of(w: Column) -> Column:
    """Features from a headline's words: a column of its own, as it is read several times and `words` is costly."""
    edged = F.concat(F.array(F.lit("<")), w, F.array(F.lit(">")))
    pairs = F.zip_with(F.slice(edged, F.lit(1), F.size(edged) - 1), F.slice(edged, F.lit(2), F.size(edged) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(w, pairs))


def train(labelled: DataFrame, title: str = "title", label: str = "label") -> DataFrame:
    """(feature, weight) from headlines and whether they are of the kind; the feature '' has the weight of a headline without any.

    Headlines without a label are left out; without headlines of both sides there are no weights, and nothing is flagged."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), features(F.col(title)).alias("f"))
    sides = rows.agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    seen = rows.select("y", F.explode("f").alias("feature")).groupBy("feature").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    share = lambda c, n: F.log((F.col(c) + SMOOTH) / (F.col(n) + 2 * SMOOTH))
    weights = seen.crossJoin(F.broadcast(sides)).where("n1 > 0 and n0 > 0").select("feature", (share("c1", "n1") - share("c0", "n0")).alias("weight"))  # one row of two numbers
    bias = sides.where("n1 > 0 and n0 > 0").select(F.lit("").alias("feature"), F.log(F.col("n1") / F.col("n0")).alias("weight"))
    return weights.unionByName(bias)


def flag(headlines: DataFrame, weights: DataFrame, key: list[str], title: str = "title", least: float = 0.0) -> DataFrame:
    """(key, score, hit): the summed weights of each headline's features, and whether they are over `least`.  A title with no known word
    is never flagged, whatever the kind's share; key must tell rows apart."""
    read = headlines.select(*key, words(F.col(title)).alias("__words"))
    f = read.select(*key, F.explode(F.concat(F.array(F.lit("")), features_of(F.col("__words")))).alias("f"))
    met = f.join(weights, F.col("f") == F.col("feature"), "left")
    known = F.count_if((F.col("f") != "") & F.col("weight").isNotNull()) > 0
    scored = met.groupBy(*key).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"), known.alias("known"))
    return scored.select(*key, "score", ((F.col("score") > least) & F.col("known")).alias("hit"))
