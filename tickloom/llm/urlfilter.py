"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

Features of a URL: length, path depth, digit ratio, character entropy, parameter count, host length, host labels, hyphens, and
two statistics of the host's suffix over the whole table: how common it is and its smoothed share of bad labelled URLs.
Trees are fitted with logistic loss on histograms of a bounded sample of labelled URLs; scoring is vectorised in tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

FEW_SUFFIXES = 50_000  # suffixes whose statistics are broadcast: some 5 MB
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "host_length", "host_labels", "hyphens", "suffix_log_count", "suffix_bad_share")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_action: the longest rule `host/path` whose host is the URL's or a parent of it and whose path
    begins the URL's path; null where none fits.  Rules are a parameter and part of the plan.  Columns host and path are read."""
    fits = []
    for rule, action in rules:
        host, slash, path = rule.partition("/")
        suits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fits.append(F.when(suits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,action:string>")
    return urls.withColumn("__best", best).withColumn("rule", F.col("__best.rule")).withColumn("rule_action", F.col("__best.action")).drop("__best")


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical(url: str, host: str, path: str) -> list[float]:
    n = max(1, len(url))
    counts = Counter(url).values()
    query = url.partition("?")[2].partition("#")[0]
    entropy = log(n) - sum(c * log(c) for c in counts) / n if url else 0.0
    return [float(len(url)), float(path.count("/")), sum(c in "0123456789" for c in url) / n, entropy, float(len([x for x in query.split("&") if x])), float(len(host)), float(host.count(".") + 1), float(host.count("-"))]


class BoostedTrees:
    """Logistic gradient boosting; each tree is complete, of fixed depth, stored as arrays (feature, cut, leaf value)."""

    def __init__(self, base: float, depth: int, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray) -> None:
        self.base, self.depth, self.features, self.cuts, self.leaves = base, depth, features, cuts, leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> BoostedTrees:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
        base, inner = log(share / (1 - share)), 2**depth - 1
        if not len(y):
            trees = 0
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(1) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        f_all, c_all, l_all, score = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for level in range(depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, 0, np.inf)
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                    for j, e in enumerate(edges):
                        gs, hs = (np.cumsum(np.bincount(binned[rows, j], w[rows], len(e) + 1)) for w in (g, h))
                        left, right = gs[:-1] ** 2 / (hs[:-1] + ridge), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge)
                        if len(left) and (gain := (left + right - whole)).max() > best[0]:
                            best = (float(gain.max()), j, float(e[gain.argmax()]))
                    f_all[t, k], c_all[t, k] = best[1], best[2]
                    node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
            leaf = node - inner
            l_all[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            score += l_all[t][leaf]
        return cls(base, depth, f_all, c_all, l_all)


def suffix_statistics(urls: DataFrame, labelled: DataFrame, *, prior: float = 20.0) -> DataFrame:
    """suffix, suffix_log_count over all URLs, suffix_bad_share over all labelled URLs, pulled to the overall share by `prior` rows."""
    seen = urls.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"))
    bad = labelled.groupBy(suffix_of(host_of(F.col("url"))).alias("s")).agg(F.sum("bad").alias("bad"), F.count("*").alias("m"))
    total = labelled.agg(F.sum("bad").alias("all_bad"), F.count("*").alias("all_m"))  # one row
    mean = F.coalesce(F.col("all_bad") / F.when(F.col("all_m") > 0, F.col("all_m")), F.lit(0.0))
    share = (F.coalesce("bad", F.lit(0)) + prior * mean) / (F.coalesce("m", F.lit(0)) + prior)
    return seen.join(bad, F.col("suffix") == F.col("s"), "left").crossJoin(F.broadcast(total)).select("suffix", F.log1p("n").alias("suffix_log_count"), share.alias("suffix_bad_share"))


def features(urls: DataFrame, stats: DataFrame, carry: list[str], *, small: bool = False) -> DataFrame:
    """The carried columns and x, the features as an array.  urls has url, host and path; a URL takes its suffix's statistics by
    an equi-join on the suffix: a broadcast one if they are known to be small, else one where Spark splits a suffix that holds much of
    the table."""
    stats = stats.select(F.col("suffix").alias("__suffix"), "suffix_log_count", "suffix_bad_share")
    stats = F.broadcast(stats) if small else stats
    joined = urls.join(stats, suffix_of(F.col("host")) == F.col("__suffix"), "left")
    flat = joined.select(*carry, F.coalesce("url", F.lit("")).alias("__u"), F.col("host").alias("__h"), F.col("path").alias("__p"), F.coalesce("suffix_log_count", F.lit(0.0)).alias("__c"), F.coalesce("suffix_bad_share", F.lit(0.0)).alias("__b"))
    n = len(carry)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, h, p, c, b = (x.to_pylist() for x in batch.columns[n:])
            rows = [[*lexical(*x[:3]), *x[3:]] for x in zip(u, h, p, c, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:n], "x"])

    schema = flat.select(*carry).withColumn("x", F.lit(None).cast("array<double>")).schema
    return flat.mapInArrow(each, schema)


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score): verdict is the rule's action, else block where the model's probability of a bad URL
    reaches the threshold, else allow.

    labelled (url, bad 0/1) trains the trees: at most `sample` rows, those with the smallest URL hashes; suffix statistics read all
    rows.  Null URLs have empty host and path and are scored like any other; null labels are left out; without labels all
    scores are next to zero.  Repeated rows stay rows.
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = with_rule(urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    labelled = labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad")).where("bad is not null")
    stats = cut(suffix_statistics(urls, labelled))
    small = stats.agg(F.count("*").alias("n"), F.sum(F.octet_length("suffix")).alias("b")).where(f"n <= {FEW_SUFFIXES} and coalesce(b, 0) <= 64 * {FEW_SUFFIXES}").count() > 0
    some = labelled.orderBy(F.xxhash64("url"), "url", "bad").limit(sample)
    some = some.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = features(some, stats, ["bad"], small=small).collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r.bad, r.x))
    model = BoostedTrees.fit(np.array([r.x for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r.bad for r in rows], np.float64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.probability(x))], names=[*batch.schema.names[:-1], "score"])

    ready = features(urls, stats, ["id", "host", "path", "rule", "rule_action"], small=small)
    scored = ready.mapInArrow(each, ready.drop("x").withColumn("score", F.lit(0.0)).schema)
    verdict = F.coalesce("rule_action", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), "score")
