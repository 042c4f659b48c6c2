"""The divergence audit against counts and values made plainly."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tickloom.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plainly(rows, k=10, least_docs=10):
    """rows (text, lang, source) -> {(lang, source, part, item, value, rank)}."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in seen[lang].items() if d >= least_docs]
        v = len(kept)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: counts[g][t] for t in kept})

        def p_of(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {g: p_of(counts[g]) for g in groups if g[0] == lang}, p_of(whole)
        for g in p:
            pairs = [(-sum(f(p[g][t], p[o][t]) for t in kept), o[1].encode(), o[1]) for o in p if o != g]
            terms = [(-f(p[g][t], q[t]), t.encode(), t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out |= {(*g, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß中") for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "b", "c", None])
        base = 0 if source == "a" else 60
        rows.append((" ".join(rnd.choice(["", "X", "7", "-"]) + words[min(299, int(rnd.expovariate(0.02)) + base)].upper() for _ in range(rnd.randint(0, 60))), lang, source))
    return rows


SCHEMA = "text string, lang string, source string"


def test_equals_the_plain_audit(spark):
    rows = made(600, 5) + [(None, "en", "empty"), ("", "en", "empty"), ("rare words only", "fr", "s1"), ("0 1 2", "fr", "s2"), (None, None, None), ("\x00A\x7fb É" * 20000, "en", "long")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("clash"), "n": F.lit(None).cast("int"), "item": F.lit("x")})
    for k, least in ((10, 10), (3, 2), (1, 1)):
        assert got(divergence.audit(docs, k=k, least_docs=least)) == plainly(rows, k, least)


def test_ties_beyond_the_last_rank_go_by_item(spark):
    rows = [(" ".join(f"t{chr(97 + i)}" for i in range(26)), "en", "x")] * 12 + [("other", "en", "y")] * 12
    want = plainly(rows)
    assert sum(r[2] == "term" and r[1] == "x" for r in want) == 10
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == want


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_buckets_below_the_last_value_stay_closed(spark, monkeypatch):
    """Two groups of many buckets: the rounds end before all of them are opened."""
    rows = [(f"{a * 2 ** (i % 9)} ", "en", s) for s, a in (("x", "rare "), ("y", "plenty ")) for i in range(30)] + made(200, 1)
    rounds, real = [], divergence.cut
    monkeypatch.setattr(divergence, "cut", lambda df: rounds.append(set(df.columns)) or real(df))
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA), k=1, least_docs=2)) == plainly(rows, 1, 2)
    assert sum("rank" in x for x in rounds) <= 2


def test_query_equals_the_plain_audit(spark, sf):
    rows = [(r.text, r.lang, r.source) for r in queries.table(spark, sf, "documents").collect()]
    assert got(queries.op11_divergence(spark, sf)) == plainly(rows)
