"""The n-gram model against a plain one, and held-out separation."""

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tickloom.llm import kneser, queries

SCHEMA = "doc_id long, text string, lang string, id string, block int"


def plain_model(texts):
    """log p(byte | three before) of an interpolated modified Kneser-Ney model over padded byte strings."""
    c4 = Counter()
    for t in texts:
        raw = b"\n\n\n" + t
        for i in range(len(t)):
            c4[raw[i : i + 4]] += 1
    counts = {4: c4}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def discounts(all_counts):
    n = [sum(1 for c in all_counts for v in c.values() if v == k) for k in (1, 2, 3, 4)]
    if not all(n[:3]):
        return [0.75 * k / (0.5 + 0.5 * k) for k in (1, 2, 3)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


def log_p(models, lang, gram):
    model, p = models.get(lang), 1 / 256
    d = {k: discounts([model[k]]) for k in (1, 2, 3, 4)} if model else {}
    for k in (1, 2, 3, 4):
        g = gram[4 - k :]
        follow = model["by_context"][k].get(g[:-1]) if model else None
        if follow:
            total = sum(follow.values())
            cut = lambda v: d[k][min(v, 3) - 1]  # noqa: E731, B023
            own = max(0.0, follow[g] - cut(follow[g])) if g in follow else 0.0
            p = (own + sum(map(cut, follow.values())) * p) / total
    return math.log(p)


def plain_scores(docs, train):
    models = {}
    for lang in {x[2] or "" for x in docs}:
        m = plain_model([x[1].encode() for x in docs if (x[2] or "") == lang and x[0] in train and x[1]])
        m["by_context"] = {k: defaultdict(dict) for k in (1, 2, 3, 4)}
        for k in (1, 2, 3, 4):
            for g, v in m[k].items():
                m["by_context"][k][g[:-1]][g] = v
        models[lang] = m
    out = {}
    for i, text, lang in ((x[0], (x[1] or "").encode(), x[2] or "") for x in docs):
        raw = b"\n\n\n" + text
        out[i] = sum(log_p(models, lang, raw[j : j + 4]) for j in range(len(text)))
    return out


def corpus(seed=4, n=40):
    rng = random.Random(seed)
    words = {"en": ["the", "plant", "opens", "rain", "sea"], "fr": ["le", "pré", "été", "mer"]}
    docs = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 12))), lang) for i, lang in ((i, rng.choice(["en", "fr"])) for i in range(n))]
    return [*docs, (n, None, "en"), (n + 1, "", None), (n + 2, "zz top", None)]


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_scores_equal_the_plain_model(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(*x, None, 7) for x in docs], SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(0, 30)], "doc_id long")
    got = {r.id: r for r in kneser.document_scores(df, trusted, block_bytes=block, shard_bytes=300).collect()}
    train = {i for i, r in got.items() if r.role == 1}
    assert train and any(r.role == 2 for r in got.values()) and len(got) == len(docs)
    want = plain_scores(docs, train)
    for i, r in got.items():
        assert r.logp == pytest.approx(want[i], rel=1e-5, abs=1e-6), i


def test_junk_goes_and_text_stays(spark):
    rng = random.Random(8)
    words = ["rain", "plant", "opens", "after", "long", "winter", "harbour", "market", "letter", "window"]
    good = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(300)]
    bad = [(1000 + i, "".join(rng.choices("qxzj#@%&0123456789", k=300)), "en") for i in range(20)]
    df = spark.createDataFrame([(*x, None, 0) for x in good + bad], SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    left = {r.doc_id for r in kneser.keep_quality(df, trusted).collect()}
    assert not any(i >= 1000 for i in left) and len(left) >= 297


def test_nulls_repeats_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert kneser.judge_quality(none, ids).count() == 0
    df = spark.createDataFrame([(None, "a b", "en", "x", 1), (1, "a b", "en", "x", 1), (1, "a b", "en", "x", 1), (2, None, None, None, None)], SCHEMA)
    assert kneser.keep_quality(df, ids).count() == 4
    assert kneser.judge_quality(df, none.select("doc_id")).where("keep").count() == 4


def test_thresholds_of_the_query_are_quantiles(spark, sf):
    """At the 99% quantile a threshold is the perplexity of a held-out document, in the query and in the pipeline."""
    rows = queries.op1_quality_classifier(spark, sf).collect()
    seen = {(r.lang, r.perplexity) for r in rows}
    limits = {(r.lang, r.threshold) for r in rows if r.threshold is not None}
    assert limits and limits <= seen
    left = corpus_pipeline.keep_quality(spark, queries.table(spark, sf, "documents"), sf)
    assert left.count() == sum(r.keep for r in rows)


def test_a_language_without_held_out_documents_has_a_threshold(spark):
    rng = random.Random(2)
    trains = [r.id for r in spark.range(200).where(kneser.hash_bucket(F.col("id"), kneser.HELD_OUT, 2) != 0).limit(12).collect()]
    words = ["rain", "plant", "opens", "after", "long", "winter"]
    docs = [(i, " ".join(rng.choices(words, k=60)), "en") for i in trains] + [(1000, "".join(rng.choices("qxzj#@%&0123456789", k=300)), "en")]
    df = spark.createDataFrame([(*x, None, 0) for x in docs], SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in trains], "doc_id long")
    got = {r.id: r for r in kneser.judge_quality(df, trusted).collect()}
    assert all(got[i].keep and got[i].threshold is not None for i in trains) and not got[1000].keep


def test_a_plan_names_the_counts_eight_times(spark, capsys):
    """The driver holds and plans every mention of the counts with all that is under it: 22 were too many for its memory (F1 pipeline)."""
    counts = spark.createDataFrame([("en", 65, 1), ("en", 66, 0)], "lang string, gram int, n long")
    kneser.probabilities(counts).explain("simple")
    text = capsys.readouterr().out
    assert 0 < text.count("ExistingRDD") + text.count("LocalTableScan") <= 8
