"""Toxicity and URL models: held-out accuracy, ordered grades, rules and odd input."""

import random

import numpy as np
import pyarrow as pa

from tickloom.llm import toxicity, urlfilter
from tickloom.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, toxic int, severity string"


def graded(n, seed):
    """Three grades: how many harsh words a text has."""
    rng = random.Random(seed)
    mild, harsh = [f"calm{i}" for i in range(80)], [f"vile{i}x" for i in range(12)]
    out = []
    for i in range(n):
        g = rng.choice([0, 0, 1, 2])
        out.append((i, " ".join(rng.choices(mild, k=30) + rng.choices(harsh, k=3 * g)), g))
    return out


def test_grades_on_held_out_texts(spark):
    train, test = graded(500, 1), [(1000 + i, t, g) for i, t, g in graded(200, 2)]
    df = spark.createDataFrame([(i, t, 9, "s") for i, t, _ in train + test], SCHEMA)
    labels = spark.createDataFrame([(i, g) for i, _, g in train] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {r.doc_id: r.severity for r in toxicity.expected_severity(df, model).collect()}
    assert np.mean([round(got[i]) == g for i, _, g in test]) > 0.95
    left = toxicity.reject_toxic(df, labels)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_of_odd_input(spark):
    df = spark.createDataFrame([(1, None, 0, None), (2, "", 0, None), (3, "vile " * 20_000, 0, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.reject_toxic(df, none).count() == 3
    assert toxicity.reject_toxic(df.limit(0), none).count() == 0


def test_two_models_in_one_worker(spark):
    """Models that differ only in weights far down, and the same labels turned round."""
    rows = [(i, "calm rain" if i % 2 else "vile noise", 0, "s") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for turn in (0, 1, 0):
        labels = spark.createDataFrame([(i, (i + turn) % 2) for i in range(40)], "doc_id long, toxic int")
        got = {r.doc_id: r.severity for r in toxicity.expected_severity(df, toxicity.train(df, labels)).collect()}
        assert all((got[i] > 0.5) == bool((i + turn) % 2) for i in range(40))


def test_the_fit_is_the_maximum_of_the_plain_likelihood():
    """Against the likelihood written out document by document: no small step away from the fit is better by more than a little."""
    rng = np.random.default_rng(3)
    n, width = 300, 12
    sizes = np.full(n, 3)
    col = np.concatenate([rng.choice(width, 3, replace=False) for _ in range(n)]).astype(np.int32)
    val = rng.uniform(0.5, 1.5, len(col)).astype(np.float32)
    truth = rng.normal(size=width)
    grades = np.digitize((val * truth[col]).reshape(n, 3).sum(axis=1) + rng.logistic(size=n), [-0.5, 1.0])
    model = toxicity.fit_ordinal(sizes, col, val.copy(), grades, np.ones(n), width=width, stems=(), l2=0.0, steps=3000)

    def plain(w, cuts):
        total = 0.0
        for r in range(n):
            s = sum(float(val[3 * r + i]) * w[col[3 * r + i]] for i in range(3))
            at_most = lambda k: 0.0 if k < 0 else 1.0 if k >= len(cuts) else 1 / (1 + np.exp(-(cuts[k] - s)))  # noqa: B023, E731
            total += np.log(at_most(grades[r]) - at_most(grades[r] - 1))
        return total / n

    w, cuts = model.weights.astype(float), model.thresholds
    best = plain(w, cuts)
    for i in range(width):
        for step in (-0.1, 0.1):
            assert plain(w + step * (np.arange(width) == i), cuts) < best + 1e-4
    assert all(plain(w, cuts + [d, e]) < best + 1e-4 for d, e in ((0.1, 0), (-0.1, 0), (0, 0.1), (0, -0.1)))
    severity = model.expected(np.array([0.3]))[0]
    assert abs(severity - sum(1 - 1 / (1 + np.exp(-(c - 0.3))) for c in cuts)) < 1e-9


def test_ties_repeats_and_clashing_names(spark):
    rows = [(1, "vile", 1, "a", 1, 2), (1, "vile", 1, "a", 1, 2), (2, "calm", 0, "b", 1, 2), (3, None, 0, None, 1, 2)] * 4 + [(k, "calm sea", 0, "b", 1, 2) for k in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int, severity string, __text int, severity_ int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int").union(spark.range(10, 20).selectExpr("id", "0"))
    model = toxicity.train(df, labels)
    got = {(min(r.doc_id, 10), round(r.severity, 6)) for r in toxicity.expected_severity(df, model, keep=("doc_id", "severity", "__text")).collect()}
    assert len(got) == 4
    left = toxicity.reject_toxic(df, labels)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {2, 3, *range(10, 20)} and {r.severity for r in left.collect()} == {"b", None}


def plain_rule(host, path):
    fits = [(len(r), r, a) for r, a in URL_RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, monkeypatch):
    rng = random.Random(4)
    urls = [None, "", "no scheme/com/en/", "http://A.Example.COM/en/7?x#y", "https://example.com", "ftp://x.com/en/://z", "http://com/en/1", "http://xcom/en/1", "http://example.net/de/8", "http://m.example.net/de/9", "http://a.org/es/x", "a://b.org?q=/es/"]
    bad = lambda: f"http://{rng.choice('abc')}{rng.randint(10**6, 10**9)}.example.org/{rng.randint(0, 10**9)}?a={rng.random()}&b=1&c=2"
    fine = lambda: f"http://news.example.net/story/{rng.choice(['rain', 'sea', 'plant'])}"
    made = [(bad(), 1) for _ in range(150)] + [(fine(), 0) for _ in range(150)]
    rows = [(i, u, "h", 0.5) for i, u in enumerate(urls + [u for u, _ in made])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score double").repartition(3)
    labelled = spark.createDataFrame([x for i, x in enumerate(made) if i % 2] + [("http://x.y/", None)], "url string, bad int")
    got = {r.id: r for r in urlfilter.judge(df, labelled, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.partition("://")[2]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = rest[:cut].lower()
            path = rest[cut:].partition("?")[0].partition("#")[0]
        assert (got[i].host, got[i].path) == (host, path), u
        rule, action = plain_rule(host, path)
        assert got[i].rule == rule and (action is None or got[i].verdict == action)
    test = [(len(urls) + i, y) for i, (_, y) in enumerate(made) if i % 2 == 0]
    assert np.mean([(got[i].verdict == "block") == bool(y) for i, y in test]) > 0.95
    assert urlfilter.judge(df.limit(0), labelled.limit(0), URL_RULES).count() == 0
    monkeypatch.setattr(urlfilter, "FEW_SUFFIXES", 1)  # the join that is not a broadcast one
    assert {r.id: r.verdict for r in urlfilter.judge(df.union(df), labelled, URL_RULES).collect()} == {i: r.verdict for i, r in got.items()}
    assert urlfilter.judge(df, labelled.limit(0), URL_RULES).where("score > 0.5 or score is null").count() == 0


def test_trees_equal_plain_boosting():
    """The fitted trees against boosting written out with every cut tried on every row."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(scale=0.3, size=120) > 0.7).astype(float)
    model = urlfilter.BoostedTrees.fit(x, y, trees=4, depth=2, rate=0.3, bins=16, ridge=2.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(3)]
    score = np.full(120, np.log(y.mean() / (1 - y.mean())))
    worth = lambda g, h: g.sum() ** 2 / (h.sum() + 2.0)

    def grow(rows, g, h, level):
        if level == 2:
            return {int(r): 0.3 * g[rows].sum() / (h[rows].sum() + 2.0) for r in rows}
        best = (1e-6, 0, np.inf)
        for j in range(3):
            for c in edges[j]:
                low = rows[x[rows, j] <= c]
                high = rows[x[rows, j] > c]
                gain = worth(g[low], h[low]) + worth(g[high], h[high]) - worth(g[rows], h[rows])
                if gain > best[0] + 1e-12:
                    best = (gain, j, c)
        _, j, c = best
        return grow(rows[x[rows, j] <= c], g, h, level + 1) | grow(rows[x[rows, j] > c], g, h, level + 1)

    for _ in range(4):
        p = 1 / (1 + np.exp(-score))
        step = grow(np.arange(120), y - p, p * (1 - p), 0)
        score = score + np.array([step[r] for r in range(120)])
    assert np.allclose(model.raw(x), score)


def test_packed_numbers_are_read_where_they_lie():
    rows = [b"", np.array([1, 2], "<i4").tobytes(), b"", np.array([3], "<i4").tobytes()]
    whole = pa.array(rows, pa.binary())
    read = lambda *chunks: toxicity._numbers(pa.chunked_array(chunks, pa.binary()), "<i4").tolist()
    assert read(whole) == read(whole.slice(0, 2), whole.slice(2)) == [1, 2, 3]
    assert read(whole.slice(2)) == [3] and read() == read(whole.slice(0, 1)) == read(whole.slice(0, 0)) == []
