"""Greedy leaders against the plain procedure, and the headline filters against labelled headlines."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import headline_model as M
from tickloom.operators import headlines as H
from tickloom.operators import leaders
from tickloom.operators import screening as C
from tickloom.plans.news import LEAST
from tickloom.sources import headlines as L


def plain_similar(a, b):
    up, down, no = (frozenset(H._stems(x)) for x in (H.RISES, H.FALLS, H.NEGATIONS))
    shared, x, y = len(a & b), a - b, b - a
    if shared < 3 or (x | y) & no or (x & up and y & down) or (x & down and y & up) or any(c.isdigit() for t in x | y for c in t):
        return False
    return 2 * shared >= len(a | b) or 5 * shared >= 4 * min(len(a), len(b))


def plain_heads(stories):
    """stories (symbol, day, stored_first, published_at, key, tokens) -> {key: head}."""
    want = {}
    for group in {s[:2] for s in stories}:
        heads = []
        for s in sorted((s for s in stories if s[:2] == group), key=lambda s: (s[2], s[3], s[4])):
            tokens = frozenset(s[5] or ())
            at = next((h for h in heads if plain_similar(tokens, h[0])), None)
            if at is None:
                heads.append(at := (tokens, s[4]))
            want[s[4]] = at[1]
    return want


SCHEMA = "symbol string, day int, stored_first int, published_at int, key string, tokens array<string>"
WORDS = ["acme", "plant", "ohio", "opens", "rises", "falls", "q1", "q2", "deal", "bolt", "court", "not", "delay", "chip"]


@pytest.mark.parametrize("first_round", [2, 16, 1024])
def test_clusters_equal_the_plain_procedure(spark, first_round):
    rnd = random.Random(9)
    stories = [(rnd.choice(["S", None]), i % 3, 0 if rnd.random() < 0.3 else 1, i, f"k{i:03d}", sorted(set(rnd.choices(WORDS, k=rnd.randint(0, 7))))) for i in range(150)]
    stories += [("T", 0, 1, 500 + i, f"t{i:03d}", ["same", "story", "again", *([f"tail{'abc'[i % 3]}"] if i % 4 else [])]) for i in range(40)]
    stories += [("U", None, 1, 900, "u1", None), ("U", None, 1, 901, "u2", ["one", "two", "six"]), ("U", None, 0, 902, "u3", ["one", "two", "six"])]
    df = spark.createDataFrame(stories, SCHEMA)
    got = H.cluster_stories(df, first_round=first_round)
    assert got.columns == [*df.columns, "head"]
    assert {r.key: r.head for r in got.collect()} == plain_heads(stories)


def test_a_chain_is_followed_in_order(spark):
    """Each title is like its neighbours only: leaders and followers take turns."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    stories = [("S", 0, 1, i, f"k{i:02d}", words[i : i + 5]) for i in range(30)]
    want = plain_heads(stories)
    assert len(set(want.values())) > 8
    assert {r.key: r.head for r in H.cluster_stories(spark.createDataFrame(stories, SCHEMA), first_round=8).collect()} == want


def test_many_variants_of_a_headline_are_not_paired_with_each_other(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit("S").alias("symbol"), F.lit(0).alias("day"), F.lit(1).alias("stored_first"), F.col("id").cast("int").alias("published_at"), F.format_string("k%06d", "id").alias("key"), F.array(F.lit("acme"), F.lit("opens"), F.lit("plant"), F.lit("ohio"), F.lit("today"), F.lit("grand"), F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("tokens"))
    made, real = [], leaders._pairs
    monkeypatch.setattr(leaders, "_pairs", lambda *a: made.append(real(*a)) or made[-1])
    got = {r.head for r in H.cluster_stories(rows, first_round=16).select("head").distinct().collect()}
    assert got == {"k000000"}
    assert sum(p.count() for p in made) < 2 * 3000 + 16 * 16


def test_few_pairs_are_compared_word_by_word(spark):
    """Titles of common words: nearly all pairs share one of their rarer words, few as many as similar ones must."""
    rnd = random.Random(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    titles = [sorted(rnd.sample(words, rnd.choice([4, 8, 12, 12, 30]))) for _ in range(300)]
    titles += [sorted({*rnd.choice(titles), rnd.choice(words)}) for _ in range(100)]
    titles = [list(t) for t in dict.fromkeys(map(tuple, titles))]
    sets = spark.createDataFrame([("S", i, i, t) for i, t in enumerate(titles)], "day string, name int, first int, tokens array<string>")
    pairs = [(i, j) for i in range(len(titles)) for j in range(i)]
    want = {(i, j) for i, j in pairs if plain_similar(frozenset(titles[i]), frozenset(titles[j]))}
    assert {(r.name, r.head) for r in leaders.similar_pairs(sets, ["day"], H.similar).collect()} == want
    compared = leaders.similar_pairs(sets, ["day"], lambda a, b: F.lit(True)).count()
    assert len(want) <= compared < len(pairs) / 10


def test_no_stories(spark):
    assert H.cluster_stories(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similarity_in_columns_and_python(spark):
    rnd = random.Random(2)
    words = [*"acme plant ohio open rise fall q1 q2 deal bolt".split(), "not"]
    pairs = [(rnd.sample(words, rnd.randint(0, 7)), rnd.sample(words, rnd.randint(0, 7))) for _ in range(300)]
    got = [(r.a, r.b, r.s) for r in spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", H.similar(F.col("a"), F.col("b")).alias("s")).collect()]
    assert all(s == plain_similar(frozenset(a), frozenset(b)) for a, b, s in got) and any(s for *_, s in got)


#: Headlines of our own that no shape gave.
RECAPS = """Bolt stock jumps on a new order|Bolt shares were still falling at noon|Shares of Bolt Motors tumbled|Bolt trades lower after the open|Bolt touches an all-time high|Bolt notches a record low|Premarket movers: Bolt, Acme|Stocks making the biggest moves
Bolt gains more than the market|Bolt extends its rally|Bolt erases losses|Bolt plunges as much as 12%|Bolt, a maker of pumps, climbs 4 percent|Bolt dives 7%|Bolt stock rockets""".replace("\n", "|").split("|")
REPORTS = """Reed Capital LLC Raises Stake in Bolt Motors $BLT|Reed Advisors Trims Position in Bolt Motors Inc. (NYSE: BLT)|Reed Bank Buys New Stake in Bolt (BLT)|Reed Fund Sells 3,100 Shares of Bolt Motors $BLT|Reed Trust Has $4.1 Million Stock Position in Bolt (BLT)
9,000 Shares of Bolt $BLT Acquired by Reed|Bolt Motors $BLT Stock Sold by Reed Capital|Bolt Motors $BLT Shares Purchased by Reed Bank|Bolt stock price and chart|Bolt stock quote""".replace("\n", "|").split("|")
NEWS = """Bolt could jump 20% this year|Bolt shares may fall further|Bolt revenue climbs 14%|Bolt profit slips 3% on costs|Bolt takes a 12% stake in Acme|Bolt gains 5% market share|Oil prices edge higher|Bolt opens a pump works|Bolt will pay a dividend|Bolt dividend up 5%|Bolt hires 400 people|Bolt margin drops, deliveries rise 5%
Bolt director buys 3,100 shares|Activist Reed raises his bet on Bolt|Bolt sells its stake in a pump works|Bolt raises prices|Reed Capital hires a trader|Bolt buys Acme|Bolt cuts 400 jobs|Court stops the sale of Bolt|Bolt names a chief executive""".replace("\n", "|").split("|")


def learned(spark, kind):
    rows = [(k == kind, shape) for k, shape in L.shapes(L.TRAIN)]
    df = spark.createDataFrame(rows, "label boolean, shape string")
    return M.train(df.withColumn("title", L.filled(F.col("shape"), F.lit("Acme"), F.lit("Kestrel Bank"), F.lit(7))))


def flagged(spark, weights, titles, kind):
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string")
    got = {r.i: r.hit for r in M.flag(df, weights, ["i"], least=LEAST[kind]).collect()}
    return [t for i, t in enumerate(titles) if got[i]]


@pytest.mark.parametrize(("kind", "own", "others"), [("recap", RECAPS, REPORTS + NEWS), ("fund", REPORTS, RECAPS + NEWS)])
def test_filters_on_headlines_that_no_shape_gave(spark, kind, own, others):
    weights = learned(spark, kind)
    assert len(flagged(spark, weights, own, kind)) >= 0.7 * len(own), set(own) - set(flagged(spark, weights, own, kind))
    assert len(flagged(spark, weights, others, kind)) <= 0.1 * len(others), flagged(spark, weights, others, kind)


@pytest.mark.parametrize("kind", ["recap", "fund"])
def test_filters_on_judged_shapes(spark, kind):
    names = [(i, k, s, L.NAMES[i % 12], L.NAMES[(i * 5 + 1) % 12]) for i, (k, s) in enumerate(L.shapes(L.JUDGED) * 6)]
    df = spark.createDataFrame(names, "i int, kind string, shape string, c string, o string").withColumn("title", L.filled(F.col("shape"), F.col("c"), F.col("o"), F.col("i") * 37))
    got = M.flag(df, learned(spark, kind), ["i", "kind"], least=LEAST[kind]).collect()
    found, all_of = sum(r.hit for r in got if r.kind == kind), sum(r.kind == kind for r in got)
    wrong, news = sum(r.hit for r in got if r.kind == "news"), sum(r.kind == "news" for r in got)
    assert found >= 0.85 * all_of and wrong <= 0.05 * news, (found, all_of, wrong, news)


def test_shapes_to_learn_from_and_to_judge_are_apart():
    assert not {s for _, s in L.shapes(L.TRAIN)} & {s for _, s in L.shapes(L.JUDGED)}


def test_filters_without_text_or_labels(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (4, "12% !")], "i int, title string")
    weights = learned(spark, "recap")
    assert {r.i: r.hit for r in M.flag(df, weights, ["i"]).collect()} | {4: None} == {1: False, 2: False, 3: False, 4: None}
    one_sided = M.train(spark.createDataFrame([("a b", True), ("c", None)], "title string, label boolean"))
    assert one_sided.count() == 0 and not any(r.hit for r in M.flag(df, one_sided, ["i"]).collect())
    assert M.flag(df.where("false"), weights, ["i"]).count() == 0
    got = df.select("i", F.size(H.title_tokens(F.col("title"))).alias("n"), C.lexicon_score(F.col("title"))["score"].alias("s")).collect()
    assert [(r.n, r.s) for r in got][:3] == [(0, 0.0), (0, 0.0), (1, 0.0)]


def test_looks(spark):
    df = spark.createDataFrame([("Acme's (NYSE: ACM) up 4.5% to $12.5 million, 1,200 sold",)], "t string")
    assert df.select(M.words(F.col("t"))).first()[0] == "acme _tick up _rate to _sum _mark _count sold".split()


def test_a_judged_headlines_words_are_read_once(spark, sf):
    """Its features are not shuffled to the weights, and its looks are replaced once, not for each use of the words."""
    from tickloom.plans import QUERIES

    plan = QUERIES["news_recap"](spark, sf)._jdf.queryExecution().optimizedPlan()
    assert "broadcast" in plan.toString().split("Join LeftOuter")[1].split("\n")[0]
    titles = spark.range(1).select(F.col("id").alias("k"), F.concat(F.lit("Acme falls "), F.col("id"), F.lit("%")).alias("title"))
    weights = spark.createDataFrame([("acme", 1.0)], "feature string, weight double")
    assert M.flag(titles, weights, ["k"])._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
