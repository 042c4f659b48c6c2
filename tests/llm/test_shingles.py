"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
from tickloom.llm import setjoin, shingles as near, simhash

SCHEMA = "doc_id long, text string, id string, gone int"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    """Ids of documents with an earlier one of five-word Jaccard similarity 0.8 at least."""
    sets, gone = sorted(((i, shingles(t)) for i, t in docs if i is not None), key=lambda x: x[0]), set()
    for n, (i, a) in enumerate(sets):
        if any(5 * len(a & b) >= 4 * len(a | b) for k, b in sets[:n] if k != i):
            gone.add(i)
    return gone


def corpus(seed):
    rng = random.Random(seed)
    docs = [(0, ""), (1, None), (2, "One  two\nthree"), (3, "one two three"), (4, "one two four")]
    while len(docs) < 200:
        if len(docs) > 10 and rng.random() < 0.6:
            words = rng.choice(docs[5:])[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = f"own{rng.getrandbits(30)}"
            docs.append((len(docs), " ".join(words[rng.randint(0, 4) :]) or "x"))
        else:
            docs.append((len(docs), " ".join(f"w{rng.randint(0, 80)}" for _ in range(rng.choice([3, 6, 40, 200, 600])))))
    return docs


def test_the_stage_equals_all_pairs(spark):
    docs = corpus(5)
    gone = brute(docs)
    extra = [(None, docs[9][1]), (500, "a b c d e f"), (500, docs[9][1]), (501, "k l m n o p"), (501, "k l m n o p")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs + extra], SCHEMA).repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None and r.doc_id < 500) == sorted((i, t) for i, t in docs if i not in gone)
    assert len(gone) > 40 and left.where("doc_id is null").count() == 1 and left.where("doc_id >= 500").count() == 4


def test_no_rows(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_simhash_links_are_made_and_checked(spark, monkeypatch):
    """Fingerprints link copies and one pair that shares but a repeated word; the copies go, even if the join names nothing."""
    rng = random.Random(7)
    text = [f"w{rng.randint(0, 900)}" for _ in range(400)]
    docs = [(1, " ".join(text)), (2, " ".join(text)), (3, " ".join([*text[:399], "own"])), (4, "a " * 900 + "b c d e f"), (5, "a " * 900 + "g h i j k"), (6, "l m n o p q"), (7, "L m n\to p q")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], SCHEMA)
    made = []
    plain = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    monkeypatch.setattr(near, "first_round", lambda filed, num, den, most: setjoin.first_round(filed.where("file < 0"), num, den, most))
    left = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6]
    assert {(r.id, r.component) for r in made[0].where("id <> component").collect()} == {(2, 1), (3, 1), (5, 4), (7, 6)}
    assert brute(docs) == {2, 3, 7}
