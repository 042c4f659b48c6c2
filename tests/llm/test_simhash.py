"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component int"


def plain_fingerprint(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    """Smallest id reachable, by all pairs of (id, fingerprint)."""
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É"]
    docs = []
    for i in range(120):
        if docs and rng.random() < 0.6:
            words = (rng.choice(docs)[1] or "").split(" ")
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((i, " ".join(words)))
        else:
            docs.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 60, 120])))))
    return [*docs, (120, None), (121, ""), (122, " \t\n"), (123, "W1 w2"), (124, "w1\x0bw2")]


@pytest.mark.parametrize("spare", [2, 3])
def test_components_equal_all_pairs(spark, spare):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], SCHEMA).repartition(3)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(df, spare=spare).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    assert {i: f for i, (f, _) in got.items()} == dict(fps)
    assert {i: c for i, (_, c) in got.items()} == plain_components(fps)


def test_chains_of_close_fingerprints_are_one_component(spark):
    rng = random.Random(3)
    fps, x = [], rng.getrandbits(64)
    for _ in range(300):
        fps.append(x)
        for b in rng.sample(range(64), rng.choice([1, 4, 5])):
            x ^= 1 << b
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    from tickloom.llm.components import components

    found = {r.node: r.component for r in components(simhash.close_links(df)).collect()}
    want = plain_components(list(enumerate(fps)))
    assert {i: found.get(i, i) for i in range(len(fps))} == want and len(set(want.values())) > 1


def test_one_of_each_component_stays(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(5, text, "a", 1), (3, text, "b", 2), (9, "other words here at all", "c", 3), (None, text, "d", 4), (3, text, "e", 5)], SCHEMA)
    left = sorted((r.doc_id or -1, r.fp) for r in simhash.keep_first(df).collect())
    assert left == [(-1, "d"), (3, "b"), (3, "e"), (9, "c")]
    assert simhash.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_an_id_link_and_shared_ids_do_not(spark, monkeypatch):
    """Fingerprints 0, 15 and 255: the middle one, whose row has no id, is within four bits of both.  Two far ones share an id."""
    far = 0x0F0F0F0F00000000
    prints = {"a": 0, "b": 15, "c": 255, "d": far, "e": far ^ (1 << 63) - 1}
    fps = spark.createDataFrame([(1, 0), (None, 15), (2, 255), (7, prints["d"]), (7, prints["e"]), (9, prints["e"] ^ 1), (None, 0x3333333333333333)], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: fps)
    got = {(r.id, r.fp): r.component for r in simhash.near_duplicates(fps).collect()}
    assert got[1, 0] == got[None, 15] == got[2, 255] == 1
    assert got[7, prints["d"]] == 7 and got[7, prints["e"]] == got[9, prints["e"] ^ 1] == 7
    assert got[None, 0x3333333333333333] is None
