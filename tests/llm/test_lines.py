"""Line de-duplication against all pairs."""

import random
from fractions import Fraction

import pytest

from tickloom.llm import lines, setjoin

SCHEMA = "doc_id long, text string, n_chars int, id string"


def words(line):
    return frozenset(line.encode().lower().split())


def brute(docs, similarity=Fraction(4, 5)):
    """Places (id, line number) of lines that have an earlier line with enough of their words."""
    places = sorted((i, j, words(x)) for i, t in docs if t is not None and i is not None for j, x in enumerate(t.split("\n")))
    gone = set()
    for n, (i, j, w) in enumerate(places):
        for k, m, v in places[:n]:
            if w and v and (k, m) != (i, j) and Fraction(len(w & v), len(w | v)) >= similarity:
                gone.add((i, j))
                break
    return gone


def cleaned(docs):
    gone = brute(docs)
    return {(i, "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone)) for i, t in docs if t is not None and i is not None}


def corpus(seed, n=60):
    rng = random.Random(seed)
    common, rare = [f"w{k}" for k in range(6)], [f"r{k}é" for k in range(300)]
    pool, out = [], []
    for i in range(n):
        body = []
        for _ in range(rng.randint(1, 6)):
            if pool and rng.random() < 0.5:
                old = rng.choice(pool).split(" ")
                if rng.random() < 0.7 and old:
                    old[rng.randrange(len(old))] = rng.choice(rare)
                if rng.random() < 0.3:
                    old.append(rng.choice(common))
                line = " ".join(old)
            else:
                line = " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 25)))
            pool.append(line)
            body.append(line.upper() if rng.random() < 0.1 else line)
        out.append((i, "\n".join(body)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(3)
    got = {(r.id, r.text) for r in lines.dedup_lines(df).collect()}
    assert got == cleaned(docs)


def test_shared_words_are_counted_over_all_files(spark):
    """The third line matches the second only; of the three prefix words that show it, the first line has the rarest as well."""
    shared, other = [f"s{k}" for k in range(178)], [f"z{k}" for k in range(199)]
    first = " ".join([shared[0], *other])
    second, third = (" ".join([*shared, *(f"{own}{k}" for k in range(22))]) for own in ("x", "y"))
    often = shared[3:] + other  # in short lines, which make them frequent words
    short = "\n".join(" ".join(often[i : i + 20]) for i in range(0, len(often), 20))
    docs = [(1, first), (2, second), (3, third), *[(10 + k, short) for k in range(5)]]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(3)
    assert (3, 0) in brute(docs)
    assert {(r.id, r.text) for r in lines.dedup_lines(df).collect()} == cleaned(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_that_drift(spark, seed):
    """Long lines that change word by word, over many generations, so that lines match some of their family only."""
    rng = random.Random(seed)
    docs, at = [], 0
    for f in range(6):
        family = [[f"f{f}w{k}" for k in range(rng.randint(60, 200))]]
        for _ in range(70):
            new = list(rng.choice(family[-8:]))
            for k in rng.sample(range(len(new)), rng.randint(1, len(new) // 7)):
                new[k] = rng.choice([f"f{f}w{rng.randint(0, 260)}", f"own{rng.getrandbits(40)}", f"c{rng.randint(0, 40)}"])
            family.append(new)
        for x in family:
            docs.append((at, " ".join(x)))
            at += 1
    ids = list(range(at))
    rng.shuffle(ids)
    docs = [(ids[i], t) for i, t in docs]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(3)
    assert {(r.id, r.text) for r in lines.dedup_lines(df).collect()} == cleaned(docs)


def test_edges(spark):
    long = " ".join(f"x{k}" for k in range(5000))
    docs = [(1, None), (None, "a b c"), (2, ""), (3, "a b c\n\n \na  b\tc"), (4, "C b a"), (5, long), (6, long + " y"), (7, "\n\n"), (8, "one two"), (8, "one two")]
    df = spark.createDataFrame([(i, t, 0, None) for i, t in docs], SCHEMA)
    got = sorted(((r.id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (None, "a b c", 1, 0), (2, "", 1, 0), (3, "a b c\n\n ", 4, 1), (4, "", 1, 1), (5, long, 1, 0), (6, "", 1, 1), (7, "\n\n", 3, 0), (8, "one two", 1, 0), (8, "one two", 1, 0)], key=str)
    kept = sorted(((r.doc_id, r.text, r.n_chars) for r in lines.clean_documents(df).collect()), key=str)
    assert (1, None, 0) in kept and (None, "a b c", 0) in kept and (3, "a b c\n\n ", 8) in kept
    assert not {4, 6} & {r[0] for r in kept}


def test_rows_that_repeat_an_id_lose_no_line_of_another(spark):
    a, b, c = ("one two three four five", "six seven eight nine ten", "a b c d e f")
    df = spark.createDataFrame([(1, a, 0, None), (5, f"{b}\n{c}", 0, None), (5, f"{a}\nlone words here", 0, None), (5, f"{b}\n{c}", 0, None)], SCHEMA)
    got = sorted((r.id, r.text) for r in lines.dedup_lines(df).collect())
    assert got == sorted([(1, a), (5, f"{b}\n{c}"), (5, f"{b}\n{c}"), (5, "lone words here")]) or got == sorted([(1, ""), (5, f"{b}\n{c}"), (5, f"{b}\n{c}"), (5, f"{a}\nlone words here")])
    kept = sorted((r.doc_id, r.text) for r in lines.clean_documents(df).collect())
    assert kept == [x for x in got if x[1]]


def test_a_decoy_hides_no_match(spark):
    """A line and its match, once alone and once with an earlier line, not alike enough, that shares rare words with the later one."""
    rng = random.Random(7)
    for decoys in (0, 1, 2, 5):
        words_ = [f"m{k}" for k in range(20)]
        earlier, later = words_[:18] + ["x1", "x2"], words_[:18] + ["y1", "y2"]
        docs = [(k, " ".join(rng.sample([*later[:17], f"d{k}a", f"d{k}b", f"d{k}c"], 20))) for k in range(decoys)] + [(50, " ".join(earlier)), (60, " ".join(later))]
        df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(3)
        assert {(r.id, r.text) for r in lines.dedup_lines(df).collect()} == cleaned(docs)


@pytest.mark.parametrize("most", [1, 3])
def test_many_lines_share_rare_words(spark, most):
    """Hundreds of lines around the threshold, of which each has many candidates that do not match."""
    rng = random.Random(11)
    docs = []
    for i in range(400):
        group = rng.randrange(4)
        n = rng.choice([9, 30, 120, 260])
        docs.append((i, " ".join(rng.sample([f"g{group}w{k}" for k in range(int(n * 1.12))], n))))
    source = spark.createDataFrame([(i, i, t) for i, t in docs], "key long, id long, text string").repartition(3)
    got = {(r.g_id, k) for r in lines.repeated_lines(source, most=most).collect() for k in r.gone}
    assert got == brute(docs) and 50 < len(got) < 390


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.dedup_lines(df).count() == 0 and lines.clean_documents(df).count() == 0


def test_word_hashes_tell_words_apart():
    raw = b"a b ab ba  a\tb\n" + b" ".join(b"k%d" % k for k in range(5000))
    h, start = setjoin.hashed_words(raw)
    found = raw.split()
    assert len(h) == len(found) == len(start)
    assert len(set(h.tolist())) == len(set(found))
    assert [raw[a : a + len(w)] for a, w in zip(start.tolist(), found, strict=True)] == found
