"""Context mixing against a plain model that knows nothing of blocks, segments in step, or shards."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ctxmix, queries


def lower(text):
    return (text or "").encode().lower()


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Plain:
    """Counts of nodes, and a text's bits one after the other with the weights of the text's segment."""

    def __init__(self, train):
        self.nodes = Counter()
        for raw in train:
            for at, byte in enumerate(raw + ctxmix.END):
                for k, ctx in self.contexts(raw, at):
                    for depth in range(9):
                        self.nodes[k, ctx, depth, byte >> (8 - depth)] += 1

    @staticmethod
    def contexts(raw, at):
        padded = bytes(ctxmix.HEAD) + raw
        return [(i, ctxmix_context(padded[: at + ctxmix.HEAD], i)) for i in range(len(ctxmix.ORDERS))]

    def logits(self, raw, at, depth, prefix):
        """Of bit 1 against bit 0 at a node, by every predictor."""
        out = []
        for k, ctx in self.contexts(raw, at):
            one, zero = (self.nodes[k, ctx, depth + 1, prefix * 2 + b] for b in (1, 0))
            out.append(max(-40, min(40, round(ctxmix.UNIT * math.log((one + ctxmix.DELTA) / (zero + ctxmix.DELTA))))))
        return out

    def bits(self, raw, also_next=None):
        """Bits of the text and its end; also_next: the sum of the probabilities of all 256 bytes that may come at that place."""
        total, body, found = 0.0, raw + ctxmix.END, None
        for at, byte in enumerate(body):
            if at % ctxmix.SEGMENT == 0:
                weights, scales = [[w / ctxmix.UNIT for w in ctxmix.START] for _ in range(8)], list(ctxmix.SCALES)
            if at == also_next:
                found = sum(2.0 ** -self.byte(raw, at, x, [list(w) for w in weights], list(scales)) for x in range(256))
            total += self.byte(raw, at, byte, weights, scales)
        return (total, found) if also_next is not None else total

    def byte(self, raw, at, byte, weights, scales):
        cost = 0.0
        for bit in range(8):
            came = byte >> (7 - bit) & 1
            x = self.logits(raw, at, bit, byte >> (8 - bit))
            gate = sum(v != 0 for v in x)
            plain = sum(w * v for w, v in zip(weights[bit], x, strict=True))
            p = 1 / (1 + math.exp(-max(-10.0, min(10.0, plain * scales[gate]))))
            cost -= math.log2(p if came else 1 - p)
            miss = came - p
            weights[bit] = [w + ctxmix.RATE / ctxmix.UNIT**2 * miss * scales[gate] * v for w, v in zip(weights[bit], x, strict=True)]
            scales[gate] = max(0.2, min(8.0, scales[gate] + ctxmix.SCALE_RATE * miss * plain))
        return cost


def ctxmix_context(before, i):
    """What predictor i sees of the bytes before: its bytes of a key without the byte itself."""
    key, _ = ctxmix.grams([before[-ctxmix.HEAD :]], [b"?"])
    return (int(key[0]) >> 8 * (5 - ctxmix.ORDERS[i])) & ((1 << 8 * ctxmix.ORDERS[i]) - 1)


def test_keys_hold_the_bytes_before():
    (key,), _ = ctxmix.grams([b"12345678"], [b"?"])
    assert int(key).to_bytes(6, "big")[:5] == b"?8765"
    (other,), _ = ctxmix.grams([b"12945678"], [b"?"])
    assert int(key) >> 8 == int(other) >> 8 and key != other


def test_sorting_with_and_without_packing(monkeypatch):
    key, _ = ctxmix.grams([bytes(8)], [bytes(random.Random(1).choices(range(256), k=5000)) + b"abcabcabc" * 100])
    packed = ctxmix.ordered(key)
    monkeypatch.setattr(ctxmix, "_dense", lambda x: (x.astype(np.uint64), 24))
    for got, want in zip(ctxmix.ordered(key), packed, strict=True):
        assert (got == want).all()


def expected(rows):
    train = [lower(t) for i, t in rows if not held(i)]
    words = Counter(w for raw in train for w in re.findall(rb"[^\x20\x09-\x0D]+", raw))
    words[None] = len(train)
    words = +words
    n, v, plain = sum(words.values()), len(words), Plain(train)
    out = []
    for i, t in rows:
        tokens = [*re.findall(rb"[^\x20\x09-\x0D]+", lower(t)), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, held(i), len(tokens), sum(w in words for w in tokens), n, base, -plain.bits(lower(t)) * math.log10(2)))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6), r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-4, abs=2e-3)


COLUMNS = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def made(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice("The the cat CAT sat on a mat été 中文 of".split()) for _ in range(rnd.randint(0, 12))) + rnd.choice(["", "\n", "\t end."])) for i in range(n)]


def test_equals_the_plain_model(spark, monkeypatch):
    rows = made(60) + [(100, None), (101, ""), (None, "the cat"), (7, "again another text"), (7, "again another text"), (8, "x" * 300), (8, " \r\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "held": F.lit(1), "BODY": F.lit(None).cast("string")})
    want = expected(rows)
    check(ctxmix.score(docs).select(COLUMNS).collect(), want)
    check(ctxmix.score(docs, block_bytes=300, shard_bytes=200).select(COLUMNS).collect(), want)  # many blocks and shards


def test_segments_and_pieces_leave_the_sum(monkeypatch):
    """A text of several segments, its contexts going on over their edges."""
    rows = [(1, " ".join(t for _, t in made(70, 3)))]
    raw = lower(rows[0][1])
    assert b"".join(ctxmix.pieces(raw, 50)) == raw
    assert all(x[-1:] in b" \n\t" for x in list(ctxmix.pieces(raw, 50))[:-1])
    assert [len(x) for x in ctxmix.pieces(b"y" * 200 + b" z", 50)] == [201, 1]


def test_long_text(spark):
    rows = [*made(30, 5), (500, " ".join(t for _, t in made(190, 3)))]
    assert len(lower(rows[-1][1])) > 2 * ctxmix.SEGMENT
    check(ctxmix.score(spark.createDataFrame(rows, "doc_id long, text string")).select(COLUMNS).collect(), expected(rows))


def test_probabilities_of_what_may_come_sum_to_one():
    plain = Plain([lower(t) for _, t in made(40)])
    for at in (0, 3, 17):
        assert plain.bits(b"the cat sat on a mat of", also_next=at)[1] == pytest.approx(1, abs=1e-9)


def test_logits_of_unseen_nodes_are_zero():
    key = np.array([256 + 65, 256 + 66, 512 + 65], np.uint64)
    got = ctxmix.logits(key, np.array([3, 0, 0])).view(np.int8).reshape(3, 8)
    assert (got[2] == 0).all()
    assert (got[0, :6] > 0).all() and (got[1, :6] == got[0, :6]).all()
    assert (got[0, 6] == -got[1, 6]) and got[0, 6] > 0


def test_without_rows_and_without_training(spark):
    assert ctxmix.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(1000) if held(i))
    (r,) = ctxmix.score(spark.createDataFrame([(only, "Ab c")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert r.score == pytest.approx(-5 * 8 * math.log10(2))


def test_query_beats_the_base_on_held_out_text(spark, sf):
    got = queries.op12_context_mixing(spark, sf).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    train = [lower(t) for i, t in texts.items() if not held(i)]
    words = Counter(w for raw in train for w in raw.split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    for r in got:
        tokens = lower(texts[r.doc_id]).split()
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(tokens) + 1, sum(w in words for w in tokens) + 1)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_mixing_takes_a_few_steps_a_bit(monkeypatch):
    """Sums and weights of a byte's eight bits are done at once: one sum of products for each byte, not one for each bit."""
    calls, plain = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rng = np.random.default_rng(2)
    values = rng.integers(-20, 20, (4, 40, 8)).astype(np.int8).view(np.uint64).reshape(4, -1)
    bits = ctxmix.mix(values, np.array([3] * 10 + [1] * 10))
    assert len(calls) == 20 and len(bits) == 3 and (bits > 0).all()
    assert np.allclose(ctxmix.mix(np.zeros((4, 5), np.uint64), np.ones(5, int)), 40)


def block(texts, copies, held=False):
    rows = [(i, held, b"", 0, True, n, bytes(ctxmix.HEAD), len(t), pa.compress(t, "zstd", asbytes=True) if t else b"", 0, 3) for i, (t, n) in enumerate(zip(texts, copies, strict=True))]
    names = [x.split()[0] for x in ctxmix.PIECES.split(", ")] + ["block", "shards"]
    return pa.table({name: list(x) for name, x in zip(names, zip(*rows, strict=True), strict=True)})


def test_words_and_their_places_equal_split():
    for texts in ([b"", b" b a\t\nb\x0b\x0c\r", b"a", "é\x85 é\xa0c \x1c".encode(), b"  "], [b""], [b" \n"], [b"x"]):
        words, place, own = ctxmix._words(block(texts, [1] * len(texts)))
        assert words == sorted({w for t in texts for w in t.split()})
        assert own.tolist() == [len(t.split()) for t in texts]
        assert [words[i] for i in place] == [w for t in texts for w in t.split()]


def test_a_block_is_named_without_slow_sorts(monkeypatch):
    """What is sorted with its place is sorted as one number, the rest by counting 8 or 16 bits; repeated texts are no exception."""
    kinds, plain = set(), np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: kinds.add(x.dtype.itemsize) or plain(x, *a, **k))
    named = ctxmix._namer(3)(block([b"one two one", b"two three", b"", b"one"], [1, 5, 1, 2]))
    assert kinds and max(kinds) <= 2
    found = {}
    for row in named.to_pylist():
        if row["many"][0]:
            found |= dict(zip(ctxmix._text(row["names"][0]).split(b" "), ctxmix._unpack(row["counts"][0], row["many"][0], "<i8").tolist(), strict=True))
    assert found == {b"one": 4, b"two": 6, b"three": 5}
