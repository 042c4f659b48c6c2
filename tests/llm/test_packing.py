"""Tokens against the tokenizer itself, and packing against its rules."""

import random
import zlib
from math import ceil

import numpy as np
import pytest

from tickloom.llm import packing
from tickloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, sequence_id long, offset string"
TEXTS = ["", None, "Hello, world.", "don't stop: I'm OK!", "Größe ÉTÉ naïve ﬁ ½ x² ΣΑΣ İstanbul İ. aİ, क़; e\u0301. ǰ! ΐ? ﬃ: Å. ﷺ. ㎏,", 'say "foo". a.b, c..', "a " * 9000, "<|endoftext|> x", "١٢٣ 456 7,8", "é té.", "日本語 テキスト。 한국어", "\t\n \x0b", "x" * 5000, "ab-cd ... !? ?! ok;"]


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    definition = open(tokenizer_path("word_bpe_49k.json")).read()
    plain, ours = Tokenizer.from_str(definition), packing.WordTokenizer(definition)
    rng = random.Random(1)
    pool = [w for t in TEXTS if t for w in t.split()] + ["".join(rng.choices("abcdeéß.,'\"1²Σσ", k=rng.randint(1, 9))) for _ in range(3000)]
    added = [f"{a}{w}{b}" for w in ("<|endoftext|>", "<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|EndOfText|>") for a in ("", "x", "X.") for b in ("", "Y", "!")]
    texts = [*added, " ".join(added)] + [t or "" for t in TEXTS] + [" ".join(rng.choices(pool, k=30)) for _ in range(300)]
    for text, raw in zip(texts, ours.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_every_letter_before_a_mark():
    """Each character that Python takes for a letter, alone and after a letter, before a mark."""
    from tokenizers import Tokenizer

    definition = open(tokenizer_path("word_bpe_49k.json")).read()
    plain, ours = Tokenizer.from_str(definition), packing.WordTokenizer(definition)
    texts = [w + packing.MARKS[c % 6] for c in range(128, 0x32000) if chr(c).isalpha() or chr(c).lower().isalpha() for w in (chr(c), "a" + chr(c))]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        for text, raw, e in zip(part, ours.ids([t.encode() for t in part]), plain.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == e.ids, (text, [hex(ord(x)) for x in text])


def test_complements_are_found_if_there_are_any():
    """Singles, pairs and triples against all combinations, while the counts run out."""
    from collections import Counter
    from itertools import combinations_with_replacement

    rng = np.random.default_rng(1)
    counts = np.zeros(41, np.int64)
    for length in rng.integers(1, 41, 60):
        counts[length] += 1
    index = packing.Complements(counts)
    for length in [int(x) for x in rng.permutation(np.repeat(np.arange(41), counts))]:
        while index.left[length]:
            there = [x for n in (0, 1, 2, 3) for x in combinations_with_replacement(range(1, 41), n) if sum(x) == 40 - length and all(index.left[k] >= m for k, m in Counter((length, *x)).items())]
            found = index.of(length, 40)
            assert (found is None) == (not there) and (found is None or (tuple(sorted(found)) in there and len(found) == len(there[0])))
            if found is None:
                break
            index.use((length, *found))


def holds(rows, capacity=4096):
    """Every sequence is gapless from 0 and fits."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_packed_whole(spark):
    rng = random.Random(2)
    docs = [(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(["rain"] * rng.choice([1, 3, 95, 700, 2047])), 5, None) for i in range(150)] + [(None, "a b", 1, None), (100, "a b", 1, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = packing.pack_documents(df, tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    n = holds(rows)
    assert sum(r.length for r in rows) / 4096 <= n <= ceil(sum(r.length for r in rows) / 4096) + 1
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length <= 4096 and r.start == 4096 * r.piece
        if r.doc_id is not None and r.doc_id != 100:
            whole.setdefault(r.doc_id, []).append(ids)
    assert set(whole) == {d[0] for d in docs} - {None, 100}
    assert all(np.concatenate(x)[-1] == 1 for x in whole.values())


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_all_pieces_once_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    for length in rng.integers(1, 101, 2000):
        counts[length] += rng.integers(1, 4)
    plan = packing.plan_patterns(counts, 100)
    used = np.zeros(101, np.int64)
    for lengths, n in plan:
        assert sum(lengths) <= 100 and n > 0
        np.add.at(used, list(lengths), n)
    assert (used == counts).all()
    assert sum(n for _, n in plan) <= ceil((counts * np.arange(101)).sum() / 100) * 1.2 + 1


def test_no_rows_and_bad_lengths(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError, match="does not fit"):
        packing.pack(spark.createDataFrame([(1, 0, 5000)], "doc_id long, piece int, length int"))


def test_runs_of_marks_are_split_off_and_letters_are_learned_once():
    from tokenizers import Tokenizer

    definition = open(tokenizer_path("word_bpe_49k.json")).read()
    plain, ours = Tokenizer.from_str(definition), packing.WordTokenizer(definition)
    rng = random.Random(3)
    stems = ["rain", "RAIN", "Größe", "ÿ", "ΣΑΣ", "K", "ẞ", "é", "µ", "l'eau", "don't", "x²", "日本"]
    words = [a + "".join(rng.choices(packing.MARKS, k=rng.randint(0, 4))) + b for a in stems for b in ("", "s", "'s", "S'", "̸") for _ in range(40)]
    for word, raw in zip(words, ours.ids([w.encode() for w in words]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(word, add_special_tokens=False).ids, word
    ours = packing.WordTokenizer(definition)
    ours.ids([b"rain.### Rain$$$ RAIN!! rain"])
    assert set(ours.stems) == {"rain"} and len(ours.words) == 4
