"""SentencePiece ids and texts against the library."""

import random

import numpy as np
import sentencepiece

from tickloom.llm import subword
from tickloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, ids string"
TEXTS = [None, "", "Hello world", "  two  spaces ", "été naïve Größe", "日本語 ☃", "a▁b", "tab\tnew\nline", "x" * 300, "1234 567.89", " ", "the " * 500]


def test_round_trip_equals_the_library(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = TEXTS + [" ".join("".join(rng.choices("etaoinsrhdlu é", k=rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    table = subword.encode(df, path)
    ids = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in table.collect()}
    for i, t in enumerate(texts):
        assert ids[i] == library.encode(t or ""), t
    back = {r.id: r.text for r in subword.decode(table, path).collect()}
    assert all(back[i] == library.decode(ids[i]) for i in ids)
    assert subword.encode(df.limit(0), path).count() == 0


def test_unigram_path_is_the_best_one():
    import itertools

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -3.2, 1), ("ba", -4.1, 1), ("bab", -6.0, 1)]

    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    import struct

    model = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    model += field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0, 5 << 3, 1, 3 << 3, 1]))
    m = subword.Subword(model)
    known = {p: s for p, s, t in pieces if t == 1}
    words = ["▁" + "".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)]
    for word, raw in m.encode_words(words).items():
        ids = np.frombuffer(raw, "<u4").tolist()
        cuts = ([word[i:j] for i, j in zip((0, *c), (*c, len(word)), strict=True)] for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
        best = max(sum(known[p] for p in parts) for parts in cuts if all(p in known for p in parts))
        assert abs(sum(m.scores[i] for i in ids) - best) < 1e-6 and "".join(m.pieces[i][0] for i in ids) == word


def test_a_long_word_needs_memory_in_proportion():
    import tracemalloc
    from pathlib import Path

    rng = random.Random(3)
    word = "".join(rng.choices("etaoinsrhdlu", k=100_000))
    path = tokenizer_path("piece_bpe_32k.model")
    model = subword.Subword(Path(path).read_bytes())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    short = word[:5_000]
    assert np.frombuffer(model.encode([short])[0], "<u4").tolist() == library.encode(short)
    tracemalloc.start()
    (raw,) = model.encode([word])
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    assert model.decode(raw) == word


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "i", "j", 5), (1, "a b", "i", "j", 5), (None, None, None, None, None)], "doc_id long, text string, ids string, id string, __text int")
    path = tokenizer_path("piece_bpe_32k.model")
    table = subword.encode(df, path, carry=("id", "ids", "__text"))
    assert table.columns == ["id", "__text", "ids"] and sorted((r.id or 0, r["__text"] or 0, len(r.ids)) for r in table.collect()) == [(0, 0, 0), (1, 5, 8), (1, 5, 8)]
    back = subword.decode(table, path, keep=("id", "__text"))
    assert sorted((r.id or 0, r.text) for r in back.collect()) == [(0, ""), (1, "a b"), (1, "a b")]
