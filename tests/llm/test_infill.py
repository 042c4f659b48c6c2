"""Fill-in-the-middle against tokens that are really split."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import infill, queries


def plainly(doc_id, text):
    """n, form, prefix, middle and output by the definition."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return len(tokens), "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ é\n<>PSM0中\U0001f600\x00"), max_size=70), st.integers(-5, 10**12))
def test_equals_the_definition(text, doc_id):
    assert infill.rearrange(text, doc_id) == plainly(doc_id, text)


def test_select_finds_every_rank():
    random.seed(3)
    for width in (1, 2, 63, 64, 65, 1000):
        bits = random.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [infill.select(bits, r) for r in range(bits.bit_count())] == places


CASES = [(1, None), (2, ""), (3, "one"), (None, "no id here"), (5, "a <P> b"), (5, "repeated id, other text"), (6, "x" * 2_000_000), (7, "é中 😀 " * 200_000), (8, "\n\n\t "), (9, "same"), (9, "same")] + [(i, f"text {i}, w<S w{i} <M") for i in range(10, 70)]


def test_table_with_odd_rows(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").withColumns({"id": F.lit("clash"), "n": F.lit(1), "output": F.lit(None).cast("string"), "FORM": F.lit("x")})
    got = infill.transform(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    rows = [(r.id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1][4])
    assert sorted(rows, key=key) == sorted([(i, plainly(i, t)) for i, t in CASES], key=key)
    assert sorted(r.back for r in got.collect()) == sorted(t or "" for _, t in CASES)


def test_no_rows(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_parameters(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    forms = {r.form for r in infill.transform(docs, plain_from=100, spm_below=100).collect()}
    assert forms == {"spm"}
    assert infill.transform(docs, seed=2).select("prefix_chars").collect() != infill.transform(docs).select("prefix_chars").collect()


def test_query_equals_the_definition(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op13_infill(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, prefix, middle, out = plainly(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(out), sha(texts[r.doc_id]))
