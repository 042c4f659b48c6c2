"""Line de-duplication as an exact set-similarity self-join.

Lines are sets of words (A-Z lower-cased, split at ASCII spaces).  A line goes if an earlier line - by document id, then line
number - has Jaccard similarity of at least the threshold with it; blank lines stay.

1. Equal lines of a batch are collapsed to the first of them; lines that are equal over batches meet by their 128-bit digest.
2. A fixed-size sketch of word counts over the whole corpus (2 MB of counters, whatever the corpus) orders words by rarity.
   Any order that is the same everywhere keeps the prefix filter exact; the sketch errs towards calling a word frequent.
3. `setjoin` files the rarest words of each line and names candidates: prefix, positional and length filters, and a parity sketch.
4. The earlier line of each candidate pair is taken to the later one's document, where Jaccard is verified exactly.  Lines that their
   earliest candidates do not settle, and that have more, are tried against all of their candidates.

It is one Spark plan: documents are moved once, by id, and files once, and both exchanges are reused.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, doc_slices, free_name, small, text_bytes, utf8_list
from tickloom.llm.setjoin import PIECE, PLACE, POSTING, by_file, candidates_table, file_count, first_round, open_in, pairs_of, postings, rarity_sketch, repeats, second_round, unsqueeze, words_of

#: White space of `[\x20\x09-\x0D]`.
SPACES = r"[\x20\x09-\x0D]+"
BATCH = 8 << 20  # bytes of text whose lines are collapsed and filed together
FEW_REPEATS = 100_000  # repeated ids that are broadcast: some 2 MB
DIGEST = np.dtype([("high", "<u8"), ("low", "<u8"), ("id", "<i8"), ("line", "<i4")])
FILED = "file int, postings binary, digests binary, id long, line int"


def _words(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, SPACES), lambda w: w != ""))


def _filer(sketch, files: int, num: int, den: int):
    """Turns (id, text) into packed postings and digests by file, and lines that equal an earlier line of the batch into rows of their own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1, BATCH):
            first: dict[bytes, tuple[int, int]] = {}
            again: list[tuple[int, int]] = []
            for i, x in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True):
                for j, line in enumerate(x.lower().split(b"\n")):
                    held = first.setdefault(line, (i, j))
                    if held != (i, j):
                        first[line] = min(held, (i, j))
                        again.append(max(held, (i, j)))
            texts = [line for line in first if line.strip()]
            places = np.array([first[x] for x in texts], PLACE)
            made = [np.zeros(0, POSTING)]
            for a, b in doc_slices([len(x) for x in texts], PIECE):
                made.append(postings(places[a:b], *words_of(texts[a:b]), sketch.value, num, den))
            p = np.concatenate(made)
            equal = np.zeros(len(texts), DIGEST)
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<u8").reshape(-1, 2)
            equal["high"], equal["low"], equal["id"], equal["line"] = both[:, 0], both[:, 1], places["id"], places["line"]
            p_file, p_part = by_file(p, p["word"], files)
            d_file, d_part = by_file(equal, equal["high"], files)
            n, m, k = len(p_part), len(d_part), len(again)
            columns = [pa.array([*p_file, *d_file, *(i % files for i, _ in again)], pa.int32()), pa.array([*p_part, *[None] * (m + k)], pa.binary()), pa.array([*[None] * n, *d_part, *[None] * k], pa.binary())]
            columns += [pa.array([*[None] * (n + m), *(x[c] for x in again)], kind) for c, kind in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "postings", "digests", "id", "line"])

    return each


def _equal(table: pa.Table) -> pa.Table:
    """Candidates without an earlier line: the lines of a file that equal an earlier one."""
    d = np.sort(unsqueeze(table.column("digests"), DIGEST), order=("high", "low", "id", "line"))
    there = (d["id"][1:] == d["id"][:-1]) & (d["line"][1:] == d["line"][:-1])  # equal rows of one key: the same place
    d = d[1:][(d["high"][1:] == d["high"][:-1]) & (d["low"][1:] == d["low"][:-1]) & ~there] if len(d) else d
    again = table.filter(pc.is_valid(table.column("id")))
    return candidates_table(np.concatenate([d["id"], again.column("id").to_numpy()]), np.concatenate([d["line"], again.column("line").to_numpy()]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of rows with an id and a text, and id if it is not the key: rows that repeat an id have a number that id and text
    give as key.  Where no row does, all joins are on (key, text), which Spark moves once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    again = cut(rows.where("id is not null").groupBy(F.col("id").alias("u_id")).count().where("count > 1").select("u_id"))
    n, rows = again.count(), rows.where("id is not null and text is not null")
    if not n:
        return rows.select(F.col("id").alias("key"), "text")
    marked = rows.join(F.broadcast(again) if n <= FEW_REPEATS else again, F.col("id") == F.col("u_id"), "left")
    return marked.select(F.when(F.col("u_id").isNull(), F.col("id")).otherwise(F.xxhash64("id", "text")).alias("key"), "id", "text")


def repeated_lines(source: DataFrame, *, similarity: float = 0.8, file_bytes: int = 4 << 20, most: int = 3) -> DataFrame:
    """(g_id, gone) of source (key, text), texts not null: the numbers of the lines that go from each key.  Rows of one key are equal."""
    part = Fraction(similarity).limit_denominator(1000)
    num, den = part.numerator, part.denominator
    files = file_count(text_bytes(source, "text"), file_bytes)
    sketch = source.sparkSession.sparkContext.broadcast(rarity_sketch(source, "text"))  # a fixed number of counters
    texts = source.select("key", "text")
    filed = texts.mapInArrow(_filer(sketch, files, num, den), FILED).repartition("file")

    def lines_of(df: DataFrame) -> DataFrame:
        """Adds all, the lines of text.  The generator holds them, so that a text is split once and not for each line that is asked for."""
        return df.withColumn("all", F.explode(F.array(F.split("text", "\n"))))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (id, line, e_id, e_line): later lines that match their earlier one.  Pairs of two documents go together:
        first to the earlier document, whose lines they take along - the only text that moves - then to the later one."""
        at = pairs.groupBy("e_id", "id").agg(F.collect_list(F.struct("line", "e_line")).alias("at"))
        pick = lambda n: F.try_element_at("all", n + 1)
        sent = lines_of(at.join(texts, F.col("e_id") == F.col("key")))
        sent = sent.select(F.col("id").alias("l_id"), F.transform("at", lambda x: F.struct(x["line"].alias("line"), pick(x["e_line"]).alias("earlier"))).alias("at"))
        met = lines_of(sent.join(texts, F.col("l_id") == F.col("key")))
        sets = F.transform("at", lambda x: F.struct(x["line"].alias("line"), _words(x["earlier"]).alias("a"), _words(pick(x["line"])).alias("b")))
        alike = F.filter(sets, lambda x: F.size(F.array_intersect(x["a"], x["b"])) * (num + den) >= num * (F.size(x["a"]) + F.size(x["b"])))
        return met.select(F.col("l_id").alias("id"), F.explode(F.transform(alike, lambda x: x["line"])).alias("line")).where("id is not null and line is not null").distinct()

    named = first_round(filed, num, den, most, _equal)
    settled = verified(pairs_of(named)).repartition("id", "line")  # two plans read this exchange
    late = verified(second_round(filed, open_in(named, settled), num, den))
    equal = named.where(repeats()).select("id", "line")
    return equal.union(settled).union(late).groupBy(F.col("id").alias("g_id")).agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, *, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_removed): each document's text without repeated lines, blank lines kept where they are.

    Every row of docs has a row here.  Rows with a null id or text are left as they are (a null text has no lines) and settle no other
    row's lines.  Rows that repeat an id are documents of their own, whose place among the others is set by a hash; equal ones are
    cleaned alike: a line stays in each of them.  No rows give no rows; other columns are not read.
    """
    source = _keyed(docs, id_col, text_col)
    gone = repeated_lines(source, similarity=similarity)
    own = "id" if "id" in source.columns else "key"
    joined = source.join(gone, F.col("key") == F.col("g_id"), "left").select(F.col(own).alias("id"), F.split("text", "\n").alias("all"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stays = F.filter("all", lambda x, i: ~F.array_contains("gone", i) | (F.regexp_replace(x, SPACES, "") == ""))
    out = joined.select("id", F.size("all").alias("n_lines"), stays.alias("left"))
    out = out.select("id", F.array_join("left", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("left")).alias("n_removed"))
    rest = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is null or text is null")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return out.union(rest.select("id", "text", lines.alias("n_lines"), F.lit(0).alias("n_removed")))


def clean_documents(docs: DataFrame, *, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """documents with repeated lines taken out and n_chars, if there is such a column, counted anew.  A document that loses every line
    with a word goes; all others stay, rows with a null id or text as they are."""
    names = docs.columns
    key, old, new = (free_name(x, names) for x in ("clean_id", "clean_old", "clean_text"))
    source = _keyed(docs, id_col, text_col)
    gone = repeated_lines(source, similarity=similarity)
    own = "id" if "id" in source.columns else "key"
    met = source.join(gone, F.col("key") == F.col("g_id")).select(F.col(own).alias("id"), F.xxhash64("text").alias("h"), F.split("text", "\n").alias("all"), "gone")
    stays = F.filter("all", lambda x, i: ~F.array_contains("gone", i) | (F.regexp_replace(x, SPACES, "") == ""))
    cleaned = met.select("id", "h", stays.alias("left"), (F.size("all") - F.size(stays)).alias("n")).where("n > 0")
    cleaned = cleaned.groupBy(F.col("id").alias(key), F.col("h").alias(old)).agg(F.first(F.array_join("left", "\n")).alias(new))
    joined = docs.join(cleaned, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(old)) & F.col(text_col).isNotNull(), "left")
    joined = joined.where(F.col(key).isNull() | (F.regexp_replace(new, SPACES, "") != ""))
    text = F.when(F.col(key).isNull(), F.col(text_col)).otherwise(F.col(new))
    renewed = {text_col: text}
    if count_col in names:
        renewed[count_col] = F.when(F.col(key).isNull(), F.col(count_col)).otherwise(F.char_length(new).cast(docs.schema[count_col].dataType))
    return joined.select(*[renewed[c].alias(c) if c in renewed else F.col(c) for c in names])
