"""Fill-in-the-middle: texts cut at token boundaries into prefix, middle and suffix, and put in another order.

Tokens are runs of ASCII letters and every other code point by itself.  Nothing is split: a text becomes a byte for each code point,
`bytes.translate` makes a mask of letters of it, and the mask is one big integer with a bit for each code point.  A shift and two boolean
operations leave a bit where a token begins; `bit_count` is their number; the bit of a given rank is found by halving the integer, where
a count of the lower half says which half holds it.  All of it is linear in the text and needs about three bytes for each code point.

Texts are never moved between tasks: the transformation and its reversal are maps, so no key can be hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small, utf8_list

MARKERS = ("<P>", "<S>", "<M>")
BATCH = 8 << 20  # bytes of text that are worked on at a time
_LETTERS = bytes(ord("1") if chr(i).isalpha() else ord("0") for i in range(128)) + b"0" * 128


def boundaries(text: str) -> int:
    """An integer whose bit i is 1 if a token begins at code point i."""
    if not text:
        return 0
    one_byte_each = text.encode("ascii", "replace")
    letters = int(one_byte_each.translate(_LETTERS)[::-1], 2)
    return ((1 << len(text)) - 1) ^ (letters & (letters << 1))


def select(bits: int, rank: int) -> int:
    """Place of the 1 bit that has `rank` others below it, by recursive halving."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, at, rank = bits >> half, width - half, at + half, rank - below
    return at


def cut_points(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of tokens n, and the code points before which the smaller and the larger of first % (n + 1) and second % (n + 1) tokens lie."""
    bits = boundaries(text)
    n = bits.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, select(bits, a) if a < n else len(text), select(bits, b) if b < n else len(text)


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first four groups of eight digits of the SHA-256 of `seed:key`."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))  # type: ignore[return-value]


def rearrange(text: str, key: object, *, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and middle (None if plain), and the rearranged text."""
    h1, h2, h3, h4 = draws(key, seed)
    n, a, b = cut_points(text, h1, h2)
    if not text or h3 % 100 >= plain_from or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; `plain_from` and `spm_below` are percentages.

    Null text is empty, and an empty text is plain.  A text with a marker in it is plain, so that every output can be read back.  A null
    id draws as an empty one; rows with the same id draw alike, but are cut by their own text.  Other columns, whatever their names, are
    left out.  No rows give no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1, BATCH):
            # bytes that are no UTF-8 go through and come back as they were
            texts = [x.decode("utf-8", "surrogateescape") for x in utf8_list(batch.column(1))]
            n, form, prefix, middle, out = zip(*(rearrange(t, i, seed=seed, plain_from=plain_from, spm_below=spm_below) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)), strict=True)
            written = pa.array([x.encode("utf-8", "surrogateescape") for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), written], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = rows.mapInArrow(each, "id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return got.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation.  Cut texts hold no marker, and none can arise where two parts meet, so the markers split the
    output into its three parts."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
