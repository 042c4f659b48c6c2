"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all grades, ordered thresholds theta_1 < ... < theta_K-1.
x has, for every distinct word of a text, log(1 + count) under the hash of the word and of its first letters.  In training each
feature is scaled by how unevenly it is spread over grades (its largest log-odds over the thresholds, as in naive-Bayes
log-count ratios), so that the many features that tell nothing cannot fit noise; the scales are folded into w afterwards.
The score w.x is a sum over words, so a task looks each distinct word up once.  Output is the expected grade, sum of P(grade >= k).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.llm.common import free_name, worker_cache

STRIP = ".,;:!?\"'()[]{}<>*#%&$|-_/\\0123456789¿¡«»…"
WORD_MEMORY = 200_000


def word_features(word: str, width: int, stems: tuple[int, ...]) -> list[int]:
    """Hashed features of a word: itself and its stems (prefixes of the given lengths, if it is longer)."""
    word = word.strip(STRIP)
    if not word:
        return []
    return [xxhash.xxh64_intdigest(f"{n}:{word[:n] if n else word}".encode(), 7) % width for n in (0, *(n for n in stems if len(word) > n))]


@dataclass(frozen=True)
class OrdinalModel:
    """weights (width numbers), thresholds (grades - 1, ascending)."""

    weights: np.ndarray
    thresholds: np.ndarray
    stems: tuple[int, ...]

    def score(self, text: str, words: dict[str, float]) -> float:
        counts, total = Counter(text.lower().split()), 0.0
        for w, c in counts.items():
            v = words.get(w)
            if v is None:
                words[w] = v = float(self.weights[word_features(w, len(self.weights), self.stems)].sum())
            if v:
                total += v * log1p(c)
        return total

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade, from 0 to the number of thresholds."""
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))).sum(axis=1)


CHUNK = 1 << 19  # features that are worked on at a time


def fit_ordinal(sizes: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, weight: np.ndarray, *, width: int, stems: tuple[int, ...], least_rows: int = 3, l2: float = 1e-4, steps: int = 200, rate: float = 0.05) -> OrdinalModel:
    """Weighted maximum likelihood by Adam; thresholds are a first value and positive gaps, so they stay ordered.  Row r has the next
    sizes[r] of the features col (int32, below width) with values val (float32).  Features of fewer than least_rows rows are left out."""
    k, n_rows = int(grades.max()) if len(grades) else 1, len(sizes)
    seen = np.bincount(col, minlength=width) if len(col) else np.zeros(width, np.int64)
    doc = np.repeat(np.arange(n_rows, dtype=np.int32), sizes)
    parts = [slice(i, i + CHUNK) for i in range(0, len(col), CHUNK)]
    scale = np.zeros(width)
    for j in range(1, k + 1):
        p = sum((np.bincount(col[x][(grades >= j)[doc[x]]], minlength=width) for x in parts), np.zeros(width, np.int64))
        n = int((grades >= j).sum())
        scale = np.maximum(scale, np.abs(np.log((p + 1) / (n + 2)) - np.log((seen - p + 1) / (n_rows - n + 2))))
    scale[seen < least_rows] = 0
    kept = (scale > 0)[col]
    doc, col, val = doc[kept], col[kept], val[kept]
    del kept
    parts = [slice(i, i + CHUNK) for i in range(0, len(col), CHUNK)]
    for x in parts:
        val[x] *= scale[col[x]]
    weight = weight / max(weight.sum(), 1e-12)
    share = np.array([np.clip((weight * (grades >= j)).sum(), 1e-3, 1 - 1e-3) for j in range(1, max(k, 1) + 1)])
    start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(len(share)))
    theta = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    p = np.concatenate([np.zeros(width), theta])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    at = np.arange(n_rows)
    for step in range(1, steps + 1 if n_rows and k else 1):
        w, raw = p[:width], p[width:]
        cuts = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        s = sum((np.bincount(doc[x], val[x] * w[col[x]], n_rows) for x in parts), np.zeros(n_rows))
        upper = np.r_[cuts, np.inf][grades]
        lower = np.r_[-np.inf, cuts][grades]
        a, b = np.where(np.isinf(upper), 1.0, sig(upper - s)), np.where(np.isinf(lower), 0.0, sig(lower - s))
        prob = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / prob * weight, b * (1 - b) / prob * weight
        g_cut = np.zeros((n_rows, k + 1))
        np.add.at(g_cut, (at, grades), -da)
        np.add.at(g_cut, (at[grades > 0], grades[grades > 0] - 1), db[grades > 0])
        tail = np.cumsum(g_cut[:, :k].sum(axis=0)[::-1])[::-1]
        slope = da - db
        of_w = sum((np.bincount(col[x], val[x] * slope[doc[x]], width) for x in parts), l2 * w)
        g = np.concatenate([of_w, np.r_[tail[0], tail[1:] * np.exp(raw[1:])]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = p[width:]
    return OrdinalModel((p[:width] * scale).astype(np.float32), np.cumsum(np.r_[raw[0], np.exp(raw[1:])]) if k else np.array([np.inf]), stems)


def train(docs: DataFrame, labels: DataFrame, *, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 6000, max_grade: int = 15, width: int = 1 << 18, stems: tuple[int, ...] = (4, 5, 6)) -> OrdinalModel:
    """Fits on at most `sample_rows` labelled rows, in equal parts for the grades 0..max_grade, those with the smallest hash of their id, and
    on all features of their whole texts: 8 bytes a distinct feature, of which a text has some thousand and `width` at the most.

    Rows stand for all labelled rows of their grade (weights correct the sampling).  Null labels, ids or texts are left out,
    as are negative grades; those over max_grade count as max_grade; a repeated label counts once, the highest grade, and every row of a repeated id counts.  Without
    labels the model says 0.
    """
    grades = labels.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).where(F.col("id").isNotNull() & (F.col("grade") >= 0)).groupBy("id").agg(F.least(F.max("grade"), F.lit(max_grade)).alias("grade"))
    counts = {r.grade: r["count"] for r in grades.groupBy("grade").count().collect()}  # max_grade + 1 rows at most
    if not counts:
        return OrdinalModel(np.zeros(width, np.float32), np.array([np.inf]), stems)
    parts = [grades.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(sample_rows // len(counts)) for g in sorted(counts)]
    chosen = parts[0]
    for x in parts[1:]:
        chosen = chosen.union(x)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                cols, vals = [], []
                for text in batch.column(2).to_pylist():
                    found: dict[int, float] = {}
                    for w, c in Counter(text.lower().split()).items():
                        for f in word_features(w, width, stems):
                            found[f] = found.get(f, 0.0) + log1p(c)
                    some = sorted(found)
                    cols.append(np.array(some, "<i4").tobytes())
                    vals.append(np.array([found[f] for f in some], "<f4").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], names=["id", "grade", "cols", "vals"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("id", "grade", "text").mapInArrow(each, "id long, grade int, cols binary, vals binary")
    return _fitted(sample.toArrow(), counts, max_grade, width, stems)  # sample_rows rows at most (more only for repeated ids)


def _fitted(sample: pa.Table, counts: dict[int, int], max_grade: int, width: int, stems: tuple[int, ...]) -> OrdinalModel:
    """The model of the rows of a sample.  Features are read where Arrow holds them, not copied to lists."""
    sample = sample.sort_by([(c, "ascending") for c in ("id", "cols", "vals")])  # rows arrive in any order
    y = sample.column("grade").to_numpy().astype(np.int64)
    of_grade = np.bincount(y, minlength=max_grade + 1)
    weight = np.array([counts[g] / of_grade[g] for g in y.tolist()], np.float64)
    sizes = pc.binary_length(sample.column("cols")).to_numpy().astype(np.int64) // 4
    return fit_ordinal(sizes, _numbers(sample.column("cols"), "<i4"), _numbers(sample.column("vals"), "<f4"), y, weight, width=width, stems=stems)


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all rows of a packed column, one row after the other."""
    found = []
    for x in column.chunks:
        _, offsets, data = x.buffers()
        at = np.frombuffer(offsets, np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else [0, 0]
        found.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind))
    return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, kind)])


def expected_severity(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", out_col: str = "severity", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the expected severity (double), which replaces a kept column of that name.  Null and empty texts have the
    severity of an empty text; equal texts have equal severities, repeated rows stay rows."""
    name = hashlib.sha256(model.weights.tobytes() + repr((model.thresholds.tolist(), model.stems)).encode()).hexdigest()
    box = docs.sparkSession.sparkContext.broadcast(model.weights)  # width floats, a fixed size
    thresholds, stems = model.thresholds, model.stems

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = worker_cache("toxicity"), OrdinalModel(box.value, thresholds, stems)
        if cache.get("toxic_model") != name:  # the words of one model at a time
            cache |= {"toxic_model": name, "toxic_words": {}}
        words = cache["toxic_words"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                if len(words) > WORD_MEMORY:
                    words.clear()
                s = np.array([m.score(x or "", words) for x in batch.column(batch.num_columns - 1).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(m.expected(s), pa.float64())], names=[*batch.schema.names[:-1], out_col])

    rest = docs.select(*[c for c in keep if c != out_col], F.col(text_col).cast("string").alias(free_name("text", list(keep))))
    return rest.mapInArrow(each, StructType([*rest.schema.fields[:-1], StructField(out_col, DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **fit) -> DataFrame:
    """documents without those whose expected severity is at the threshold or above; all columns stay."""
    model = train(docs, labels, **fit)
    pa.default_memory_pool().release_unused()  # the sample's
    names = docs.columns
    grade = free_name("severity", names)
    return expected_severity(docs, model, keep=tuple(names), out_col=grade).where(F.col(grade) < threshold).select(*names)
