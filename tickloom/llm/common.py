"""What several operators share: shared storage, lineage cuts and Arrow helpers."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.storage import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, for tokenizers and the like.  It serves one operator at a time: what the
    one before has left goes."""
    held = sys.modules.setdefault("_tickloom_worker", types.ModuleType("_tickloom_worker"))
    if getattr(held, "owner", None) != owner:
        held.owner, held.cache = owner, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
    return held.cache


def utf8_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def doc_slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) slices of about `most` bytes, at least one item each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def small(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices whose text column (its number) holds about `most` bytes, at least one row each."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(text).cast(pa.binary())), 0).to_pylist()
        for a, b in doc_slices(sizes, most):
            yield whole.slice(a, b - a)


def text_bytes(df: DataFrame, text: str) -> int:
    """Total UTF-8 bytes of a text column: one narrow scan."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def free_name(base: str, names: list[str]) -> str:
    """A column name that is not taken; names are told apart as Spark does, without regard to case."""
    taken = {x.lower() for x in names}
    while base.lower() in taken:
        base += "_"
    return base


def hash_bucket(column: Column, n: int, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")


def join_null_safe(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
