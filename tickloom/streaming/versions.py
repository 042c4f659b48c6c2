"""A table that streams upsert into, whole batch by whole batch.

Data lie in folders that are never changed.  A version is a small manifest that names the folder of every part of the table, the folder of
its coverage state, the last batch of every stream that is in it, and marks (such as months done).  A batch is merged into new folders of
the parts that it touches and becomes visible, rows, state and marks at once, when its manifest is there.  A batch that is repeated finds its
number in the manifest and changes nothing; one that was killed half-way has left folders that no manifest names, which the next commit removes.

One writer at a time; readers read a version while later ones are written, as long as it is among the last `keep`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)
    state: str | None = None
    marks: list[str] = field(default_factory=list)

    def folders(self) -> set[str]:
        return {x.split("/")[0] for x in self.parts.values()} | ({self.state} if self.state else set())


class Files:
    """The few operations on shared storage that a manifest needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self.fs = self.path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.fs.exists(self.path(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str, modified: int | None = None) -> None:
        """The file is there whole or not at all; one that is there already is an error."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if modified is not None:
            self.fs.setTimes(self.path(draft), modified, -1)
        if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(draft), self.path(name)):
            self.fs.delete(self.path(draft), False)
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """Rows by part (a column, such as a month, that a key's rows all share), and by symbol what times they cover.

    merge(stored, batch) gives a part's new rows; `covers` names the columns of symbol and time that the coverage state is kept of.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, part: str, merge: Merge, covers: tuple[str, str], keep: int = 2) -> None:
        self.spark, self.folder, self.part, self.merge, self.covers, self.keep = spark, folder, part, merge, covers, keep
        self.schema, self.files = spark.createDataFrame([], schema).schema, Files(spark, folder)

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for."""
        names = [n for n in self.files.names("versions") if n.endswith(".json")]
        if version is not None:
            names = [n for n in names if int(n[:-5]) == version]
            if not names:
                raise KeyError(f"there is no version {version}")
        return Manifest(**json.loads(self.files.read(f"versions/{names[-1]}"))) if names else Manifest()

    def read(self, version: int | None = None) -> DataFrame:
        return self._parts(self.manifest(version), None)

    def _parts(self, m: Manifest, only: Sequence[str] | None) -> DataFrame:
        paths = [f"{self.folder}/data/{f}" for p, f in sorted(m.parts.items()) if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty(self.schema)

    def _empty(self, schema: StructType) -> DataFrame:
        """No rows, made without a Python worker."""
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def state(self, version: int | None = None) -> DataFrame:
        """(symbol, covered_start, newest, rows): over all rows that batches brought, repeated ones included."""
        m = self.manifest(version)
        if m.state:
            return self.spark.read.parquet(f"{self.folder}/data/{m.state}")
        time = self.schema[self.covers[1]].dataType.simpleString()
        return self._empty(StructType.fromDDL(f"symbol string, covered_start {time}, newest {time}, rows long"))

    def commit(self, stream: str, number: int, batch: DataFrame, marks: Sequence[str] = ()) -> Manifest:
        """Merges a batch unless it is in already.  Rows whose part is null are left out."""
        before = self.manifest()
        if before.batches.get(stream, -1) >= number:
            return before
        self._clean()
        name = f"v{before.version + 1:012d}-{uuid.uuid4().hex}"
        rows = batch.select(*self.schema.names).where(F.col(self.part).isNotNull()).persist()
        try:
            touched = [r[0] for r in rows.select(F.col(self.part).cast("string")).distinct().collect()]  # a batch's months, not its rows
            parts = dict(before.parts)
            if touched:
                slot: Column = F.col(self.part).cast("string")
                merged = self.merge(self._parts(before, touched), rows)
                # each part goes to one task, or a few if it is large, not from every task to a file of its own
                merged.select(*self.schema.names).withColumn("_part", slot).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{self.folder}/data/{name}")
                parts |= {p: f"{name}/_part={self._escaped(p)}" for p in touched}
            symbol, time = self.covers
            fresh = rows.groupBy(F.col(symbol).cast("string").alias("symbol")).agg(F.min(time).alias("covered_start"), F.max(time).alias("newest"), F.count("*").alias("rows"))
            covered = self.state().unionByName(fresh).groupBy("symbol").agg(F.min("covered_start").alias("covered_start"), F.max("newest").alias("newest"), F.sum("rows").alias("rows"))
            covered.write.parquet(f"{self.folder}/data/{name}-state")
        finally:
            rows.unpersist()
        after = replace(before, version=before.version + 1, batches={**before.batches, stream: number}, parts=parts, state=f"{name}-state", marks=sorted({*before.marks, *marks}))
        self.files.put(f"versions/{after.version:012d}.json", json.dumps(after.__dict__))
        return after

    def _escaped(self, part: str) -> str:
        if not part:
            return "__HIVE_DEFAULT_PARTITION__"  # Spark's name for it
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)

    def _clean(self) -> None:
        """Removes manifests but the last `keep`, and folders that none of these name."""
        names = [n for n in self.files.names("versions") if n.endswith(".json")]
        for n in names[: -self.keep]:
            self.files.remove(f"versions/{n}")
        used = set().union(*[self.manifest(int(n[:-5])).folders() for n in names[-self.keep :]], set())
        for n in self.files.names("data"):
            if n not in used:
                self.files.remove(f"data/{n}")

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch body."""
        return lambda batch, number: self.commit(stream, number, batch) and None


def ingest(rows: DataFrame, table: VersionedTable, stream: str, checkpoint: str, *, keys: list[str], time: str, late: str = "30 days") -> None:
    """Runs a stream of rows into a table until what is there now is in: rows that repeat a key within the watermark are dropped before
    the sink, which makes them idempotent for good."""
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    once.writeStream.foreachBatch(table.sink(stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def months_before(spark: SparkSession, end: str, months: int) -> list[str]:
    """The months before the one that `end` (YYYY-MM) names, newest first."""
    year, month = map(int, end.split("-"))
    found = [divmod(year * 12 + month - 1 - k, 12) for k in range(1, months + 1)]
    return [f"{y:04d}-{m + 1:02d}" for y, m in found]


def backfill(spark: SparkSession, folder: str, months: Sequence[str], fetch: Callable[[str], DataFrame], table: VersionedTable, stream: str = "backfill") -> list[str]:
    """Fetches months in the order given, each a batch of its own, and gives those that are still missing.

    Every month is a ticket, a small file; a stream over the tickets takes them in the order of their times, one a batch.  The
    stream's checkpoint is the set of months done: a run that stopped goes on with the month that it stopped at.  A batch's rows and its month
    as a mark are committed together.  A later call may name more months; these come after those that wait.
    """
    files = Files(spark, f"{folder}/tickets")
    there = {n.removesuffix(".json") for n in files.names("") if n.endswith(".json")}
    first = 1_000_000_000_000 + 1000 * len(there)
    for i, month in enumerate(m for m in months if m not in there):
        files.put(f"{month}.json", json.dumps({"month": month}), first + 1000 * i)

    def body(batch: DataFrame, number: int) -> None:
        for month in [r.month for r in batch.collect()]:  # one ticket
            table.commit(stream, number, fetch(month), [month])

    tickets = spark.readStream.schema("month string").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(f"{folder}/tickets")
    tickets.writeStream.foreachBatch(body).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = set(table.manifest().marks)
    return [m for m in months if m not in done]
