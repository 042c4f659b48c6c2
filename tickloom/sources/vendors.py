"""Market and news connectors: vendors' pages as Spark data sources with push-down.

A vendor's pages lie under `exchange=X/month=YYYY-MM/` as JSON lines, each line an answer as the vendor gives it.  An adapter names the
exchanges it covers and turns a page into rows.  `market_pages` and `news_pages` are data sources over adapters:

* a scan is planned as one partition for each adapter, exchange and month that the query's filters leave; an adapter that does not
  cover an exchange is never asked for it, and months outside the filters are never listed;
* filters on symbol, exchange, provider and time are taken over whole, so Spark does not apply them again;
* rows without a time or a price (a title, a web address, a publisher) are passed over; the rest of their page stays.

Files are opened through the file system that their address names (file, hdfs, s3, gs), on executors.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Iterable, Iterator
from typing import ClassVar, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

BAR_SCHEMA = "provider string, exchange string, symbol string, session date, open double, high double, low double, close double, volume double"
NEWS_SCHEMA = "provider string, exchange string, symbol string, published_at timestamp, url string, title string, summary string, publisher string"
UTC = dt.UTC


class Adapter:
    """What a vendor is to the data sources.  A row is a tuple in the order of the source's schema, without provider and exchange."""

    name: ClassVar[str]
    exchanges: ClassVar[frozenset[str]]

    def rows(self, page: dict) -> Iterator[tuple]:
        raise NotImplementedError


def _price(x: object) -> float | None:
    """A finite number above zero; vendors send null, text or 0 where they have none."""
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and x > 0 else None


class ColumnBars(Adapter):
    """Bars as arrays side by side: {"symbol", "t": [seconds], "o", "h", "l", "c", "v"}."""

    name, exchanges = "columns", frozenset({"US", "SGX"})

    def rows(self, page: dict) -> Iterator[tuple]:
        for t, *prices, volume in zip(*(page.get(k) or [] for k in "tohlcv"), strict=False):
            prices = [_price(p) for p in prices]
            if isinstance(t, int) and None not in prices:
                yield page.get("symbol"), dt.datetime.fromtimestamp(t, UTC).date(), *prices, float(volume or 0)


class RecordBars(Adapter):
    """Bars as records: {"meta": {"symbol"}, "values": [{"datetime": "YYYY-MM-DD", "open": "1.5", ...}]}; numbers are text."""

    name, exchanges = "records", frozenset({"US"})

    def rows(self, page: dict) -> Iterator[tuple]:
        for r in page.get("values") or []:
            try:
                prices = [_price(float(r[k])) for k in ("open", "high", "low", "close")]
                day, volume = dt.date.fromisoformat(r["datetime"]), float(r.get("volume") or 0)
            except (KeyError, TypeError, ValueError):
                continue
            if None not in prices:
                yield (page.get("meta") or {}).get("symbol"), day, *prices, volume


_WEB = re.compile(r"https?://[^/?#\s]+", re.I)


def _article(symbol: object, at: dt.datetime | None, url: object, title: object, summary: object, publisher: object) -> Iterator[tuple]:
    if at is not None and isinstance(url, str) and _WEB.match(url) and isinstance(title, str) and title.strip() and isinstance(publisher, str) and publisher.strip():
        yield symbol, at, url, title.strip(), summary if isinstance(summary, str) and summary.strip() else None, publisher.strip()


class WireNews(Adapter):
    """News with times in seconds: {"symbol", "items": [{"datetime", "headline", "url", "summary", "source"}]}; every exchange."""

    name, exchanges = "wire", frozenset({"US", "SGX"})

    def rows(self, page: dict) -> Iterator[tuple]:
        for r in page.get("items") or []:
            t = r.get("datetime")
            yield from _article(page.get("symbol"), dt.datetime.fromtimestamp(t, UTC) if isinstance(t, int) else None, r.get("url"), r.get("headline"), r.get("summary"), r.get("source"))


class TaggedNews(Adapter):
    """News of one market with ISO times and a symbol for each item: {"data": [{"published_at", "title", "url", "snippet", "source",
    "symbol"}]}."""

    name, exchanges = "tagged", frozenset({"US"})

    def rows(self, page: dict) -> Iterator[tuple]:
        for r in page.get("data") or []:
            try:
                at = dt.datetime.fromisoformat(r.get("published_at") or "")
            except (TypeError, ValueError):
                continue
            yield from _article(r.get("symbol"), at if at.tzinfo else at.replace(tzinfo=UTC), r.get("url"), r.get("title"), r.get("snippet"), r.get("source"))


BARS: dict[str, type[Adapter]] = {a.name: a for a in (ColumnBars, RecordBars)}
NEWS: dict[str, type[Adapter]] = {a.name: a for a in (WireNews, TaggedNews)}


class Part(InputPartition):
    """The pages of one adapter, exchange and month."""

    def __init__(self, provider: str, exchange: str, folder: str, files: list[str]) -> None:
        self.provider, self.exchange, self.folder, self.files = provider, exchange, folder, files


class Span(NamedTuple):
    """A bound of time, and whether it belongs to what is asked for."""

    at: object
    inclusive: bool


class PageReader(DataSourceReader):
    """One reader for both sources: kind, time column, adapters, and the filters it has taken over."""

    def __init__(self, options: dict, adapters: dict[str, type[Adapter]], time: str, schema: pa.Schema) -> None:
        names = [n.strip() for n in options.get("adapters", ",".join(adapters)).split(",") if n.strip()]
        if unknown := [n for n in names if n not in adapters]:
            raise ValueError(f"unknown adapters: {unknown}; known: {sorted(adapters)}")
        self.root, self.adapters, self.time, self.schema = options["path"], {n: adapters[n] for n in names}, time, schema
        self.sets: dict[str, set] = {}
        self.low: list[Span] = []
        self.high: list[Span] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull):
            return column in ("provider", "exchange", self.time)  # these are never null
        if column in ("provider", "exchange", "symbol") and isinstance(f, EqualTo | In):
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.sets[column] = self.sets[column] & values if column in self.sets else values
            return True
        if column == self.time and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            value = self._time(f.value)
            if not isinstance(f, LessThan | LessThanOrEqual):
                self.low.append(Span(value, not isinstance(f, GreaterThan)))
            if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.high.append(Span(value, not isinstance(f, LessThan)))
            return True
        return False

    @staticmethod
    def _time(x: object) -> object:
        if isinstance(x, dt.datetime):
            return x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)
        return x

    def _wanted(self, column: str, value: object) -> bool:
        return column not in self.sets or value in self.sets[column]

    def _in_span(self, at: object) -> bool:
        return all(at > s.at or (s.inclusive and at == s.at) for s in self.low) and all(at < s.at or (s.inclusive and at == s.at) for s in self.high)

    def _month_in_span(self, month: str) -> bool:
        first = f"{month}-01"  # as text, since bounds are dates or times
        begins = lambda s: (text := str(s.at)[:19]) > first or (s.inclusive and text[:10] == first and not text[10:].strip(" 0:"))
        return all(month >= str(s.at)[:7] for s in self.low) and all(begins(s) for s in self.high)

    def partitions(self) -> list[Part]:
        out = []
        for name, adapter in self.adapters.items():
            for exchange in sorted(e for e in adapter.exchanges if self._wanted("exchange", e)) if self._wanted("provider", name) else []:
                for month, folder in months_of(f"{self.root}/{name}/exchange={exchange}"):
                    if self._month_in_span(month):
                        out.append(Part(name, exchange, folder, files_of(folder)))
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        adapter, place = self.adapters[partition.provider](), self.schema.names.index(self.time) - 2
        found: list[tuple] = []
        for page in pages_of(partition.folder, partition.files):
            for row in adapter.rows(page):
                if self._wanted("symbol", row[0]) and self._in_span(row[place]):
                    found.append((partition.provider, partition.exchange, *row))
            if len(found) >= 10_000:
                yield self._batch(found)
                found = []
        if found:
            yield self._batch(found)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.schema.types, strict=True)], schema=self.schema)


def _file_system(address: str) -> tuple[pafs.FileSystem, str]:
    if "://" in address or address.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))
    return pafs.LocalFileSystem(), address


def _listed(address: str) -> list[pafs.FileInfo]:
    fs, path = _file_system(address)
    return fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))


def months_of(address: str) -> list[tuple[str, str]]:
    """(month, folder) under an exchange's folder, in order."""
    found = [(x.base_name.removeprefix("month="), f"{address}/{x.base_name}") for x in _listed(address) if x.type == pafs.FileType.Directory and x.base_name.startswith("month=")]
    return sorted(found)


def files_of(folder: str) -> list[str]:
    return sorted(x.base_name for x in _listed(folder) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))


def pages_of(folder: str, files: list[str]) -> Iterator[dict]:
    """Pages of a folder's files; lines that are no JSON object are passed over."""
    fs, path = _file_system(folder)
    for name in files:
        with fs.open_input_stream(f"{path}/{name}") as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from filter(None, map(_page, lines))
            yield from filter(None, map(_page, [rest]))


def _page(line: bytes) -> dict | None:
    try:
        page = json.loads(line)
    except ValueError:
        return None
    return page if isinstance(page, dict) else None


class MarketPages(DataSource):
    """Daily bars of all adapters: spark.read.format("market_pages").option("path", ...), and "adapters" to name some of them."""

    @classmethod
    def name(cls) -> str:
        return "market_pages"

    def schema(self) -> str:
        return BAR_SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options, BARS, "session", pa.schema([("provider", pa.string()), ("exchange", pa.string()), ("symbol", pa.string()), ("session", pa.date32()), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume")]]))


class NewsPages(DataSource):
    """News of all adapters that cover what is asked for: spark.read.format("news_pages")."""

    @classmethod
    def name(cls) -> str:
        return "news_pages"

    def schema(self) -> str:
        return NEWS_SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options, NEWS, "published_at", pa.schema([("provider", pa.string()), ("exchange", pa.string()), ("symbol", pa.string()), ("published_at", pa.timestamp("us", "UTC")), *[(c, pa.string()) for c in ("url", "title", "summary", "publisher")]]))


def register(spark: SparkSession) -> SparkSession:
    """Makes both sources known to the session and lets Spark hand them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MarketPages, NewsPages):
        spark.dataSource.register(source)
    return spark


def read_bars(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return register(spark).read.format("market_pages").options(path=path, **options).load()


def read_news(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return register(spark).read.format("news_pages").options(path=path, **options).load()


def _write(pages: DataFrame, folder: str) -> None:
    pages.write.mode("overwrite").partitionBy("exchange", "month").option("ignoreNullFields", "false").json(folder)


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def write_column_bars(bars: DataFrame, path: str) -> None:
    """Lays bars (exchange, symbol, session, prices, volume) out as the `columns` vendor does: a page for each symbol and month."""
    row = F.struct(F.unix_timestamp(F.col("session").cast("timestamp")).alias("t"), *[F.col(c).alias(c[0]) for c in ("open", "high", "low", "close", "volume")])
    pages = bars.groupBy("exchange", _month("session").alias("month"), "symbol").agg(F.sort_array(F.collect_list(row)).alias("r"))  # a month's days
    _write(pages.select("exchange", "month", "symbol", *[F.col(f"r.{c}").alias(c) for c in "tohlcv"]), f"{path}/columns")


def write_record_bars(bars: DataFrame, path: str) -> None:
    """The same as the `records` vendor does."""
    row = F.struct(F.date_format("session", "yyyy-MM-dd").alias("datetime"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    pages = bars.groupBy("exchange", _month("session").alias("month"), "symbol").agg(F.sort_array(F.collect_list(row)).alias("values"))
    _write(pages.select("exchange", "month", F.struct("symbol").alias("meta"), "values"), f"{path}/records")


def write_wire_news(news: DataFrame, path: str, page: int = 50) -> None:
    """Lays articles (exchange, symbol, published_at, url, title, summary, publisher) out as the `wire` vendor does, about `page` to a page."""
    item = F.struct(F.unix_timestamp("published_at").alias("datetime"), F.col("title").alias("headline"), "url", "summary", F.col("publisher").alias("source"))
    _write(_paged(news, item, page).select("exchange", "month", "symbol", "items"), f"{path}/wire")


def write_tagged_news(news: DataFrame, path: str, page: int = 50) -> None:
    """The same as the `tagged` vendor does."""
    item = F.struct(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at"), "title", "url", F.col("summary").alias("snippet"), F.col("publisher").alias("source"), "symbol")
    _write(_paged(news, item, page).select("exchange", "month", F.col("items").alias("data")), f"{path}/tagged")


def _paged(news: DataFrame, item: Column, page: int) -> DataFrame:
    """Pages by symbol, day and a number that keeps a page of a busy day short: rows of a day are dealt by their address's hash."""
    busy = news.groupBy("exchange", "symbol", F.to_date("published_at").alias("day")).agg(F.ceil(F.count("*") / page).alias("pages"))
    dealt = news.withColumn("day", F.to_date("published_at")).join(busy, ["exchange", "symbol", "day"])
    number = F.pmod(F.xxhash64("url"), F.col("pages"))
    return dealt.groupBy("exchange", _month("published_at").alias("month"), "symbol", "day", number.alias("number")).agg(F.collect_list(item).alias("items"))
