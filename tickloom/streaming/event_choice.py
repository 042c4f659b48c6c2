"""Event choice over a stream: the sessions that count as news events, as their windows close.

The batch rule (see event_study.choose): a window opens at the first news session out of the last event's reach and spans some sessions;
its most salient session, the earliest on ties, is the event.  Here articles arrive one by one, late ones among them.  The state of a symbol is the
last event and the sums of the sessions that are not decided.  A timer at the close of a window's last session decides it once the
watermark says that nothing can come before: until then late articles change the sums of the open window, afterwards they change nothing.

A symbol's state is one task's, so articles are summed by session where they are read: what reaches it are sessions, however many the articles.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, pos long, sentiment double, article_count long"
SUMS = "symbol string, pos long, at timestamp, total double, many long"
HELD = 1 << 16  # rows that are summed at a time
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's articles by symbol, position and time: the sum and the number of their scores.  Rows without either keep their time."""
    keys, held, rows = ["symbol", "pos", "at"], [], 0

    def folded(parts: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(parts).group_by(keys).aggregate([("total", "sum"), ("many", "sum")])
        return got.select([*keys, "total_sum", "many_sum"]).rename_columns([*keys, "total", "many"])

    for batch in batches:
        score = batch.column(batch.schema.get_field_index("score"))
        one = pa.Table.from_batches([batch]).select(keys)
        held.append(one.append_column("total", score).append_column("many", score.is_valid().cast(pa.int64())))
        rows += batch.num_rows
        if rows >= max(HELD, 2 * held[0].num_rows):
            held = [folded(held)]
            rows = held[0].num_rows
    if held:
        yield from folded(held).combine_chunks().to_batches()


class Choose(StatefulProcessor):
    """closes: the close of every session of the calendar in milliseconds, in order; its length is the calendar's, not the data's."""

    def __init__(self, closes: list[int], exclusion: int = 5) -> None:
        self.closes, self.exclusion = closes, exclusion

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "pos long")
        self.days = handle.getMapState("days", "pos long", "total double, many long")

    def _reach(self) -> int:
        return self.last.get()[0] + self.exclusion if self.last.exists() else -1

    def _complete(self, now: int) -> int:
        """Position of the last session that had closed by then."""
        return bisect.bisect_right(self.closes, now) - 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        reach, fresh = self._reach(), {}
        for r in rows:
            if r.pos is not None and r.pos > reach and r.many:
                total, many = fresh.get(r.pos, (0.0, 0))
                fresh[r.pos] = (total + r.total, many + r.many)
        for pos, (total, many) in fresh.items():
            old = self.days.getValue((pos,)) if self.days.containsKey((pos,)) else (0.0, 0)
            self.days.updateValue((pos,), (old[0] + total, old[1] + many))
        self._wait()
        return iter([])

    def _waiting(self) -> list[int]:
        return sorted(k[0] for k in self.days.keys())

    def _wait(self) -> None:
        """One timer at the close of the open window's last session."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if found := self._waiting():
            self.handle.registerTimer(self.closes[min(found[0] + self.exclusion, len(self.closes) - 1)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        complete, out, found = self._complete(timerValues.getCurrentWatermarkInMs()), [], self._waiting()
        while found:
            end = found[0] + self.exclusion
            if min(end, len(self.closes) - 1) > complete:
                break
            window = {p: self.days.getValue((p,)) for p in found[: bisect.bisect_right(found, end)]}
            salience = {p: abs(total / many) * math.log1p(many) for p, (total, many) in window.items()}
            best = max(window, key=lambda p: (salience[p], -p))
            total, many = window[best]
            out.append(Row(symbol=key[0], pos=best, sentiment=total / many, article_count=many))
            self.last.update((best,))
            done = bisect.bisect_right(found, max(end, best + self.exclusion))
            for p in found[:done]:
                self.days.removeKey((p,))
            found = found[done:]
        self._wait()
        return iter(out)

    def close(self) -> None:
        pass


def stream_events(articles: DataFrame, closes: list[int], late: str = "2 days", exclusion: int = 5) -> DataFrame:
    """(symbol, pos, sentiment, article_count) of the events, each when its window has closed.

    articles: symbol, pos (position of the session that the article counts for), at (that session's close) and score.  Rows without a position or score
    are left out, as are rows of sessions within the last event's reach."""
    spark = articles.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = articles.select(F.col("symbol").cast("string").alias("symbol"), F.col("pos").cast("long").alias("pos"), F.col("at").cast("timestamp").alias("at"), F.col("score").cast("double").alias("score")).mapInArrow(summed, SUMS)
    return rows.withWatermark("at", late).groupBy("symbol").transformWithState(statefulProcessor=Choose(closes, exclusion), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
