"""Jobs that keep state per key: last row per cell with expiry, and calls joined with their awards."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

# Ship the processor inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepLast(StatefulProcessor):
    """The latest row of a cell, for as long as corrections may still come.

    A row counts as later by its recency columns, nulls first.  Every batch that brings a later row gives the cell out once.  When
    the watermark passes the last row's event time the cell's timer fires and its state goes; older rows do not get in again,
    because the watermark drops them before they come here.
    """

    def __init__(self, state: StructType, recency: Sequence[str], at: str, columns: Sequence[str]):
        self.schema, self.recency, self.at, self.columns = state, list(recency), at, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _age(self, row: Any) -> list[tuple[bool, Any]]:
        return [(False, 0) if row[c] is None else (True, row[c]) for c in self.recency]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = dict(zip(self.schema.fieldNames(), self.last.get(), strict=True)) if self.last.exists() else None
        best = held
        for row in rows:
            if best is None or self._age(row) > self._age(best):
                best = row.asDict()
        if best is not held:
            self.last.update(tuple(best[c] for c in self.schema.fieldNames()))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[self.at] + 1)
            yield Row(**{c: best[c] for c in self.columns})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_last_in_state(stream: DataFrame, cell: Sequence[str], recency: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Cells whose latest row changed, batch by batch (update mode); state of a cell ends ``delay`` after its latest row.

    Only state is read and written, no earlier output: a correction costs one lookup instead of a rewritten month.
    """
    spark = stream.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    # Times are compared as numbers, so no time zone of a worker plays a part.
    ages = {f"__age{i}": F.unix_micros(F.col(c).cast("timestamp")) if isinstance(timed.schema[c].dataType, (TimestampType, TimestampNTZType)) else F.col(c)
            for i, c in enumerate(recency)}
    aged = timed.withColumns({**ages, "__at": F.unix_millis(event_time)})
    state = StructType([StructField(f.name, f.dataType) for f in aged.schema])
    columns = StructType([StructField(f.name, f.dataType) for f in timed.schema])
    processor = KeepLast(state, list(ages), "__at", columns.fieldNames())
    return aged.groupBy(*cell).transformWithState(processor, columns, "Update", "EventTime")


def calls_with_awards(calls: DataFrame, awards: DataFrame, key: str, call_time: str, award_time: str, delay: str, within: str) -> DataFrame:
    """Calls with every award of the same procedure that follows ``within`` that time; calls without one come once it has passed.

    Both sides hold rows for the join window and ``delay`` only, so state does not grow with the history.
    """
    ours = calls.withWatermark(call_time, delay).alias("call")
    theirs = awards.withWatermark(award_time, delay).withColumnRenamed(key, "__award_key")
    limit = F.expr(f"INTERVAL {within}")
    follows = (F.col(key) == F.col("__award_key")) & (F.col(award_time) >= F.col(call_time)) & (F.col(award_time) <= F.col(call_time) + limit)
    return ours.join(theirs, follows, "left_outer").drop("__award_key")
