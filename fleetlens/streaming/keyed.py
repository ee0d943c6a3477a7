"""Stateful streams on the keyed state store: counters that correct themselves, and flushing.

State lives in the RocksDB state store, one entry per key. A trigger writes the entries it
touches; entries that were not touched for their time to live are gone. Nothing depends on
an entry being there: a row whose predecessor the state does not know is settled from the
result table, so a lost, expired or fresh state costs a look-up and changes no result.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetlens.operators import derive
from fleetlens.operators.ordered import WIDTH
from fleetlens.session import settle
from fleetlens.streaming import jobs
from fleetlens.streaming.tables import Batch, BatchTable

WEEK_MS = 7 * 86_400_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What is added to the columns of the keys.
READING = [T.StructField("tick", T.LongType()), T.StructField("raw", T.LongType())]
DELTA = T.StructField("delta", T.DoubleType())
VERSION = T.StructField("version", T.LongType())


@contextlib.contextmanager
def keyed_store(spark: SparkSession, *, idle: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings come back.

    Without `idle` no trigger runs for want of rows, which would keep a job that takes all
    there is now from ending: with a clock in its state there is always one more to run.
    """
    wanted = {_STORE: _ROCKSDB, **({} if idle else {_IDLE: "false"})}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class LastReading(StatefulProcessor):
    """Deltas of one series. `sure` tells whether the reading before is known.

    Rows come in batches of bounded size, each sorted by itself, so a series of any length
    passes through. A reading that is not after the last one seen is not sure.
    """

    def __init__(self, keys: Sequence[str], keep_ms: int):
        self.keys, self.keep_ms = list(keys), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType(READING), self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.last.get()) if self.last.exists() else None
        for part in rows:
            part = part[["tick", "raw"]].sort_values("tick", kind="stable").drop_duplicates("tick")
            tick = part["tick"].to_numpy()
            raw = part["raw"].array
            late = tick <= known[0] if known else np.zeros(len(tick), bool)
            value = [None if pd.isna(r) or r < 0 else int(r) for r in raw]
            before = known[1] if known else None
            delta: list[float | None] = []
            for old, v in zip(late, value):
                delta.append(float(v - before) if not old and v is not None and before is not None and v >= before else None)
                if not old:
                    before = v
            sure = ~late
            if known is None:
                sure[:1] = False
            out = pd.DataFrame({k: [v] * len(tick) for k, v in zip(self.keys, key)})
            out["tick"], out["raw"] = tick, pd.array(raw, dtype="Int64")
            out["delta"], out["sure"] = pd.array(delta, dtype="Float64"), sure
            yield out
            if not late.all():
                known = (int(tick[-1]), value[-1])
        if known is not None:
            self.last.update(known)

    def close(self) -> None:
        pass


def counter_rows(keys: dict[str, T.DataType]) -> T.StructType:
    """Schema of a table that `counters_with_corrections` writes."""
    return T.StructType([*[T.StructField(k, t) for k, t in keys.items()], *READING, DELTA, VERSION])


def counters_with_corrections(
    stream: DataFrame, results: BatchTable, checkpoint: str, *, keys: Sequence[str] = ("boot_id", "field"),
    keep_ms: int = WEEK_MS, width: int = WIDTH, **trigger,
) -> StreamingQuery:
    """Counter deltas of (keys, tick, raw) in any order of arrival; read them with `current`.

    A row in the order of its series gets its delta from the state. A late one, the first of
    a series the state does not know, and one that is delivered again meet the stored rows of
    their series from their predecessor on: what is new is derived there, and a follower
    whose delta changes is stored once more with a higher version. So the table equals the
    batch derivation whatever the arrival; ticks that are stored already keep their reading.
    """
    names = list(keys)

    def batch(rows: DataFrame, now: Batch) -> None:
        fresh = settle(rows, "readings")
        version = F.lit(now.number + 1).cast("bigint") + F.lit(_base_version(results, now))
        unsure = fresh.where(~F.col("sure"))
        found = fresh
        if not unsure.isEmpty():
            late = settle(unsure.groupBy(*names).agg(F.min("tick").alias("__low")), "late-series")
            certain = fresh.join(late, names, "left_anti")
            found = certain.unionByName(_corrected(fresh, late, results, now, names, width))
        results.write(found.drop("sure").withColumn("version", version), now)

    schema = T.StructType([
        *[f for f in stream.schema.fields if f.name in names], *READING, DELTA, T.StructField("sure", T.BooleanType())
    ])
    schema = T.StructType(sorted(schema.fields, key=lambda f: [*names, "tick", "raw", "delta", "sure"].index(f.name)))
    with keyed_store(stream.sparkSession, idle=False):
        read = stream.select(*names, "tick", "raw").groupBy(*names).transformWithStateInPandas(
            LastReading(names, keep_ms), schema, "append", "processingTime"
        )
        return jobs.run(read, batch, checkpoint, **trigger)


def _base_version(results: BatchTable, now: Batch) -> int:
    """The largest version other runs have stored; inside a run versions follow the batches."""
    others = results.read_runs(but=now.run)
    return others.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _corrected(fresh, late, results, now, names, width) -> DataFrame:
    """New and changed rows of the series in `late` (keys, __low: the first unsure tick)."""
    past = current(results.read(but=now).join(late.select(*names), names, "left_semi"), names)
    before = past.join(late, names).where(F.col("tick") < F.col("__low")).groupBy(*names).agg(
        F.max("tick").alias("__from")
    )
    span = late.join(before, names, "left").select(*names, "__low", F.coalesce("__from", "__low").alias("__from"))
    around = settle(
        past.join(span, names).where(F.col("tick") >= F.col("__from")).select(*names, *_OLD, "__low"), "around"
    )
    arrived = fresh.join(late, names).groupBy(*names, "tick", "__low").agg(F.min("raw").alias("raw"))
    new = arrived.join(around.select(*names, "tick"), [*names, "tick"], "left_anti")
    both = around.withColumn("__stored", F.lit(True)).unionByName(
        new.withColumn("__stored", F.lit(False)), allowMissingColumns=True
    )
    derived = derive.counter_delta(both.withColumnRenamed("delta", "__was"), keys=names, width=width)
    changed = ~F.col("__stored") | ~F.col("delta").eqNullSafe(F.col("__was"))
    # rows before the first unsure tick are there for their reading only
    return derived.where(changed & (F.col("tick") >= F.col("__low"))).select(*names, *_OLD, F.lit(True).alias("sure"))


_OLD = ("tick", "raw", "delta")


def current(rows: DataFrame, keys: Sequence[str] = ("boot_id", "field")) -> DataFrame:
    """(keys, tick, raw, delta): of every reading the row with the highest version."""
    return rows.groupBy(*keys, "tick").agg(F.max_by(F.struct("raw", "delta"), "version").alias("__row")).select(
        *keys, "tick", "__row.*"
    )


class FlushBuffer(StatefulProcessor):
    """Holds rows of a key until there are enough of them or the oldest has waited long enough."""

    def __init__(self, columns: T.StructType, order: Sequence[str], rows: int, wait_ms: int):
        self.columns, self.order, self.rows, self.wait_ms = columns, list(order), rows, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.columns)
        self.due = handle.getValueState("due", "at bigint")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns.names)

    def _empty(self) -> pd.DataFrame:
        held = self._frame([tuple(r) for r in self.held.get()]) if self.held.exists() else self._frame([])
        self.held.clear()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        return held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[self.columns.names].sort_values(self.order, kind="stable")
            n = sum(1 for _ in self.held.get()) if self.held.exists() else 0
            if n + len(part) >= self.rows:
                held = self._empty()
                yield pd.concat([held, part]) if len(held) else part
            elif len(part):
                self.held.appendList([
                    tuple(None if pd.isna(v) else v for v in r) for r in part.astype(object).itertuples(index=False)
                ])
                if not self.due.exists():
                    at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                    self.handle.registerTimer(at)
                    self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        if self.held.exists():
            yield self._empty()

    def close(self) -> None:
        pass


def flush_stream(
    stream: DataFrame, table: BatchTable, checkpoint: str, *, key: str = "boot_id", order: Sequence[str] = ("tick",),
    rows: int = 30, wait_ms: int = 30_000, interval: str = "1 second",
) -> StreamingQuery:
    """Store rows once a key has `rows` of them or its oldest has waited `wait_ms`, whichever is first.

    A key's rows are stored in the order of `order` within a trigger, triggers in theirs. A
    failed write leaves the buffer as it was at the last commit: the trigger runs again with
    the same rows, so nothing is lost, doubled or overtaken.
    """
    columns = T.StructType([f for f in table.schema.fields])
    with keyed_store(stream.sparkSession):
        flushed = stream.select(*columns.names).groupBy(key).transformWithStateInPandas(
            FlushBuffer(columns, order, rows, wait_ms), columns, "append", "processingTime"
        )
        return jobs.run(flushed, lambda part, now: table.write(part, now), checkpoint, once=False, interval=interval)
