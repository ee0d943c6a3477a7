"""Keyed state: counters in any order of arrival, restarts, and flushing by rows or time."""

import random
import time

import pytest
from pyspark.sql import types as T

from fleetlens.operators import derive
from fleetlens.streaming import jobs, keyed
from fleetlens.streaming.tables import BatchTable

COUNTERS = "boot_id string, field string, tick bigint, raw bigint"
KINDS = {"boot_id": T.StringType(), "field": T.StringType()}


@pytest.fixture
def narrow(spark):
    """Few state partitions: each is one more worker to start."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(spark, rows, path):
    spark.createDataFrame(rows, COUNTERS).coalesce(1).write.mode("append").parquet(path)


def follow(spark, path, results, checkpoint):
    query = keyed.counters_with_corrections(
        spark.readStream.schema(COUNTERS).parquet(path), results, str(checkpoint), width=4
    )
    query.awaitTermination()
    return query


def series(boot, field, n, seed):
    rng = random.Random(seed)
    value, out = 0, []
    for t in range(n):
        value = 0 if rng.random() < 0.1 else value + rng.randrange(5)
        out.append((boot, field, t, None if rng.random() < 0.2 else -1 if rng.random() < 0.05 else value))
    return out


def as_rows(frame):
    return sorted(map(tuple, frame.select("boot_id", "field", "tick", "raw", "delta").collect()),
                  key=lambda r: tuple((v is not None, v) for v in r))


def test_shuffled_arrival_equals_the_batch(spark, narrow, tmp_path):
    rows = [r for i in range(4) for r in series(f"b{i % 2}", f"f{i}", 40, i)]
    random.Random(1).shuffle(rows)
    path, results = str(tmp_path / "in"), BatchTable(spark, str(tmp_path / "out"), keyed.counter_rows(KINDS))
    parts = [rows[:50], rows[50:70], rows[70:71], rows[71:]]
    for n, part in enumerate([*parts, parts[0]]):  # the first part comes twice
        land(spark, part, path)
        # a fresh checkpoint in between gets everything again and has no state
        follow(spark, path, results, tmp_path / ("cp" if n < 3 else "cp2"))
    expected = derive.counter_delta(spark.createDataFrame(rows, COUNTERS))
    assert as_rows(keyed.current(results.read())) == as_rows(expected)


def test_state_follows_the_series_touched(spark, narrow, tmp_path):
    path, results = str(tmp_path / "in"), BatchTable(spark, str(tmp_path / "out"), keyed.counter_rows(KINDS))
    land(spark, [("b", f"f{i}", 0, i) for i in range(50)], path)
    follow(spark, path, results, tmp_path / "cp")
    land(spark, [("b", "f7", 1, 9), ("b", "f8", 1, 9)], path)
    (state,) = follow(spark, path, results, tmp_path / "cp").lastProgress["stateOperators"]
    assert state["numRowsUpdated"] <= 4 and state["numRowsTotal"] >= 50
    # in order, so nothing stored was looked at again
    stored = results.read()
    assert stored.count() == 52
    assert sorted(r.delta for r in stored.where("tick = 1").collect()) == [1.0, 2.0]


def test_a_late_reading_corrects_its_follower(spark, narrow, tmp_path):
    path, results = str(tmp_path / "in"), BatchTable(spark, str(tmp_path / "out"), keyed.counter_rows(KINDS))
    for part in ([("b", "f", t, 10 * t) for t in (0, 1, 3, 4)], [("b", "f", 2, 12)], [("b", "f", 2, 99)]):
        land(spark, part, path)
        follow(spark, path, results, tmp_path / "cp")
    assert results.read().count() == 6  # four, the late one, its follower again
    assert [r[3:] for r in as_rows(keyed.current(results.read()))] == [
        (0, None), (10, 10.0), (12, 2.0), (30, 18.0), (40, 10.0)]


def test_settings_come_back(spark):
    before = spark.conf.get(keyed._STORE, None)
    with keyed.keyed_store(spark, idle=False):
        assert spark.conf.get(keyed._STORE) == keyed._ROCKSDB and spark.conf.get(keyed._IDLE) == "false"
    assert spark.conf.get(keyed._STORE, None) == before


ROWS = T.StructType([T.StructField("boot_id", T.StringType()), T.StructField("tick", T.LongType()),
                     T.StructField("value", T.DoubleType())])


def until(condition, seconds=40):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.3)
    return False


class Failing(BatchTable):
    """Fails at the first write that has rows."""

    failed = False

    def write(self, rows, batch):
        if not self.failed and not rows.isEmpty():
            self.failed = True
            raise OSError("the store is away")
        super().write(rows, batch)


def test_flush_by_rows_or_time(spark, narrow, tmp_path):
    path = str(tmp_path / "in")
    table = Failing(spark, str(tmp_path / "out"), ROWS)

    def put(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)

    def start():
        return keyed.flush_stream(spark.readStream.schema(ROWS).parquet(path), table, str(tmp_path / "cp"),
                                  rows=5, wait_ms=6000, interval="200 milliseconds")

    put([("a", t, 0.5) for t in range(5)] + [("b", 0, None), ("b", 1, 1.5)])
    query = start()
    try:
        with pytest.raises(Exception, match="the store is away"):
            query.awaitTermination(40)
        query = start()
        began = time.time()
        # five rows of a at once, those of b after their time
        assert until(lambda: table.read().count() >= 5)
        first = sorted((r.boot_id, r.tick) for r in table.read().collect())
        assert first[:5] == [("a", t) for t in range(5)]
        put([("a", 5, None)])
        assert until(lambda: table.read().count() == 8)
        assert time.time() - began > 1
        rows = [tuple(r) for r in table.read().orderBy("boot_id", "tick").collect()]
        assert rows == [("a", t, 0.5) for t in range(5)] + [("a", 5, None), ("b", 0, None), ("b", 1, 1.5)]
    finally:
        query.stop()
