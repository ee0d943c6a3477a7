"""Key filters and id ranges: appends that do not read the past."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.plans import dataset as D
from fleetlens.plans import keys as K
from fleetlens.plans.commits import CommitLog
from fleetlens.streaming import jobs
from fleetlens.streaming.tables import BatchTable
from test_streams import KEYED, land

EVENTS = "ts bigint, source string, kind string, severity string, message string, dedup string"


def strings(frame):
    return sorted(r[0] for r in frame.collect())


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "dedup string")


def test_known_keys(spark, tmp_path):
    index = K.KeyIndex(spark, str(tmp_path / "i"))
    assert index.known(keys(spark, ["a"])).count() == 0
    index.add(keys(spark, [f"k{i}" for i in range(500)] + [None]), "one")
    index.add(keys(spark, ["x", "x", "y", "k3"]), "two")
    assert index.batches() == ["one", "two"]
    assert strings(index.known(keys(spark, ["k3", "x", "x", "new", None]))) == ["k3", "x"]
    assert strings(index.known(keys(spark, ["k3", "x", "k4"]), ["two"])) == ["k3", "x"]
    index.add(keys(spark, ["z"]), "two")  # a repeated batch replaces its own
    assert strings(index.known(keys(spark, ["x", "z"]))) == ["z"]
    assert index.known(keys(spark, [])).count() == 0


def test_look_ups_do_not_grow_with_the_table(spark, tmp_path):
    """Keys nobody has stored open no key file; one that is stored opens its own folder."""
    index = K.KeyIndex(spark, str(tmp_path / "i"))
    for n in range(4):
        index.add(keys(spark, [f"{n}:{i}" for i in range(2000)]), f"b{n}")
    assert index.known(keys(spark, [f"new{i}" for i in range(1000)])).count() == 0
    assert len(index.opened) <= 2  # one in 100,000 is taken for a stored one
    assert strings(index.known(keys(spark, ["2:77"]))) == ["2:77"]
    assert len(index.opened) == 1 and "batch=b2" in index.opened[0]


def test_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SLICE", 10)
    index = K.KeyIndex(spark, str(tmp_path / "i"))
    names = [f"n{i}" for i in range(3000)]
    index.add(keys(spark, names), "b")
    assert spark.read.parquet(str(tmp_path / "i" / "filters")).agg(F.max("slices")).first()[0] == 5
    assert strings(index.known(keys(spark, names[::3] + ["no"]))) == sorted(names[::3])


def test_filters():
    rng = np.random.default_rng(0)
    stored, other = rng.integers(-(1 << 63), 1 << 63, 20000), rng.integers(-(1 << 63), 1 << 63, 200000)
    bits = K._filter(stored).tobytes()
    assert K._passes(bits, stored).all()
    assert K._passes(bits, other).mean() < 1e-4


def event_rows(spark, names, ts=1):
    return spark.createDataFrame([(ts + i, "s", "k", "error", f"m{i}", n) for i, n in enumerate(names)], EVENTS)


def test_append_events(spark, tmp_path):
    path = str(tmp_path / "events")
    D.append_events(event_rows(spark, ["a", "b", None, None, "a"]), path)
    D.append_events(event_rows(spark, ["b", "c", None], 10), path)
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [r.dedup for r in rows if r.dedup] == ["a", "b", "c"] and len(rows) == 6
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6]
    assert len(K.KeyIndex(spark, f"{path}_keys").batches()) == 2


def test_append_to_a_table_without_an_index(spark, tmp_path):
    path = str(tmp_path / "events")
    event_rows(spark, ["a", "b"]).withColumn("id", F.lit(41).cast("bigint")).write.parquet(path)
    D.append_events(event_rows(spark, ["b", "c"]), path)
    rows = spark.read.parquet(path).collect()
    assert sorted(r.dedup for r in rows) == ["a", "b", "c"]
    assert [r.id for r in rows if r.dedup == "c"] == [42]


@pytest.mark.parametrize("stored", [True, False])
def test_an_append_that_broke_off(spark, tmp_path, stored):
    """Keys were written, the commit of the index was not; the rows may be there or not."""
    path = str(tmp_path / "events")
    D.append_events(event_rows(spark, ["a"]), path)
    index = K.KeyIndex(spark, f"{path}_keys")
    index.begin(keys(spark, ["b", "c"]))
    if stored:
        event_rows(spark, ["b", "c"]).withColumn("id", F.lit(7).cast("bigint")).write.mode("append").parquet(path)
    D.append_events(event_rows(spark, ["a", "b", "c", "d"]), path)
    assert sorted(r.dedup for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]
    assert not any(n.startswith("pending") for n in index.batches())


def test_two_writers(spark, tmp_path):
    """Concurrent appends: no id twice, those of an append without a gap."""
    path = str(tmp_path / "samples")
    errors = []

    def write(host):
        try:
            for part in range(3):
                rows = [(part * 100 + i, host, float(i)) for i in range(20)]
                D.append_samples(spark.createDataFrame(rows, "ts bigint, boot_id string, value double"), path)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(h,)) for h in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    rows = spark.read.parquet(path).collect()
    assert sorted(r.sample_id for r in rows) == list(range(1, 121))
    for host in ("a", "b"):
        ids = sorted(r.sample_id for r in rows if r.boot_id == host)
        assert all(ids[i + 19] - ids[i] == 19 for i in (0, 20, 40))


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "samples")
    frame = lambda rows: spark.createDataFrame(rows, "ts bigint, boot_id string")
    D.append_samples(frame([(1, "b")]), path)
    with pytest.raises(Exception):
        D.append_samples(frame([(2, "b"), (None, "b")]), path)
    D.append_samples(frame([(3, "b")]), path)
    rows = spark.read.parquet(path).orderBy("sample_id").collect()
    assert [r.ts for r in rows] == [1, 3] and rows[0].sample_id == 1 and rows[1].sample_id > 1


def test_log_goes_on_from_a_table_without_one(spark, tmp_path):
    path = str(tmp_path / "samples")
    spark.createDataFrame([(1, "b", 99)], "ts bigint, boot_id string, sample_id bigint").write.parquet(path)
    D.append_samples(spark.createDataFrame([(2, "b")], "ts bigint, boot_id string"), path)
    assert sorted(r.sample_id for r in spark.read.parquet(path).collect()) == [99, 100]
    assert CommitLog(spark, path, "sample_id").last().first == 100


def test_stream_dedup_opens_no_old_keys(spark, tmp_path):
    path, table = str(tmp_path / "in"), BatchTable(spark, str(tmp_path / "out"), KEYED)

    def run():
        stream = spark.readStream.schema(KEYED).parquet(path)
        jobs.dedup_stream(stream, table, str(tmp_path / "cp"), ["event_id"]).awaitTermination()

    for n in range(3):
        land(spark, [(n * 10 + i, 10, f"{n}:{i}") for i in range(5)] + [(n * 10 + 9, 10, "0:1"), (n * 10 + 8, 10, None)], KEYED, path)
        run()
    rows = [r.event_id for r in table.read().collect()]
    assert sorted(rows) == [0, 1, 2, 3, 4, 8, 10, 11, 12, 13, 14, 18, 20, 21, 22, 23, 24, 28]
