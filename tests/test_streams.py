import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import derive, events as E
from fleetlens.plans.stream_queries import COUNTER_ROWS, DELTA_ROWS, KEYED, SAMPLE_ROWS
from fleetlens.sources.logs import parse_kmsg
from fleetlens.streaming import jobs
from fleetlens.streaming.tables import Batch, BatchTable


def land(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_intake():
    assert jobs.intake(5, "1g") == {"maxFilesPerTrigger": "5", "maxBytesPerTrigger": "1g"}
    assert jobs.intake() == {}
    with pytest.raises(ValueError):
        jobs.intake(0)


def test_follow_log_replays_follows_and_restarts(spark, tmp_path):
    landed, out = tmp_path / "log", str(tmp_path / "events")
    folder = landed / "boot_id=b" / "tick=1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("2,1,1000,-;Kernel panic\nbroken\n6,2,2000,-;usb 1-1: fine\n KEY=v\n")
    table = BatchTable(spark, out, jobs.EVENT_ROWS)
    counts = BatchTable(spark, str(tmp_path / "counts"), jobs.COUNT_ROWS)
    storms = BatchTable(spark, str(tmp_path / "storms"), jobs.STORM_ROWS)

    def run():
        lines = jobs.log_lines(spark, str(landed), jobs.intake(max_files=1))
        jobs.follow_log(
            lines, jobs.kernel_log(F.lit(5)), table, storms, str(tmp_path / "cp"), counts=counts
        ).awaitTermination()

    run()
    assert [(r.ts, r.kind, r.dedup) for r in table.read().collect()] == [(6, "panic", "b:1")]
    # after a restart: a line seen before, an old one that comes late, a new one
    (folder / "b.txt").write_text("2,1,1000,-;Kernel panic\n3,0,500,-;odd thing\n3,9,9000,-;NVRM: Xid (x): 79, y\n")
    run()
    run()
    got = sorted((r.dedup, r.ts, r.kind) for r in table.read().collect())
    assert got == [("b:0", 5, "kernel_error"), ("b:1", 6, "panic"), ("b:9", 14, "gpu_xid")]
    (total,) = jobs.tick_totals(counts).collect()
    assert (total.messages, total.criticals, total.errors) == (5, 3, 1)


def test_dedup_keeps_the_first_and_all_without_key(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, [(1, 10, "a"), (2, 10, None), (3, 11, "a")], KEYED, path)
    table = BatchTable(spark, str(tmp_path / "out"), KEYED)

    def run():
        stream = spark.readStream.schema(KEYED).parquet(path)
        jobs.dedup_stream(stream, table, str(tmp_path / "cp"), ["event_id"]).awaitTermination()

    run()
    land(spark, [(4, 1, "a"), (5, 12, None), (6, 12, "b")], KEYED, path)
    run()
    assert sorted(r.event_id for r in table.read().collect()) == [1, 2, 5, 6]


def test_dedup_bounded(spark, tmp_path):
    schema = T.StructType([*KEYED.fields, T.StructField("at", T.TimestampType())])
    path = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 10, "a"), (2, 11, "a"), (3, 12, "b")], KEYED)
    df.withColumn("at", F.timestamp_millis("ts")).write.parquet(path)
    stream = jobs.dedup_bounded(spark.readStream.schema(schema).parquet(path), "at", "1 minute")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.dedup for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_counter_state_equals_the_batch(spark, tmp_path):
    data = [("b", f, t, v) for f in ("x", "y") for t, v in enumerate([5, 7, None, 9, 12, 3, 4, 4, None, 6])]
    path = str(tmp_path / "in")
    deltas = BatchTable(spark, str(tmp_path / "deltas"), DELTA_ROWS)
    state = BatchTable(spark, str(tmp_path / "state"), COUNTER_ROWS)
    # the last part has no rows of y at all; its state must survive
    for part in ([r for r in data if r[2] < 3], [r for r in data if 3 <= r[2] < 6 and r[1] == "x"],
                 [r for r in data if r[2] >= 3 and not (r[1] == "x" and r[2] < 6)]):
        land(spark, part, COUNTER_ROWS, path)
        stream = spark.readStream.schema(COUNTER_ROWS).parquet(path)
        jobs.counter_stream(stream, deltas, state, str(tmp_path / "cp"), width=2).awaitTermination()
    batch = derive.counter_delta(spark.createDataFrame(data, COUNTER_ROWS))
    key = lambda r: (r.field, r.tick)
    assert [(key(r), r.delta) for r in sorted(deltas.read().collect(), key=key)] == [
        (key(r), r.delta) for r in sorted(batch.collect(), key=key)]


ENERGY = T.StructType([T.StructField("boot_id", T.StringType()), T.StructField("zone", T.StringType())] + [
    T.StructField(n, T.LongType()) for n in ("tick", "mono_us", "energy_uj", "max_uj")])
CPU = T.StructType([T.StructField("boot_id", T.StringType()), T.StructField("tick", T.LongType()),
                    T.StructField("cpus", T.MapType(T.StringType(), T.ArrayType(T.LongType())))])


def in_parts(spark, tmp_path, data, schema, start):
    """Run a job over three parts, with a restart before each."""
    path = str(tmp_path / "in")
    for low, high in ((0, 3), (3, 5), (5, 99)):
        part = [r for r in data if low <= r[schema.names.index("tick")] < high]
        land(spark, part, schema, path)
        start(spark.readStream.schema(schema).parquet(path)).awaitTermination()


def test_power_state_equals_the_batch(spark, tmp_path):
    energy = [100, 65_000_100, None, 7, 5, 2 * 10**9, 2 * 10**9 + 10**6, 0]
    data = [("b", z, t, t * 10**6, e, 10**10) for z in "pq" for t, e in enumerate(energy)]
    results = BatchTable(spark, str(tmp_path / "w"), T.StructType([*ENERGY.fields, T.StructField("watts", T.DoubleType())]))
    state = BatchTable(spark, str(tmp_path / "s"), ENERGY)
    in_parts(spark, tmp_path, data, ENERGY, lambda s: jobs.power_stream(s, results, state, str(tmp_path / "cp"), width=2))
    batch = derive.watts(spark.createDataFrame(data, ENERGY))
    key = lambda r: (r.zone, r.tick)
    assert [(key(r), r.watts) for r in sorted(results.read().collect(), key=key)] == [
        (key(r), r.watts) for r in sorted(batch.collect(), key=key)]


def test_cpu_state_equals_the_batch(spark, tmp_path):
    def snapshot(t):
        cpus = {"cpu": [t * 5, 0, 0, t * 3, t], "cpu0": [t, 0, 0, t * t, 1]}
        if t in (2, 3):
            del cpus["cpu0"]
        if t > 3:
            cpus["cpu9"] = [1, 1, 1, 1, 1]
        return cpus

    data = [("b", t, snapshot(t)) for t in range(8)]
    out = T.StructType([*CPU.fields[:2], T.StructField("cpu", T.StringType()), T.StructField("util", T.DoubleType())])
    results = BatchTable(spark, str(tmp_path / "u"), out)
    state = BatchTable(spark, str(tmp_path / "s"), T.StructType([*CPU.fields, T.StructField("names", T.ArrayType(T.StringType()))]))
    in_parts(spark, tmp_path, data, CPU, lambda s: jobs.cpu_stream(s, results, state, str(tmp_path / "cp"), width=2))
    batch = derive.cpu_utilisation(spark.createDataFrame(data, CPU))
    assert sorted(map(tuple, results.read().collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert batch.count() == 16


def test_samples_are_stored_once_and_bad_batches_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    table = BatchTable(spark, str(tmp_path / "out"), SAMPLE_ROWS)

    def run():
        stream = spark.readStream.schema(SAMPLE_ROWS).parquet(path)
        jobs.sample_stream(stream, table, str(tmp_path / "cp")).awaitTermination()

    land(spark, [("b", 1, 10, 1.0), ("b", 2, 10, 2.0), ("b", 1, 10, 1.0)], SAMPLE_ROWS, path)
    run()
    land(spark, [("b", 2, 10, 2.0), ("b", 3, 5, 3.0)], SAMPLE_ROWS, path)  # the clock went back
    run()
    assert sorted((r.tick, r.ts) for r in table.read().collect()) == [(1, 10), (2, 10), (3, 5)]
    land(spark, [("b", 4, None, 2.0), ("b", 5, 5, 3.0)], SAMPLE_ROWS, path)
    with pytest.raises(Exception):
        run()
    assert table.read().count() == 3


def test_a_repeated_batch_leaves_the_same_result(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), KEYED)
    df = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], KEYED)
    now = Batch("r", 0)
    for _ in range(2):
        table.write(E.new_only(df, table.read(but=now), ["event_id"]), now)
    assert table.read().count() == 2 and table.read(but=now).count() == 0
    assert table.read(but=Batch("other", 0)).count() == 2
    assert table.read(between=("ts", 11, 12)).count() == 1


def test_a_fresh_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    table = BatchTable(spark, str(tmp_path / "out"), KEYED)

    def run(checkpoint, source=path):
        stream = spark.readStream.schema(KEYED).parquet(source)
        jobs.dedup_stream(stream, table, str(tmp_path / checkpoint), ["event_id"]).awaitTermination()

    land(spark, [(1, 10, "a"), (2, 10, "b")], KEYED, path)
    run("cp1")
    run("cp2")  # delivers everything again
    assert sorted(r.event_id for r in table.read().collect()) == [1, 2]
    other = str(tmp_path / "other")
    land(spark, [(7, 10, "b"), (8, 10, "c")], KEYED, other)
    run("cp3", other)  # a second stream into the same table
    assert sorted(r.event_id for r in table.read().collect()) == [1, 2, 8]


def test_series_go_on_under_a_fresh_checkpoint(spark, tmp_path):
    data = [("b", "x", t, v) for t, v in enumerate([5, 7, 9, 12, 20])]
    path = str(tmp_path / "in")
    deltas = BatchTable(spark, str(tmp_path / "deltas"), DELTA_ROWS)
    state = BatchTable(spark, str(tmp_path / "state"), COUNTER_ROWS)
    for n, part in enumerate((data[:2], data[2:4], data[4:])):
        land(spark, part, COUNTER_ROWS, path)
        stream = spark.readStream.schema(COUNTER_ROWS).parquet(path)
        jobs.counter_stream(stream, deltas, state, str(tmp_path / f"cp{n}"), width=2).awaitTermination()
    got = sorted((r.tick, r.delta) for r in deltas.read().collect())
    assert got == [(0, None), (1, 2.0), (2, 2.0), (3, 3.0), (4, 8.0)]


def test_the_cap_counts_per_tick_over_all_triggers(spark, tmp_path):
    lines = [f"2,{i},{i * 1000},-;Kernel panic {i}" for i in range(9)]
    for n in range(3):
        folder = tmp_path / "log" / "boot_id=b" / "tick=1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n}.txt").write_text("\n".join(lines[3 * n : 3 * n + 3]))
    boots = spark.createDataFrame([("b", 5)], "boot_id string, boot_epoch_ms bigint")
    found = []
    for files in (1, 3):
        events = BatchTable(spark, str(tmp_path / f"e{files}"), jobs.EVENT_ROWS)
        storms = BatchTable(spark, str(tmp_path / f"s{files}"), jobs.STORM_ROWS)
        jobs.follow_log(
            jobs.log_lines(spark, str(tmp_path / "log"), jobs.intake(max_files=files)), jobs.kernel_log(boots),
            events, storms, str(tmp_path / f"c{files}"), limit=4,
        ).awaitTermination()
        rows = jobs.followed_events(events, storms).collect()
        assert sum(r.kind == "panic" for r in rows) == 4
        found.append([r.message for r in rows if r.kind == "event_storm"])
    assert found[0] == found[1] and len(found[0]) == 1


def test_triggers_leave_no_scratch_behind(spark, tmp_path):
    import os

    folder = tmp_path / "log" / "boot_id=b" / "tick=1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("2,1,1000,-;Kernel panic")
    root = os.path.join(spark.conf.get("spark.checkpoint.dir"), "fleetlens")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    jobs.follow_log(
        jobs.log_lines(spark, str(tmp_path / "log")), jobs.kernel_log(F.lit(0)),
        BatchTable(spark, str(tmp_path / "e"), jobs.EVENT_ROWS), BatchTable(spark, str(tmp_path / "s"), jobs.STORM_ROWS),
        str(tmp_path / "c"),
    ).awaitTermination()
    assert set(os.listdir(root)) == before


def test_stream_equals_batch_for_parsing(spark, tmp_path):
    lines = [f"{i % 8},{i},{i * 1000},-;line {i}" for i in range(20)]
    folder = tmp_path / "log" / "boot_id=b" / "tick=1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("\n".join(lines))
    stream = parse_kmsg(jobs.log_lines(spark, str(tmp_path / "log")).withColumn("boot_epoch_ms", F.lit(0)))
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    batch = parse_kmsg(spark.createDataFrame([("b", 1, l, 0) for l in lines],
                                             "boot_id string, tick bigint, line string, boot_epoch_ms int"))
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0
    assert batch.count() == 20
