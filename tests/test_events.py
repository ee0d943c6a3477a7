import random

import pytest

from fleetlens.operators import events as E

RECORD = "boot_id string, tick bigint, seq bigint, ts bigint, kind string, severity string, text string, dedup string"


def record(tick, seq, kind="gpu_reset", severity="critical", dedup="auto", text="amdgpu: GPU reset begin!"):
    key = f"b:{seq}" if dedup == "auto" else dedup
    return ("b", tick, seq, 1000 * tick + seq, kind, severity, text, key)


def test_storm_is_capped_and_reported(spark):
    df = spark.createDataFrame([record(1, i) for i in range(120)] + [record(2, 200)], RECORD)
    out = E.log_events(df.withColumn("note", df.kind)).collect()
    assert sum(r.kind == "gpu_reset" and r.tick == 1 for r in out) == 50
    (storm,) = [r for r in out if r.kind == "event_storm"]
    assert (storm.tick, storm.severity, storm.dedup) == (1, "warning", None)
    assert storm.message.startswith("70 ")
    assert {r.dedup for r in out if r.tick == 1 and r.dedup} == {f"b:{i}" for i in range(50)}


def test_known_keys_do_not_use_the_budget(spark):
    df = spark.createDataFrame([record(1, i) for i in range(80)], RECORD)
    known = df.select("dedup")
    kept, suppressed = E.cap_events(df, known)
    assert kept.count() == 0 and suppressed.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cap_matches_a_walk(spark, seed):
    rng = random.Random(seed)
    data = [
        record(tick, tick * 1000 + i, dedup=rng.choice(["auto", "auto", None]))
        for tick in range(4) for i in range(rng.randint(0, 30))
    ]
    stored = {r[7] for r in data if r[7] and rng.random() < 0.3}
    kept, count, seen = set(), {}, {}
    for r in data:
        new = r[7] is None or r[7] not in stored
        if seen.get(r[1], 0) >= 5:
            count[r[1]] = count.get(r[1], 0) + 1
        elif new:
            kept.add(r[2])
            seen[r[1]] = seen.get(r[1], 0) + 1
    df = spark.createDataFrame(data, RECORD).repartition(3)
    known = spark.createDataFrame([(s,) for s in stored], "dedup string")
    got, suppressed = E.cap_events(df, known, limit=5, width=7)
    assert {r.seq for r in got.collect()} == kept
    assert {r.tick: r.suppressed for r in suppressed.collect()} == count


def test_new_only(spark, rows):
    df = spark.createDataFrame([
        (1, 10, "s", "k", "a"), (2, 11, "s", "k", "a"), (3, 12, "s", "k", None), (4, 12, "s", "k", None),
        (5, 13, "s", "k", None), (6, 14, "s", "k", "b"), (7, None, "s", "k", "c"), (8, 15, None, "k", "d"),
        (9, 15, "s", None, None),
    ], "id bigint, ts bigint, source string, kind string, dedup string")
    assert [r[0] for r in rows(E.new_only(df, None, ["id"]), "id")] == [1, 3, 4, 5, 6]
    known = df.where("dedup = 'b' or dedup is null").select("dedup")
    assert [r[0] for r in rows(E.new_only(df, known, ["id"]), "id")] == [1, 3, 4, 5]


def test_tick_counts(spark, rows):
    df = spark.createDataFrame([
        record(1, 1), record(1, 2, "nvme_error", "error"), record(1, 3, None, None),
        record(1, 4, "ecc_ce", "warning"),
    ], RECORD)
    ticks = spark.createDataFrame([("b", 1), ("b", 2)], "boot_id string, tick bigint")
    assert rows(E.tick_counts(df, ticks)) == [("b", 1, 4.0, 1.0, 2.0), ("b", 2, 0.0, 0.0, 0.0)]


def test_replayed_faults(spark, rows):
    df = spark.createDataFrame([record(1, 1), record(1, 2, None, None), record(2, 3)], RECORD)
    assert rows(E.replayed_faults(df)) == [("b", 2)]


def test_register_boots(spark, rows):
    seen = spark.createDataFrame([("a", 5, 2), ("a", 9, 1), ("b", 1, 3)], "boot_id string, ts_first bigint, arrival bigint")
    assert rows(E.register_boots(seen), "boot_id", "ts_first") == [("a", 9), ("b", 1)]
    known = spark.createDataFrame([("a",)], "boot_id string")
    assert rows(E.register_boots(seen, known), "boot_id") == [("b",)]


def test_fault_scan(spark):
    data = [("b", i, "oom", "error" if i else "warning", f"m{i}") for i in range(9)] + [("b", 20, "mce", "critical", "x")]
    df = spark.createDataFrame(data, "boot_id string, position bigint, kind string, severity string, message string")
    found = {r.kind: r for r in E.fault_scan(df.repartition(4)).collect()}
    oom = found["oom"]
    assert (oom.severity, oom.n, oom.more, oom.severity_rank) == ("warning", 9, 3, 2)
    assert oom.examples == [f"m{i}" for i in range(6)]
    assert (found["mce"].criticals, found["mce"].more, found["mce"].severity_rank) == (1, 0, 0)


def test_listings(spark):
    data = [(i, 100 + i % 3, "kmsg", "oom" if i % 4 else "mce", "error", "m") for i in range(8)]
    df = spark.createDataFrame(data, "id bigint, ts bigint, source string, kind string, severity string, message string")
    assert [(r.ts, r.id) for r in E.recent_events(df, 3).collect()] == [(102, 5), (102, 2), (101, 7)]
    assert [tuple(r) for r in E.events_by_kind(df).collect()] == [("kmsg", "oom", 6), ("kmsg", "mce", 2)]
