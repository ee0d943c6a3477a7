import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import context as C, coverage, derive as D
from fleetlens.sources import sensors
from fleetlens.sources import snapshots as S


def deltas(spark, values, width=1 << 17):
    df = spark.createDataFrame(
        [("b", "err_nmi", i, v) for i, v in enumerate(values)], "boot_id string, field string, tick bigint, raw bigint"
    )
    return [r.delta for r in D.counter_delta(df, width=width).orderBy("tick").collect()]


def test_counter_delta(spark):
    assert deltas(spark, [5, 9]) == [None, 4.0]
    assert deltas(spark, [5, 1, 3]) == [None, None, 2.0]
    assert deltas(spark, [5, None, 9, 10, -1, 11, 11]) == [None, None, None, 1.0, None, None, 0.0]


def test_counter_delta_matches_a_walk(spark):
    rng = random.Random(5)
    values = [rng.choice([None, -3, *range(12)]) for _ in range(300)]
    expected, before = [], None
    for v in values:
        ok = v is not None and v >= 0
        expected.append(float(v - before) if ok and before is not None and v >= before else None)
        before = v if ok else None
    assert deltas(spark, values, width=11) == expected


def test_counter_events_and_coverage(spark, rows):
    df = spark.createDataFrame([
        ("b", "err_nmi", 1, 5), ("b", "err_nmi", 2, 9), ("b", "err_mce", 1, None), ("b", "err_mce", 2, 4),
        ("b", "err_ecc_ue", 1, 0), ("b", "err_ecc_ue", 2, 1),
    ], "boot_id string, field string, tick bigint, raw bigint")
    moved = D.counter_events(D.counter_delta(df))
    assert rows(moved, "field", "kind", "severity") == [("err_ecc_ue", "ecc_ue", "critical"), ("err_nmi", "nmi", "error")]
    assert "err_nmi +4 (total 9)" in moved.where("field = 'err_nmi'").first().message
    assert rows(D.baseline_events(df), "field", "severity") == [("err_nmi", "warning")]
    active = {r.field for r in coverage.counter_coverage(df).where("active").collect()}
    assert active == {"err_nmi", "err_ecc_ue"}
    missing = {r.field for r in coverage.missing_counters(df).collect()}
    assert missing == {c.field for c in R.COUNTERS} - active and len(missing) == 14


def test_source_coverage(spark, rows):
    df = spark.createDataFrame(
        [("b", "psi", 1, None), ("b", "psi", 2, 1.0), ("b", "rapl", 1, 2.0)],
        "boot_id string, source string, tick bigint, value double",
    )
    assert rows(coverage.source_coverage(df), "source", "active") == [("psi", False), ("rapl", True)]


def test_coverage_by_the_boots_first_tick(spark, rows):
    """A source or metric that comes later is not active, and a boot that exposes nothing has an answer."""
    ticks = spark.createDataFrame([("b", 1), ("b", 2), ("c", 5), ("d", 3)], "boot_id string, tick bigint")
    readings = spark.createDataFrame(
        [("b", "rapl", 2, 2.0), ("b", "psi", 1, 1.0), ("c", "rapl", 5, 1.0), ("c", "psi", 5, None)],
        "boot_id string, source string, tick bigint, value double",
    )
    counters = spark.createDataFrame([("b", "err_nmi", 2, 5), ("c", "err_nmi", 5, 0)],
                                     "boot_id string, field string, tick bigint, raw bigint")
    found = coverage.machine_coverage(readings, counters, ticks, ["psi", "rapl", "gpu"])
    assert found.count() == 3 * (3 + len(R.COUNTERS))
    assert rows(found.where("active"), "boot_id", "part", "name") == [
        ("b", "source", "psi"), ("c", "counter", "err_nmi"), ("c", "source", "rapl")]
    missing = coverage.missing_counters(counters, ticks=ticks)
    assert missing.where("boot_id = 'd'").count() == len(R.COUNTERS)
    assert missing.where("field = 'err_nmi'").count() == 2
    metrics = spark.createDataFrame([("b", "power_mw", 2, 1), ("b", "temperature", 1, 4)],
                                    "boot_id string, metric string, tick bigint, raw bigint")
    assert rows(sensors.supported_metrics(metrics, ticks=ticks), "metric") == [("temperature",)]


def watts(spark, points, maximum, width=1 << 17):
    df = spark.createDataFrame(
        [("b", "pkg", i, e, t, maximum) for i, (e, t) in enumerate(points)],
        "boot_id string, zone string, tick bigint, energy_uj bigint, mono_us bigint, max_uj bigint",
    )
    return [r.watts for r in D.watts(df, width=width).orderBy("tick").collect()]


def test_watts(spark):
    assert watts(spark, [(0, 0), (65_000_000, 1_000_000)], 10**9) == [None, 65.0]
    assert watts(spark, [(900_000, 0), (100_000, 1_000_000)], 10**6) == [None, 0.2]
    # a gap, no time passed, an implausible step whose value still is the next base
    assert watts(spark, [(0, 0), (None, 10**6), (5, 2 * 10**6), (5, 2 * 10**6), (3 * 10**9, 3 * 10**6),
                         (3 * 10**9 + 10**6, 4 * 10**6)], 10**12) == [None, None, None, None, None, 1.0]


def test_watts_match_a_walk(spark):
    rng, points, t = random.Random(9), [], 0
    for _ in range(200):
        t += rng.choice([0, 500_000, 1_000_000])
        points.append((rng.choice([None, rng.randrange(10**9)]), t))
    expected, before = [], None
    for e, t in points:
        power = None
        if e is not None and before is not None and t > before[1]:
            step = e - before[0] + (10**9 if e < before[0] else 0)
            power = step / (t - before[1])
            power = power if power <= 1000 else None
        expected.append(power)
        before = (e, t) if e is not None else None
    assert watts(spark, points, 10**9, width=13) == expected


def util(spark, snapshots):
    df = spark.createDataFrame(
        [("b", i, "/proc/stat", c) for i, c in enumerate(snapshots)],
        "boot_id string, tick bigint, path string, content string",
    )
    out = D.cpu_utilisation(S.cpu_stat(df), width=2).collect()
    return {(r.tick, r.cpu): r.util for r in out}


def test_cpu_utilisation(spark):
    got = util(spark, [
        "cpu  100 0 0 100 0 0 0 0 0 0\ncpu0 1 1 1 1 1\ncpu1 5 5 5 5 5",
        "cpu  125 0 0 175 0 0 0 0 50 0\ncpu0 2 1 1 2 1\nintr 5",
        "cpu  125 0 0 175 0 0 0 0 0 0\ncpu0 1 1 1 3 1\ncpu1 6 5 5 6 5\ncpu7 1 1 1 1 1",
        None,
        "cpu  225 0 0 275 0 0 0 0\ncpu1 7 5 5 7 5\ncpu0 bad",
    ])
    assert got[0, "cpu"] is None and got[1, "cpu"] == 0.25  # guest time is not counted twice
    assert got[1, "cpu0"] == 0.5
    assert got[2, "cpu"] is None  # no time passed
    assert got[2, "cpu0"] is None  # one counter went back although the total did not
    assert got[1, "cpu1"] is None and got[2, "cpu1"] is None  # missing, then no predecessor
    assert got[3, "cpu"] is None and got[4, "cpu"] is None
    assert "cpu7" not in {cpu for _, cpu in got}


def test_failure_streak(spark, rows):
    df = spark.createDataFrame(
        [("b", name, i, c == "+") for name, text in
         (("x", "--+---"), ("y", "--+--+-"), ("z", "+-----+---")) for i, c in enumerate(text)],
        "boot_id string, source string, tick bigint, ok boolean",
    )
    failures = D.reader_failures(df, width=2)
    assert rows(failures, "source", "failed_tick") == [("x", 5), ("z", 3)]
    masked = D.mask_failed(df.withColumn("v", F.col("tick")), failures, ["boot_id", "source"], ["v"])
    assert [r.v for r in masked.where("source = 'z'").orderBy("tick").collect()] == [0, 1, 2, 3] + [None] * 6
    assert rows(D.failure_events(failures), "message", "kind") == [("x", "reader_fail"), ("z", "reader_fail")]


def test_state_changes(spark, rows):
    df = spark.createDataFrame(
        [("b", "nvme0", i, s) for i, s in enumerate(["live", "live\n", "resetting", None, " ", "live"])],
        "boot_id string, device string, tick bigint, state string",
    )
    changes = D.state_changes(df, width=2)
    assert rows(changes, "tick", "severity") == [(2, "error"), (3, "error"), (5, "warning")]
    assert "resetting -> absent" in changes.where("tick = 3").first().message
    assert [r[1] for r in rows(D.degraded_controllers(df), "tick", "err_nvme_state")] == [0, 0, 1, 1, 1, 0]


def test_strict_sum(spark, rows):
    df = spark.createDataFrame([(1, 5), (1, 10), (2, 5), (2, None), (3, -1), (3, 4)], "tick bigint, raw bigint")
    assert rows(D.strict_sum(df, ["tick"]), "tick", "total") == [(1, 15), (2, None), (3, None)]


def test_context_flags(spark):
    df = spark.createDataFrame(
        [("STEAM_APP_1|x", 50), ("kitty|sh", 50), ("kitty|sh", 0), (None, 50), (None, 0), ("", 5), ("", None)],
        "w string, busy int",
    ).coalesce(1)
    gaming = C.is_gaming(F.col("w"))
    got = [tuple(r) for r in df.select(gaming, C.is_compositing(F.col("busy"), gaming)).collect()]
    assert got == [(1, 0), (0, 1), (0, 0), (None, None), (None, 0), (0, 1), (0, None)]


def test_as_of_context(spark):
    polls = spark.createDataFrame(
        [("b", 10, 1, "a"), ("b", 20, 2, None), ("b", 30, 3, "c")], "boot_id string, ts bigint, id bigint, active_window string"
    )
    ticks = spark.createDataFrame(
        [("b", t, 100 + t) for t in (5, 10, 19, 20, 29, 95)], "boot_id string, ts bigint, id bigint"
    )
    out = C.as_of_context(ticks, polls, width=7).orderBy("ts").collect()
    assert [r.active_window for r in out] == [None, "a", "a", None, None, "c"]


def test_top_process(spark):
    schema = "boot_id string, tick bigint, mono_us bigint, pid bigint, comm string, jiffies bigint, starttime bigint"
    df = spark.createDataFrame([
        ("b", 1, 0, 1, "a", 100, 7), ("b", 1, 0, 2, "b", 100, 8), ("b", 1, 0, 3, None, None, None),
        ("b", 2, 10**6, 1, "a", 200, 7), ("b", 2, 10**6, 2, "b", 400, 99), ("b", 2, 10**6, 4, "new", 900, 1),
        ("b", 5, 2 * 10**6, 1, "a", 200, 7), ("b", 5, 2 * 10**6, 2, "b", 300, 99),
        ("b", 6, 3 * 10**6, 1, "z", 250, 7), ("b", 6, 3 * 10**6, 2, "y", 350, 99),
        ("b", 7, 4 * 10**6, 9, "n", 1, 1),
    ], schema)
    got = [tuple(r)[1:] for r in C.top_process(df, width=2).orderBy("tick").collect()]
    assert got == [(1, 3, None, None), (2, 3, 100.0, "a"), (5, 2, 0.0, None), (6, 2, 50.0, "z"), (7, 1, None, None)]


def test_assemble_and_pivot(spark, rows):
    spine = spark.createDataFrame([("b", 1, 10), ("b", 2, 20)], "boot_id string, tick bigint, ts bigint")
    one = spark.createDataFrame([("b", 1, 1.5), ("b", 9, 9.0)], "boot_id string, tick bigint, load1 double")
    two = spark.createDataFrame([("b", 2, "x")], "boot_id string, tick bigint, note string")
    assert rows(C.assemble_ticks(spine, [one, two]), "tick", "ts", "load1", "note") == [(1, 10, 1.5, None), (2, 20, None, "x")]
    long = spark.createDataFrame([("b", 1, "p", 1.0), ("b", 1, "q", 2.0), ("b", 2, "r", 3.0)],
                                 "boot_id string, tick bigint, metric string, value double")
    assert rows(C.pivot_ticks(long, ["p", "q"]), "tick", "p", "q") == [(1, 1.0, 2.0), (2, None, None)]
