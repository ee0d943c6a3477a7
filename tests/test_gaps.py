"""Missing readings and vanished devices give NULL, as the collector's rules demand."""

from fleetlens.operators import derive as D
from fleetlens.operators.spine import on_spine, ticks_of
from fleetlens.sources import snapshots as S


def landed(spark, *rows):
    return spark.createDataFrame(
        [("b", *r) for r in rows], "boot_id string, tick bigint, path string, content string"
    )


def deltas(counters):
    found = D.counter_delta(D.monitored_series(counters)).orderBy("field", "tick").collect()
    return [(r.field, r.tick, r.delta) for r in found]


def nmi(n):
    return f"      CPU0\nNMI:   {n}   Non-maskable interrupts\n"


def test_unreadable_file_is_no_spike(spark):
    files = landed(
        spark, *[(t, "/proc/interrupts", nmi(n) if n is not None else None) for t, n in enumerate([5, None, 9, 10])]
    )
    counters = S.interrupt_counters(files)
    assert deltas(counters) == [("err_nmi", 0, None), ("err_nmi", 1, None), ("err_nmi", 2, None), ("err_nmi", 3, 1.0)]


def test_vanished_label_is_a_gap(spark):
    other = "      CPU0\nMCE:  1\n"
    files = landed(spark, (0, "/proc/interrupts", nmi(5) + "MCE: 1\n"), (1, "/proc/interrupts", other),
                   (2, "/proc/interrupts", nmi(8) + "MCE: 1\nLOC: 7\n"))
    found = S.interrupt_totals(files).orderBy("label", "tick").collect()
    assert [(r.label, r.tick, r.total) for r in found] == [
        ("MCE", 0, 1), ("MCE", 1, 1), ("MCE", 2, 1), ("NMI", 0, 5), ("NMI", 1, None), ("NMI", 2, 8)
    ]


def test_partial_sum_is_unknown_until_all_files_are_back(spark):
    def mc(n):
        return f"/sys/devices/system/edac/mc/mc{n}/ce_count"

    files = landed(spark, (0, mc(0), "5"), (0, mc(1), "10"), (1, mc(0), "5"), (2, mc(0), "5"), (2, mc(1), "10"),
                   (3, mc(0), "6"), (3, mc(1), "10"), (4, "/proc/uptime", "9"), (5, mc(0), "6"), (5, mc(1), "10"))
    assert [d for *_, d in deltas(S.integer_counters(files))] == [None, None, None, 1.0, None, None]


def test_partial_named_sum(spark):
    field, pattern, skip = S.NAMED_COUNTERS[0]

    def aer(n):
        return f"/sys/bus/pci/devices/{n}/aer_dev_correctable"

    files = landed(spark, (0, aer(1), "RxErr 2\n"), (0, aer(2), "RxErr 3\n"), (1, aer(2), "RxErr 3\n"),
                   (2, aer(1), "RxErr 2\n"), (2, aer(2), "RxErr 3\n"), (2, aer(9), "RxErr 100\n"))
    got = S.named_counters(files, field, pattern, skip_totals=skip).orderBy("tick").collect()
    assert [r.raw for r in got] == [5, None, 5]


def test_counter_unreadable_at_the_start_stays_out(spark):
    counters = spark.createDataFrame(
        [("b", "err_nmi", 1, None), ("b", "err_nmi", 2, 5), ("b", "err_nmi", 3, 7), ("b", "err_mce", 1, 2),
         ("b", "err_mce", 3, 4), ("b", "err_oom_kill", 2, 1), ("b", "err_oom_kill", 3, 9)],
        "boot_id string, field string, tick bigint, raw bigint",
    )
    series = D.monitored_series(counters)
    assert deltas(counters) == [("err_mce", 1, None), ("err_mce", 2, None), ("err_mce", 3, None)]
    assert D.counter_events(D.counter_delta(series)).count() == 0
    # a series that starts late has no baseline, however its own first row reads
    assert [r.message for r in D.baseline_events(counters).collect()] == ["err_mce=2 when collection started"]
    assert [(r.field, r.raw) for r in D.monitored(counters).collect()] == [("err_mce", 2)]


def test_vanished_controller_is_absent(spark):
    states = spark.createDataFrame(
        [("b", "nvme0", 1, "live"), ("b", "nvme1", 1, "live"), ("b", "nvme0", 2, "live"), ("b", "nvme0", 3, "live"),
         ("b", "nvme1", 3, "live\n")], "boot_id string, device string, tick bigint, state string",
    )
    changes = D.state_changes(states).orderBy("tick").collect()
    assert [(r.device, r.tick, r.severity) for r in changes] == [("nvme1", 2, "error"), ("nvme1", 3, "warning")]
    assert "live -> absent" in changes[0].message and "absent -> live" in changes[1].message
    assert [r.err_nvme_state for r in D.degraded_controllers(states).orderBy("tick").collect()] == [0.0, 1.0, 0.0]


def test_power_after_a_missing_row(spark):
    energy = spark.createDataFrame(
        [("b", "pkg", t, e, t * 10**6, 10**12) for t, e in ((0, 0), (1, 10**6), (3, 4 * 10**6), (4, 5 * 10**6))],
        "boot_id string, zone string, tick bigint, energy_uj bigint, mono_us bigint, max_uj bigint",
    )
    ticks = spark.createDataFrame([("b", t) for t in range(5)], "boot_id string, tick bigint")
    filled = on_spine(energy, ticks, ["boot_id", "zone"])
    assert [r.watts for r in D.watts(filled).orderBy("tick").collect()] == [None, 1.0, None, None, 1.0]


def test_boots_do_not_mix(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5)], "boot_id string, tick bigint")
    b = spark.createDataFrame([("x", 2), ("y", 4)], "boot_id string, tick bigint")
    ticks = ticks_of(a, b)
    rows = spark.createDataFrame([("x", "s", 1, 7), ("y", "s", 5, 8)], "boot_id string, s string, tick bigint, v int")
    found = on_spine(rows, ticks, ["boot_id", "s"]).orderBy("boot_id", "tick").collect()
    assert [(r.boot_id, r.tick, r.v) for r in found] == [("x", 1, 7), ("x", 2, None)]  # y began without s
