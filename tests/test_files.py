import pytest
from pyspark.sql import functions as F

from fleetlens.functions import text as X
from fleetlens.sources import sensors, snapshots as S

FILES = "boot_id string, tick bigint, mono_us bigint, path string, content string"


def files(spark, *entries):
    return spark.createDataFrame([("b", t, t * 10**6, p, c) for t, p, c in entries], FILES).coalesce(1)


def test_cpu_stat(spark, rows):
    df = files(
        spark,
        (1, "/proc/stat", "cpu  1 2 3 4 5 6 7 8 9 10\ncpu0 1 1 1 1 1\ncpu1 1 2 3 4\ncpu2 1 1 1 1 -1 1 1 1\n"
                          "cpufreq 1 1 1 1 1\n  cpu3\t1 2 3 4 5 6 x\ncpu4 1 2 3 4 5 6 7 8 x\ncpu0 2 2 2 2 2 2 \nintr 1 1 1 1 1"),
        (2, "/proc/stat", None), (3, "/proc/other", "cpu 1 1 1 1 1"),
    )
    got = {(r.tick, r.cpu): r.counters for r in S.cpu_stat_rows(df).collect()}
    assert got == {(1, "cpu"): list(range(1, 9)), (1, "cpu0"): [2] * 6, (1, "cpu4"): list(range(1, 9))}
    assert S.cpu_stat(df).where("tick = 2").first().cpus == {}


def test_memory(spark, rows):
    df = files(
        spark,
        (1, "/proc/meminfo", "MemTotal: 8000000 kB\nMemFree: 1 kB\nMemAvailable:    4000000 kB\nSwapTotal: 2048 kB\nSwapFree: 1024 kB\n"),
        (2, "/proc/meminfo", "MemTotal: 8000000 kB\nSwapTotal: 10 kB\nSwapFree: x kB"),
        (3, "/proc/meminfo", None),
    )
    assert rows(S.memory_used(df), "tick", "mem_used_mb", "swap_used_mb") == [
        (1, 3906.25, 1.0), (2, None, None), (3, None, None)]


def test_first_numbers(spark, rows):
    df = files(spark, (1, "/proc/loadavg", "0.51 0.4 0.3 1/2 3\n"), (2, "/proc/loadavg", ""), (3, "/proc/loadavg", "x"),
               (1, "/proc/uptime", "12.5 3"))
    assert rows(S.load_average(df), "tick", "load1") == [(1, 0.51), (2, None), (3, None)]
    assert rows(S.uptime(df), "uptime_s") == [(12.5,)]


def test_cpu_frequency(spark, rows):
    path = "/sys/devices/system/cpu/cpu{}/cpufreq/{}"
    avg, cur = "cpuinfo_avg_freq", "scaling_cur_freq"
    measured = files(
        spark, (1, path.format(0, avg), "3500000\n"), (1, path.format(1, avg), "n/a"), (1, path.format(0, cur), "1"),
        (1, path.format(1, cur), "1"), (2, path.format(0, avg), None), (2, path.format(1, avg), "9"), (2, path.format(0, cur), "1"),
    )
    assert rows(S.cpu_frequency(measured), "tick", "cpu_freq_avg") == [(1, 3500.0), (2, None)]
    fallback = files(spark, (1, path.format(0, avg), "x"), (1, path.format(0, cur), "1000000"), (1, path.format(1, cur), "2000000"))
    assert rows(S.cpu_frequency(fallback), "cpu_freq_avg") == [(1500.0,)]


def test_pressure(spark, rows):
    df = files(
        spark, (1, "/proc/pressure/cpu", "some avg10=1.50 avg60=2.00 total=5\nfull avg10=9.00"),
        (1, "/proc/pressure/io", "some avg10=0.25 avg60=2.00\nfull avg60=1.0 avg10=0.75 total=1\n"),
        (2, "/proc/pressure/memory", "some avg10=bad\nfull avg10=0.00 x"),
    )
    assert rows(S.pressure(df)) == [("b", 1, 1.5, 0.25, 0.75, None, None), ("b", 2, None, None, None, None, 0.0)]


def test_interrupts(spark, rows):
    text = ("            CPU0       CPU1\n  0:   33   0  IO-APIC\n NMI:   2   3   Non-maskable 9 interrupts\n"
            "ERR:   0\nMIS:\nLOC: -1 4 x\nNMI: 1 4 later")
    df = files(spark, (1, "/proc/interrupts", text), (2, "/proc/interrupts", None))
    assert rows(S.interrupt_totals(df).where("tick = 1"), "label", "total") == [("ERR", 0), ("LOC", 3), ("NMI", 5)]
    assert rows(S.interrupt_counters(df).where("tick = 1"), "field", "raw") == [("err_apic", 0), ("err_nmi", 5)]
    # the unreadable file leaves a row for every label, without a total
    assert rows(S.interrupt_totals(df).where("tick = 2"), "label", "total") == [("ERR", None), ("LOC", None), ("NMI", None)]


def test_counters(spark, rows):
    vm = files(spark, (1, "/proc/vmstat", "a 1\noom_kill 4\noom_kill_x 9\n"), (2, "/proc/vmstat", "oom_kill x"), (3, "/proc/vmstat", None))
    assert rows(S.oom_kills(vm), "tick", "raw") == [(1, 4), (2, None), (3, None)]
    aer = "/sys/bus/pci/devices/{}/aer_dev_correctable"
    df = files(
        spark, (1, aer.format(1), "RxErr 3\nBadTLP 2\nTOTAL_ERR_COR 5\n"), (1, aer.format(2), "RxErr: 2\n\n"),
        (2, aer.format(1), "RxErr 3"), (2, aer.format(2), "RxErr 3 x"), (3, aer.format(1), "TOTAL_ERR_COR 5"),
        (3, aer.format(2), "RxErr 0"), (4, aer.format(1), None), (4, aer.format(2), "RxErr 0"),
        (5, aer.format(1), "Lone\n"), (5, aer.format(2), "RxErr 0"),
    )
    field, pattern, skip = S.NAMED_COUNTERS[0]
    got = rows(S.named_counters(df, field, pattern, skip_totals=skip), "tick", "raw")
    assert got == [(1, 7), (2, None), (3, None), (4, None), (5, None)]
    with_totals = S.named_counters(df, field, pattern, skip_totals=False)
    assert rows(with_totals.where("tick = 3"), "raw") == [(5,)]
    edac = "/sys/devices/system/edac/mc/mc{}/ce_count"
    ints = files(spark, (1, edac.format(0), "5\n"), (1, edac.format(1), "10"), (2, edac.format(0), "5"), (2, edac.format(1), None),
                 (3, edac.format(0), "-1"), (1, edac.replace("ce_", "ue_").format(0), "0"), (1, "/x", "7"))
    assert rows(S.integer_counters(ints), "tick", "field", "raw") == [
        (1, "err_ecc_ce", 15), (1, "err_ecc_ue", 0), (2, "err_ecc_ce", None), (2, "err_ecc_ue", None),
        (3, "err_ecc_ce", None), (3, "err_ecc_ue", None)]


def test_processes(spark, rows):
    tail = " ".join(["S"] + ["0"] * 10 + ["30", "12"] + ["0"] * 6 + ["777", "8"])
    df = files(
        spark, (1, "/proc/10/stat", f"10 (Web (x) y) {tail}"), (1, "/proc/11/stat", "11 (short) S 1 2"),
        (1, "/proc/12/stat", None), (1, "/proc/13/stat", "13 no frame"), (1, "/proc/self/stat", f"1 (a) {tail}"),
        (1, "/proc/14/stat", f"14 (bad) {tail.replace('777', 'x')}"),
    )
    assert rows(S.processes(df), "pid", "comm", "jiffies", "starttime") == [
        (10, "Web (x) y", 42, 777), (11, None, None, None), (12, None, None, None), (13, None, None, None),
        (14, None, None, None)]


def test_windows(spark):
    replies = ['{"class":"kitty","title":"a|b"}', "{}", '{"class":"kitty"}', '{"class":1,"title":"x"}', "[]", '"x"', "bad", None,
               '{"class":"","title":""}']
    df = spark.createDataFrame([(r,) for r in replies], "r string").coalesce(1)
    assert [r[0] for r in df.select(S.active_window(F.col("r"))).collect()] == [
        "kitty|a|b", "", None, None, None, None, None, None, "|"]


SENSOR = "boot_id string, tick bigint, device string, instance int, channel string, idx int, suffix string, label string, raw bigint"


def catalogue(spark, *entries):
    df = spark.createDataFrame([("b", *e) for e in entries], SENSOR)
    found = sensors.sensor_catalogue(df)
    values = {(r.tick, r.column): r.value for r in sensors.sensor_values(df, found).collect()}
    return {r.column for r in found.collect()}, values


def test_sensor_basics(spark):
    names, values = catalogue(
        spark, (1, "k10temp", 0, "temp", 1, "input", "Tctl", 45250), (2, "k10temp", 0, "temp", 1, "input", "Tctl", None),
        (1, "k10temp", 0, "in", 1, "input", None, 5), (1, "unknown", 0, "temp", 1, "input", None, 5),
        (2, "k10temp", 0, "temp", 2, "input", None, 7), (1, "nvme", 0, "temp", 1, "input", None, 40000),
        (1, "nvme", 1, "temp", 1, "input", None, 40001), (1, "gigabyte_wmi", 0, "temp", 3, "input", "Wrong", 1000),
        (1, "amdgpu", 0, "power", 1, "label", "PPT", None),
    )
    assert names == {"k10temp_tctl", "nvme_temp1", "nvme1_temp1", "gigabyte_temp3"}
    assert values[1, "k10temp_tctl"] == 45.25 and values[2, "k10temp_tctl"] is None


@pytest.mark.parametrize("average, expected", [(None, 5.0), (7000000, 7.0), (0, 0.0)])
def test_sensor_prefers_the_first_readable_file(spark, average, expected):
    _, values = catalogue(
        spark, (1, "amdgpu", 0, "power", 1, "average", "PPT", average), (1, "amdgpu", 0, "power", 1, "input", "PPT", 5000000),
        (2, "amdgpu", 0, "power", 1, "average", "PPT", 9000000), (2, "amdgpu", 0, "power", 1, "input", "PPT", 5000000),
    )
    assert values[1, "amdgpu_ppt_w"] == expected
    assert values[2, "amdgpu_ppt_w"] == (5.0 if average is None else 9.0)


def test_sensor_label_collisions(spark):
    labels = ["Composite3", "Composite", "Composite", "Composite3_2"]
    names, values = catalogue(spark, *[
        (1, "nvme", 0, "temp", i, "input", label, i * 1000) for i, label in enumerate(labels, 1)
    ])
    assert values == {(1, "nvme_composite3"): 1.0, (1, "nvme_composite"): 2.0, (1, "nvme_composite3_2"): 3.0,
                      (1, "nvme_composite3_24"): 4.0}


def test_busy_percentage_keeps_its_name(spark):
    names, values = catalogue(
        spark, (1, "amdgpu", 0, "temp", 1, "input", "Busy Pct", 42000), (1, "amdgpu", 0, "temp", 2, "input", "Busy Pct 2", 43000),
        (1, "amdgpu", 0, "busy_pct", 0, "percent", None, 75),
    )
    assert values == {(1, "amdgpu_busy_pct"): 75.0, (1, "amdgpu_busy_pct_2"): 43.0, (1, "amdgpu_busy_pct_3"): 42.0}


def test_energy_zones(spark, rows):
    df = spark.createDataFrame([
        ("one", "intel-rapl:0", "package-0\n", 5, 100), ("one", "intel-rapl:0:0", "core", 5, 100),
        ("one", "intel-rapl:0:1", None, 5, 100), ("one", "intel-rapl:0:2", "dram", None, 100),
        ("one", "intel-rapl:0:3", "uncore", 5, 0), ("one", "intel-rapl-mmio:0", "x", 5, 100),
        ("one", "intel-rapl:0:4", "Core", 5, 100),
        ("two", "intel-rapl:0", "package-0", 5, 100), ("two", "intel-rapl:1", "package-1", 5, 100),
        ("two", "intel-rapl:1:0", "core", 5, 100), ("two", "intel-rapl:2", None, 5, 100),
    ], "boot_id string, zone string, zone_name string, energy_uj bigint, max_uj bigint")
    got = rows(sensors.energy_zones(df), "boot_id", "column")
    assert got == [("one", "rapl_core_watts"), ("one", "rapl_core_watts_2"), ("one", "rapl_pkg_watts"), ("one", "rapl_sub1_watts"),
                   ("two", "rapl_pkg0_watts"), ("two", "rapl_pkg1_core_watts"), ("two", "rapl_pkg1_watts"),
                   ("two", "rapl_pkg2_zone2_watts")]


def test_gpu_metrics(spark, rows):
    df = spark.createDataFrame([("b", 1, "power_mw", 125500), ("b", 1, "temperature", 60), ("b", 1, "fan_pct", None),
                                ("b", 1, "memory_used_bytes", 1 << 21), ("b", 2, "power_mw", None), ("b", 2, "temperature", 61)],
                               "boot_id string, tick bigint, metric string, raw bigint")
    assert rows(sensors.gpu_metrics(df), "tick", "gpu_power_w", "gpu_temp", "gpu_fan_pct", "gpu_mem_used_mb") == [
        (1, 125.5, 60.0, None, 2.0), (2, None, 61.0, None, None)]
    assert {r.metric for r in sensors.supported_metrics(df).collect()} == {"power_mw", "temperature", "memory_used_bytes"}


def test_text_helpers(spark):
    df = spark.createDataFrame([("  +1_000\t",), ("12",), ("1.5",), ("",), ("\x1c7",), ("_1",), ("9" * 30,), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(X.whole_number(F.col("t"))).collect()] == [1000, 12, None, None, 7, None, None, None]
    assert df.select(X.whole_number(F.col("t"), "decimal(38,0)")).collect()[6][0] == int("9" * 30)
    slugs = spark.createDataFrame([("Tctl",), ("Composite 0",), ("  S0-in  ",), ("Sensor 1 (edge)",), ("???",)], "t string").coalesce(1)
    assert [r[0] for r in slugs.select(X.slug(F.col("t"))).collect()] == ["tctl", "composite_0", "s0_in", "sensor_1_edge", ""]


def test_compute_is_not_repeated_below_a_filter(spark):
    df = X.compute(spark.createDataFrame([("a1",)], "t string"), n=F.regexp_extract("t", r"(\d)", 1)).where("n = '1'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and df.count() == 1


def test_sensor_catalogue_sorts_no_readings(spark, tmp_path, monkeypatch):
    """First readings are found over numbers by hashing; rows of later ticks are not grouped with their labels."""
    plans, kept = {}, sensors.settle
    monkeypatch.setattr(sensors, "settle", lambda df, purpose: plans.setdefault(
        purpose, df._jdf.queryExecution().executedPlan().toString()) and kept(df, purpose))
    rows = [(b, t, "k10temp", 0, "temp", 1, "input", "Tctl" if t == 5 else "late", 100 * t) for b in "ab" for t in range(5, 9)]
    rows += [("a", 6, "k10temp", 0, "temp", 3, "input", "Tccd1", 5), (None, 1, "k10temp", 0, "temp", 1, "input", "x", 1),
             ("a", None, "nvme", 0, "temp", 1, "input", "Composite", 1), ("b", 5, "nvme", 0, "temp", 1, "input", "Composite", None)]
    schema = "boot_id string, tick bigint, device string, instance int, channel string, idx int, suffix string, label string, raw bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "raw"))
    found = sensors.sensor_catalogue(spark.read.parquet(str(tmp_path / "raw")))
    assert {(r.boot_id, r.column) for r in found.collect()} == {("a", "k10temp_tctl"), ("b", "k10temp_tctl")}
    assert "SortAggregate" not in plans["began"] and "LeftSemi" in plans["sensors"]
