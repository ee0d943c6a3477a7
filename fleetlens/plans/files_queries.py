"""Registered queries: landed files, sensors, processes.

The file texts are put together from the events table; the SQL texts compute the
expected numbers from the same columns and parse nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators.ordered import lookup
from fleetlens.plans import fixtures as fx
from fleetlens.plans.fixtures import sql
from fleetlens.plans.registry import query
from fleetlens.sources import sensors
from fleetlens.sources import snapshots as S


def _text(column):
    return column.cast("string")


def landed(spark, sf_dir, path, content, *extra):
    """One file per event: boot_id, tick, path, content."""
    path = F.lit(path) if isinstance(path, str) else path
    return fx.base(spark, sf_dir).select(
        "boot_id", F.col("event_id").alias("tick"), F.col("ts_us").alias("mono_us"),
        path.alias("path"), content.alias("content"), *extra,
    )


@query("q_memory_used", sql("""
SELECT boot_id, event_id AS tick,
       CASE WHEN k % 7 = 0 THEN NULL ELSE (8000000 - k * 1000) / 1024.0::DOUBLE END AS mem_used_mb,
       CASE WHEN k % 5 = 0 THEN NULL ELSE (2000000 - user_id) / 1024.0::DOUBLE END AS swap_used_mb
FROM fx_base
"""))
def memory_used(spark, sf_dir):
    k = F.col("k")
    content = F.concat_ws(
        "\n",
        F.lit("MemTotal:        8000000 kB"), F.lit("MemFree: 12 kB"),
        F.when(k % 7 != 0, F.concat(F.lit("MemAvailable:   "), _text(k * 1000), F.lit(" kB"))),
        F.when(k % 5 != 0, F.lit("SwapTotal: 2000000 kB")),
        F.concat(F.lit("SwapFree: "), _text(F.col("user_id")), F.lit(" kB")),
    )
    return S.memory_used(landed(spark, sf_dir, "/proc/meminfo", content))


@query("q_loadavg", sql("""
SELECT boot_id, event_id AS tick, CASE WHEN k % 10 > 0 THEN k / 100.0::DOUBLE END AS load1 FROM fx_base
"""))
def loadavg(spark, sf_dir):
    k = F.col("k")
    number = F.concat(F.lit("0."), F.lpad(_text(k), 2, "0"), F.lit(" 0.40 0.30 2/345 6789\n"))
    content = F.when(k % 20 == 10, F.lit("n/a")).when(k % 20 == 0, F.lit(" \n")).otherwise(number)
    return S.load_average(landed(spark, sf_dir, "/proc/loadavg", content))


_CORES = (0, 1, 2, 3)


@query("q_cpu_freq", sql("""
SELECT boot_id, tick, avg(khz) / 1000.0::DOUBLE AS cpu_freq_avg FROM (
  SELECT boot_id, event_id AS tick, c.core,
         CASE WHEN user_id % 2 = 0 AND c.core < 2 AND (k % 6 <> 5 OR event_id = start) THEN 1000000 + k * 1000 * (c.core + 1)
              WHEN user_id % 2 = 1 THEN 2000000 + k * 1000 * (c.core + 1) END AS khz,
         user_id % 2 = 0 AND c.core < 2 OR user_id % 2 = 1 AS used
  FROM (SELECT *, min(event_id) OVER (PARTITION BY boot_id) AS start FROM fx_base) b,
       (VALUES (0), (1), (2), (3)) c(core)) x
WHERE used GROUP BY boot_id, tick
"""))
def cpu_freq(spark, sf_dir):
    """Even boots measure two of four cores, odd ones only know the set frequency.

    The first reading of a boot always works; later a core may fail.
    """
    rows = fx.base(spark, sf_dir)
    start = rows.groupBy("boot_id").agg(F.min("event_id").alias("start"))
    rows = lookup(rows, start, ["boot_id"], spread="event_id")
    works = (F.col("k") % 6 != 5) | (F.col("event_id") == F.col("start"))
    each = []
    for core in _CORES:
        bump = F.col("k") * 1000 * (core + 1)
        measured = (F.col("user_id") % 2 == 0) & F.lit(core < 2)
        each += [
            F.struct(
                F.lit(f"/sys/devices/system/cpu/cpu{core}/cpufreq/cpuinfo_avg_freq").alias("path"),
                F.when(measured & works, _text(F.lit(1000000) + bump)).alias("content"),
            ),
            F.struct(
                F.lit(f"/sys/devices/system/cpu/cpu{core}/cpufreq/scaling_cur_freq").alias("path"),
                _text(F.lit(2000000) + bump).alias("content"),
            ),
        ]
    files = rows.select(
        "boot_id", F.col("event_id").alias("tick"), F.inline(F.array(*each))
    )
    return S.cpu_frequency(files)


@query("q_psi", sql("""
SELECT boot_id, tick, max(CASE WHEN f = 'cpu' THEN v END) AS psi_cpu_some,
       max(CASE WHEN f = 'io' THEN v END) AS psi_io_some, max(CASE WHEN f = 'io' THEN w END) AS psi_io_full,
       max(CASE WHEN f = 'memory' THEN v END) AS psi_mem_some, max(CASE WHEN f = 'memory' THEN w END) AS psi_mem_full
FROM (SELECT boot_id, ts_ms // 600000 AS tick, CASE k % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'io' ELSE 'memory' END AS f,
             k / 100.0::DOUBLE AS v, CASE WHEN k % 4 > 0 THEN 0.5::DOUBLE END AS w FROM fx_base) x
GROUP BY boot_id, tick
"""))
def psi(spark, sf_dir):
    k = F.col("k")
    avg10 = F.concat(F.lit("0."), F.lpad(_text(k), 2, "0"))
    content = F.concat(
        F.lit("some avg10="), avg10, F.lit(" avg60=9.00 total=12\n"),
        F.when(k % 4 != 0, F.lit("full avg10=0.50 avg60=1.00 total=3\n")).otherwise(F.lit("full avg10=bad\n")),
    )
    path = F.concat(F.lit("/proc/pressure/"), fx.pick(k % 3, {0: "cpu", 1: "io"}, "memory"))
    files = fx.base(spark, sf_dir).select(
        "boot_id", F.expr("ts_ms div 600000").alias("tick"), path.alias("path"), content.alias("content")
    )
    return S.pressure(files)


@query("q_interrupt_totals", sql("""
SELECT e.boot_id, t.event_id AS tick, e.label, r.total
FROM fx_base t
JOIN (SELECT boot_id, label FROM reads JOIN (SELECT boot_id, min(event_id) AS tick FROM fx_base GROUP BY boot_id) f
      USING (boot_id, tick)) e USING (boot_id)
LEFT JOIN reads r ON r.boot_id = e.boot_id AND r.label = e.label AND r.tick = t.event_id
""", extra={"reads": """
SELECT boot_id, event_id AS tick, 'NMI' AS label, k * 4 AS total FROM fx_base WHERE k % 9 > 0
UNION ALL SELECT boot_id, event_id, 'ERR', user_id FROM fx_base WHERE k % 9 > 0
UNION ALL SELECT boot_id, event_id, 'MCE', k + 7 FROM fx_base WHERE k % 2 = 0 AND k % 9 > 0"""}))
def interrupt_totals(spark, sf_dir):
    """The file is unreadable at some ticks, and one row comes and goes."""
    k = F.col("k")
    content = F.concat_ws(
        "\n",
        F.lit("           CPU0       CPU1"),
        F.lit("  0:         33          0   IO-APIC    2-edge      timer"),
        F.concat(F.lit("NMI:  "), _text(k), F.lit("   "), _text(k * 3), F.lit("   Non-maskable interrupts")),
        F.concat(F.lit("ERR: "), _text(F.col("user_id"))),
        F.when(k % 2 == 0, F.concat(F.lit("MCE: "), _text(k), F.lit(" 7 Machine 5 checks"))),
    )
    return S.interrupt_totals(landed(spark, sf_dir, "/proc/interrupts", F.when(k % 9 > 0, content)))


@query("q_vmstat_oom", sql("""
SELECT boot_id, event_id AS tick, 'err_oom_kill' AS field, CASE WHEN k % 6 > 0 THEN k END AS raw FROM fx_base
"""))
def vmstat_oom(spark, sf_dir):
    k = F.col("k")
    content = F.concat(
        F.lit("nr_free_pages 5\noom_kill_other 9\n"),
        F.when(k % 6 != 0, F.concat(F.lit("oom_kill "), _text(k), F.lit("\n"))).otherwise(""),
        F.lit("pgfault 1\n"),
    )
    return S.oom_kills(landed(spark, sf_dir, "/proc/vmstat", content))


@query("q_named_counters", sql("""
SELECT boot_id, tick, 'err_aer_corr' AS field,
       CASE WHEN count(*) = count(v) THEN CAST(sum(v) AS BIGINT) END AS raw
FROM (SELECT boot_id, t.tick, r.v FROM (SELECT DISTINCT boot_id, tick FROM reads) t
      JOIN (SELECT DISTINCT boot_id, device FROM reads JOIN (
              SELECT boot_id, min(tick) AS tick FROM reads GROUP BY boot_id) f USING (boot_id, tick)) e USING (boot_id)
      LEFT JOIN reads r USING (boot_id, tick, device)) x
GROUP BY boot_id, tick
""", extra={"reads": """
SELECT boot_id, ts_ms // 600000 AS tick, user_id % 3 AS device,
       CASE WHEN arg_max(k, event_id) % 23 > 1 THEN arg_max(k, event_id) + 2 END AS v
FROM fx_base GROUP BY ALL"""}))
def named_counters(spark, sf_dir):
    """One error file per device and ten minutes; some are broken, empty or gone."""
    k = F.col("k")
    content = F.when(k % 23 == 0, F.lit("RxErr none\n")).when(k % 23 == 1, F.lit("\n")).otherwise(
        F.concat(F.lit("RxErr "), _text(k), F.lit("\nBadTLP: 2\n\nTOTAL_ERR_COR "), _text(k + 2), F.lit("\n"))
    )
    path = F.concat(F.lit("/sys/bus/pci/devices/"), _text(F.col("user_id") % 3), F.lit("/aer_dev_correctable"))
    files = fx.base(spark, sf_dir).groupBy(
        "boot_id", F.expr("ts_ms div 600000").alias("tick"), path.alias("path")
    ).agg(F.max_by("k", "event_id").alias("k")).select("boot_id", "tick", "path", content.alias("content"))
    field, pattern, skip = S.NAMED_COUNTERS[0]
    return S.named_counters(files, field, pattern, skip_totals=skip)


@query("q_energy_zones", sql("""
SELECT boot_id, zone, max_uj, concat(name, CASE WHEN nth > 1 THEN '_' || CAST(nth AS VARCHAR) ELSE '' END) AS "column"
FROM (SELECT *, row_number() OVER (PARTITION BY boot_id, name ORDER BY zone) AS nth FROM (
SELECT boot_id, zone, max_uj, concat('rapl_', CASE
    WHEN many AND sub IS NULL THEN concat('pkg', CAST(pkg AS VARCHAR))
    WHEN many THEN concat('pkg', CAST(pkg AS VARCHAR), '_sub', CAST(sub AS VARCHAR))
    WHEN sub IS NULL THEN 'pkg' ELSE concat('sub', CAST(sub AS VARCHAR)) END, '_watts') AS name
FROM (SELECT *, count(DISTINCT CASE WHEN sub IS NULL THEN pkg END) OVER (PARTITION BY boot_id) > 1 AS many
      FROM (SELECT boot_id, pkg, sub, concat('intel-rapl:', CAST(pkg AS VARCHAR), coalesce(':' || CAST(sub AS VARCHAR), '')) AS zone,
                   max(k) AS max_uj, arg_min(k % 11 > 0, event_id) AS readable
            FROM (SELECT concat(boot_id, '/', CAST(ts_ms // 86400000 AS VARCHAR)) AS boot_id, event_id, k,
                         CASE WHEN user_id % 3 = 0 THEN k % 2 ELSE 0 END AS pkg,
                         CASE WHEN event_type IN ('view', 'click') THEN length(event_type) END AS sub FROM fx_base) a
            GROUP BY boot_id, pkg, sub) b) c
WHERE readable AND max_uj > 0) d) e
"""))
def energy_zones(spark, sf_dir):
    """Zones of every machine day: one or two packages, two kinds of parts."""
    k, kind = F.col("k"), F.col("event_type")
    package = F.when(F.col("user_id") % 3 == 0, k % 2).otherwise(0)
    part = F.when(kind.isin("view", "click"), F.length(kind))
    boot = F.concat("boot_id", F.lit("/"), F.expr("ts_ms div 86400000").cast("string"))
    zone = F.concat(
        F.lit("intel-rapl:"), _text(package),
        F.when(part.isNotNull(), F.concat(F.lit(":"), _text(part))).otherwise(""),
    )
    name = F.when(part.isNull(), F.lit("package-0\n"))
    zones = fx.base(spark, sf_dir).groupBy(boot.alias("boot_id"), zone.alias("zone"), name.alias("zone_name")).agg(
        F.min_by(F.when(k % 11 != 0, k), "event_id").alias("energy_uj"), F.max("k").alias("max_uj")
    )
    return sensors.energy_zones(zones)


# Sensors of a boot: (device, instance, channel, idx, suffix, label, per-k value).
_SENSORS = (
    ("k10temp", 0, "temp", 1, "input", "Tctl", 250),
    ("k10temp", 0, "temp", 3, "input", "Tccd1", 125),
    ("gigabyte_wmi", 0, "temp", 2, "input", "Wrong label", 500),
    ("nvme", 0, "temp", 1, "input", "Composite", 100),
    ("nvme", 0, "temp", 2, "input", "Composite", 200),
    ("nvme", 1, "temp", 1, "input", None, 300),
    ("amdgpu", 0, "power", 1, "average", "PPT", None),
    ("amdgpu", 0, "power", 1, "input", "PPT", 1000000),
    ("amdgpu", 0, "in", 0, "input", "vddgfx", 8),
    ("amdgpu", 0, "fan", 1, "input", None, 16),
    ("amdgpu", 0, "freq", 1, "input", "sclk", 2000000),
    ("amdgpu", 0, "busy_pct", 0, "percent", None, 1),
    ("coretemp", 0, "temp", 1, "input", "Core 0", 64),
)
# What the presets make of them: column, per-k value in user units as (factor, scale).
_EXPECTED = (
    ("k10temp_tctl", 250, 1e-3), ("k10temp_tccd1", 125, 1e-3), ("gigabyte_temp2", 500, 1e-3),
    ("nvme_composite", 100, 1e-3), ("nvme_composite2", 200, 1e-3), ("nvme1_temp1", 300, 1e-3),
    ("amdgpu_ppt_w", 1000000, 1e-6), ("amdgpu_vddgfx_v", 8, 1e-3), ("amdgpu_fan1_rpm", 16, 1.0),
    ("amdgpu_sclk_mhz", 2000000, 1e-6), ("amdgpu_busy_pct", 1, 1.0),
)


def raw_sensors(spark, sf_dir):
    each = [
        F.struct(
            F.lit(device).alias("device"), F.lit(instance).alias("instance"), F.lit(channel).alias("channel"),
            F.lit(idx).alias("idx"), F.lit(suffix).alias("suffix"),
            F.lit(label).cast("string").alias("label"),
            (F.col("k") * F.lit(factor).cast("bigint")).alias("raw"),
        )
        for device, instance, channel, idx, suffix, label, factor in _SENSORS
    ]
    return fx.base(spark, sf_dir).select(
        "boot_id", F.col("event_id").alias("tick"), F.inline(F.array(*each))
    )


@query("q_sensor_channels", sql(" UNION ALL ".join(
    f"SELECT boot_id, event_id AS tick, '{column}' AS \"column\", (k * {factor}) * {scale:.6f}::DOUBLE AS value FROM fx_base"
    for column, factor, scale in _EXPECTED
)))
def sensor_channels(spark, sf_dir):
    raw = raw_sensors(spark, sf_dir)
    return sensors.sensor_values(raw, sensors.sensor_catalogue(raw))


@query("q_sensor_presets", sql(f"""
SELECT boot_id, c."column", c.scale FROM (SELECT DISTINCT boot_id FROM fx_base) b,
     (VALUES {', '.join(f"('{column}', {scale:.6f}::DOUBLE)" for column, _, scale in _EXPECTED)}) c("column", scale)
"""))
def sensor_presets(spark, sf_dir):
    return sensors.sensor_catalogue(raw_sensors(spark, sf_dir)).select("boot_id", "column", "scale")


@query("q_gpu_metrics", sql("""
SELECT boot_id, event_id AS tick, (k + 30)::DOUBLE AS gpu_temp, k * 1500 / 1000.0::DOUBLE AS gpu_power_w,
       1800.0::DOUBLE AS gpu_clock_sm, 7000.0::DOUBLE AS gpu_clock_mem, k::DOUBLE AS gpu_util,
       CASE WHEN k % 3 > 0 THEN k::DOUBLE END AS gpu_mem_util, CAST(NULL AS DOUBLE) AS gpu_fan_pct,
       (k * 1048576 + 524288) / 1048576.0::DOUBLE AS gpu_mem_used_mb, (k % 2 * 4)::DOUBLE AS gpu_throttle_mask
FROM fx_base
"""))
def gpu_metrics(spark, sf_dir):
    k = F.col("k")
    readings = {
        "temperature": k + 30, "power_mw": k * 1500, "clock_sm": F.lit(1800), "clock_mem": F.lit(7000),
        "util_gpu": k, "util_memory": F.when(k % 3 > 0, k),
        "memory_used_bytes": k * 1048576 + 524288, "throttle_mask": k % 2 * 4,
    }
    rows = fx.base(spark, sf_dir).select(
        "boot_id", F.col("event_id").alias("tick"),
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), v.cast("bigint").alias("raw")) for m, v in readings.items()
        ])),
    )
    return sensors.gpu_metrics(rows)


@query("q_proc_stat_parse", sql("""
SELECT boot_id, event_id AS tick, ts_us AS mono_us, user_id AS pid,
       CASE WHEN k % 8 > 1 THEN concat('Web (', CAST(k AS VARCHAR), ') x') END AS comm,
       CASE WHEN k % 8 > 1 THEN k * 3 END AS jiffies, CASE WHEN k % 8 > 1 THEN 5000 + user_id END AS starttime
FROM fx_base
"""))
def proc_stat_parse(spark, sf_dir):
    k = F.col("k")
    path = F.concat(F.lit("/proc/"), _text(F.col("user_id")), F.lit("/stat"))
    content = F.concat(
        _text(F.col("user_id")), F.lit(" (Web ("), _text(k), F.lit(") x) S 1 1 1 0 -1 0 0 0 0 0 "),
        _text(k), F.lit(" "), _text(k * 2), F.lit(" 0 0 20 0 1 0 "),
        F.when(k % 8 == 1, F.lit("soon")).otherwise(_text(F.col("user_id") + 5000)), F.lit(" 999 5\n"),
    )
    return S.processes(landed(spark, sf_dir, path, F.when(k % 8 != 0, content)))


@query("q_window_parse", sql("""
SELECT event_id, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN concat('app', CAST(k AS VARCHAR), '|t "', event_type, '"') END AS active_window
FROM fx_base
"""))
def window_parse(spark, sf_dir):
    k = F.col("k")
    good = F.concat(
        F.lit('{"class":"app'), _text(k), F.lit('","title":"t \\"'), F.col("event_type"), F.lit('\\"","pid":4}')
    )
    reply = F.when(k % 6 == 0, F.lit("{}")).when(k % 6 == 1, good).when(
        k % 6 == 2, F.lit('{"class":5,"title":"x"}')
    ).when(k % 6 == 3, F.lit('["class"]')).when(k % 6 == 4, F.lit('{"class":"a"}'))
    return fx.base(spark, sf_dir).select("event_id", S.active_window(reply).alias("active_window"))
