"""Registered queries: counters, power, utilisation, context, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import context as C
from fleetlens.operators import coverage
from fleetlens.operators import derive as D
from fleetlens.plans import fixtures as fx
from fleetlens.plans.fixtures import sql
from fleetlens.plans.registry import query
from fleetlens.session import settle
from fleetlens.sources import snapshots as S
from fleetlens.sources.registry import MetricSource, SourceRegistry

_SEVERITY = {c.field: c.severity for c in R.COUNTERS}
_NOTE = {c.field: c.note for c in R.COUNTERS}
# Every tick of a boot, with the counters readable at its first one.
_DELTA = {
    "began": "SELECT boot_id, min(event_id) AS tick FROM fx_base GROUP BY boot_id",
    "watched": "SELECT c.boot_id, c.field FROM fx_counters c JOIN began USING (boot_id, tick) WHERE raw >= 0",
    "d": """
SELECT boot_id, field, tick, raw, CASE WHEN raw >= before THEN CAST(raw - before AS DOUBLE) END AS delta
FROM (SELECT w.boot_id, w.field, t.event_id AS tick, c.raw,
             lag(c.raw) OVER (PARTITION BY w.boot_id, w.field ORDER BY t.event_id) AS before
      FROM fx_base t JOIN watched w USING (boot_id)
      LEFT JOIN fx_counters c ON c.boot_id = w.boot_id AND c.field = w.field AND c.tick = t.event_id) x""",
}


def watched_counters(spark, sf_dir):
    return D.monitored_series(fx.counters(spark, sf_dir), ticks=fx.ticks(spark, sf_dir))


@query("q_counter_delta", sql("SELECT * FROM d", "fx_counters", extra=_DELTA))
def counter_delta(spark, sf_dir):
    return D.counter_delta(watched_counters(spark, sf_dir))


@query("q_counter_events", sql("""
SELECT boot_id, tick, CASE field WHEN 'err_nmi' THEN 'nmi' ELSE 'mce' END AS kind,
       CASE field WHEN 'err_nmi' THEN 'error' ELSE '""" + _SEVERITY["err_mce"] + """' END AS severity,
       concat(field, ' +', CAST(CAST(delta AS BIGINT) AS VARCHAR), ' (total ', CAST(raw AS VARCHAR),
              ') — ', CASE field WHEN 'err_nmi' THEN '""" + _NOTE["err_nmi"] + "' ELSE '" + _NOTE["err_mce"] + """' END) AS message
FROM d WHERE delta > 0
""", "fx_counters", extra=_DELTA))
def counter_events(spark, sf_dir):
    return D.counter_events(D.counter_delta(watched_counters(spark, sf_dir))).drop("field", "source")


_FIELDS = ("err_nmi", "err_mce", "err_ecc_ce", "err_oom_kill", "err_disk_io")
_MANY = """
SELECT boot_id, event_id AS tick, f.field, CASE WHEN (k + f.n) % 5 > 0 THEN k + 7 * f.n - 20 END AS raw
FROM fx_base, (VALUES """ + ", ".join(f"('{f}', {n})" for n, f in enumerate(_FIELDS)) + """) f(field, n)
WHERE (k + f.n) % 6 > 0"""


def many_counters(spark, sf_dir):
    """Five counters per boot, some missing, unreadable or negative at the boot's first tick."""
    k = F.col("k")
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), ((k + n) % 6 > 0).alias("seen"),
                 F.when((k + n) % 5 > 0, k + 7 * n - 20).alias("raw"))
        for n, f in enumerate(_FIELDS)
    ])).alias("f")
    rows = fx.base(spark, sf_dir).select("boot_id", F.col("event_id").alias("tick"), each)
    return rows.where("f.seen").select("boot_id", "tick", "f.field", "f.raw")


_FIRST = {"many": _MANY, "began": """
SELECT m.* FROM many m JOIN (SELECT boot_id, min(event_id) AS tick FROM fx_base GROUP BY boot_id) f USING (boot_id, tick)"""}


@query("q_counter_baseline", sql("""
SELECT boot_id, field, tick, CASE field WHEN 'err_nmi' THEN 'nmi' WHEN 'err_mce' THEN 'mce'
         WHEN 'err_ecc_ce' THEN 'ecc_ce' WHEN 'err_oom_kill' THEN 'oom' ELSE 'block_error' END AS kind,
       'warning' AS severity, concat(field, '=', CAST(raw AS VARCHAR), ' when collection started') AS message
FROM began WHERE raw > 0
""", extra=_FIRST))
def counter_baseline(spark, sf_dir):
    found = D.baseline_events(many_counters(spark, sf_dir), ticks=fx.ticks(spark, sf_dir))
    return found.drop("source")


@query("q_counter_coverage", sql(f"""
SELECT b.boot_id, c.field, coalesce(w.raw >= 0, FALSE) AS active
FROM (SELECT DISTINCT boot_id FROM fx_base) b,
     (VALUES {', '.join(f"('{c.field}')" for c in R.COUNTERS)}) c(field)
LEFT JOIN began w ON w.boot_id = b.boot_id AND w.field = c.field
""", extra=_FIRST))
def counter_coverage(spark, sf_dir):
    return coverage.counter_coverage(many_counters(spark, sf_dir), ticks=fx.ticks(spark, sf_dir))


# Boot 7 leaves no counter row, boot 4 nothing at all but its ticks; sources may have no value at the
# boot's first tick, or come later.
_SOURCES = ("rapl", "psi", "gpu", "battery")


@query("q_machine_coverage", sql(f"""
SELECT b.boot_id, 'counter' AS part, c.field AS name, coalesce(w.raw >= 0, FALSE) AS active
FROM boots b, (VALUES {', '.join(f"('{c.field}')" for c in R.COUNTERS)}) c(field)
LEFT JOIN began w ON w.boot_id = b.boot_id AND w.field = c.field AND b.boot_id NOT IN ('boot-4', 'boot-7')
UNION ALL
SELECT b.boot_id, 'source', s.source, coalesce(f.k % 3 <> s.n AND (f.k + s.n) % 4 > 0 AND b.boot_id <> 'boot-4' AND s.n < 3, FALSE)
FROM boots b, (VALUES {', '.join(f"('{s}', {n})" for n, s in enumerate(_SOURCES))}) s(source, n)
JOIN first f ON f.boot_id = b.boot_id
""", extra={
    **_FIRST, "boots": "SELECT DISTINCT boot_id FROM fx_base",
    "first": "SELECT b.* FROM fx_base b JOIN (SELECT boot_id, min(event_id) AS event_id FROM fx_base GROUP BY boot_id) f USING (boot_id, event_id)",
}))
def machine_coverage(spark, sf_dir):
    base = fx.base(spark, sf_dir).where("boot_id <> 'boot-4'")
    each = F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(n).alias("n")) for n, s in enumerate(_SOURCES[:3])
    ])).alias("s")
    rows = base.select("boot_id", F.col("event_id").alias("tick"), "k", each)
    readings = rows.where((F.col("k") + F.col("s.n")) % 4 > 0).select(
        "boot_id", "tick", "s.source", F.when(F.col("k") % 3 != F.col("s.n"), F.col("k")).alias("value")
    )
    counters = many_counters(spark, sf_dir).where("boot_id NOT IN ('boot-4', 'boot-7')")
    return coverage.machine_coverage(readings, counters, fx.ticks(spark, sf_dir), _SOURCES)


@query("q_rapl_watts", sql("""
SELECT boot_id, tick, CASE WHEN watts <= 1000 THEN watts END AS watts FROM (
  SELECT boot_id, tick, CASE WHEN mono_us > m THEN
    CAST(CASE WHEN energy_uj < e THEN energy_uj - e + max_uj ELSE energy_uj - e END AS DOUBLE)
    / CAST(mono_us - m AS DOUBLE) END AS watts
  FROM (SELECT *, lag(energy_uj) OVER w AS e, lag(mono_us) OVER w AS m FROM fx_energy
        WINDOW w AS (PARTITION BY boot_id, zone ORDER BY tick)) x) y
""", "fx_energy"))
def rapl_watts(spark, sf_dir):
    return D.watts(fx.energy(spark, sf_dir)).select("boot_id", "tick", "watts")


# Time counters per boot: eight running sums; cpu1 is missing in every 13th snapshot.
_WEIGHTS = (3, 1, 2, 40, 5, 1, 1, 1)


def cpu_snapshots(spark, sf_dir):
    rows = fx.base(spark, sf_dir).select("boot_id", "event_id", "k")
    rows = fx.running_total(rows, ["boot_id"], ["event_id"], F.col("k"), into="busy")
    rows = fx.running_total(rows, ["boot_id"], ["event_id"], F.col("k") % 7 + 1, into="rest")

    def line(name: str, busy_first: int):
        counters = [
            (F.col("busy") * (w + busy_first) if i in (0, 2) else F.col("rest") * w).cast("string")
            for i, w in enumerate(_WEIGHTS)
        ]
        return F.concat_ws(" ", F.lit(name), *counters, F.lit("7 7"))

    content = F.concat_ws(
        "\n", line("cpu ", 0), line("cpu0", 1),
        F.when(F.col("k") % 13 != 0, line("cpu1", 2)), F.lit("intr 5 5 5"), F.lit("cpu9 1 2 -3 4 5"),
    )
    return rows.select(
        "boot_id", F.col("event_id").alias("tick"), F.lit(0).cast("bigint").alias("mono_us"),
        F.lit("/proc/stat").alias("path"), content.alias("content"), "k",
    )


def _counters_sql(busy_first: int) -> str:
    return " + ".join(
        f"busy * {w + busy_first}" if i in (0, 2) else f"rest * {w}" for i, w in enumerate(_WEIGHTS)
    )


_CPU = {
    "sums": """
SELECT boot_id, event_id AS tick, k, CAST(sum(k) OVER w AS BIGINT) AS busy, CAST(sum(k % 7 + 1) OVER w AS BIGINT) AS rest
FROM fx_base WINDOW w AS (PARTITION BY boot_id ORDER BY event_id)""",
    "cpus": " UNION ALL ".join(
        f"SELECT boot_id, tick, k, '{name}' AS cpu, CAST({_counters_sql(n)} AS BIGINT) AS total, "
        f"CAST(rest * 45 AS BIGINT) AS idle FROM sums" + (" WHERE k % 13 <> 0" if name == "cpu1" else "")
        for n, name in enumerate(("cpu", "cpu0", "cpu1"))
    ),
}


@query("q_cpu_stat_parse", sql("""
SELECT boot_id, tick, cpu, 8 AS n, total FROM cpus
""", extra=_CPU))
def cpu_stat_parse(spark, sf_dir):
    total = F.aggregate("counters", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return S.cpu_stat_rows(cpu_snapshots(spark, sf_dir)).select(
        "boot_id", "tick", "cpu", F.size("counters").alias("n"), total.alias("total")
    )


@query("q_cpu_util", sql("""
SELECT t.boot_id, t.tick, c.cpu,
  CASE WHEN n.total - p.total > 0
       THEN 1.0::DOUBLE - CAST(n.idle - p.idle AS DOUBLE) / CAST(n.total - p.total AS DOUBLE) END AS util
FROM (SELECT *, lag(tick) OVER (PARTITION BY boot_id ORDER BY tick) AS before FROM sums) t
JOIN (SELECT boot_id, cpu FROM cpus JOIN (SELECT boot_id, min(tick) AS tick FROM sums GROUP BY boot_id) f
      USING (boot_id, tick)) c ON c.boot_id = t.boot_id
LEFT JOIN cpus n ON n.boot_id = t.boot_id AND n.tick = t.tick AND n.cpu = c.cpu
LEFT JOIN cpus p ON p.boot_id = t.boot_id AND p.tick = t.before AND p.cpu = c.cpu
""", extra=_CPU))
def cpu_util(spark, sf_dir):
    """Files are parsed once; the utilisation reads the parsed counters."""
    return D.cpu_utilisation(settle(S.cpu_stat(cpu_snapshots(spark, sf_dir)), "cpu"))


@query("q_strict_sum", sql("""
SELECT boot_id, tick, field, CASE WHEN count(*) = count(*) FILTER (v >= 0) THEN CAST(sum(v) AS BIGINT) END AS raw
FROM (SELECT boot_id, t.tick, e.field, r.v FROM (SELECT DISTINCT boot_id, tick FROM reads) t
      JOIN (SELECT DISTINCT boot_id, field, device FROM reads JOIN (
              SELECT boot_id, min(tick) AS tick FROM reads GROUP BY boot_id) f USING (boot_id, tick)) e USING (boot_id)
      LEFT JOIN reads r USING (boot_id, tick, field, device)) x
GROUP BY boot_id, tick, field
""", extra={"reads": """
SELECT boot_id, ts_ms // 3600000 AS tick, CASE WHEN event_type = 'view' THEN 'err_disk_io' ELSE 'err_ecc_ce' END AS field,
       k % 3 AS device, CASE WHEN arg_max(k, event_id) % 17 = 0 THEN NULL WHEN arg_max(k, event_id) % 19 = 0 THEN -1
       ELSE arg_max(k, event_id) END AS v
FROM fx_base GROUP BY ALL"""}))
def strict_sum(spark, sf_dir):
    """One integer file per device and hour; some are unreadable, negative or gone."""
    k = F.col("k")
    device = (k % 3).cast("string")
    path = F.when(
        F.col("event_type") == "view", F.concat(F.lit("/sys/block/sd"), device, F.lit("/device/ioerr_cnt"))
    ).otherwise(F.concat(F.lit("/sys/devices/system/edac/mc/mc"), device, F.lit("/ce_count")))
    content = F.when(k % 17 == 0, F.lit("n/a")).when(
        k % 19 == 0, F.lit("-1\n")
    ).otherwise(F.concat(k.cast("string"), F.lit("\n")))
    files = fx.base(spark, sf_dir).groupBy(
        "boot_id", F.expr("ts_ms div 3600000").alias("tick"), path.alias("path")
    ).agg(F.max_by("k", "event_id").alias("k")).select("boot_id", "tick", "path", content.alias("content"))
    return S.integer_counters(files)


# Two controllers; the second has no row at all at some ticks.
_STATE = """
SELECT boot_id, event_id AS tick, d.device, CASE WHEN d.device = 'nvme1' AND k % 7 = 2 THEN 'absent'
  ELSE CASE (k + d.n) % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'live' WHEN 2 THEN 'resetting' WHEN 3 THEN 'absent' ELSE 'dead' END
  END AS state
FROM fx_base, (VALUES ('nvme0', 0), ('nvme1', 1)) d(device, n)
WHERE d.device = 'nvme0' OR boot_id IN (
  SELECT boot_id FROM fx_base JOIN (SELECT min(event_id) AS event_id FROM fx_base GROUP BY boot_id) f USING (event_id)
  WHERE k % 7 <> 2)"""


@query("q_nvme_state", sql("""
SELECT boot_id, device, tick, CASE WHEN state = 'live' THEN 'warning' ELSE 'error' END AS severity,
       concat(device, ': controller state ', before, ' -> ', state) AS message, err_nvme_state
FROM (SELECT *, lag(state) OVER (PARTITION BY boot_id, device ORDER BY tick) AS before,
             CAST(count(*) FILTER (state <> 'live') OVER (PARTITION BY boot_id, tick) AS DOUBLE) AS err_nvme_state
      FROM states) x
WHERE before <> state
""", extra={"states": _STATE}))
def nvme_state(spark, sf_dir):
    k = F.col("k")
    each = F.explode(F.array(*[
        F.struct(F.lit(device).alias("device"),
                 fx.pick((k + n) % 5, {0: "live", 1: "live\n", 2: "resetting", 4: "dead"}).alias("state"))
        for n, device in enumerate(("nvme0", "nvme1"))
    ])).alias("d")
    states = fx.base(spark, sf_dir).select("boot_id", F.col("event_id").alias("tick"), "k", each).where(
        "d.device = 'nvme0' OR k % 7 <> 2"
    ).select("boot_id", "tick", "d.device", "d.state")
    ticks = fx.ticks(spark, sf_dir)
    degraded = D.degraded_controllers(states, ticks)
    return D.state_changes(states, ticks).join(degraded, ["boot_id", "tick"]).drop("source", "kind")


@query("q_failure_streak", sql("""
SELECT boot_id, 'sensors' AS message, min(tick) AS tick FROM (
  SELECT boot_id, tick, ok, row_number() OVER (PARTITION BY boot_id, run, ok ORDER BY tick) AS nth
  FROM (SELECT boot_id, event_id AS tick, event_type <> 'error' AS ok,
               sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY boot_id ORDER BY event_id) AS run
        FROM fx_base) a) b
WHERE NOT ok AND nth = 3 GROUP BY boot_id
"""))
def failure_streak(spark, sf_dir):
    found = D.failure_events(D.reader_failures(fx.polls(spark, sf_dir)))
    return found.select("boot_id", "message", "tick")


_TOP = """
SELECT s.boot_id, s.tick, s.n_procs, max(pct) AS top_proc_cpu,
       CASE WHEN max(pct) > 0 THEN arg_max(comm, struct_pack(a := pct, b := -pid)) END AS top_proc_name
FROM (SELECT boot_id, tick, count(*) AS n_procs, max(mono_us) AS mono_us,
             lag(tick) OVER w AS before, max(mono_us) - lag(max(mono_us)) OVER w AS elapsed
      FROM fx_procs GROUP BY boot_id, tick WINDOW w AS (PARTITION BY boot_id ORDER BY tick)) s
LEFT JOIN (
  SELECT n.boot_id, n.tick, n.pid, n.comm, p.tick AS before, n.jiffies - p.jiffies AS used
  FROM fx_procs n JOIN fx_procs p USING (boot_id, pid, starttime) WHERE n.jiffies >= p.jiffies AND p.tick < n.tick
) u ON u.boot_id = s.boot_id AND u.tick = s.tick AND u.before = s.before AND s.elapsed > 0,
LATERAL (SELECT u.used / 100.0::DOUBLE / (s.elapsed / 1e6::DOUBLE) * 100.0::DOUBLE AS pct) l
GROUP BY s.boot_id, s.tick, s.n_procs"""


@query("q_top_process", sql(_TOP, "fx_procs"))
def top_process(spark, sf_dir):
    return C.top_process(fx.procs(spark, sf_dir))


@query("q_context_flags", sql("""
SELECT sample_id, g AS is_gaming,
       CASE WHEN busy IS NULL THEN NULL WHEN busy = 0 OR g = 1 THEN 0.0 WHEN g = 0 THEN 1.0 END::DOUBLE AS is_compositing
FROM (SELECT s.sample_id, CASE WHEN b.k % 4 = 0 THEN NULL ELSE b.k % 3 END AS busy,
             CASE WHEN s.active_window IS NULL THEN NULL
                  WHEN regexp_matches(lower(s.active_window), 'steam_app|gamescope|lutris|heroic|bottles|wine|proton|minecraft|stalker')
                  THEN 1.0 ELSE 0.0 END::DOUBLE AS g
      FROM fx_samples s JOIN fx_base b ON b.event_id = s.sample_id) x
""", "fx_samples"))
def context_flags(spark, sf_dir):
    window = fx.pick(F.col("event_type"), {"purchase": "Steam_App_42|Game", "view": "kitty|shell", "signup": ""})
    busy = F.when(F.col("k") % 4 != 0, F.col("k") % 3)
    gaming = C.is_gaming(window)
    return fx.base(spark, sf_dir).select(
        F.col("event_id").alias("sample_id"), gaming.alias("is_gaming"),
        C.is_compositing(busy, gaming).alias("is_compositing"),
    )


@query("q_asof_context", sql("""
SELECT boot_id, id, ts, CASE WHEN polled IS NULL THEN NULL ELSE nullif(polled, '<none>') END AS active_window FROM (
  SELECT boot_id, id, ts, kind, last_value(poll IGNORE NULLS) OVER (
      PARTITION BY boot_id ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING) AS polled
  FROM (SELECT boot_id, event_id AS id, ts_ms // 60000 * 60000 AS ts,
               CASE event_type WHEN 'purchase' THEN 'steam_app_42|game' WHEN 'view' THEN '<none>' WHEN 'signup' THEN '' END AS poll,
               CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS kind
        FROM fx_base WHERE event_type <> 'error') p) x
WHERE kind = 1
"""))
def asof_context(spark, sf_dir):
    """Clicks are ticks; views are polls that failed and hide the poll before."""
    rows = fx.base(spark, sf_dir).select(
        "boot_id", F.col("event_id").alias("id"), fx.minute_of("ts_ms").alias("ts"), "event_type",
        fx.pick(F.col("event_type"), {"purchase": "steam_app_42|game", "signup": ""}).alias("active_window"),
    )
    ticks = rows.where("event_type = 'click'").select("boot_id", "id", "ts")
    seen = rows.where("event_type in ('purchase', 'view', 'signup')").drop("event_type")
    return C.as_of_context(ticks, seen, width=fx.HOUR)


@query("q_tick_pivot", sql("""
SELECT boot_id, event_id AS tick, ts_ms AS ts, CASE WHEN k % 7 > 0 THEN value END AS load1,
       CASE WHEN event_type = 'view' THEN k::DOUBLE END AS fan_rpm,
       CASE WHEN event_type = 'click' THEN boot_id END AS note
FROM fx_base
"""))
def tick_pivot(spark, sf_dir):
    """Three registered sources merged into one wide row per tick."""
    raw = fx.base(spark, sf_dir).withColumn("tick", F.col("event_id"))
    registry = SourceRegistry()
    registry.register(MetricSource("load", ["load1"], lambda r: r.select(
        "boot_id", "tick", F.when(F.col("k") % 7 > 0, F.col("value")).otherwise(float("nan")).alias("load1"),
        F.lit(1).alias("undeclared"),
    )))
    registry.register(MetricSource("fan", ["fan_rpm"], lambda r: r.where("event_type = 'view'").select(
        "boot_id", "tick", F.col("k").alias("fan_rpm"),
    )))
    registry.register(MetricSource("notes", ["note"], lambda r: r.where("event_type = 'click'").select(
        "boot_id", "tick", F.col("boot_id").alias("note"),
    ), text_fields=["note"]))
    spine = raw.select("boot_id", "tick", F.col("ts_ms").alias("ts"))
    return registry.assemble(raw, spine)


@query("q_source_breaker", sql("""
SELECT b.boot_id, event_id AS tick, ts_ms AS ts, CASE WHEN f.tick IS NULL OR event_id <= f.tick THEN value END AS load1,
       k::DOUBLE AS fan_rpm, CAST(NULL AS DOUBLE) AS volts
FROM fx_base b LEFT JOIN (
  SELECT boot_id, min(tick) AS tick FROM (
    SELECT boot_id, tick, ok, row_number() OVER (PARTITION BY boot_id, run, ok ORDER BY tick) AS nth
    FROM (SELECT boot_id, event_id AS tick, event_type <> 'error' AS ok,
                 sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY boot_id ORDER BY event_id) AS run
          FROM fx_base) a) c
  WHERE NOT ok AND nth = 3 GROUP BY boot_id) f USING (boot_id)
"""))
def source_breaker(spark, sf_dir):
    """One source fails three times in a row and goes off; one cannot be planned at all."""
    raw = fx.base(spark, sf_dir).withColumn("tick", F.col("event_id"))
    registry = SourceRegistry()
    registry.register(MetricSource("load", ["load1"], lambda r: r.select("boot_id", "tick", F.col("value").alias("load1"))))
    registry.register(MetricSource("fan", ["fan_rpm"], lambda r: r.select("boot_id", "tick", F.col("k").alias("fan_rpm"))))
    registry.register(MetricSource("broken", ["volts"], lambda r: r.select("boot_id", "tick", "no_such_column")))
    polls = fx.polls(spark, sf_dir).withColumn("source", F.lit("load"))
    return registry.assemble(raw, raw.select("boot_id", "tick", F.col("ts_ms").alias("ts")), polls=polls)
