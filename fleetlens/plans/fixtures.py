"""Telemetry tables derived from the given `events` table, for the registered queries.

Each fixture exists twice: as a DataFrame here and as SQL text in `CTES`, written
for another engine. Running sums use the chunked operators, so a fixture spreads
over the cluster as far as the query that reads it. Fixtures with running sums are
written once, like the landed tables they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import compute
from fleetlens.operators.ordered import running_total
from fleetlens.session import settle, spread

MINUTE, HOUR = 60_000, 3_600_000
EPOCH_MS = 1_704_067_200_000
MAX_UJ = 262_143_328_850

#: Kernel log texts of the fixtures: one for every kind of fault, then an unlisted Xid, an unknown
#: trouble and a harmless text at error level. What is beyond the list is everyday noise.
KERNEL_TEXTS = (
    "core 4: processor context corrupt, giving up on bank 2",
    "machine check events logged by the poller",
    "GHES: firmware reports an error in block 7",
    "EDAC skx MC2: UE row 11 channel 0 lost",
    "EDAC skx MC2: CE row 11 channel 0 repaired",
    "microcode: revision mismatch on socket 1",
    "System halted after the last resort",
    "Oops: 0002 in worker",
    "traps: double fault in interrupt entry",
    "NMI watchdog: CPU 12 locked up",
    "soft lockup - CPU#9 stuck in copy loop",
    "rcu_sched detected stalls on processors",
    "task mover:88 blocked for more than 240 seconds",
    "Dazed and confused, but going on",
    "viewer[55]: segfault at 8 ip 0 sp 0",
    "batchjob invoked oom-killer: order=2",
    "page allocation failure: order:9",
    "NVRM: Xid (PCI:0000:41:00): 48, pid=77",
    "i915: GPU hang on the render engine",
    "render ring gfx_0 timeout, signaled seq 5",
    "GPU ECC error counted in bank 3",
    "gpu 2 thermal throttling engaged",
    "atomic update failed on pipe B",
    "nvme3: controller is down",
    "ata7: hard resetting link",
    "critical medium error near sector 4096",
    "F2FS: checkpoint error in segment 12",
    "SMART attribute 197 above threshold",
    "AER: uncorrected error on root port",
    "PCIe bus error: severity=corrected",
    "pcieport 0000:80:03.0: link is down",
    "usb 4-2: unable to enumerate the device",
    "package temperature above threshold on node 1",
    "Undervoltage detected on rail 5V",
    "ACPI exception in method _Q11",
    "failed to load firmware blob rev 3",
    "freezing of tasks failed after 20 s",
    "netdev watchdog: port 2: transmit queue 4 timed out",
    "NVRM: Xid (PCI:0000:41:00): 250, pid=78",
    "sprocket 3 lost its chain",
    "SGX disabled by BIOS",
)
EVERYDAY = "usb 2-5: new device found"
_KERNEL_SQL = "CASE k % 45 " + " ".join(
    f"WHEN {i} THEN '{text}'" for i, text in enumerate(KERNEL_TEXTS)
) + f" ELSE '{EVERYDAY}' END"

CTES: dict[str, str] = {
    "fx_base": """
SELECT event_id, user_id, event_type, value,
       CAST(props->>'$.k' AS BIGINT) AS k,
       epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) AS ts_us,
       concat('boot-', CAST(user_id % 20 AS VARCHAR)) AS boot_id
FROM events""",
    "fx_samples": """
SELECT event_id AS sample_id, ts_ms // 60000 * 60000 AS ts, boot_id,
       CASE WHEN k % 7 = 0 THEN NULL ELSE value / 500.0 END AS cpu_util,
       CASE WHEN event_type = 'error' THEN NULL ELSE 30 + value / 10.0 END AS gpu_temp,
       CASE event_type WHEN 'purchase' THEN 'steam_app_42|game'
                       WHEN 'view' THEN 'kitty|shell' WHEN 'signup' THEN '' END AS active_window
FROM fx_base""",
    "fx_labels": """
SELECT event_id AS id, boot_id, ts_ms // 60000 * 60000 AS ts_start,
       CASE WHEN event_id = max(event_id) OVER (PARTITION BY boot_id) THEN NULL
            ELSE ts_ms // 60000 * 60000 + (k % 5) * 3600000 END AS ts_end,
       CASE k % 6 WHEN 0 THEN 'normal' WHEN 1 THEN 'fan_curve_low' WHEN 2 THEN 'airflow_blocked'
                  WHEN 3 THEN 'oc_unstable' WHEN 4 THEN 'stress_ng' ELSE 'gaming' END AS label,
       CASE WHEN k % 3 = 0 THEN NULL ELSE concat('été "', CAST(k AS VARCHAR), '"') END AS notes
FROM fx_base WHERE event_type = 'signup'""",
    "fx_kmsg_raw": f"""
SELECT boot_id, event_id, ts_ms // 864000000 AS tick, k, ts_ms, {_KERNEL_SQL} AS body,
       CAST(k % 8 AS INTEGER) AS level
FROM fx_base""",
    "fx_counters": """
SELECT boot_id, event_id AS tick, f.field, CASE WHEN k % f.bad = 0 THEN NULL ELSE total % f.top END AS raw
FROM (SELECT *, CAST(sum(CASE WHEN k % 4 = 0 THEN k ELSE 0 END) OVER (PARTITION BY boot_id ORDER BY event_id) AS BIGINT) AS total
      FROM fx_base) t, (VALUES ('err_nmi', 11, 13, 500), ('err_mce', 9, 7, 300)) f(field, bad, gone, top)
WHERE k % f.gone <> 3""",
    "fx_energy": """
SELECT boot_id, event_id AS tick, 'pkg' AS zone, ts_us AS mono_us,
       CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT) * 1000000)
         OVER (PARTITION BY boot_id ORDER BY event_id) % 262143328850 AS BIGINT) AS energy_uj,
       262143328850 AS max_uj
FROM fx_base""",
    "fx_procs": """
SELECT boot_id, tick, max(mono_us) OVER (PARTITION BY boot_id, tick) AS mono_us, pid,
       concat('proc-', CAST(pid % 7 AS VARCHAR)) AS comm, jiffies, pid + tick // 200 AS starttime
FROM (SELECT boot_id, ts_ms // 43200000 AS tick, user_id AS pid, max(ts_us) AS mono_us, max(j) AS jiffies
      FROM (SELECT *, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT))
              OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS j FROM fx_base) a
      GROUP BY boot_id, ts_ms // 43200000, user_id) b""",
}
_ORDER = list(CTES)


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """A query text with the fixtures it needs in front."""
    used = [n for n in _ORDER if n == "fx_base" or n in names]
    parts = [f"{n} AS ({CTES[n].strip()})" for n in used]
    parts += [f"{n} AS ({text.strip()})" for n, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    read = compute(
        events.select("event_id", "user_id", "event_type", "value", "ts", "props"),
        k=F.get_json_object("props", "$.k").cast("bigint"),
        ts_us=F.unix_micros(F.col("ts").cast("timestamp")),
    )
    return read.select(
        "event_id", "user_id", "event_type", "value", "k",
        F.expr("ts_us div 1000").alias("ts_ms"),
        "ts_us",
        F.concat(F.lit("boot-"), (F.col("user_id") % 20).cast("string")).alias("boot_id"),
    )


def pick(selector: Column, values: dict, default=None) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(selector == key, F.lit(value)) if out is None else out.when(
            selector == key, F.lit(value)
        )
    return out if default is None else out.otherwise(F.lit(default))


def minute_of(ms: str) -> Column:
    return F.expr(f"`{ms}` div {MINUTE} * {MINUTE}")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    return base(spark, sf_dir).select(
        F.col("event_id").alias("sample_id"),
        minute_of("ts_ms").alias("ts"),
        "boot_id",
        F.when(k % 7 != 0, F.col("value") / 500.0).alias("cpu_util"),
        F.when(kind != "error", F.lit(30) + F.col("value") / 10.0).alias("gpu_temp"),
        pick(kind, {"purchase": "steam_app_42|game", "view": "kitty|shell", "signup": ""})
        .alias("active_window"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment window per signup, on its boot; a boot's last one is still open."""
    found = base(spark, sf_dir).where(F.col("event_type") == "signup")
    last = found.groupBy("boot_id").agg(F.max("event_id").alias("last_id"))
    k, start = F.col("k"), minute_of("ts_ms")
    names = {0: "normal", 1: "fan_curve_low", 2: "airflow_blocked", 3: "oc_unstable", 4: "stress_ng"}
    return found.join(last, "boot_id").select(
        F.col("event_id").alias("id"),
        "boot_id",
        start.alias("ts_start"),
        F.when(F.col("event_id") != F.col("last_id"), start + (k % 5) * HOUR).alias("ts_end"),
        pick(k % 6, names, "gaming").alias("label"),
        F.when(k % 3 != 0, F.concat(F.lit('été "'), k.cast("string"), F.lit('"'))).alias("notes"),
    )


def kernel_text() -> Column:
    return pick(F.col("k") % 45, dict(enumerate(KERNEL_TEXTS)), EVERYDAY)


def kmsg_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw kernel log lines; one in 31 is broken, the priority has facility bits."""
    k = F.col("k")
    head = F.concat_ws(
        ",",
        ((k % 3) * 8 + k % 8).cast("string"),
        F.col("event_id").cast("string"),
        (F.col("ts_us") - EPOCH_MS * 1000).cast("string"),
    )
    broken = F.concat(F.lit("bad,"), F.col("event_id").cast("string"), F.lit(";no timestamp"))
    return base(spark, sf_dir).select(
        "event_id",
        "ts_ms",
        "boot_id",
        F.expr("ts_ms div 864000000").alias("tick"),
        F.when(k % 31 == 0, broken).otherwise(F.concat(head, F.lit(",-;"), kernel_text())).alias("line"),
        F.lit(EPOCH_MS).alias("boot_epoch_ms"),
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    summed = running_total(
        base(spark, sf_dir).select("boot_id", "event_id", "k"),
        ["boot_id"], ["event_id"], F.when(k % 4 == 0, k).otherwise(0), into="total",
    )
    # two counters; each is unreadable at some ticks and has no row at all at others
    field = F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), (k % gone != 3).alias("seen"),
                 F.when(k % bad != 0, F.col("total") % top).alias("raw"))
        for name, bad, gone, top in (("err_nmi", 11, 13, 500), ("err_mce", 9, 7, 300))
    ])).alias("f")
    rows = summed.select("boot_id", F.col("event_id").alias("tick"), field)
    return settle(rows.where("f.seen").select("boot_id", "tick", "f.field", "f.raw"), "counters")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("boot_id", F.col("event_id").alias("tick"))


def hundredths() -> Column:
    return F.floor(F.col("value") * 100 + 0.5).cast("bigint")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = running_total(
        base(spark, sf_dir).select("boot_id", "event_id", "ts_us", "value"),
        ["boot_id"], ["event_id"], hundredths() * 1000000, into="total",
    )
    return settle(summed.select(
        "boot_id",
        F.col("event_id").alias("tick"),
        F.lit("pkg").alias("zone"),
        F.col("ts_us").alias("mono_us"),
        (F.col("total") % MAX_UJ).alias("energy_uj"),
        F.lit(MAX_UJ).alias("max_uj"),
    ), "energy")


def procs(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = running_total(
        base(spark, sf_dir).select("boot_id", "event_id", "user_id", "ts_ms", "ts_us", "value"),
        ["user_id"], ["event_id"], hundredths(), into="j",
    )
    tick = F.expr("ts_ms div 43200000")
    seen = summed.groupBy("boot_id", tick.alias("tick"), F.col("user_id").alias("pid")).agg(
        F.max("ts_us").alias("mono_us"), F.max("j").alias("jiffies")
    )
    return settle(seen.select(
        "boot_id", "tick", "mono_us", "pid",
        F.concat(F.lit("proc-"), (F.col("pid") % 7).cast("string")).alias("comm"),
        "jiffies",
        (F.col("pid") + F.expr("tick div 200")).alias("starttime"),
    ), "procs")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(
        "boot_id",
        F.lit("sensors").alias("source"),
        F.col("event_id").alias("tick"),
        (F.col("event_type") != "error").alias("ok"),
    )
