"""Registered queries: export, report, table upkeep, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.functions import text as X
from fleetlens.operators import events as E
from fleetlens.operators import labels as L
from fleetlens.operators import quality as Q
from fleetlens.operators.intervals import interval_pairs
from fleetlens.operators.ordered import first_per_key
from fleetlens.plans import dataset as D
from fleetlens.plans import fixtures as fx
from fleetlens.plans import report
from fleetlens.plans.export import export_rows, write_csv
from fleetlens.plans.fixtures import sql
from fleetlens.plans.logs_queries import DAY, stored_events, EVENTS_SQL
from fleetlens.plans.registry import query
from fleetlens.plans.versions import Versions, write_clustered
from fleetlens.schema import METRIC_TYPES
from fleetlens.session import scratch_dir
from pyspark.sql import types as T

SINCE, UNTIL = 1_704_844_800_000, 1_705_708_800_000

_COVERS = "l.boot_id = s.boot_id AND l.ts_start <= s.ts AND (l.ts_end IS NULL OR s.ts < l.ts_end)"
# Windows belong to the boot they were opened on.
PER_BOOT = ("boot_id",)
_JSON = """
SELECT s.sample_id, CAST(to_json(list({'id': l.id, 'label': l.label, 'notes': l.notes,
         'ts_start': l.ts_start, 'ts_end': l.ts_end} ORDER BY l.id)) AS VARCHAR) AS labels_json
FROM fx_samples s JOIN fx_labels l ON """ + _COVERS + " GROUP BY s.sample_id"


@query("q_export_labels", sql("""
SELECT s.sample_id, s.ts, s.boot_id, s.cpu_util, s.gpu_temp, s.active_window,
       coalesce(j.labels_json, '[]') AS labels_json
FROM fx_samples s LEFT JOIN j USING (sample_id)
""", "fx_samples", "fx_labels", extra={"j": _JSON}))
def export_labels(spark, sf_dir):
    return export_rows(fx.samples(spark, sf_dir), fx.labels(spark, sf_dir), keys=PER_BOOT)


@query("q_export_filtered", sql(f"""
SELECT s.active_window, s.ts, s.cpu_util, coalesce(j.labels_json, '[]') AS labels_json, s.sample_id
FROM fx_samples s LEFT JOIN j USING (sample_id)
WHERE s.boot_id = 'boot-3' AND s.ts >= {SINCE} AND s.ts < {UNTIL}
""", "fx_samples", "fx_labels", extra={"j": _JSON}))
def export_filtered(spark, sf_dir):
    return export_rows(
        fx.samples(spark, sf_dir), fx.labels(spark, sf_dir),
        boot_id="boot-3", since=SINCE, until=UNTIL, columns=["active_window", "ts", "cpu_util"], keys=PER_BOOT,
    ).drop("boot_id")


@query("q_export_csv", sql("""
SELECT s.ts, s.boot_id, nullif(s.active_window, '') AS active_window, coalesce(j.labels_json, '[]') AS labels_json,
       n.n AS written
FROM fx_samples s LEFT JOIN j USING (sample_id), (SELECT count(*) AS n FROM fx_samples) n
""", "fx_samples", "fx_labels", extra={"j": _JSON}))
def export_csv(spark, sf_dir):
    """Written as compressed CSV and read back; quotes, blanks and umlauts have to survive."""
    target = scratch_dir(spark, "csv")
    written = write_csv(
        fx.samples(spark, sf_dir), fx.labels(spark, sf_dir), target,
        columns=["ts", "boot_id", "active_window"], keys=PER_BOOT, compression="zstd",
    )
    read = spark.read.schema("ts bigint, boot_id string, active_window string, labels_json string").csv(
        target, header=True, escape='"', multiLine=True
    )
    return read.withColumn("written", F.lit(written))


@query("q_interval_join_binned", sql(f"""
SELECT s.sample_id, s.ts, l.id AS label_id FROM fx_samples s LEFT JOIN fx_labels l ON {_COVERS}
""", "fx_samples", "fx_labels"))
def interval_join_binned(spark, sf_dir):
    """The way taken when the segments are too large to broadcast."""
    rows = fx.samples(spark, sf_dir).select("sample_id", "ts", "boot_id")
    return interval_pairs(rows, fx.labels(spark, sf_dir), PER_BOOT, broadcast_bytes=0).drop("boot_id")


@query("q_count_samples", sql("SELECT count(*) AS n FROM fx_samples", "fx_samples"))
def count_samples(spark, sf_dir):
    return fx.samples(spark, sf_dir).agg(F.count("*").alias("n"))


_SAMPLE_REPORT = """
SELECT count(*) AS "count", min(ts) AS first_ts, max(ts) AS last_ts,
       count(*) FILTER (labelled) AS labelled,
       count(*) FILTER (labelled) / nullif(count(*), 0)::DOUBLE * 100 AS labelled_pct
FROM (SELECT s.ts, EXISTS (SELECT 1 FROM fx_labels l WHERE """ + _COVERS + """) AS labelled
      FROM fx_samples s WHERE {where}) x"""


@query("q_report_samples", sql(_SAMPLE_REPORT.format(where="true"), "fx_samples", "fx_labels"))
def report_samples(spark, sf_dir):
    return report.sample_section(fx.samples(spark, sf_dir), fx.labels(spark, sf_dir), keys=PER_BOOT)


@query("q_report_window", sql(
    _SAMPLE_REPORT.format(where=f"s.ts >= {SINCE} AND s.ts < {UNTIL}"), "fx_samples", "fx_labels"))
def report_window(spark, sf_dir):
    return report.sample_section(fx.samples(spark, sf_dir), fx.labels(spark, sf_dir), SINCE, UNTIL, PER_BOOT)


_COVERAGE = """
SELECT {position} AS position, '{name}' AS "column", '{type}' AS type, count({name}) AS present,
       count(*) - count({name}) AS missing, count({name}) / nullif(count(*), 0)::DOUBLE * 100 AS coverage_pct
FROM fx_samples"""
_COVERAGES = " UNION ALL ".join(
    _COVERAGE.format(position=i, name=n, type=t)
    for i, (n, t) in enumerate([("cpu_util", "REAL"), ("gpu_temp", "REAL"), ("active_window", "TEXT")])
)


@query("q_metric_coverage", sql(_COVERAGES, "fx_samples"))
def metric_coverage(spark, sf_dir):
    return report.metric_section(fx.samples(spark, sf_dir))


_BOOTS = """
SELECT boot_id, count(*) AS samples, min(ts) AS first_ts, max(ts) AS last_ts,
       count(*) - count(DISTINCT ts) AS duplicate_timestamps
FROM fx_samples GROUP BY boot_id"""


@query("q_report_boots", sql(_BOOTS, "fx_samples"))
def report_boots(spark, sf_dir):
    return report.boot_section(fx.samples(spark, sf_dir))


@query("q_report_labels", sql(f"""
SELECT count(*) AS total, count(*) FILTER (ts_end IS NULL) AS open FROM fx_labels
WHERE (ts_end IS NULL OR ts_start < ts_end) AND (ts_end IS NULL OR ts_end > {SINCE}) AND ts_start < {UNTIL}
""", "fx_labels"))
def report_labels(spark, sf_dir):
    return report.label_section(fx.labels(spark, sf_dir), SINCE, UNTIL)


@query("q_report_events", sql("""
SELECT source, kind, severity, count(*) AS "count" FROM ev GROUP BY source, kind, severity
""", "fx_kmsg_raw", extra=EVENTS_SQL))
def report_events(spark, sf_dir):
    return report.event_section(stored_events(spark, sf_dir))


@query("q_report_json", sql(f"""
SELECT concat('{{"window":{{"since":{SINCE},"until":{UNTIL}}},"samples":', s.j, ',"boots":', b.j,
              ',"metrics":', m.j, ',"labels":', l.j, ',"events":', e.j, '}}') AS report
FROM (SELECT CAST(to_json(r) AS VARCHAR) AS j FROM ({_SAMPLE_REPORT.format(where=f"s.ts >= {SINCE} AND s.ts < {UNTIL}")}) r) s,
     (SELECT CAST(to_json(list(r ORDER BY boot_id)) AS VARCHAR) AS j FROM ({_BOOTS.replace("GROUP", f"WHERE ts >= {SINCE} AND ts < {UNTIL} GROUP")}) r) b,
     (SELECT CAST(to_json(list({{'column': "column", 'type': type, 'present': present, 'missing': missing,
         'coverage_pct': coverage_pct}} ORDER BY position)) AS VARCHAR) AS j
      FROM ({_COVERAGES.replace("FROM fx_samples", f"FROM fx_samples WHERE ts >= {SINCE} AND ts < {UNTIL}")}) r) m,
     (SELECT CAST(to_json(r) AS VARCHAR) AS j FROM (
        SELECT count(*) AS total, count(*) FILTER (ts_end IS NULL) AS open FROM fx_labels
        WHERE (ts_end IS NULL OR ts_start < ts_end) AND (ts_end IS NULL OR ts_end > {SINCE})
          AND ts_start < {UNTIL}) r) l,
     (SELECT CAST(to_json(list(r ORDER BY source, kind, severity)) AS VARCHAR) AS j FROM (
        SELECT source, kind, severity, count(*) AS "count" FROM ev
        WHERE ts >= {SINCE} AND ts < {UNTIL} GROUP BY source, kind, severity) r) e
""", "fx_samples", "fx_labels", "fx_kmsg_raw", extra=EVENTS_SQL))
def report_object(spark, sf_dir):
    return report.report_json(
        fx.samples(spark, sf_dir), fx.labels(spark, sf_dir), stored_events(spark, sf_dir), SINCE, UNTIL, PER_BOOT
    )


# ---- tables ---------------------------------------------------------------------


@query("q_append_samples", sql("""
SELECT ts, boot_id, cpu_util, CASE WHEN ts % 120000 = 0 THEN NULL ELSE gpu_temp END AS gpu_temp,
       CASE WHEN ts % 120000 = 0 THEN 1 ELSE 2 END AS batch, (SELECT count(*) FROM fx_samples) AS ids
FROM fx_samples
""", "fx_samples"))
def append_samples(spark, sf_dir):
    """Two batches: one from a source without gpu_temp, one with a column too many."""
    path = scratch_dir(spark, "samples")
    schema = T.StructType([
        T.StructField("ts", T.LongType()), T.StructField("boot_id", T.StringType()),
        T.StructField("cpu_util", METRIC_TYPES["REAL"]), T.StructField("gpu_temp", METRIC_TYPES["REAL"]),
    ])
    rows = fx.samples(spark, sf_dir)
    D.append_samples(rows.where("ts % 120000 = 0").select("ts", "boot_id", "cpu_util"), path, schema)
    D.append_samples(rows.where("ts % 120000 != 0"), path, schema)
    stored = spark.read.parquet(path)
    first = rows.where("ts % 120000 = 0").count()
    ids = stored.select("sample_id").distinct().count()
    batch = F.when(F.col("sample_id").between(1, first), 1).when(F.col("sample_id") <= ids, 2)
    return stored.withColumn("batch", batch).withColumn("ids", F.lit(ids)).drop("sample_id")


@query("q_version_read", sql("""
SELECT CAST(0 AS BIGINT) AS version, ts, boot_id, cpu_util, CAST(NULL AS DOUBLE) AS gpu_temp
FROM fx_samples WHERE ts % 120000 = 0
UNION ALL
SELECT 1, ts, boot_id, cpu_util, CASE WHEN ts % 120000 = 0 THEN NULL ELSE gpu_temp END FROM fx_samples
""", "fx_samples"))
def version_read(spark, sf_dir):
    """Two versions beside three appends; the second knows a column more, the last append is in none."""
    root = scratch_dir(spark, "versions")
    rows = fx.samples(spark, sf_dir).select("ts", "boot_id", "cpu_util", "gpu_temp")
    versions = Versions(spark, root)
    D.append_samples(rows.where("ts % 120000 = 0").drop("gpu_temp"), f"{root}/samples")
    versions.publish(["samples"])
    D.append_samples(rows.where("ts % 120000 != 0"), f"{root}/samples")
    versions.publish(["samples"])
    D.append_samples(rows.drop("cpu_util"), f"{root}/samples")
    first, second = (versions.read(n)["samples"].drop("sample_id") for n in (0, 1))
    return first.withColumn("version", F.lit(0).cast("bigint")).unionByName(
        second.withColumn("version", F.lit(1).cast("bigint")), allowMissingColumns=True
    )


@query("q_clustered_boot", sql(f"""
SELECT sample_id, ts, boot_id, cpu_util FROM fx_samples
WHERE boot_id = 'boot-3' AND ts >= {SINCE} AND ts < {UNTIL}
""", "fx_samples"))
def clustered_boot(spark, sf_dir):
    """A boot's rows of a table written by boot, from the files whose bounds can hold them."""
    root = scratch_dir(spark, "clustered")
    write_clustered(fx.samples(spark, sf_dir).select("sample_id", "ts", "boot_id", "cpu_util"), f"{root}/samples")
    versions = Versions(spark, root)
    versions.publish(["samples"])
    return versions.read_table("samples", boot_id="boot-3", since=SINCE, until=UNTIL)


@query("q_verified_copy", sql("""
SELECT 'samples' AS "table", count(*) AS rows FROM fx_samples
UNION ALL SELECT 'boots', count(DISTINCT boot_id) FROM fx_samples
UNION ALL SELECT 'labels', count(*) FROM fx_labels
UNION ALL SELECT 'events', count(*) FROM ev
""", "fx_samples", "fx_labels", "fx_kmsg_raw", extra=EVENTS_SQL))
def verified_copy(spark, sf_dir):
    source, target = scratch_dir(spark, "dataset"), scratch_dir(spark, "copy")
    samples = fx.samples(spark, sf_dir)
    samples.write.parquet(f"{source}/samples")
    samples.groupBy("boot_id").agg(F.min("ts").alias("ts_first")).write.parquet(f"{source}/boots")
    fx.labels(spark, sf_dir).write.parquet(f"{source}/labels")
    stored_events(spark, sf_dir).write.parquet(f"{source}/events")
    return D.verified_copy(spark, source, target)


@query("q_schema_upgrade", sql("""
SELECT row_number() OVER (ORDER BY ts) AS sample_id, ts, boot_id, cpu_util
FROM (SELECT ts_ms AS ts, arg_min(boot_id, event_id) AS boot_id, min(value) AS cpu_util
      FROM fx_base GROUP BY ts_ms) o
"""))
def schema_upgrade(spark, sf_dir):
    """An old table held one row per millisecond, keyed by it."""
    old = fx.base(spark, sf_dir).groupBy(F.col("ts_ms").alias("ts")).agg(
        F.min_by("boot_id", "event_id").alias("boot_id"), F.min("value").alias("cpu_util")
    )
    return D.upgrade_samples(old)


@query("q_register_boots", sql("""
SELECT boot_id, arg_min(ts_ms, event_id) AS ts_first, arg_min(kernel, event_id) AS kernel
FROM (SELECT event_id, ts_ms, concat(boot_id, '/', CAST(ts_ms // 86400000 AS VARCHAR)) AS boot_id,
             concat('6.', CAST(k AS VARCHAR)) AS kernel FROM fx_base) b
GROUP BY boot_id
"""))
def register_boots(spark, sf_dir):
    seen = fx.base(spark, sf_dir).select(
        F.concat("boot_id", F.lit("/"), F.expr("ts_ms div 86400000").cast("string")).alias("boot_id"),
        F.col("ts_ms").alias("ts_first"),
        F.concat(F.lit("6."), F.col("k").cast("string")).alias("kernel"),
        F.col("event_id").alias("arrival"),
    )
    return E.register_boots(seen).drop("arrival")


@query("q_conform_columns", sql("""
SELECT ts, boot_id, gpu_temp, CAST(NULL AS DOUBLE) AS fan_rpm FROM fx_samples
""", "fx_samples"))
def conform_columns(spark, sf_dir):
    """Stored: ts, boot_id, gpu_temp, fan_rpm. The others, sample_id too, go."""
    schema = T.StructType([
        T.StructField("sample_id", T.LongType()),
        T.StructField("ts", T.LongType()), T.StructField("boot_id", T.StringType()),
        T.StructField("gpu_temp", T.DoubleType()), T.StructField("fan_rpm", T.DoubleType()),
    ])
    return Q.conform(fx.samples(spark, sf_dir), schema)[0]


@query("q_sanitize", sql("""
SELECT event_id,
       CASE k % 8 WHEN 0 THEN k WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
                  WHEN 4 THEN 1.0 WHEN 5 THEN NULL WHEN 6 THEN k + 0.5 ELSE NULL END::DOUBLE AS reading,
       CASE WHEN k % 3 = 0 THEN NULL ELSE concat('w', CAST(k AS VARCHAR)) END AS title,
       CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS temp
FROM fx_base
"""))
def sanitize(spark, sf_dir):
    """Untyped readings: number, text, list, object, true, 2^63, fraction, null."""
    k = F.col("k").cast("string")
    raw = (
        F.when(F.col("k") % 8 == 0, k)
        .when(F.col("k") % 8 == 1, F.lit('"12.5"'))
        .when(F.col("k") % 8 == 2, F.lit("[1]"))
        .when(F.col("k") % 8 == 3, F.lit('{"a":1}'))
        .when(F.col("k") % 8 == 4, F.lit("true"))
        .when(F.col("k") % 8 == 5, F.lit("9223372036854775808"))
        .when(F.col("k") % 8 == 6, F.concat(k, F.lit(".5")))
        .otherwise(F.lit("null"))
    )
    title = F.when(F.col("k") % 3 == 0, k).otherwise(F.concat(F.lit('"w'), k, F.lit('"')))
    rows = fx.base(spark, sf_dir).select(
        "event_id",
        F.parse_json(raw).alias("reading"),
        F.parse_json(title).alias("title"),
        F.when(F.col("k") % 10 == 0, F.lit(float("nan")))
        .when(F.col("k") % 10 == 5, F.lit(float("inf")))
        .otherwise(F.col("value")).alias("temp"),
    )
    return Q.sanitize(rows, {"reading": "REAL", "title": "TEXT", "temp": "REAL"})


@query("q_unit_scale", sql("""
SELECT event_id, (k * 1000) * 0.001::DOUBLE AS celsius, k * 0.001::DOUBLE AS volts,
       (k * 1000000) * 0.000001::DOUBLE AS watts, k * 1.0::DOUBLE AS rpm,
       CASE WHEN k % 9 = 0 THEN NULL ELSE k / 1024.0::DOUBLE END AS mem_mb
FROM fx_base
"""))
def unit_scale(spark, sf_dir):
    raw = fx.base(spark, sf_dir).select(
        "event_id", (F.col("k") * 1000).alias("m"), F.col("k"), (F.col("k") * 1000000).alias("u"),
        F.when(F.col("k") % 9 != 0, F.col("k")).alias("kb"),
    )
    return Q.scale(raw, {
        "celsius": ("m", 1e-3), "volts": ("k", 1e-3), "watts": ("u", 1e-6), "rpm": ("k", 1.0),
        "mem_mb": ("kb", 1 / 1024),
    }).drop("m", "k", "u", "kb")


_RAW_NAME = "concat('  Sensor ', CAST(k % 40 AS VARCHAR), ' (', upper(event_type), ')-', CAST(user_id AS VARCHAR), ' ')"


@query("q_slug", sql(f"""
SELECT event_id, trim(regexp_replace(lower(trim({_RAW_NAME})), '[^a-z0-9]+', '_', 'g'), '_') AS name
FROM fx_base
"""))
def slug(spark, sf_dir):
    raw = F.concat(
        F.lit("  Sensor "), (F.col("k") % 40).cast("string"), F.lit(" ("), F.upper("event_type"),
        F.lit(")-"), F.col("user_id").cast("string"), F.lit(" "),
    )
    return fx.base(spark, sf_dir).select("event_id", X.slug(raw).alias("name"))


@query("q_natural_order", sql("""
SELECT device, row_number() OVER (ORDER BY n, device) AS place
FROM (SELECT DISTINCT concat('hwmon', CAST(user_id AS VARCHAR)) AS device, user_id AS n FROM fx_base) d
"""))
def natural_order(spark, sf_dir):
    """Places by counts per stretch of device numbers; no task sorts all devices."""
    from fleetlens.operators.ordered import numbered

    devices = fx.base(spark, sf_dir).select(
        F.concat(F.lit("hwmon"), F.col("user_id").cast("string")).alias("device")
    ).distinct()
    number, _ = Q.natural_key(F.col("device"))
    return numbered(
        devices.withColumn("number", number), [], ["number", "device"], into="place", width=256
    ).drop("number")


@query("q_metric_names", sql("""
SELECT boot_id, position, CASE WHEN nth = 1 THEN base ELSE concat(base, '_', CAST(nth AS VARCHAR)) END AS name
FROM (SELECT boot_id, position, base, row_number() OVER (PARTITION BY boot_id, base ORDER BY position) AS nth
      FROM (SELECT boot_id, position, CASE WHEN k % 3 = 0 THEN concat('metric_', CAST(k % 4 AS VARCHAR), '_volts')
                   WHEN k % 3 = 1 THEN concat('temp_', event_type) ELSE 'metric' END AS base
            FROM (SELECT boot_id, event_type, k % 25 AS position, min(k) AS k FROM fx_base
                  GROUP BY boot_id, event_type, k % 25) a) b) c
""".replace("k % 25 AS position", "(k % 25) * 10 + length(event_type) AS position")
   .replace("GROUP BY boot_id, event_type, k % 25", "GROUP BY boot_id, event_type, (k % 25) * 10 + length(event_type)")))
def metric_names(spark, sf_dir):
    """The labels a boot's devices show, in discovery order."""
    position = ((F.col("k") % 25) * 10 + F.length("event_type")).alias("position")
    found = fx.base(spark, sf_dir).groupBy("boot_id", "event_type", position).agg(F.min("k").alias("k"))
    raw = (
        F.when(F.col("k") % 3 == 0, F.concat((F.col("k") % 4).cast("string"), F.lit(" volts")))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("Temp "), F.initcap("event_type")))
        .otherwise(F.lit("???"))
    )
    return Q.metric_names(found.select("boot_id", "position", raw.alias("raw"))).drop("raw")


@query("q_message_truncate", sql("""
SELECT event_id, left(repeat(concat(event_type, '-'), CAST(k * 10 AS BIGINT)), 4000) AS message FROM fx_base
"""))
def message_truncate(spark, sf_dir):
    from fleetlens.functions.faults import truncated

    text = F.repeat(F.concat("event_type", F.lit("-")), (F.col("k") * 10).cast("int"))
    return fx.base(spark, sf_dir).select("event_id", truncated(text).alias("message"))


@query("q_sample_identity", sql("""
SELECT boot_id, ts_ms AS ts, event_id AS arrival,
       row_number() OVER (PARTITION BY boot_id ORDER BY event_id) AS sample_id
FROM fx_base
"""))
def sample_identity(spark, sf_dir):
    rows = fx.base(spark, sf_dir).select(
        "boot_id", F.col("ts_ms").alias("ts"), F.col("event_id").alias("arrival")
    )
    return Q.sample_identity(rows, keys=["boot_id"])


@query("q_boot_identity", sql("""
SELECT event_id, CASE WHEN k % 4 < 2 THEN 'unknown-boot' ELSE boot_id END AS boot_id FROM fx_base
"""))
def boot_identity(spark, sf_dir):
    landed = F.when(F.col("k") % 4 == 0, F.lit(" \n")).when(
        F.col("k") % 4 > 1, F.concat(F.lit("\t"), "boot_id", F.lit("\n"))
    )
    return fx.base(spark, sf_dir).select("event_id", Q.boot_identity(landed).alias("boot_id"))


@query("q_device_inventory", sql("""
SELECT boot_id, name, string_agg(path, ',' ORDER BY n) AS paths
FROM (SELECT DISTINCT boot_id, event_type AS name, k % 30 AS n,
             concat('/sys/class/hwmon/hwmon', CAST(k % 30 AS VARCHAR)) AS path
      FROM fx_base WHERE event_type <> 'error') d
GROUP BY boot_id, name
"""))
def device_inventory(spark, sf_dir):
    devices = fx.base(spark, sf_dir).select(
        "boot_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"),
        F.concat(F.lit("/sys/class/hwmon/hwmon"), (F.col("k") % 30).cast("string")).alias("path"),
    )
    return Q.device_inventory(devices).withColumn("paths", F.array_join("paths", ","))


# ---- labels ---------------------------------------------------------------------


@query("q_label_fold", sql("""
SELECT host_id, id, ts_start, ts_end, label, notes FROM (
  SELECT CAST(user_id AS VARCHAR) AS host_id, event_type, event_id AS id, ts_ms AS ts_start,
         min(CASE WHEN event_type = 'purchase' THEN ts_ms END) OVER (
           PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ts_end,
         concat('label ', CAST(k AS VARCHAR)) AS label, CAST(NULL AS VARCHAR) AS notes
  FROM fx_base) c WHERE event_type = 'signup'
"""))
def label_fold(spark, sf_dir):
    commands = fx.base(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("host_id"),
        F.col("event_id").alias("seq"),
        fx.pick(F.col("event_type"), {"signup": "start", "purchase": "end"}).alias("action"),
        F.col("ts_ms").alias("ts"),
        F.when(F.col("event_type") == "signup", F.col("event_id")).alias("id"),
        F.concat(F.lit("  label "), F.col("k").cast("string"), F.lit("\n")).alias("label"),
        F.lit(None).cast("string").alias("notes"),
    )
    return L.fold_commands(commands.where(F.col("action").isNotNull()))


# One step per command: what is open, and what the command closed. The clock jumps two days ahead at
# times, so ends are refused until a window is closed by its id or the clock has caught up.
@query("q_label_fold_refused", sql("""
SELECT w.host_id, w.id, w.ts AS ts_start, s.ts AS ts_end, w.label, CAST(NULL AS VARCHAR) AS notes
FROM commands w LEFT JOIN (
  SELECT host_id, unnest(shut).id AS id, unnest(shut).ts AS ts FROM steps WHERE len(shut) > 0) s
  ON s.host_id = w.host_id AND s.id = w.id
WHERE w.action = 'start'
""", extra={
    "commands": f"""
SELECT CAST(user_id % 6 AS VARCHAR) AS host_id, event_id AS seq, action, label,
       ts_ms + CASE WHEN k % 7 = 0 AND event_id % 5 = 0 THEN {2 * DAY} WHEN k % 5 = 1 THEN -{DAY // 12} ELSE 0 END AS ts,
       CASE WHEN action = 'start' THEN event_id
            WHEN event_type <> 'purchase' THEN event_id - user_id % 6 - 6 * (k % 40) END AS id,
       row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) AS n
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' WHEN 'click' THEN 'end'
                                WHEN 'error' THEN 'end' END AS action,
             concat('label ', CAST(k AS VARCHAR)) AS label FROM fx_base) b
WHERE action IS NOT NULL AND (event_type = 'signup' OR event_type = 'purchase' OR event_id - user_id % 6 - 6 * (k % 40) > 0)""",
    "steps": """
SELECT DISTINCT host_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, ts BIGINT)[]) AS open,
       CAST([] AS STRUCT(id BIGINT, ts BIGINT)[]) AS shut FROM commands
UNION ALL
SELECT s.host_id, c.n,
  CASE WHEN action = 'start' THEN list_append(open, {'id': id, 'ts': ts})
       WHEN len(list_filter(open, lambda w: (id IS NULL OR w.id = id) AND w.ts > ts)) > 0 THEN open
       ELSE list_filter(open, lambda w: id IS NOT NULL AND w.id <> id) END,
  CASE WHEN action = 'end' AND len(list_filter(open, lambda w: (id IS NULL OR w.id = id) AND w.ts > ts)) = 0
       THEN list_transform(list_filter(open, lambda w: id IS NULL OR w.id = id), lambda w: {'id': w.id, 'ts': ts})
       ELSE CAST([] AS STRUCT(id BIGINT, ts BIGINT)[]) END
FROM steps s JOIN commands c ON c.host_id = s.host_id AND c.n = s.n + 1"""}).replace("WITH", "WITH RECURSIVE", 1))
def label_fold_refused(spark, sf_dir):
    host = F.col("user_id") % 6
    meant = F.col("event_id") - host - 6 * (F.col("k") % 40)
    is_start, all_ = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    ahead = F.when((F.col("k") % 7 == 0) & (F.col("event_id") % 5 == 0), 2 * DAY).when(F.col("k") % 5 == 1, -DAY // 12)
    commands = fx.base(spark, sf_dir).select(
        host.cast("string").alias("host_id"), F.col("event_id").alias("seq"),
        fx.pick(F.col("event_type"), {"signup": "start", "purchase": "end", "click": "end", "error": "end"}).alias("action"),
        (F.col("ts_ms") + F.coalesce(ahead, F.lit(0))).alias("ts"),
        F.when(is_start, F.col("event_id")).when(~all_, meant).alias("id"),
        F.concat(F.lit("label "), F.col("k").cast("string")).alias("label"), F.lit(None).cast("string").alias("notes"),
    )
    return L.fold_commands(commands.where(F.col("action").isNotNull()), rows=512)


@query("q_list_labels", sql("""
SELECT id, boot_id, ts_start, ts_end, label, notes FROM fx_labels WHERE ts_end IS NULL ORDER BY ts_start, id
""", "fx_labels"))
def list_labels(spark, sf_dir):
    return L.list_labels(fx.labels(spark, sf_dir))


@query("q_label_advisory", sql("""
SELECT id, label, CASE WHEN label IN ('normal', 'fan_curve_low', 'airflow_blocked', 'oc_unstable',
         'stress_ng', 'gaming') THEN NULL ELSE concat('not a usual label: ', label) END AS advice
FROM (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'gaming' ELSE event_type END AS label FROM fx_base) l
"""))
def label_advisory(spark, sf_dir):
    found = fx.base(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.when(F.col("k") % 2 == 0, F.lit(R.KNOWN_LABELS[-1])).otherwise(F.col("event_type")).alias("label"),
    )
    return L.with_advice(found)
