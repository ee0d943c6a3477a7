"""Registered queries: streaming jobs run over all landed data.

Each job writes its input to the shared scratch folder, follows it in several
triggers until nothing is left, and returns the result table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import rules as R
from fleetlens.plans import fixtures as fx
from fleetlens.plans.fixtures import sql
from fleetlens.plans.logs_queries import DAY, EVENTS_SQL, journal_line
from fleetlens.plans.derive_queries import _DELTA, watched_counters
from fleetlens.plans.registry import query
from fleetlens.session import scratch_dir, settle
from fleetlens.sources.logs import parse_journal
from fleetlens.streaming import jobs, keyed
from fleetlens.streaming.tables import BatchTable

# Landed data comes in three parts by age.
PART = 10 * DAY


def _land(part, path):
    part.write.mode("append").parquet(path)


def _land_log(part, path):
    """Text files below boot and tick folders; a file holds a stretch of a boot's log."""
    part.repartitionByRange("boot_id", "tick", "event_id").select("boot_id", "tick", "value").write.mode(
        "append"
    ).partitionBy("boot_id", "tick").text(path)


def _follow(rows, path, time: str, start, again: int | None = None, land=_land):
    """Land the rows part by part, oldest first, and run the job after each.

    A part is as many files as it has partitions. Every run is a restart from the
    same checkpoint and takes all that has arrived; part `again` arrives twice.
    """
    first = fx.EPOCH_MS
    for i in [*range(3), *([] if again is None else [again])]:
        late = rows.where(F.col(time) >= first + i * PART) if i else rows
        part = late.where(F.col(time) < first + (i + 1) * PART) if i < 2 else late
        land(part, path)
        start().awaitTermination()


@query("q_stream_kmsg", sql("""
SELECT boot_id, tick, ts, kind, severity, message, dedup FROM ev
""", "fx_kmsg_raw", extra=EVENTS_SQL))
def stream_kmsg(spark, sf_dir):
    """Log files per boot and tick, followed as text; ticks reach over two parts."""
    root = scratch_dir(spark, "follow")
    raw = fx.kmsg_raw(spark, sf_dir).select("event_id", "ts_ms", "boot_id", "tick", F.col("line").alias("value"))
    boots = raw.select("boot_id").distinct().withColumn("boot_epoch_ms", F.lit(fx.EPOCH_MS))
    events = BatchTable(spark, f"{root}/events", jobs.EVENT_ROWS)
    storms = BatchTable(spark, f"{root}/storms", jobs.STORM_ROWS)
    _follow(raw, f"{root}/landed", "ts_ms", lambda: jobs.follow_log(
        jobs.log_lines(spark, f"{root}/landed"), jobs.kernel_log(boots), events, storms, f"{root}/checkpoint"
    ), land=_land_log)
    return jobs.followed_events(events, storms).drop("source")


# Nothing in these texts names a fault, so the level decides. Entries without a cursor are never merged.
@query("q_stream_journal", sql(f"""
SELECT boot_id, tick, ts, '{R.CATCH_ALL}' AS kind, dedup FROM (
  SELECT boot_id, ts_us // 1000 // 864000000 AS tick, ts_us // 1000 AS ts,
         CASE WHEN k % 9 = 4 THEN 6 ELSE k % 8 END AS level,
         CASE WHEN k % 2 = 0 THEN concat('s=', CAST(event_id AS VARCHAR)) END AS dedup
  FROM fx_base WHERE k % 9 NOT IN (0, 1, 2, 5, 6)) j
WHERE level <= 3
"""))
def stream_journal(spark, sf_dir):
    """Journal entries, followed in three parts; the cap is above what a tick holds."""
    root = scratch_dir(spark, "journal")
    raw = fx.base(spark, sf_dir).select(
        "event_id", "ts_ms", "boot_id", F.expr("ts_ms div 864000000").alias("tick"), journal_line().alias("value")
    )
    events = BatchTable(spark, f"{root}/events", jobs.EVENT_ROWS)
    storms = BatchTable(spark, f"{root}/storms", jobs.STORM_ROWS)
    _follow(raw, f"{root}/landed", "ts_ms", lambda: jobs.follow_log(
        jobs.log_lines(spark, f"{root}/landed"), parse_journal, events, storms, f"{root}/checkpoint",
        source="journal", order=["ts", "dedup"], limit=1 << 40,
    ), land=_land_log)
    return jobs.followed_events(events, storms, "journal").select("boot_id", "tick", "ts", "kind", "dedup")


KEYED = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.LongType()),
    T.StructField("dedup", T.StringType()),
])


@query("q_stream_dedup", sql("""
SELECT event_id, ts, dedup FROM (
  SELECT event_id, ts_ms AS ts, key AS dedup, row_number() OVER (PARTITION BY key ORDER BY event_id) AS nth
  FROM (SELECT *, CASE WHEN k % 5 > 0 THEN concat(boot_id, ':', CAST(user_id * 10 + k % 10 AS VARCHAR)) END AS key
        FROM fx_base) b) d
WHERE dedup IS NULL OR nth = 1
"""))
def stream_dedup(spark, sf_dir):
    root = scratch_dir(spark, "dedup")
    key = F.concat("boot_id", F.lit(":"), (F.col("user_id") * 10 + F.col("k") % 10).cast("string"))
    rows = fx.base(spark, sf_dir).select(
        "event_id", F.col("ts_ms").alias("ts"), F.when(F.col("k") % 5 > 0, key).alias("dedup")
    )
    table = BatchTable(spark, f"{root}/kept", KEYED)
    _follow(rows, f"{root}/landed", "ts", lambda: jobs.dedup_stream(
        spark.readStream.schema(KEYED).parquet(f"{root}/landed"), table, f"{root}/checkpoint", ["event_id"]
    ))
    return table.read()


COUNTER_ROWS = T.StructType([
    T.StructField("boot_id", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("tick", T.LongType()), T.StructField("raw", T.LongType()),
])
DELTA_ROWS = T.StructType([*COUNTER_ROWS.fields, T.StructField("delta", T.DoubleType())])


@query("q_stream_counter", sql("SELECT * FROM d", "fx_counters", extra=_DELTA))
def stream_counter(spark, sf_dir):
    root = scratch_dir(spark, "counters")
    times = fx.base(spark, sf_dir).select(F.col("event_id").alias("tick"), "ts_ms")
    landed = watched_counters(spark, sf_dir).join(times, "tick").select(*COUNTER_ROWS.names, "ts_ms")
    deltas = BatchTable(spark, f"{root}/deltas", DELTA_ROWS)
    state = BatchTable(spark, f"{root}/state", COUNTER_ROWS)
    _follow(landed, f"{root}/landed", "ts_ms", lambda: jobs.counter_stream(
        spark.readStream.schema(COUNTER_ROWS).parquet(f"{root}/landed"), deltas, state, f"{root}/checkpoint"
    ))
    return deltas.read()


@query("q_stream_counter_keyed", sql("SELECT * FROM d", "fx_counters", extra=_DELTA))
def stream_counter_keyed(spark, sf_dir):
    """Readings arrive shuffled, in three parts without any order in time; the first part arrives twice."""
    root = scratch_dir(spark, "counters-keyed")
    landed = settle(watched_counters(spark, sf_dir).select(*COUNTER_ROWS.names), "watched")
    kinds = {"boot_id": T.StringType(), "field": T.StringType()}
    results = BatchTable(spark, f"{root}/deltas", keyed.counter_rows(kinds))
    for part in (0, 1, 2, 0):
        _land(landed.where(F.pmod(F.xxhash64("tick"), F.lit(3)) == part), f"{root}/landed")
        keyed.counters_with_corrections(
            spark.readStream.schema(COUNTER_ROWS).parquet(f"{root}/landed"), results, f"{root}/checkpoint"
        ).awaitTermination()
    return keyed.current(results.read())


SAMPLE_ROWS = T.StructType([
    T.StructField("boot_id", T.StringType()), T.StructField("tick", T.LongType()),
    T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType()),
])


@query("q_stream_samples", sql("""
SELECT boot_id, event_id AS tick, ts_ms // 60000 * 60000 AS ts, value FROM fx_base
"""))
def stream_samples(spark, sf_dir):
    """The middle part of the samples is delivered twice and stored once."""
    root = scratch_dir(spark, "samples")
    rows = fx.base(spark, sf_dir).select(
        "boot_id", F.col("event_id").alias("tick"), fx.minute_of("ts_ms").alias("ts"), "value"
    )
    table = BatchTable(spark, f"{root}/stored", SAMPLE_ROWS)
    _follow(rows, f"{root}/landed", "ts", lambda: jobs.sample_stream(
        spark.readStream.schema(SAMPLE_ROWS).parquet(f"{root}/landed"), table, f"{root}/checkpoint"
    ), again=1)
    return table.read()
