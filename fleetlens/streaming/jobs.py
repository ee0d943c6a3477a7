"""Log following, keyed dedup, counters with state and sample intake as streams.

A file source delivers what is already there first and new files afterwards, so
replay and follow are one job. Intake per trigger is bounded by files or bytes
(`intake`); rows that do not fit wait for the next trigger. Nothing is dropped
for being late: rows keep their own ts and there is no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions import rules as R
from fleetlens.operators import derive, events as E
from fleetlens.operators.ordered import WIDTH, first_per_key
from fleetlens.plans.dataset import exists, require_identity
from fleetlens.plans.keys import KeyIndex
from fleetlens.session import scratch_scope, settle
from fleetlens.sources.logs import parse_kmsg
from fleetlens.streaming.tables import Batch, BatchTable, run_id

FLUSH_INTERVAL = "30 seconds"

EVENT_ROWS = T.StructType([
    T.StructField("boot_id", T.StringType()),
    T.StructField("tick", T.LongType()),
    T.StructField("ts", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("dedup", T.StringType()),
])
COUNT_ROWS = T.StructType([
    T.StructField("boot_id", T.StringType()),
    T.StructField("tick", T.LongType()),
    T.StructField("messages", T.LongType()),
    T.StructField("criticals", T.LongType()),
    T.StructField("errors", T.LongType()),
])


def intake(max_files: int | None = None, max_bytes: str | None = None) -> dict[str, str]:
    """Source options that bound one trigger."""
    options = {}
    if max_files is not None:
        if max_files <= 0:
            raise ValueError("max_files must be positive")
        options["maxFilesPerTrigger"] = str(max_files)
    if max_bytes is not None:
        options["maxBytesPerTrigger"] = max_bytes
    return options


def run(
    stream: DataFrame,
    batch: Callable[[DataFrame, Batch], None],
    checkpoint: str,
    *,
    once: bool = True,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Start a foreachBatch job: all that is there now, or forever by interval.

    What a batch settles on its way is deleted at its end.
    """
    def handled(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        with scratch_scope(spark):
            batch(rows, Batch(run_id(spark, checkpoint), number))

    writer = stream.writeStream.foreachBatch(handled).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def _span(rows: DataFrame, column: str) -> tuple:
    """(column, low, high) of a batch, to prune what is read back by."""
    return (column, *rows.agg(F.min(column), F.max(column)).first())


def log_lines(
    spark: SparkSession, path: str, options: dict[str, str] | None = None
) -> DataFrame:
    """Landed log files below `boot_id=.../tick=...` folders, as a stream."""
    layout = T.StructType([
        T.StructField("value", T.StringType()),
        T.StructField("boot_id", T.StringType()),
        T.StructField("tick", T.LongType()),
    ])
    reader = spark.readStream.schema(layout).options(**(options or {}))
    return reader.text(path).withColumnRenamed("value", "line")


STORM_ROWS = T.StructType([
    T.StructField("boot_id", T.StringType()),
    T.StructField("tick", T.LongType()),
    T.StructField("suppressed", T.LongType()),
    T.StructField("ts", T.LongType()),
])


def kernel_log(boot_epoch_ms) -> Callable[[DataFrame], DataFrame]:
    """Parser of kernel log lines.

    `boot_epoch_ms` is a column, or a table (boot_id, boot_epoch_ms) with one row per
    boot, from which every line gets the start of its own boot; lines of a boot that is
    not in the table have no time and are left out.
    """
    def parse(lines: DataFrame) -> DataFrame:
        if isinstance(boot_epoch_ms, DataFrame):
            return parse_kmsg(lines.join(boot_epoch_ms, "boot_id"))
        return parse_kmsg(lines.withColumn("boot_epoch_ms", boot_epoch_ms))

    return parse


def follow_log(
    lines: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    events: BatchTable,
    storms: BatchTable,
    checkpoint: str,
    *,
    counts: BatchTable | None = None,
    source: str = "kmsg",
    order: Sequence[str] = ("seq",),
    limit: int = R.EVENTS_PER_TICK,
    **trigger,
) -> StreamingQuery:
    """Classify new lines into the event table, with per-tick counts on the side.

    `parse` turns lines into log records (`kernel_log`, `parse_journal`), which `order`
    sorts within a tick: sequence numbers, or ts and cursor for a journal. The cap holds
    for a tick however its lines fall into triggers: what earlier triggers stored of a
    tick counts against it, and surplus is added up in `storms` (`followed_events` makes
    one warning per tick of it). A key names one record, so only stored events of the
    batch's own time span are looked up.
    """
    def batch(rows: DataFrame, now: Batch) -> None:
        classified = settle(E.classify(parse(rows)), "classified")
        span = _span(classified, "ts")
        known = events.read(but=now, between=span)
        used = events.read(but=now, between=_span(classified, "tick")).groupBy("boot_id", "tick").agg(
            F.count("*").alias("used")
        )
        kept, suppressed = E.capped_faults(classified, known, limit=limit, used=used, order=order)
        events.write(E.as_events(kept, source, "boot_id", "tick"), now)
        storms.write(suppressed, now)
        if counts is not None:
            counts.write(classified.groupBy("boot_id", "tick").agg(
                F.count("*").alias("messages"),
                F.count_if(F.col("severity") == R.CRITICAL).alias("criticals"),
                F.count_if(
                    F.col("kind").isNotNull() & (F.col("severity") != R.CRITICAL)
                ).alias("errors"),
            ), now)

    return run(lines, batch, checkpoint, **trigger)


def followed_events(events: BatchTable, storms: BatchTable, source: str = "kmsg") -> DataFrame:
    """All stored events, with one storm warning per tick over all triggers."""
    totals = storms.read().groupBy("boot_id", "tick").agg(
        F.sum("suppressed").alias("suppressed"), F.max("ts").alias("ts")
    )
    rows = events.read()
    return rows.unionByName(E.storm_events(totals, source).select(*rows.columns))


def tick_totals(counts: BatchTable) -> DataFrame:
    """Counts per tick over all triggers."""
    return counts.read().groupBy("boot_id", "tick").agg(*[
        F.sum(c).alias(c) for c in ("messages", "criticals", "errors")
    ])


def dedup_stream(
    stream: DataFrame, table: BatchTable, checkpoint: str, order: Sequence[str], **trigger
) -> StreamingQuery:
    """Exact: the first row per key over all triggers and runs; rows without a key all pass.

    A key may come back at any time, so it is looked up in the index of all stored keys
    (`<table>_keys`), which opens key files only where its filters find the key. Where
    copies come soon, `dedup_bounded` keeps a bounded state instead.
    """
    index = KeyIndex(table.spark, f"{table.path}_keys")

    def batch(rows: DataFrame, now: Batch) -> None:
        rows = settle(rows, "keyed")
        # a repeated batch must not meet what its failed attempt has left
        others = [name for name in index.batches() if not _from(now, name)]
        if not others and exists(table.spark, table.path):
            index.add(table.read(but=now).select("dedup"), "before")
            others = ["before"]
        known = index.known(rows.select("dedup"), others).select(F.col("key").alias("dedup"))
        new = settle(E.new_only(rows, known, order), "new")
        index.add(new.select("dedup"), f"{now.run}.{now.number}")
        table.write(new, now)

    return run(stream, batch, checkpoint, **trigger)


def _from(now: Batch, name: str) -> bool:
    """Whether the index batch `name` is this micro-batch's or a later one's of its run."""
    run, _, number = name.rpartition(".")
    return run == now.run and int(number) >= now.number


def dedup_bounded(keyed: DataFrame, time: str, horizon: str) -> DataFrame:
    """Dedup with state bounded by a watermark; for keys that only repeat soon.

    Takes rows that have a key. Which copy survives inside a trigger is open,
    and copies further apart than the horizon both pass.
    """
    return keyed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["dedup"])


def series_stream(
    stream: DataFrame,
    results: BatchTable,
    state: BatchTable,
    checkpoint: str,
    derived: Callable[[DataFrame], DataFrame],
    *,
    keys: Sequence[str],
    remember: Callable[[DataFrame], DataFrame] | None = None,
    **trigger,
) -> StreamingQuery:
    """An ordered derivation across triggers.

    State is the last row of every series (and what `remember` adds per series),
    kept as a table per trigger. It joins the next trigger's rows as their
    predecessor, so a series of any size is cut into chunks as in a batch and
    never sits in one task. `derived` must pass on the column `__new`.

    A run with a new checkpoint starts from the latest state any run has left. Ticks
    that are stored already are not derived again. A tick older than its series' state
    comes too late to have a predecessor: it is stored with NULL, and its neighbours
    stay as they are.
    """
    def batch(rows: DataFrame, now: Batch) -> None:
        stored = results.read(but=now, between=_span(rows, "tick")).select(*keys, "tick").distinct()
        fresh = rows.join(stored, [*keys, "tick"], "left_anti")
        last = _last_state(state, now, keys)
        joined = fresh.withColumn("__new", F.lit(True)).unionByName(
            last.withColumn("__new", F.lit(False)), allowMissingColumns=True
        )
        results.write(derived(joined).where("__new"), now)
        columns = [c for c in rows.columns if c not in keys]
        latest = joined.groupBy(*keys).agg(
            F.max_by(F.struct(*columns), "tick").alias("__last")
        ).select(*keys, "__last.*")
        if remember is not None:
            latest = latest.join(remember(joined), list(keys))
        state.write(latest, now)

    return run(stream, batch, checkpoint, **trigger)


def _last_state(state: BatchTable, now: Batch, keys: Sequence[str]) -> DataFrame:
    """The state the batch before left; for the first batch of a run, that of all other runs."""
    if now.number:
        return state.read_batch(Batch(now.run, now.number - 1))
    rest = [c for c in state.schema.names if c not in keys]
    everything = state.read(but=now)
    return everything.groupBy(*keys).agg(F.max_by(F.struct(*rest), "tick").alias("__last")).select(
        *keys, "__last.*"
    )


def counter_stream(
    stream: DataFrame, deltas: BatchTable, state: BatchTable, checkpoint: str,
    *, keys: Sequence[str] = ("boot_id", "field"), width: int = WIDTH, **trigger,
) -> StreamingQuery:
    """Counter deltas of (keys, tick, raw) across triggers."""
    return series_stream(
        stream, deltas, state, checkpoint,
        lambda rows: derive.counter_delta(rows, keys=keys, width=width), keys=keys, **trigger,
    )


def power_stream(
    stream: DataFrame, results: BatchTable, state: BatchTable, checkpoint: str,
    *, keys: Sequence[str] = ("boot_id", "zone"), width: int = WIDTH, **trigger,
) -> StreamingQuery:
    """Power of (keys, tick, mono_us, energy_uj, max_uj) across triggers."""
    return series_stream(
        stream, results, state, checkpoint,
        lambda rows: derive.watts(rows, keys=keys, width=width), keys=keys, **trigger,
    )


def cpu_stream(
    stream: DataFrame, results: BatchTable, state: BatchTable, checkpoint: str,
    *, keys: Sequence[str] = ("boot_id",), width: int = WIDTH, **trigger,
) -> StreamingQuery:
    """CPU utilisation of (keys, tick, cpus) across triggers.

    The state also remembers the CPUs of a boot's first snapshot.
    """
    return series_stream(
        stream, results, state, checkpoint,
        lambda rows: derive.cpu_utilisation(rows, keys=keys, keep=["__new"], width=width),
        keys=keys, remember=lambda rows: derive.cpu_names(rows, keys=keys), **trigger,
    )


def sample_stream(
    stream: DataFrame,
    table: BatchTable,
    checkpoint: str,
    *,
    keys: Sequence[str] = ("boot_id", "tick"),
    order: Sequence[str] = ("ts",),
    **trigger,
) -> StreamingQuery:
    """Append samples once per (boot, tick), however often a file is delivered."""
    def batch(rows: DataFrame, now: Batch) -> None:
        first = first_per_key(require_identity(rows), list(keys), order)
        stored = table.read(but=now, between=_span(rows, keys[-1])).select(*keys)
        table.write(first.join(stored, list(keys), "left_anti"), now)

    return run(stream, batch, checkpoint, **trigger)
