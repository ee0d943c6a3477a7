"""Fault events: classification, idempotent keys, the per-tick cap, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import faults, rules as R
from fleetlens.operators.ordered import WIDTH, first_per_key, running_total
from fleetlens.session import settle

EVENT_COLUMNS = ("ts", "source", "kind", "severity", "message", "dedup")


def classify(
    records: DataFrame,
    rules: Sequence[R.Rule] = R.RULES,
    benign: Sequence[str] = R.BENIGN,
    *,
    text: str = "text",
    level: str = "level",
) -> DataFrame:
    """Add kind, severity and note; NULL when the record is no fault."""
    found = faults.with_rule_number(records, text, level, "__rule", rules, benign)
    return found.withColumns(faults.rule_fields("__rule", rules)).drop("__rule")


def only_faults(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("kind").isNotNull())


def rule_catalogue(spark, rules: Sequence[R.Rule] = R.RULES) -> DataFrame:
    """One row per kind, from its first rule."""
    rows = [(i, r.kind, r.severity, r.note) for i, r in enumerate(rules, 1)]
    listed = spark.createDataFrame(rows, "position int, kind string, severity string, note string")
    return first_per_key(listed, ["kind"], ["position"])


def tick_counts(
    classified: DataFrame, ticks: DataFrame, keys: Sequence[str] = ("boot_id", "tick")
) -> DataFrame:
    """Messages, criticals and other faults of every tick; a quiet tick counts 0.0."""
    counted = classified.groupBy(*keys).agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("severity") == R.CRITICAL).alias("criticals"),
        F.count_if(F.col("kind").isNotNull() & (F.col("severity") != R.CRITICAL)).alias("errors"),
    )
    spine = ticks.select(*keys).distinct()
    return spine.join(counted, list(keys), "left").select(
        *keys,
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"kmsg_{c}")
            for c in ("messages", "criticals", "errors")
        ],
    )


def replayed_faults(classified: DataFrame, keys: Sequence[str] = ("boot_id",)) -> DataFrame:
    """Faults found in the replay of a boot, stored or not."""
    return classified.groupBy(*keys).agg(F.count_if(F.col("kind").isNotNull()).alias("backfilled"))


def new_only(
    events: DataFrame, known: DataFrame | None = None, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """First row of every key that is not stored yet; rows without a key all pass.

    Rows that miss ts, source or kind are left out. Rows without a key go round
    the shuffle, where they would all meet in one partition.
    """
    valid = events
    for name in ("ts", "source", "kind"):
        if name in events.columns:
            valid = valid.where(F.col(name).isNotNull())
    free = valid.where(F.col("dedup").isNull())
    keyed = first_per_key(valid.where(F.col("dedup").isNotNull()), ["dedup"], order)
    if known is not None:
        stored = known.select("dedup").where(F.col("dedup").isNotNull())
        keyed = keyed.join(stored, "dedup", "left_anti")
    return keyed.select(*events.columns).unionByName(free)


def cap_events(
    records: DataFrame,
    known: DataFrame | None = None,
    *,
    keys: Sequence[str] = ("boot_id", "tick"),
    order: Sequence[str] = ("seq",),
    limit: int = R.EVENTS_PER_TICK,
    width: int = WIDTH,
    used: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed per tick) of classified records.

    `used` (keys, used) tells how many records of a tick are stored already, so a tick
    that comes in several inputs has one budget.

    The first `limit` records that are new to the event table are kept. After
    that every further record of the tick is only counted, known or not. A key
    must occur once per input, as log sequences and journal cursors do; later
    copies of a key are set aside first.
    """
    free = records.where(F.col("dedup").isNull()).withColumn("__new", F.lit(True))
    keyed = first_per_key(records.where(F.col("dedup").isNotNull()), ["dedup"], order)
    if known is None:
        keyed = keyed.withColumn("__new", F.lit(True))
    else:
        stored = known.select("dedup").where(F.col("dedup").isNotNull()).distinct()
        keyed = keyed.join(stored.withColumn("__stored", F.lit(True)), "dedup", "left")
        keyed = keyed.withColumn("__new", F.col("__stored").isNull()).drop("__stored")
    # Both results read this table; without it each would count again.
    counted = settle(running_total(
        keyed.unionByName(free), keys, order, F.col("__new").cast("int"), into="__n", width=width
    ), "counted")
    if used is not None:
        counted = counted.join(used, list(keys), "left").withColumn(
            "__n", F.col("__n") + F.coalesce("used", F.lit(0))
        )
    keep = F.col("__new") & (F.col("__n") <= limit)
    kept = counted.where(keep).select(*records.columns)
    suppressed = (
        counted.where(~keep & (F.col("__n") >= limit))
        .groupBy(*keys)
        .agg(F.count("*").alias("suppressed"), F.max("ts").alias("ts"))
    )
    return kept, suppressed


def storm_events(suppressed: DataFrame, source: str = "kmsg") -> DataFrame:
    """One warning per tick whose surplus was only counted."""
    return suppressed.withColumns({
        "source": F.lit(source),
        "kind": F.lit("event_storm"),
        "severity": F.lit(R.WARNING),
        "message": F.format_string("%d more fault messages not listed", F.col("suppressed")),
        "dedup": F.lit(None).cast("string"),
    }).drop("suppressed")


def as_events(classified: DataFrame, source: str = "kmsg", *keep: str) -> DataFrame:
    """Event rows of classified records; texts get their Xid meaning and are cut."""
    message = faults.truncated(faults.event_message(F.col("kind"), F.col("text")))
    return only_faults(classified).select(
        *keep, "ts", F.lit(source).alias("source"), "kind", "severity",
        message.alias("message"), "dedup",
    )


def capped_faults(classified: DataFrame, known: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """`cap_events` of the faults in classified records.

    The faults, a small part of a log, are settled first, so the patterns run
    over the log once although the steps after them read the faults repeatedly.
    """
    return cap_events(settle(only_faults(classified).drop("note"), "faults"), known, **options)


def log_events(
    classified: DataFrame,
    known: DataFrame | None = None,
    *,
    keys: Sequence[str] = ("boot_id", "tick"),
    order: Sequence[str] = ("seq",),
    source: str = "kmsg",
    limit: int = R.EVENTS_PER_TICK,
) -> DataFrame:
    """Log records to stored events: dedup, cap, storm warning."""
    kept, suppressed = capped_faults(classified, known, keys=keys, order=order, limit=limit)
    return as_events(kept, source, *keys).unionByName(
        storm_events(suppressed, source).select(*keys, *EVENT_COLUMNS)
    )


def register_boots(seen: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First seen row of each boot that is not registered yet, by arrival."""
    first = first_per_key(seen, ["boot_id"], ["arrival"])
    if known is not None:
        first = first.join(known.select("boot_id"), "boot_id", "left_anti")
    return first.select(*seen.columns)


def recent_events(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def events_by_kind(events: DataFrame) -> DataFrame:
    counted = events.groupBy("source", "kind").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "source", "kind")


def fault_scan(
    events: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id",),
    order: Sequence[str] = ("position",),
    examples: int = 6,
) -> DataFrame:
    """Per kind: severity of its first entry, count, first messages, how many more.

    The examples are ranked with a per-task limit before the shuffle, so a kind
    that fills the table sends only a few rows to its task.
    """
    place = Window.partitionBy(*keys, "kind").orderBy(*order)
    shown = (
        events.select(*keys, "kind", *order, "message")
        .withColumn("__n", F.row_number().over(place))
        .where(F.col("__n") <= examples)
        .groupBy(*keys, "kind")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("__n", "message"))), lambda e: e["message"]
        ).alias("examples"))
    )
    totals = events.groupBy(*keys, "kind").agg(
        F.min_by("severity", F.struct(*order)).alias("severity"),
        F.count("*").alias("n"),
        F.count_if(F.col("severity") == R.CRITICAL).alias("criticals"),
    )
    rank = F.when(F.col("severity") == R.CRITICAL, 0).when(F.col("severity") == R.ERROR, 1)
    return totals.join(shown, [*keys, "kind"]).withColumns({
        "more": F.greatest(F.col("n") - examples, F.lit(0)),
        "severity_rank": rank.otherwise(2),
    })
