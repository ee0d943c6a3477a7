"""Completeness and annotation report over the four tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.text import percent
from fleetlens.operators.intervals import mark_labelled, overlapping
from fleetlens.plans.export import in_range
from fleetlens.schema import DAY, RESERVED

_TYPE_NAMES = {T.DoubleType(): "REAL", T.LongType(): "INTEGER", T.StringType(): "TEXT"}


def metric_columns(samples: DataFrame) -> list[str]:
    missing = {"ts", "boot_id"} - set(samples.columns)
    if missing:
        raise ValueError(f"not a sample table, it lacks {sorted(missing)}")
    return [name for name in samples.columns if name not in (*RESERVED, DAY)]


def sample_section(
    samples: DataFrame, labels: DataFrame, since: int | None = None, until: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Count, first and last ts, labelled count and percentage (NULL of nothing).

    With `keys`, a window labels only the samples that share them.
    """
    rows = in_range(samples, since, until).select("ts", *keys)
    marked = mark_labelled(rows, overlapping(labels, since, until), keys)
    totals = marked.agg(
        F.count("*").alias("count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if("labelled").alias("labelled"),
    )
    return totals.withColumn("labelled_pct", percent(F.col("labelled"), F.col("count")))


def metric_section(
    samples: DataFrame, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Present and missing values of every metric column from one pass."""
    rows = in_range(samples, since, until)
    names = metric_columns(samples)
    kinds = {f.name: _TYPE_NAMES.get(f.dataType, f.dataType.simpleString()) for f in samples.schema}
    schema = "position int, column string, type string, present bigint, missing bigint, coverage_pct double"
    if not names:
        return samples.sparkSession.createDataFrame([], schema).drop("position")
    counted = rows.agg(
        F.count("*").alias("__n"), *[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kinds[name]).alias("type"),
            F.col(f"c{i}").alias("present"),
            (F.col("__n") - F.col(f"c{i}")).alias("missing"),
            percent(F.col(f"c{i}"), F.col("__n")).alias("coverage_pct"),
        )
        for i, name in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*entries)))


def boot_section(
    samples: DataFrame, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Per boot: samples, first and last ts, repeated timestamps.

    Counting per (boot, ts) first keeps the exact distinct count of a hot boot
    spread over many tasks.
    """
    per_ts = in_range(samples, since, until).groupBy("boot_id", "ts").agg(F.count("*").alias("n"))
    return per_ts.groupBy("boot_id").agg(
        F.sum("n").alias("samples"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"),
    )


def label_section(
    labels: DataFrame, since: int | None = None, until: int | None = None
) -> DataFrame:
    return overlapping(labels, since, until).agg(
        F.count("*").alias("total"), F.count_if(F.col("ts_end").isNull()).alias("open")
    )


def event_section(
    events: DataFrame, since: int | None = None, until: int | None = None
) -> DataFrame:
    return (
        in_range(events, since, until)
        .groupBy("source", "kind", "severity")
        .agg(F.count("*").alias("count"))
    )


def _as_list(section: DataFrame, order: Sequence[str], shown: Sequence[str], name: str) -> DataFrame:
    """One row with the section's finished rows in order."""
    entry = F.struct(
        F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]).alias("o"),
        F.struct(*shown).alias("v"),
    )
    return section.agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name)
    )


def report_json(
    samples: DataFrame,
    labels: DataFrame,
    events: DataFrame,
    since: int | None = None,
    until: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The whole report as one JSON object.

    Only finished aggregate rows are gathered here: one per boot, column and
    (source, kind, severity). The section functions give the same as tables, and for a
    fleet whose boots don't fit one document they are the report.
    """
    parts = [
        sample_section(samples, labels, since, until, keys).select(F.struct("*").alias("samples")),
        _as_list(boot_section(samples, since, until), ["boot_id"],
                 ["boot_id", "samples", "first_ts", "last_ts", "duplicate_timestamps"], "boots"),
        _as_list(metric_section(samples, since, until), ["position"],
                 ["column", "type", "present", "missing", "coverage_pct"], "metrics"),
        label_section(labels, since, until).select(F.struct("*").alias("labels")),
        _as_list(event_section(events, since, until), ["source", "kind", "severity"],
                 ["source", "kind", "severity", "count"], "events"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    whole = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
    window = F.struct(
        F.lit(since).cast("bigint").alias("since"), F.lit(until).cast("bigint").alias("until")
    )
    document = F.struct(window.alias("window"), "samples", "boots", "metrics", "labels", "events")
    return whole.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))
