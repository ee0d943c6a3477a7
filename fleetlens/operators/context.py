"""Window, process and tick context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators.ordered import WIDTH, last_known, lookup, with_previous
from fleetlens.session import settle


def is_gaming(window: Column, hints: Sequence[str] = R.GAMING_HINTS) -> Column:
    """1.0 on a hint, 0.0 for any other known window, NULL for an unknown one."""
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(F.lower(window), F.lit(hint))
    return F.when(window.isNotNull(), found.cast("double"))


def is_compositing(busy: Column, gaming: Column) -> Column:
    """1.0 when the GPU works without a game, NULL when that cannot be told."""
    return (
        F.when(busy.isNull(), F.lit(None).cast("double"))
        .when((busy == 0) | (gaming == 1.0), 0.0)
        .when(gaming == 0.0, 1.0)
    )


def as_of_context(
    ticks: DataFrame,
    polls: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id",),
    time: str = "ts",
    tie: str = "id",
    value: str = "active_window",
    width: int = WIDTH,
) -> DataFrame:
    """Give every tick the latest poll at or before it.

    The poll travels as a struct: a failed poll (NULL inside) replaces the value
    before it, while ticks (NULL struct) do not.
    """
    seen = polls.select(*keys, time, tie, F.struct(value).alias("__poll"), F.lit(0).alias("__kind"))
    asked = ticks.withColumns({
        "__poll": F.lit(None).cast(seen.schema["__poll"].dataType), "__kind": F.lit(1)
    })
    stream = asked.unionByName(seen, allowMissingColumns=True)
    filled = last_known(
        stream, keys, [time, "__kind", tie], F.col("__poll"), into="__last", width=width
    )
    return (
        filled.where(F.col("__kind") == 1)
        .withColumn(value, F.col(f"__last.{value}"))
        .drop("__poll", "__last", "__kind")
    )


def top_process(
    procs: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id",),
    clock_ticks: int = R.CLOCK_TICKS,
    width: int = WIDTH,
) -> DataFrame:
    """Per tick: number of processes, the busiest one and its CPU percentage.

    A process counts when the scan just before held the same pid with the same
    start time. Rows with NULL jiffies are processes that could not be read.
    Ties go to the lowest pid.
    """
    scans = procs.groupBy(*keys, "tick").agg(
        F.max("mono_us").alias("mono_us"), F.count("*").alias("n_procs")
    )
    paired = with_previous(scans, keys, ["tick"], ["tick", "mono_us"], width=width).select(
        *keys, "tick", "n_procs",
        F.col("prev.tick").alias("__before"),
        (F.col("mono_us") - F.col("prev.mono_us")).alias("__elapsed"),
    )
    paired = settle(paired, "scans")
    readable = procs.where(F.col("jiffies").isNotNull() & F.col("starttime").isNotNull())
    spans = paired.select(*keys, "tick", "__before", "__elapsed").where(F.col("__elapsed") > 0)
    now = lookup(
        readable.select(*keys, "tick", "pid", "comm", "jiffies", "starttime"),
        spans, [*keys, "tick"], spread="pid", how="inner",
    )
    before = readable.select(
        *keys, F.col("tick").alias("__before"), "pid", "starttime", F.col("jiffies").alias("__was")
    )
    shares = now.join(before, [*keys, "__before", "pid", "starttime"]).where(
        F.col("jiffies") >= F.col("__was")
    ).withColumn(
        "pct",
        (F.col("jiffies") - F.col("__was")) / F.lit(float(clock_ticks))
        / (F.col("__elapsed") / F.lit(1e6)) * 100.0,
    )
    best = shares.groupBy(*keys, "tick").agg(
        F.max("pct").alias("top_proc_cpu"),
        F.max_by("comm", F.struct(F.col("pct"), -F.col("pid"))).alias("__name"),
    )
    return paired.join(best, [*keys, "tick"], "left").select(
        *keys, "tick", "n_procs", "top_proc_cpu",
        F.when(F.col("top_proc_cpu") > 0, F.col("__name")).alias("top_proc_name"),
    )


def assemble_ticks(
    spine: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str] = ("boot_id", "tick")
) -> DataFrame:
    """One wide row per tick from the rows of every source.

    All parts are stacked and grouped once, instead of one join per source. A
    source without a row leaves NULLs; ticks that are not in the spine are left out.
    """
    extra = [name for name in spine.columns if name not in keys]
    stacked = spine.withColumn("__spine", F.lit(1))
    names: list[str] = []
    for part in parts:
        names += [c for c in part.columns if c not in keys]
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    merged = stacked.groupBy(*keys).agg(
        F.max("__spine").alias("__spine"), *[F.max(c).alias(c) for c in [*extra, *names]]
    )
    return merged.where(F.col("__spine") == 1).drop("__spine")


def pivot_ticks(
    readings: DataFrame,
    columns: Mapping[str, str] | Sequence[str],
    *,
    keys: Sequence[str] = ("boot_id", "tick"),
    name: str = "metric",
    value: str = "value",
) -> DataFrame:
    """Long readings to one wide row per tick with a fixed list of columns."""
    wanted = list(columns)
    return readings.groupBy(*keys).agg(*[
        F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in wanted
    ])
