"""Rates, deltas and utilisation from cumulative values.

A missing reading, the reading after it and a value that went back all give
NULL, never 0. Rows are ordered by tick; ts may repeat or go backwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import rules as R
from fleetlens.functions.text import strip
from fleetlens.operators.ordered import WIDTH, running_total, with_previous
from fleetlens.operators.spine import BOOT, at_start, on_spine, ticks_of


def counter_delta(
    counters: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id", "field"),
    order: Sequence[str] = ("tick",),
    width: int = WIDTH,
) -> DataFrame:
    """Add `delta` of the cumulative column `raw`; a lower value is a new base.

    A gap has to be a row with NULL (`monitored_series` adds them).
    """
    read = counters.withColumn("__ok", F.when(F.col("raw") >= 0, F.col("raw")))
    paired = with_previous(read, keys, order, ["__ok"], width=width)
    step = F.col("__ok") - F.col("prev.__ok")
    return paired.withColumn("delta", F.when(step >= 0, step.cast("double"))).drop("__ok", "prev")


def monitored(
    counters: DataFrame,
    keys: Sequence[str] = ("boot_id", "field"),
    *,
    boots: Sequence[str] = BOOT,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """(keys, tick, raw) of the baseline of every series readable at its boot's first tick.

    `ticks` are the ticks of the boots; those of the counters if not given.
    """
    began = at_start(counters, ticks_of(counters, boots=boots) if ticks is None else ticks, boots)
    return began.where(F.col("raw") >= 0).select(*keys, "tick", "raw")


def monitored_series(
    counters: DataFrame,
    keys: Sequence[str] = ("boot_id", "field"),
    *,
    boots: Sequence[str] = BOOT,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """(keys, tick, raw) of the monitored counters at every tick, NULL in gaps.

    Input for `counter_delta`: after a gap there is no delta, and a counter that could
    not be read when collection began stays out for the whole boot.
    """
    ticks = ticks_of(counters, boots=boots) if ticks is None else ticks
    rows = counters.select(*keys, "tick", "raw")
    return on_spine(rows, ticks, keys, boots=boots, expected=F.col("raw") >= 0)


def _catalogue(catalogue: Sequence[R.Counter]) -> Column:
    """Counter name to (kind, severity, note) as a literal map."""
    pairs = []
    for c in catalogue:
        pairs += [
            F.lit(c.field),
            F.struct(F.lit(c.kind).alias("kind"), F.lit(c.severity).alias("severity"),
                     F.lit(c.note).alias("note")),
        ]
    return F.create_map(*pairs)


def counter_events(
    deltas: DataFrame,
    keys: Sequence[str] = ("boot_id", "field"),
    catalogue: Sequence[R.Counter] = R.COUNTERS,
) -> DataFrame:
    """An event for every counter that moved."""
    moved = deltas.where(F.col("delta") > 0).withColumn(
        "__c", F.try_element_at(_catalogue(catalogue), F.col("field"))
    )
    return moved.where(F.col("__c").isNotNull()).select(
        *keys, "tick",
        F.lit("errcounters").alias("source"),
        F.col("__c.kind").alias("kind"),
        F.col("__c.severity").alias("severity"),
        F.format_string(
            "%s +%d (total %d) — %s", "field", F.col("delta").cast("bigint"), "raw", F.col("__c.note")
        ).alias("message"),
    )


def baseline_events(
    counters: DataFrame,
    keys: Sequence[str] = ("boot_id", "field"),
    catalogue: Sequence[R.Counter] = R.COUNTERS,
    *,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """A warning for every counter already above zero when collection began."""
    started = monitored(counters, keys, ticks=ticks).where(F.col("raw") > 0).withColumn(
        "__c", F.try_element_at(_catalogue(catalogue), F.col("field"))
    )
    return started.where(F.col("__c").isNotNull()).select(
        *keys, "tick",
        F.lit("errcounters").alias("source"),
        F.col("__c.kind").alias("kind"),
        F.lit(R.WARNING).alias("severity"),
        F.format_string("%s=%d when collection started", "field", "raw").alias("message"),
    )


def strict_sum(
    readings: DataFrame, keys: Sequence[str], value: str = "raw", into: str = "total"
) -> DataFrame:
    """Sum per key; NULL as soon as one member is missing or negative."""
    good = F.col(value) >= 0
    return readings.groupBy(*keys).agg(
        F.when(F.count_if(good) == F.count("*"), F.sum(value)).alias(into)
    )


def watts(
    energy: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id", "zone"),
    order: Sequence[str] = ("tick",),
    width: int = WIDTH,
) -> DataFrame:
    """Add `watts` from cumulative microjoules that wrap at `max_uj`.

    Implausible power (above 1 kW, a reset in disguise) and steps without time
    give NULL; the reading still is the base of the next step. A tick without a
    reading has to be a row with NULL (`on_spine`), else its step is bridged.
    """
    paired = with_previous(energy, keys, order, ["energy_uj", "mono_us"], width=width)
    step = F.col("energy_uj") - F.col("prev.energy_uj")
    joules = F.when(step < 0, step + F.col("max_uj")).otherwise(step)
    elapsed = F.col("mono_us") - F.col("prev.mono_us")
    power = F.when(elapsed > 0, joules.cast("double") / elapsed.cast("double"))
    return paired.withColumn("watts", power).withColumn(
        "watts", F.when(F.col("watts") <= R.MAX_WATTS, F.col("watts"))
    ).drop("prev")


def utilisation(now: Column, before: Column) -> Column:
    """Busy share between two lists of time counters (idle is 4th, I/O wait 5th)."""
    steps = F.zip_with(now, before, lambda a, b: a - b)
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    idle = F.get(steps, F.lit(3)) + F.get(steps, F.lit(4))
    usable = (
        (F.size(now) == F.size(before))
        & ~F.exists(steps, lambda x: x < 0)
        & (total > 0)
    )
    return F.when(usable, 1.0 - idle.cast("double") / total.cast("double"))


def cpu_names(
    stats: DataFrame, *, keys: Sequence[str] = ("boot_id",), order: Sequence[str] = ("tick",)
) -> DataFrame:
    """The CPUs of each boot's first snapshot.

    Rows may bring `names` decided earlier, as the state of a stream does.
    """
    first = F.array_sort(F.map_keys(F.min_by("cpus", F.struct(*order))))
    known = F.max("names") if "names" in stats.columns else F.lit(None)
    return stats.groupBy(*keys).agg(F.coalesce(known, first).alias("names"))


def cpu_utilisation(
    stats: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id",),
    order: Sequence[str] = ("tick",),
    keep: Sequence[str] = (),
    width: int = WIDTH,
) -> DataFrame:
    """Busy share per tick and CPU from snapshots with a `cpus` map of counters.

    The map of the snapshot before is compared entry by entry, so a CPU missing
    from one snapshot is NULL there and in the next one. CPUs are fixed by the
    first snapshot of a boot.
    """
    baseline = cpu_names(stats, keys=keys, order=order)
    rows = stats.select(*keys, *order, "cpus", *keep)
    paired = with_previous(rows, keys, order, ["cpus"], width=width)
    # one row per boot: broadcast when measured small, else AQE splits a hot boot
    spread = paired.join(baseline, list(keys), "left").select(
        *keys, *order, *keep, "cpus", "prev", F.explode("names").alias("cpu")
    )
    return spread.select(
        *keys, *order, *keep, "cpu",
        utilisation(
            F.try_element_at("cpus", F.col("cpu")), F.try_element_at("prev.cpus", F.col("cpu"))
        ).alias("util"),
    )


def reader_failures(
    polls: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id", "source"),
    order: Sequence[str] = ("tick",),
    limit: int = R.FAILURE_LIMIT,
    width: int = WIDTH,
) -> DataFrame:
    """First tick at which a source failed `limit` times in a row."""
    runs = running_total(polls, keys, order, F.col("ok").cast("int"), into="__run", width=width)
    place = Window.partitionBy(*keys, "__run").orderBy(*order)
    nth = (
        runs.where(~F.col("ok"))
        .withColumn("__n", F.row_number().over(place))
        .where(F.col("__n") <= limit)
        .where(F.col("__n") == limit)
    )
    return nth.groupBy(*keys).agg(F.min(order[0]).alias("failed_tick"))


def mask_failed(
    rows: DataFrame, failures: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """A source is ignored after the tick that switched it off."""
    joined = rows.join(failures, list(keys), "left")  # one row per source of a boot
    gone = F.col("tick") > F.col("failed_tick")
    masked = {
        c: F.when(gone, F.lit(None)).otherwise(F.col(c)) for c in columns
    }
    return joined.withColumns(masked).drop("failed_tick")


def failure_events(failures: DataFrame, keys: Sequence[str] = ("boot_id", "source")) -> DataFrame:
    return failures.select(
        *[k for k in keys if k != "source"],
        F.col("failed_tick").alias("tick"),
        F.lit("collector").alias("source"),
        F.lit("reader_fail").alias("kind"),
        F.lit(R.WARNING).alias("severity"),
        F.col("source").alias("message"),
    )


def controller_state(state: Column) -> Column:
    """A controller without a readable state counts as absent."""
    bare = strip(state)
    return F.coalesce(F.when(bare != "", bare), F.lit("absent"))


def controller_series(
    states: DataFrame,
    ticks: DataFrame | None = None,
    *,
    keys: Sequence[str] = ("boot_id", "device"),
    boots: Sequence[str] = BOOT,
) -> DataFrame:
    """(keys, tick, state) of the controllers seen when collection began, at every tick.

    A controller that vanished is `absent` until it comes back.
    """
    ticks = ticks_of(states, boots=boots) if ticks is None else ticks
    rows = states.select(*keys, "tick", "state")
    return on_spine(rows, ticks, keys, boots=boots).withColumn("state", controller_state(F.col("state")))


def state_changes(
    states: DataFrame,
    ticks: DataFrame | None = None,
    *,
    keys: Sequence[str] = ("boot_id", "device"),
    width: int = WIDTH,
) -> DataFrame:
    """Events for controllers whose state differs from the tick before.

    `ticks` are the ticks of the boots; those of the states if not given.
    """
    known = controller_series(states, ticks, keys=keys)
    paired = with_previous(known, keys, ["tick"], ["state"], width=width)
    changed = paired.where(F.col("prev.state") != F.col("state"))
    return changed.select(
        *keys, "tick",
        F.lit("errcounters").alias("source"),
        F.lit("nvme_error").alias("kind"),
        F.when(F.col("state") == "live", R.WARNING).otherwise(R.ERROR).alias("severity"),
        F.format_string(
            "%s: controller state %s -> %s", F.col(keys[-1]), F.col("prev.state"), F.col("state")
        ).alias("message"),
    )


def degraded_controllers(
    states: DataFrame,
    ticks: DataFrame | None = None,
    *,
    keys: Sequence[str] = ("boot_id", "device"),
    boots: Sequence[str] = BOOT,
) -> DataFrame:
    """Controllers per tick that are not live, vanished ones included."""
    known = controller_series(states, ticks, keys=keys, boots=boots)
    return known.groupBy(*boots, "tick").agg(
        F.count_if(F.col("state") != "live").cast("double").alias("err_nvme_state")
    )
