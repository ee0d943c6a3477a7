"""What a machine exposes and what it does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators.derive import monitored
from fleetlens.operators.spine import BOOT, first_ticks, ticks_of

NVME_FIELD = "err_nvme_state"


def _wanted(ticks: DataFrame, boots: Sequence[str], catalogue: Sequence[R.Counter]) -> DataFrame:
    fields = F.array(*[F.lit(c.field) for c in catalogue])
    return ticks.select(*boots).distinct().select(*boots, F.explode(fields).alias("field"))


def counter_coverage(
    counters: DataFrame,
    *,
    boots: Sequence[str] = BOOT,
    catalogue: Sequence[R.Counter] = R.COUNTERS,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Every catalogue counter of every boot, active or absent.

    A counter is active when it could be read at the boot's first tick. `ticks` are those of
    the boots, whatever left them; without it a boot that has no counter row is not known.
    """
    ticks = ticks_of(counters, boots=boots) if ticks is None else ticks
    active = monitored(counters, [*boots, "field"], boots=boots, ticks=ticks).select(
        *boots, "field", F.lit(True).alias("__active")
    )
    return _wanted(ticks, boots, catalogue).join(active.distinct(), [*boots, "field"], "left").select(
        *boots, "field", F.coalesce("__active", F.lit(False)).alias("active")
    )


def missing_counters(
    counters: DataFrame,
    *,
    boots: Sequence[str] = BOOT,
    catalogue: Sequence[R.Counter] = R.COUNTERS,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Catalogue counters a boot does not expose; all of them for a boot without any counter row."""
    covered = counter_coverage(counters, boots=boots, catalogue=catalogue, ticks=ticks)
    return covered.where(~F.col("active")).drop("active")


def source_coverage(
    readings: DataFrame, keys: Sequence[str] = ("boot_id", "source"), value: str = "value",
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Sources with at least one value at their boot's first tick are active.

    What a machine offers is settled when its collection begins, so a source that comes
    later is not active. `ticks` are those of the boots; the readings' own if not given.
    """
    boots = [k for k in keys if k != "source"]
    ticks = ticks_of(readings, boots=boots) if ticks is None else ticks
    began = first_ticks(ticks, boots).withColumnRenamed("tick", "__began")
    at_first = (F.col("tick") == F.col("__began")) & F.col(value).isNotNull()
    return readings.join(began, boots).groupBy(*keys).agg(
        (F.count_if(at_first) > 0).alias("active"), F.min("tick").alias("first_tick")
    )


def machine_coverage(
    readings: DataFrame,
    counters: DataFrame,
    ticks: DataFrame,
    sources: Sequence[str],
    *,
    boots: Sequence[str] = BOOT,
    catalogue: Sequence[R.Counter] = R.COUNTERS,
) -> DataFrame:
    """(boots, part, name, active): one answer per boot for sources and counters alike.

    What is not monitored is listed as well, for a boot that exposes nothing too.
    """
    named = F.explode(F.array(*[F.lit(s) for s in sources])).alias("name")
    active = source_coverage(readings, [*boots, "source"], ticks=ticks).where("active")
    of_sources = ticks.select(*boots).distinct().select(*boots, named).join(
        active.select(*boots, F.col("source").alias("name"), F.lit(True).alias("__active")), [*boots, "name"], "left"
    ).select(*boots, F.lit("source").alias("part"), "name", F.coalesce("__active", F.lit(False)).alias("active"))
    of_counters = counter_coverage(counters, boots=boots, catalogue=catalogue, ticks=ticks).select(
        *boots, F.lit("counter").alias("part"), F.col("field").alias("name"), "active"
    )
    return of_sources.unionByName(of_counters)
