"""Ticks and expected series: what should have been read, so that gaps show.

A collector fixes what it watches when a boot's collection begins. From then on a
series has a row at every tick of the boot, NULL where nothing was read. Without
these rows a derivation would bridge the gap to the reading before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOT = ("boot_id",)


def ticks_of(*tables: DataFrame, boots: Sequence[str] = BOOT) -> DataFrame:
    """Every (boot, tick) that any of the tables has a row for."""
    found = None
    for table in tables:
        part = table.select(*boots, "tick")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def first_ticks(ticks: DataFrame, boots: Sequence[str] = BOOT) -> DataFrame:
    """(boot, tick) of the first tick of each boot: one row per boot, narrow columns only."""
    return ticks.groupBy(*boots).agg(F.min("tick").alias("tick"))


def at_start(rows: DataFrame, ticks: DataFrame, boots: Sequence[str] = BOOT) -> DataFrame:
    """The rows of each boot's first tick.

    A join with one row per boot, which is broadcast when measured small, instead of
    an aggregate over all readings; the boot's tick counts, not the series' own.
    """
    return rows.join(first_ticks(ticks, boots), [*boots, "tick"], "left_semi")


def on_spine(
    rows: DataFrame,
    ticks: DataFrame,
    keys: Sequence[str],
    *,
    boots: Sequence[str] = BOOT,
    expected: Column | None = None,
) -> DataFrame:
    """`rows` with a row for every tick of the boot and every expected series.

    `keys` are the columns of a series, the boots first. A series is expected if it
    has a row at the boot's first tick for which `expected` holds; rows of other
    series are dropped. Columns beyond keys and tick are NULL where no row was.
    """
    began = at_start(rows, ticks, boots)
    series = (began if expected is None else began.where(expected)).select(*keys).distinct()
    spine = ticks.select(*boots, "tick").join(series, list(boots))
    return spine.join(rows, [*keys, "tick"], "left")
