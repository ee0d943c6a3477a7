"""Order-dependent operators that never hold a whole series in one task.

A plain window over (boot, series) sorts that series in a single task. One boot
may own a large share of all rows, so each operator here works in two levels:

1. rows are cut into chunks of `width` units of the order column, and each chunk
   is reduced to one summary row by an aggregate with map-side combine;
2. a window over the summaries (one row per chunk) gives every chunk the value
   it inherits, which joins the chunk as one extra *carry* row. The real window
   then runs inside (series, chunk) only.

The first entry of `order` is the integer column that is cut into chunks; more
entries break ties. The pair must identify a row inside its series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.session import settle

#: Units of the order column in a chunk, for ticks that count up by one; series with
#: other units or rates take `measured_width`.
WIDTH = 1 << 12
#: Rows a chunk should hold.
CHUNK_ROWS = 100_000

# Rows up to which a stored dimension is broadcast, a choice of plan only.
BROADCAST_ROWS = 100_000

_CHUNK, _CARRY, _REAL = "__chunk", "__carry", "__real"


def measured_width(
    df: DataFrame, keys: Sequence[str], order: str, rows: int = CHUNK_ROWS
) -> int:
    """The chunk width at which the densest series has about `rows` rows per chunk.

    One aggregate over keys and order column, with one row per series and task after the
    map side. Series of up to `rows` rows stay whole.
    """
    per_series = df.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max(order) - F.min(order) + 1).alias("span")
    )
    least = per_series.where(F.col("n") > rows).agg(F.min(F.col("span") * rows / F.col("n"))).first()[0]
    return max(1, int(least)) if least is not None else 1 << 62


def _chunked(df: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    return df.withColumn(_CHUNK, F.expr(f"`{order[0]}` div {width}L"))


def _with_carry(staged: DataFrame, heads: DataFrame) -> DataFrame:
    """Add one carry row per chunk; it sorts before the real rows."""
    return staged.withColumn(_REAL, F.lit(1)).unionByName(
        heads.where(F.col(_CARRY).isNotNull()).withColumn(_REAL, F.lit(0)),
        allowMissingColumns=True,
    )


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, _CHUNK).orderBy(_REAL, *order)


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.where(F.col(_REAL) == 1).drop(_CHUNK, _CARRY, _REAL)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    *,
    into: str = "prev",
    width: int = WIDTH,
) -> DataFrame:
    """Add the struct `into` with `columns` of the preceding row, NULL on the first."""
    payload = F.struct(*columns)
    staged = _chunked(df, order, width)
    tails = staged.groupBy(*keys, _CHUNK).agg(
        F.max_by(payload, F.struct(*order)).alias("__tail")
    )
    heads = tails.select(
        *keys,
        _CHUNK,
        F.lag("__tail").over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias(_CARRY),
    )
    value = F.when(F.col(_REAL) == 0, F.col(_CARRY)).otherwise(payload)
    return _drop_helpers(
        _with_carry(staged, heads).withColumn(into, F.lag(value).over(_inside(keys, order)))
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    *,
    into: str,
    width: int = WIDTH,
) -> DataFrame:
    """Add the running integer total of `value` up to and including each row."""
    staged = _chunked(df, order, width).withColumn("__value", value.cast("bigint"))
    sums = staged.groupBy(*keys, _CHUNK).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    heads = sums.select(*keys, _CHUNK, F.sum("__sum").over(before).alias(_CARRY))
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col(_REAL) == 0, F.col(_CARRY)).otherwise(F.col("__value"))
    return _drop_helpers(
        _with_carry(staged, heads).withColumn(into, F.sum(step).over(upto))
    ).drop("__value")


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    *,
    into: str,
    width: int = WIDTH,
) -> DataFrame:
    """Add the largest non-NULL `value` seen up to and including each row."""
    staged = _chunked(df, order, width).withColumn("__value", value)
    tops = staged.groupBy(*keys, _CHUNK).agg(F.max("__value").alias("__top"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    heads = tops.select(*keys, _CHUNK, F.max("__top").over(before).alias(_CARRY))
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col(_REAL) == 0, F.col(_CARRY)).otherwise(F.col("__value"))
    return _drop_helpers(
        _with_carry(staged, heads).withColumn(into, F.max(seen).over(upto))
    ).drop("__value")


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    *,
    into: str,
    width: int = WIDTH,
) -> DataFrame:
    """Add the latest non-NULL `value` at or before each row."""
    staged = _chunked(df, order, width).withColumn("__value", value)
    lasts = staged.groupBy(*keys, _CHUNK).agg(
        F.max_by(
            "__value", F.when(F.col("__value").isNotNull(), F.struct(*order))
        ).alias("__last")
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    heads = lasts.select(
        *keys, _CHUNK, F.last("__last", ignorenulls=True).over(before).alias(_CARRY)
    )
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col(_REAL) == 0, F.col(_CARRY)).otherwise(F.col("__value"))
    return _drop_helpers(
        _with_carry(staged, heads).withColumn(into, F.last(seen, ignorenulls=True).over(upto))
    ).drop("__value")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    into: str,
    width: int = WIDTH,
) -> DataFrame:
    """Add 1, 2, 3, ... in order, without one task seeing the whole series."""
    return running_total(df, keys, order, F.lit(1), into=into, width=width)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The first whole row of each key.

    An aggregate instead of `row_number() = 1`: copies of a hot key are combined
    before the shuffle.
    """
    rest = [name for name in df.columns if name not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    )
    return first.select(
        *[F.col(n) if n in keys else F.col(f"__first.`{n}`").alias(n) for n in df.columns]
    )


def lookup(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    *,
    spread: str,
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Join one-row-per-key `dimension` onto facts whose keys may be hot.

    The dimension is copied `salts` times and the rows of a key are dealt to the
    copies by the hash of `spread`, so no key lands in one task as a whole.

    An inner join may be built from either side, and the planner would send facts whose size it
    underrates (unpacked arrays, compressed files) through the driver. There the dimension is
    stored and counted: it is broadcast if small, and neither side is if not.
    """
    if how == "inner":
        dimension = settle(dimension, "dimension")
        if dimension.count() <= BROADCAST_ROWS:
            return facts.join(F.broadcast(dimension), list(on), how)
        dimension, facts = dimension.hint("merge"), facts.hint("merge")
    copies = dimension.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    dealt = facts.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")
