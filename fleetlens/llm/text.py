"""Words and table access shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`.

    A column alias would be copied into every place that names it, and inside a
    lambda it would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given values alone.

    52 bits of an MD5 over the values, NULLs marked, so that any engine can
    compute the same number.
    """
    marked = [F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *marked)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with `stem` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
