"""Text and number helpers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a metric name (length, kept prefix, hash digits).
NAME_MAX, NAME_KEEP, NAME_HASH = 63, 50, 12

# The characters that count as white space.
BLANKS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space (Spark's trim knows spaces only)."""
    return F.btrim(text, F.lit(BLANKS))


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def tokens(text: Column) -> Column:
    """Words of a kernel file, separated by blanks, tabs or line ends.

    A split by one plain character compiles no pattern per row.
    """
    plain = _replaced(_replaced(_replaced(text, "\t", " "), "\n", " "), "\r", " ")
    return F.filter(F.split(plain, " "), lambda word: word != "")


def lines(text: Column) -> Column:
    """Lines of a kernel file; `\\r\\n` leaves an empty line behind."""
    return F.split(_replaced(text, "\r", "\n"), "\n")


def whole_number(text: Column, kind: str = "bigint") -> Column:
    """An optionally signed decimal integer with blanks around it, else NULL."""
    bare = strip(text)
    unusual = F.when(
        bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
        F.regexp_replace(bare, "_", "").try_cast(kind),
    )
    # The plain cast settles nearly all; digit groups and long numbers are left over.
    return F.coalesce(text.try_cast("bigint").cast(kind), unusual)


def digits(text: Column) -> Column:
    """An unsigned integer made of digits only, else NULL."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def real_number(text: Column) -> Column:
    """A finite or infinite decimal number, else NULL."""
    return strip(text).try_cast("double")


def slug(text: Column) -> Column:
    """Lower case, every run of other characters turned into one underscore."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""
    )


def bounded_name(name: Column) -> Column:
    """Names over 63 characters keep 50 and get 12 hash digits."""
    short = F.concat(
        F.left(name, F.lit(NAME_KEEP)), F.lit("_"), F.left(F.sha2(name, 256), F.lit(NAME_HASH))
    )
    return F.when(F.length(name) <= NAME_MAX, name).otherwise(short)


def metric_base(raw: Column) -> Column:
    """A metric name before collisions are settled."""
    base = slug(raw)
    base = F.when(base == "", F.lit("metric")).otherwise(base)
    return F.when(base.rlike("^[0-9]"), F.concat(F.lit("metric_"), base)).otherwise(base)


def finite(value: Column) -> Column:
    """Keep finite doubles, everything else becomes NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def percent(part: Column, total: Column) -> Column:
    """NULL instead of a percentage of nothing."""
    return F.try_divide(part.cast("double"), total.cast("double")) * 100


def all_of(*conditions: Column) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def compute(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once.

    They come out of a generator. A filter on a plain projection is pushed below
    it together with a copy of the expressions; below a generator it is not.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(row)))
