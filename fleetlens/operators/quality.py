"""Keeping rows inside the column contract: values, columns, names, identity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetlens.functions import rules as R
from fleetlens.functions import text as X
from fleetlens.operators.ordered import WIDTH, numbered
from fleetlens.schema import METRIC_TYPES
from fleetlens.session import settle


def _clean_variant(value: Column, name: str, kind: str) -> Column:
    """An untyped value: its own type decides, nothing is parsed out of a text."""
    found = F.schema_of_variant(value)
    if kind == "TEXT":
        return F.when(found == "STRING", F.try_validate_utf8(F.expr(f"try_variant_get(`{name}`, '$', 'string')")))
    number = F.expr(f"try_variant_get(`{name}`, '$', 'double')")
    whole = F.expr(f"try_variant_get(`{name}`, '$', 'bigint')")
    flag = F.expr(f"try_variant_get(`{name}`, '$', 'boolean')")
    in_range = ~found.rlike(r"^DECIMAL\(\d+,0\)$") | whole.isNotNull()
    if kind == "INTEGER":
        return F.when(found == "BOOLEAN", flag.cast("bigint")).when(
            found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (whole.cast("double") == number), whole
        )
    return F.when(found == "BOOLEAN", flag.cast("double")).when(
        found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & in_range, X.finite(number)
    )


def clean_value(df: DataFrame, name: str, kind: str) -> Column:
    """Column `name` as REAL, INTEGER or TEXT; what does not fit becomes NULL."""
    source = df.schema[name].dataType
    value = F.col(f"`{name}`")
    target = METRIC_TYPES[kind]
    if isinstance(source, T.VariantType):
        return _clean_variant(value, name, kind)
    if kind == "TEXT":
        return F.try_validate_utf8(value) if isinstance(source, T.StringType) else F.lit(None).cast(target)
    if not isinstance(source, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast(target)
    if kind == "INTEGER":
        if isinstance(source, T.BooleanType):
            return value.cast("bigint")
        whole = value.try_cast("bigint")
        return F.when(whole.cast("double") == value.cast("double"), whole)
    if isinstance(source, T.DecimalType) and source.scale == 0:
        return value.try_cast("bigint").cast("double")
    return X.finite(value)


def sanitize(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Clean the declared columns; the other columns of a row stay as they are."""
    return df.withColumns({n: clean_value(df, n, k) for n, k in types.items() if n in df.columns})


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Bring rows to a stored schema: (rows, names of dropped columns).

    Missing columns become NULL. An incoming sample_id is dropped as well,
    because the table numbers its rows itself.
    """
    stored = [f for f in schema if f.name != "sample_id"]
    known = {f.name for f in stored}
    dropped = sorted(set(df.columns) - known)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in stored
    ]), dropped


def scale(df: DataFrame, factors: Mapping[str, tuple[str, float]]) -> DataFrame:
    """New columns from raw ones: {target: (source, factor)}; NULL stays NULL."""
    return df.withColumns({
        target: F.col(source) * F.lit(float(factor)) for target, (source, factor) in factors.items()
    })


def metric_names(
    found: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id",),
    order: Sequence[str] = ("position",),
    raw: str = "raw",
    retry: str | None = None,
) -> DataFrame:
    """Add a valid `name` per discovered raw label, unique inside `keys`.

    A taken name is followed by `retry` (by default the label itself with _2,
    then _3, ...) in discovery order. Usually no such name meets another label
    that happens to end in _2, and counting inside equal labels is the answer.
    Only names that share a first word with such a clash are settled one after
    the other. What is grouped is one device inventory (taken once per boot),
    not readings.
    """
    base = found.withColumn("__base", X.metric_base(F.col(raw)))
    base = base.withColumn("__again", X.metric_base(F.col(retry)) if retry else F.lit(None).cast("string"))
    same = Window.partitionBy(*keys, "__base").orderBy(*order)
    nth = F.col("__nth")
    second = F.coalesce("__again", F.concat("__base", F.lit("_"), nth.cast("string")))
    tried = base.withColumn("__nth", F.row_number().over(same)).withColumns({
        "__try": X.bounded_name(F.when(nth == 1, F.col("__base")).otherwise(second)),
        # All names a label can get share its first word, cut like a bounded name.
        "__family": F.left(F.split("__base", "_")[0], F.lit(X.NAME_KEEP)),
    })
    tried = settle(tried, "names")
    clash = (
        tried.groupBy(*keys, "__family", "__try").agg(F.count("*").alias("__n"))
        .where(F.col("__n") > 1).select(*keys, "__family").distinct()
    )
    if clash.isEmpty():
        return tried.select(*found.columns, F.col("__try").alias("name"))
    on = [*keys, "__family"]
    easy = tried.join(clash, on, "left_anti").withColumn("name", F.col("__try"))
    hard = _settle(tried.join(clash, on, "left_semi"), on, order, found.columns)
    return easy.select(*found.columns, "name").unionByName(hard)


def _settle(rows: DataFrame, on: Sequence[str], order: Sequence[str], shown: Sequence[str]) -> DataFrame:
    entry = F.struct(*order, "__base", "__again", F.struct(*shown).alias("row"))

    def free_name(taken: Column, entry: Column) -> Column:
        stem = F.coalesce(entry["__again"], entry["__base"])
        # A label with its own retry name tries that one bare, too.
        first = F.when(entry["__again"].isNull(), 2).otherwise(1)
        numbers = F.sequence(first, F.size(taken) + 2)
        options = F.concat(
            F.array(X.bounded_name(entry["__base"])),
            F.transform(numbers, lambda i: X.bounded_name(
                F.when(i == 1, stem).otherwise(F.concat(stem, F.lit("_"), i.cast("string")))
            )),
        )
        # More options than taken names, so one is free.
        return F.filter(options, lambda o: ~F.array_contains(taken, o))[0]

    named = rows.groupBy(*on).agg(F.array_sort(F.collect_list(entry)).alias("__rows")).withColumn(
        "__names",
        F.aggregate(
            "__rows", F.array().cast("array<string>"),
            lambda taken, e: F.concat(taken, F.array(free_name(taken, e))),
        ),
    )
    pairs = named.select(
        F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__names").alias("n"))).alias("p")
    )
    return pairs.select("p.r.row.*", F.col("p.n").alias("name"))


def sample_identity(
    rows: DataFrame,
    *,
    keys: Sequence[str] = (),
    arrival: Sequence[str] = ("arrival",),
    start: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """Number samples 1, 2, 3 ... by arrival, never by ts."""
    return numbered(rows, keys, arrival, into="sample_id", width=width).withColumn(
        "sample_id", F.col("sample_id") + start
    )


def boot_identity(boot: Column) -> Column:
    bare = X.strip(boot)
    return F.coalesce(F.when(bare != "", bare), F.lit(R.UNKNOWN_BOOT))


def natural_key(name: Column) -> tuple[Column, Column]:
    """Sort key that puts dev2 before dev10 and unnumbered names last."""
    number = F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")
    return F.coalesce(number, F.lit(1 << 30).cast("bigint")), name


def device_inventory(
    devices: DataFrame, keys: Sequence[str] = ("boot_id",), name: str = "name", path: str = "path"
) -> DataFrame:
    """Every device name of a machine with its paths in natural order.

    Repeated sightings of a path are merged before the lists are built, so a
    list holds the devices of one machine.
    """
    seen = devices.where(F.coalesce(F.col(name), F.lit("")) != "").select(*keys, name, path).distinct()
    number, text = natural_key(F.col(path))
    entry = F.struct(number.alias("n"), text.alias("p"))
    return seen.groupBy(*keys, name).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["p"]).alias("paths")
    )
