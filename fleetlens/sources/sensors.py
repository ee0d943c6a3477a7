"""Sensor channels, presets, energy zones and GPU readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.spine import at_start, first_ticks, ticks_of
from fleetlens.functions import rules as R
from fleetlens.functions import text as X
from fleetlens.operators.ordered import lookup
from fleetlens.operators.quality import metric_names
from fleetlens.session import settle

SENSOR = ("device", "instance", "channel", "idx")

# The device and the name of its load percentage.
BUSY_DEVICE, BUSY_CHANNEL = "amdgpu", "busy_pct"


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def sensor_catalogue(
    raw: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id",),
    presets: Sequence[R.Preset] = R.PRESETS,
    channels: Sequence[R.Channel] = R.CHANNELS,
) -> DataFrame:
    """Columns a boot's sensors fill: sensor, value file, factor, column name.

    `raw` holds (keys, tick, device, instance, channel, idx, suffix, label, raw).
    The value file readable first is chosen at the boot's first tick and kept; a
    channel with only a label gives no column. The result has one row per sensor
    of a boot, however long the boot was watched.
    """
    by_device = {p.device: p for p in presets}
    preset = F.create_map(*[
        x
        for p in presets
        for x in (
            F.lit(p.device),
            F.struct(
                F.lit(p.prefix).alias("prefix"),
                F.array(*[F.lit(c) for c in p.channels]).alias("channels"),
                F.lit(p.ignore_labels).alias("ignore_labels"),
                F.lit(p.every_instance).alias("every_instance"),
            ),
        )
    ])
    files = F.create_map(*[
        x for c in channels for x in (F.lit(c.channel), F.array(*[F.lit(s) for s in c.suffixes]))
    ])
    known = raw.where(F.col("device").isin(*by_device))
    # First ticks are numbers and found by hashing; a text beside them would have all readings
    # sorted. Stored, one row per boot is known to be small before the readings meet it.
    began = settle(first_ticks(known, keys), "began")
    first = (
        known.join(began, [*keys, "tick"], "left_semi")
        .groupBy(*keys, *SENSOR, "suffix")
        .agg(F.min_by("raw", "tick").alias("__raw"), F.min_by("label", "tick").alias("label"))
    )
    # One row per value file of a boot; all that follows works on this table.
    first = settle(first, "sensors").where(F.col("__raw").isNotNull())
    rated = (
        first.withColumn("__p", F.try_element_at(preset, F.col("device")))
        .withColumn("__rank", F.array_position(F.try_element_at(files, F.col("channel")), F.col("suffix")))
        .withColumn("__place", F.array_position("__p.channels", F.col("channel")))
        .where((F.col("__rank") > 0) & (F.col("__place") > 0))
        .where(F.col("__p.every_instance") | (F.col("instance") == 0))
    )
    chosen = rated.groupBy(*keys, *SENSOR).agg(
        F.min_by(F.struct("suffix", "label", "__p", "__place"), "__rank").alias("__c")
    ).select(*keys, *SENSOR, "__c.*")
    label = X.slug(F.col("label"))
    generic = F.concat("channel", F.col("idx").cast("string"))
    stem = F.when(~F.col("__p.ignore_labels") & (label != ""), label).otherwise(generic)
    prefix = F.concat(
        F.col("__p.prefix"),
        F.when(F.col("instance") > 0, F.col("instance").cast("string")).otherwise(""),
    )
    unit = F.try_element_at(_literal_map({c.channel: c.unit for c in channels}), F.col("channel"))
    # A label used twice gets its channel number, like the second "Composite".
    named = chosen.withColumn("__stem", stem).withColumns({
        "raw_name": F.concat(prefix, F.lit("_"), F.col("__stem"), unit),
        "retry_name": F.concat(prefix, F.lit("_"), F.col("__stem"), F.col("idx").cast("string"), unit),
        "scale": F.try_element_at(_literal_map({c.channel: c.scale for c in channels}), F.col("channel")),
        "__device": F.array_position(F.array(*[F.lit(d) for d in by_device]), F.col("device")),
    }).withColumn("position", F.struct("__device", "instance", "__place", "idx"))
    columns = settle(metric_names(
        named, keys=[*keys, "device", "instance"], order=["position"],
        raw="raw_name", retry="retry_name",
    ).select(*keys, *SENSOR, "suffix", "scale", F.col("name").alias("column")), "columns")
    return _with_busy(columns, first, keys, by_device)


def _with_busy(
    columns: DataFrame, first: DataFrame, keys: Sequence[str], by_device: dict[str, R.Preset],
) -> DataFrame:
    """Add the GPU's busy percentage, which keeps its name against any sensor."""
    group = [*keys, "device", "instance"]
    busy = (
        first.where((F.col("device") == BUSY_DEVICE) & (F.col("channel") == BUSY_CHANNEL))
        .where(F.col("instance") == 0)
        .join(columns.select(*group).distinct(), group, "left_semi")
        .select(*keys, *SENSOR, "suffix", F.lit(1.0).alias("scale"),
                F.lit(f"{by_device[BUSY_DEVICE].prefix}_{BUSY_CHANNEL}").alias("column"))
    ) if BUSY_DEVICE in by_device else columns.limit(0)
    clash = busy.select(*group, F.col("column")).join(columns, [*group, "column"], "left_semi")
    if clash.isEmpty():
        return columns.unionByName(busy)
    # The names in use by the one device that lost its name to the percentage.
    taken = columns.join(clash.select(*group), group, "left_semi").groupBy(*group).agg(
        F.collect_set("column").alias("__taken")
    )
    losing = clash.join(taken, group).select(*group, "column", "__taken")
    free = F.filter(
        F.transform(
            F.sequence(F.lit(2), F.size("__taken") + 2),
            lambda i: X.bounded_name(F.concat("column", F.lit("_"), i.cast("string"))),
        ),
        lambda o: ~F.array_contains("__taken", o),
    )[0]
    renamed = columns.join(losing, [*group, "column"], "left").withColumn(
        "column", F.coalesce(free, F.col("column"))
    )
    return renamed.select(*columns.columns).unionByName(busy)


def sensor_values(
    raw: DataFrame, catalogue: DataFrame, *, keys: Sequence[str] = ("boot_id",)
) -> DataFrame:
    """Long sensor values in user units, named by the catalogue."""
    on = [*keys, *SENSOR, "suffix"]
    joined = lookup(raw.select(*on, "tick", "raw"), catalogue, on, spread="tick", how="inner")
    return joined.select(
        *keys, "tick", "column", (F.col("raw") * F.col("scale")).alias("value")
    )


def energy_zones(
    zones: DataFrame, keys: Sequence[str] = ("boot_id",)
) -> DataFrame:
    """Column name per readable energy zone.

    `zones` holds (keys, zone, zone_name, energy_uj, max_uj) of the first tick,
    zone being `intel-rapl:P` or `intel-rapl:P:S`. Packages get their number
    once a machine has more than one. Zones without a range are left out.
    """
    pattern = r"^intel-rapl:(\d+)(?::(\d+))?$"
    parsed = zones.where(F.col("zone").rlike(pattern)).withColumns({
        "__pkg": F.regexp_extract("zone", pattern, 1),
        "__sub": F.regexp_extract("zone", pattern, 2),
    })
    packages = parsed.where(F.col("__sub") == "").groupBy(*keys).agg(
        (F.count_distinct("zone") > 1).alias("__many")
    )
    shown = F.coalesce(
        F.when(X.strip(F.col("zone_name")) != "", X.strip(F.col("zone_name"))),
        F.when(F.col("__sub") == "", F.concat(F.lit("zone"), F.col("__pkg"))).otherwise(
            F.concat(F.lit("sub"), F.col("__sub"))
        ),
    )
    package = shown.startswith("package")
    stem = F.when(package, F.lit("pkg")).otherwise(X.slug(shown))
    many = F.coalesce(F.col("__many"), F.lit(False))
    numbered = F.concat(F.lit("pkg"), F.col("__pkg"))
    full = F.when(many & (stem == "pkg"), numbered).when(
        many, F.concat(numbered, F.lit("_"), stem)
    ).otherwise(stem)
    usable = parsed.where(F.col("energy_uj").isNotNull() & (F.coalesce("max_uj", F.lit(0)) != 0))
    named = usable.join(packages, list(keys), "left").withColumn(
        "raw", F.concat(F.lit("rapl_"), full, F.lit("_watts"))
    )
    return metric_names(named, keys=keys, order=["zone"]).select(
        *keys, "zone", "max_uj", F.col("name").alias("column")
    )


def gpu_metrics(
    readings: DataFrame,
    *,
    keys: Sequence[str] = ("boot_id", "tick"),
    metrics: Sequence[tuple[str, str, float]] = R.GPU_METRICS,
) -> DataFrame:
    """Long GPU readings (metric, raw) to one wide row per tick.

    A failed reading is NULL and leaves the others alone.
    """
    return readings.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == metric, F.col("raw").cast("double") / F.lit(divisor))).alias(column)
        for metric, column, divisor in metrics
    ])


def supported_metrics(
    readings: DataFrame, keys: Sequence[str] = ("boot_id",), ticks: DataFrame | None = None
) -> DataFrame:
    """Metrics that gave a value at the boot's first tick; only those are monitored.

    `ticks` are those of the boots; the readings' own if not given.
    """
    ticks = ticks_of(readings, boots=keys) if ticks is None else ticks
    return at_start(readings, ticks, keys).where(F.col("raw").isNotNull()).select(*keys, "metric").distinct()
