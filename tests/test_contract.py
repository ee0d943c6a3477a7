import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schema
from fleetlens.operators import quality as Q
from fleetlens.sources.registry import MetricSource, SourceRegistry


@pytest.mark.parametrize("fields, texts, types", [
    ("abc", (), {}), (["Bad"], (), {}), ([5], (), {}), (["a" * 64], (), {}), (["ts"], (), {}), (["a", "a"], (), {}),
    (["a"], "a", {}), (["a"], ["b"], {}), (["a"], (), {"a": "BLOB"}), (["a"], (), {"a": "TEXT"}),
    (["a"], ["a"], {"a": "REAL"}), (["a"], (), {"b": "REAL"}),
])
def test_contract_refusals(fields, texts, types):
    with pytest.raises(ValueError):
        schema.check_contract(fields, texts, types)


def test_contract():
    assert schema.check_contract(["a", "b", "c"], ["b"], {"c": "INTEGER"}) == {"a": "REAL", "b": "TEXT", "c": "INTEGER"}


def test_registry(spark, rows):
    raw = spark.createDataFrame([("b", 1), ("b", 2)], "boot_id string, tick bigint")
    registry = SourceRegistry()
    registry.register(MetricSource(
        "x", ["x_v", "x_gone"], lambda r: r.select("boot_id", "tick", F.col("tick").alias("x_v"), F.lit(1).alias("oops")),
        events=lambda r: r.select("tick", F.lit("k").alias("kind")),
    ))
    with pytest.raises(ValueError):  # the whole source is refused
        registry.register(MetricSource("y", ["y_v", "x_v"], lambda r: r))
    with pytest.raises(ValueError):
        registry.register(MetricSource("x", ["z"], lambda r: r))
    registry.register(MetricSource("y", ["y_v"], lambda r: r.where("tick = 2").select("boot_id", "tick", F.lit("t").alias("y_v")),
                                   text_fields=["y_v"]))
    clean, undeclared = registry.rows("x", raw, ["boot_id", "tick"])
    assert undeclared == ["oops"] and clean.columns == ["boot_id", "tick", "x_v", "x_gone"]
    assert rows(registry.assemble(raw, raw), "tick", "x_v", "x_gone", "y_v") == [(1, 1.0, None, None), (2, 2.0, None, "t")]
    assert rows(registry.events(raw), "tick", "source") == [(1, "x"), (2, "x")]
    assert SourceRegistry().events(raw) is None


def test_sanitize_typed(spark):
    df = spark.createDataFrame(
        [(float("nan"), "12.5", True, 5, "ok", [1]), (float("inf"), "x", False, None, None, None), (1.5, None, None, 7, "", [])],
        "d double, s string, b boolean, i int, t string, l array<int>",
    ).coalesce(1)
    out = Q.sanitize(df, {"d": "REAL", "s": "REAL", "b": "REAL", "i": "INTEGER", "t": "TEXT", "l": "REAL"})
    assert [tuple(r) for r in out.collect()] == [
        (None, None, 1.0, 5, "ok", None), (None, None, 0.0, None, None, None), (1.5, None, None, 7, "", None)]


def test_sanitize_untyped(spark):
    values = ["12", '"12.5"', "[1]", '{"a":1}', "true", str(2**63), str(2**63 - 1), "1.5", "1e3", "null", '"w"']
    df = spark.createDataFrame([(v, v, v) for v in values], "r string, n string, t string").coalesce(1)
    df = df.select(*[F.parse_json(c).alias(c) for c in df.columns])
    out = Q.sanitize(df, {"r": "REAL", "n": "INTEGER", "t": "TEXT"}).collect()
    assert [r.r for r in out] == [12.0, None, None, None, 1.0, None, float(2**63 - 1), 1.5, 1000.0, None, None]
    assert [r.n for r in out] == [12, None, None, None, 1, None, 2**63 - 1, None, 1000, None, None]
    assert [r.t for r in out] == [None, "12.5", None, None, None, None, None, None, None, None, "w"]


def test_conform(spark):
    df = spark.createDataFrame([(9, 1, "b", 2.5)], "sample_id bigint, ts bigint, boot_id string, extra double")
    stored = T.StructType([*schema.SAMPLES.fields, T.StructField("a", T.DoubleType())])
    out, dropped = Q.conform(df, stored)
    assert dropped == ["extra", "sample_id"] and [tuple(r) for r in out.collect()] == [(1, "b", None)]


def walk_names(raws):
    """Names in order; the hash part is checked by shape only."""
    taken = []
    for raw in raws:
        base = re.sub("[^a-z0-9]+", "_", raw.strip().lower()).strip("_") or "metric"
        base = f"metric_{base}" if base[0].isdigit() else base
        n, name = 1, base
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.append(name)
    return taken


def names(spark, raws):
    df = spark.createDataFrame([("b", i, r) for i, r in enumerate(raws)], "boot_id string, position bigint, raw string")
    return [r.name for r in Q.metric_names(df.repartition(2)).orderBy("position").collect()]


def test_metric_names(spark):
    long = "a" * 100
    got = names(spark, ["temp_tctl", "9 volts", "???", long + "x", long + "y", long + "x", "temp_tctl", "temp_tctl_2"])
    assert got[:3] == ["temp_tctl", "metric_9_volts", "metric"]
    assert got[6:] == ["temp_tctl_2", "temp_tctl_2_2"]
    assert len(set(got)) == 8 and all(schema.check_name(n) for n in got)
    assert all(re.fullmatch("a{50}_[0-9a-f]{12}", n) for n in got[3:6])


@pytest.mark.parametrize("seed", range(2))
def test_metric_names_match_a_walk(spark, seed):
    rng = random.Random(seed)
    raws = [rng.choice(["T", "T 2", "t_2", "T 3", "t_2_2", "u", "U_2", "v", "7"]) for _ in range(40)]
    assert names(spark, raws) == walk_names(raws)


def test_identity(spark, rows):
    df = spark.createDataFrame([(30, 9), (10, 3), (10, 4)], "ts bigint, arrival bigint")
    out = Q.sample_identity(df, start=100, width=2)
    assert rows(out, "sample_id", "ts") == [(101, 10), (102, 10), (103, 30)]
    boots = spark.createDataFrame([(" x\n",), ("",), (None,), (" \t",)], "b string").coalesce(1)
    assert [r[0] for r in boots.select(Q.boot_identity(F.col("b"))).collect()] == ["x"] + ["unknown-boot"] * 3


def test_devices(spark):
    df = spark.createDataFrame(
        [("b", "nvme", f"hwmon{i}") for i in (10, 2, 2, 0)] + [("b", None, "hwmon5"), ("b", "", "hwmon6"), ("b", "nvme", "odd")],
        "boot_id string, name string, path string",
    )
    (row,) = Q.device_inventory(df).collect()
    assert (row.name, row.paths) == ("nvme", ["hwmon0", "hwmon2", "hwmon10", "odd"])


def test_scale(spark):
    df = spark.createDataFrame([(45250,), (None,)], "m bigint").coalesce(1)
    assert [r.c for r in Q.scale(df, {"c": ("m", 1e-3)}).collect()] == [45.25, None]
