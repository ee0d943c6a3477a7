"""Chunked operators against a plain walk through the rows, over many chunk widths."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ordered as O


def series(seed, n=120):
    rng = random.Random(seed)
    ticks = sorted(rng.sample(range(-200, 2000), n))
    return [
        (rng.choice("ab"), t, rng.choice([None, *range(6)])) for t in ticks
    ]


def walk(data, step):
    out, state = {}, {}
    for key, tick, value in data:
        state[key], out[key, tick] = step(state.get(key), tick, value)
    return out


CASES = {
    "previous": (
        lambda df, w: O.with_previous(df, ["key"], ["tick"], ["tick", "value"], width=w).select(
            "key", "tick", F.col("prev.tick"), F.col("prev.value")),
        lambda prev, t, v: ((t, v), prev or (None, None)),
    ),
    "total": (
        lambda df, w: O.running_total(df, ["key"], ["tick"], F.coalesce("value", F.lit(0)), into="x", width=w)
        .select("key", "tick", "x"),
        lambda total, t, v: ((total or 0) + (v or 0), ((total or 0) + (v or 0),)),
    ),
    "max": (
        lambda df, w: O.running_max(df, ["key"], ["tick"], F.col("value"), into="x", width=w)
        .select("key", "tick", "x"),
        lambda top, t, v: (lambda m: (m, (m,)))(v if top is None else top if v is None else max(top, v)),
    ),
    "last": (
        lambda df, w: O.last_known(df, ["key"], ["tick"], F.col("value"), into="x", width=w)
        .select("key", "tick", "x"),
        lambda last, t, v: (lambda m: (m, (m,)))(last if v is None else v),
    ),
    "number": (
        lambda df, w: O.numbered(df, ["key"], ["tick"], into="x", width=w).select("key", "tick", "x"),
        lambda n, t, v: ((n or 0) + 1, ((n or 0) + 1,)),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_a_walk(spark, name):
    operator, step = CASES[name]
    for seed, width in ((1, 7), (2, 100), (3, 1 << 17)):
        data = series(seed)
        df = spark.createDataFrame(data, "key string, tick bigint, value bigint").repartition(3)
        got = {(r[0], r[1]): tuple(r)[2:] for r in operator(df, width).collect()}
        assert got == walk(data, step)


def test_no_window_spans_a_whole_series(spark):
    df = spark.createDataFrame(series(4), "key string, tick bigint, value bigint")
    plan = O.with_previous(df, ["key"], ["tick"], ["value"], width=9)._jdf.queryExecution().toString()
    assert "__chunk" in plan.split("Optimized Logical Plan")[1]


def test_series_without_key(spark, rows):
    df = spark.range(1000).select(F.col("id").alias("tick"))
    out = O.numbered(df, [], ["tick"], into="n", width=37)
    assert rows(out, "tick", "n") == [(i, i + 1) for i in range(1000)]


def test_first_per_key_and_lookup(spark, rows):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None)], "k string, o int, v string")
    assert rows(O.first_per_key(df, ["k"], ["o"]), "k", "o", "v") == [("a", 1, "y"), ("b", 2, None)]
    dim = spark.createDataFrame([("a", 10)], "k string, d int")
    assert rows(O.lookup(df, dim, ["k"], spread="o"), "k", "o", "d") == [("a", 1, 10), ("a", 3, 10), ("b", 2, None)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_an_inner_lookup_never_sends_the_facts_through_the_driver(spark, monkeypatch, most):
    """Facts unpacked from short rows look small; here they even look smaller than the dimension."""
    from fleetlens.operators import ordered

    monkeypatch.setattr(ordered, "BROADCAST_ROWS", most, raising=False)
    facts = spark.range(40).selectExpr("id % 5 AS k", "explode(sequence(0, 99)) AS t")
    wide = spark.range(7).withColumn("j", F.lit(1))
    dimension = wide.join(wide.selectExpr("id AS other", "j"), "j").where("id = other").selectExpr("id AS k", "id * 10 AS v")
    found = ordered.lookup(facts, dimension, ["k"], spread="t", how="inner")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0)
    assert sorted(r.v for r in found.collect()) == sorted(k % 5 * 10 for k in range(40) for _ in range(100))
