"""Connected components of a link table, for graphs of any shape and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import settle


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.col("a") % 1000003), F.sum(F.col("b") % 1000003), F.bit_xor(F.xxhash64("a", "b"))
    ).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is linked to the vertex's least neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A vertex and its neighbours below it are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select("a", "b", "m")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .where("a <> b")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (id, root): the least id reachable.

    Alternating large-star and small-star steps, whose number grows with the
    logarithm of the vertices. Vertices without a link have no row. Links never
    leave the cluster; each round is settled in the shared folder, and a vertex
    with very many links is reduced before the shuffle (minimum) or split by the
    skew join.
    """
    current = settle(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = _state(current)
    while seen[0]:
        current = settle(_small_star(_large_star(current)), "links")
        now = _state(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
