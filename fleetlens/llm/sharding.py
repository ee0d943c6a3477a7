"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Documents with equal texts are one group and stay together, so groups of very
different sizes have to be dealt to a few shards. Karmarkar-Karp starts with one
partial partition per group, (size, 0, ..., 0), and repeatedly combines the two
with the largest spread (largest minus smallest sum), the largest part of one
with the smallest of the other, until one partition is left.

At scale this runs in levels. Groups are cut into blocks of about `BLOCK` groups by
their hash; a task differences one block into one partial partition; partial
partitions of up to `FAN` blocks are differenced again, and so on to the last.

A group larger than 1/`HEAVY` of all bytes may outweigh its block, so the at most
`HEAVY` such groups are differenced first. Smaller groups that exceed a shard's share
of a block, and enough of the rest to fill up what the large ones leave uneven, are
dealt to `BINS` bins by hash and differenced with the heavy ones. All others go through
blocks and levels, where parts have no names, and meet that partition as one more
partial partition at the end.

An indivisible group larger than a shard's share gets a shard to itself, and all else
is levelled among the other shards.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.session import settle

SHARDS = 16
HEAVY = 4096
BLOCK = 4096
BINS = 4096
#: Bytes dealt to bins against what the large groups leave uneven.
FILL = 1.5
FAN = 1024
#: Rows that are numbered together within a shard.
NUMBERED = 2048


def difference(parts: Sequence[Sequence[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions into one.

    Returns the sums of the result and, for every input, the place in the result
    that each of its parts went to.
    """
    n = len(parts)
    sums, trees, heap = [], [], []
    for number, part in enumerate(parts):
        order = sorted(range(len(part)), key=part.__getitem__, reverse=True)
        ranked = [part[i] for i in order]
        sums.append(ranked)
        trees.append(order)
        heap.append((ranked[-1] - ranked[0], number))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        mixed = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        last = len(mixed) - 1
        order = sorted(range(len(mixed)), key=mixed.__getitem__, reverse=True)
        sums[a] = sums[b] = None
        ranked = [mixed[i] for i in order]
        sums.append(ranked)
        trees.append((a, b, order, [last - i for i in order]))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(sums) - 1))
    places: list = [None] * len(trees)
    total = sums[-1]
    places[-1] = list(range(len(total)))
    for node in range(len(trees) - 1, n - 1, -1):
        a, b, from_a, from_b = trees[node]
        where = places[node]
        to_a, to_b = [0] * len(where), [0] * len(where)
        for place, i, j in zip(where, from_a, from_b):
            to_a[i] = to_b[j] = place
        places[a], places[b], places[node] = to_a, to_b, None
    found = []
    for number in range(n):
        target = [0] * len(parts[number])
        for place, original in zip(places[number], trees[number]):
            target[original] = place
        found.append(target)
    return total, found


def _single(size: int, shards: int) -> list[int]:
    return [int(size)] + [0] * (shards - 1)


def _block_solver(shards: int):
    def solve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        sums, places = difference([_single(s, shards) for s in block["bytes"].tolist()])
        return pd.DataFrame({
            "key": block["key"].to_numpy(), "block": block["block"].to_numpy(),
            "slot": [p[0] for p in places], "sums": [sums] * len(places),
        })

    return solve


def _merge_solver(level: int):
    def solve(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", kind="stable")
        sums, places = difference([list(map(int, s)) for s in blocks["sums"]])
        return pd.DataFrame({
            "block": blocks["block"].to_numpy(), "above": blocks["block"].to_numpy() // FAN,
            "places": places, "sums": [sums] * len(places),
        })

    return solve


def _block_cut(groups: DataFrame, shares: int) -> tuple[int, int]:
    """A size below which no group exceeds 1/`shares` of the bytes below it, and the largest size from there on."""
    bits = F.length(F.bin("bytes"))
    classes = groups.groupBy(bits).agg(F.sum("bytes"), F.max("bytes")).collect()  # at most 63 rows
    cut, most, below = 0, 0, 0
    for width, size, largest in sorted(map(tuple, classes)):
        below += size
        most = largest
        if largest * shares <= below:
            cut, most = largest + 1, 0
    return cut, most


def assign(groups: DataFrame, shards: int = SHARDS, *, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """(key, bytes) with distinct keys -> (key, shard)."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    big = groups.where(F.col("bytes") * heavy > F.lit(total))  # fewer than `heavy` rows
    weights = sorted(((r["key"], r["bytes"]) for r in big.collect()), key=lambda r: (-r[1], r[0]))
    named, left = [], total
    while shards > 1 and weights and weights[0][1] * shards > left:  # alone in the last shard
        key, b = weights.pop(0)
        shards, left = shards - 1, left - b
        named.append((key, shards))
    small = groups.where(F.col("bytes") * heavy <= F.lit(total))
    blocks = max(1, -(-n // block))
    cut, most = _block_cut(small, shards * blocks) if blocks > 1 else (1 << 63, 0)
    level = None
    if weights or most:
        level, _ = difference([_single(b, shards) for _, b in weights or [("", 0)]])
        uneven = max(level) * shards - sum(level) + most * shards
        share = min(1.0, FILL * uneven / max(left - sum(level), 1))
        blocks = max(1, math.ceil(n * (1 - share) / block))
        filler = F.pmod(F.xxhash64("key", F.lit("fill")), F.lit(1 << 16)) < F.lit(math.ceil(share * (1 << 16)))
        if most:
            filler = filler | (F.col("bytes") >= F.lit(cut))
        bins = F.pmod(F.xxhash64("key", F.lit("bin")), F.lit(BINS)).cast("int")
        filling = small.where(filler).withColumn("bin", bins)
        dealt = sorted(map(tuple, filling.groupBy("bin").agg(F.sum("bytes")).collect()))  # at most BINS rows
        level, places = difference([_single(b, shards) for _, b in [*weights, *dealt]])
        slots = [place[0] for place in places]
        named += [(key, slot) for (key, _), slot in zip(weights, slots)]
        small = small.where(~filler)
    fixed = spark.createDataFrame(named, "key string, shard int")
    if level and dealt:
        where = spark.createDataFrame(
            [(number, slot) for (number, _), slot in zip(dealt, slots[len(weights) :])], "bin int, shard int"
        )
        fixed = fixed.unionByName(filling.join(F.broadcast(where), "bin").select("key", "shard"))
    solved = settle(
        small.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_block_solver(shards), "key string, block long, slot int, sums array<long>"),
        "shard-blocks",
    )
    current = solved.groupBy("block").agg(F.first("sums").alias("sums"))
    chain = solved.select("key", "block", "slot")
    while blocks > 1:
        merged = settle(
            current.withColumn("above", F.expr(f"block DIV {FAN}"))
            .groupBy("above")
            .applyInPandas(
                _merge_solver(FAN), "block long, above long, places array<int>, sums array<long>"
            ),
            "shard-levels",
        )
        chain = chain.join(merged.drop("sums"), "block").select(
            "key", F.col("above").alias("block"), F.get("places", F.col("slot")).alias("slot")
        )
        current = merged.groupBy(F.col("above").alias("block")).agg(F.first("sums").alias("sums"))
        blocks = -(-blocks // FAN)
    last = current.first() if level else None
    if last:
        _, (to_named, to_rest) = difference([level, list(map(int, last["sums"]))])
        shard_at = {place: shard for shard, place in enumerate(to_named)}
        names = F.array(*[F.lit(shard_at[place]) for place in to_rest])
        chain = chain.withColumn("slot", F.get(names, F.col("slot")))
    return chain.select("key", F.col("slot").alias("shard")).unionByName(fixed)


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard).

    size is the UTF-8 length plus 1; a NULL text has length 0 and checksum 0, and
    all NULL texts are one group beside the empty texts. Rows are numbered by a hash
    of id and text, then by id; repeated rows get different slots. Texts are read
    once and only ids, sizes and digests are shuffled.
    """
    t = F.col(f"`{text}`")
    rows = settle(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(t.cast("binary")), F.lit("null")).alias("key"),
        ),
        "shard-rows",
    )
    placed = assign(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards)
    sharded = settle(rows.join(placed, "key"), "sharded")
    most = sharded.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // NUMBERED)
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)))
    ahead = (
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = dealt.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    return (
        dealt.withColumn("place", F.row_number().over(inside))
        .join(starts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        )
    )
