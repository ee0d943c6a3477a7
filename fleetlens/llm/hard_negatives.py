"""Hard negatives by rotated one-bit codes with exact intervals.

For every anchor the best rows of its own label are its positives. A hard negative of
a positive is a row of another label that scores almost as high, but no higher.

A vector x is divided by its length, rotated, and described by the signs of its
coordinates: c = sign / sqrt(d) is a unit vector, and the stored alignment a = <x, c>
says how much of x it covers. What is left, x - a c, is at right angles to c and gets a
code of its own, `LEVELS` times; the length rho of the last rest is stored as well. With
a rotated anchor y of length one

    <y, x> = sum of a_l <y, c_l> + <y, rest>,   |<y, rest>| <= rho * sqrt(1 - <y, c_last>^2)

by Cauchy-Schwarz, as the last rest has no part along the last code. The anchor is cut to
`PLANES` bits a coordinate, so <y, c> is a few popcounts; what the cut leaves out adds the
length of that error. The interval holds for certain, not with high probability.

Candidates go through the levels one by one. Those whose interval cannot reach the k-th
best lower end so far, or cannot meet the wanted band, are out; the survivors of the last
level are scored with whole numbers, so results are exact.

Every anchor has to meet every row: both are dealt to a grid of cells of bounded size,
and only the best few of each cell are compared across cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.session import settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores between this share of the positive's score, in hundredths, and all of it.
LEAST_SHARE = 80
LEVELS = 4
PLANES = 8
ANCHORS_PER_CELL = 2048
#: Bytes of vectors in a cell, and the bounds of its rows.
CELL_BYTES = 32 << 20
CELL_ROWS = (2048, 65536)
_SEED = 12
#: Sums of products up to here are exact in 64-bit numbers.
_EXACT = float(1 << 62)
_ROUNDING = 1e-9
_RANGE = (-float(1 << 63), float(1 << 63))


def whole_vectors(
    rows: DataFrame, label: Column | str = "label", column: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(vec_id, label, v) with floor(scale * component); rows that take no part are gone.

    Out: NULL ids or labels, NULL vectors, vectors with a NULL, NaN or infinite component.
    """
    v = F.col(f"`{column}`").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    scaled = F.transform(v, lambda c: c * float(scale))
    # floor() gives a long; taking the remainder off keeps components of any size
    down = F.transform(scaled, lambda c: c - F.pmod(c, F.lit(1.0)))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.when(sound, down).alias("v"))
    return named.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by seeded sign flips and Hadamard transforms, padded to 64 times a power of two."""
    width = 64
    while width < x.shape[1]:
        width *= 2
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(_SEED).integers(0, 2, (3, width)) * 2.0 - 1.0
    for flip in signs:
        out *= flip
        step = 1
        while step < width:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            out = out.reshape(len(x), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and rotated vectors of length one; a zero vector stays zero."""
    # scaled first, so that squares of very large components stay finite
    top = np.abs(x).max(axis=1, initial=0.0)
    small = x / np.where(top > 0, top, 1.0)[:, None]
    norm = np.sqrt((small * small).sum(axis=1))
    return norm * top, rotated(small / np.where(norm > 0, norm, 1.0)[:, None])


@dataclass
class Codes:
    """Code words (rows, levels, words), alignments and rests (rows, levels), lengths."""

    bits: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    norm: np.ndarray


def encode(x: np.ndarray) -> Codes:
    norm, left = _units(x)
    width = left.shape[1]
    bits = np.zeros((len(x), LEVELS, width // 64), np.uint64)
    align, rest = np.zeros((len(x), LEVELS)), np.zeros((len(x), LEVELS))
    for level in range(LEVELS):
        plus = left >= 0
        packed = np.packbits(plus, axis=1, bitorder="little")
        bits[:, level] = packed.view("<u8").reshape(len(x), -1)
        align[:, level] = np.abs(left).sum(axis=1) / np.sqrt(width)
        left = left - np.where(plus, 1.0, -1.0) * (align[:, level] / np.sqrt(width))[:, None]
        rest[:, level] = np.sqrt((left * left).sum(axis=1))
    return Codes(bits, align, rest, norm)


class Anchor:
    """An anchor cut to bit planes, ready for popcounts."""

    def __init__(self, unit: np.ndarray, norm: float):
        self.norm, self.width = norm, len(unit)
        low, high = unit.min(), unit.max()
        self.low, self.step = low, max((high - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((unit - low) / self.step), 0, (1 << PLANES) - 1).astype(np.uint64)
        cut = low + self.step * level
        self.total = cut.sum()
        self.error = float(np.sqrt(((unit - cut) ** 2).sum()))
        planes = [(level >> np.uint64(j) & np.uint64(1)).astype(np.uint8) for j in range(PLANES)]
        self.planes = np.stack([np.packbits(p, bitorder="little").view("<u8") for p in planes])

    def estimate(self, bits: np.ndarray) -> np.ndarray:
        """<cut anchor, code> of code words (rows, words)."""
        ones = np.bitwise_count(bits).sum(axis=1)
        weighted = np.zeros(len(bits))
        for j, plane in enumerate(self.planes):
            weighted += np.bitwise_count(bits & plane).sum(axis=1) * float(1 << j)
        return (2.0 * (self.low * ones + self.step * weighted) - self.total) / np.sqrt(self.width)

    def intervals(self, codes: Codes, rows: np.ndarray, level: int, upto: np.ndarray):
        """(estimate, low, high) of the products with `rows`, `upto` being the levels before."""
        t = self.estimate(codes.bits[rows, level])
        value = upto + codes.align[rows, level] * t
        rest = codes.rest[rows, level]
        # of the last code's direction the rest has no part
        sure = np.maximum(np.abs(t) - self.error, 0.0)
        wide = rest * np.sqrt(np.maximum(1.0 - sure * sure, 0.0)) + self.error * (1.0 + rest) + _ROUNDING
        scale = self.norm * codes.norm[rows]
        return value, np.clip((value - wide) * scale, *_RANGE), np.clip((value + wide) * scale, *_RANGE)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole inner products, clipped to 64 bits."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < _EXACT:
        return x.astype(np.int64) @ q.astype(np.int64)
    least, most = -(1 << 63), (1 << 63) - 1
    return np.array([max(least, min(most, sum(int(a) * int(b) for a, b in zip(row, q)))) for row in x], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    # of the complement, as the smallest number has no negative
    return np.lexsort((ids, ~scores))[:k]


def nearest(anchor: Anchor, q: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: Codes, rows: np.ndarray, k: int):
    """(rows, scores) of the k best of `rows` for one anchor."""
    value = np.zeros(len(rows))
    for level in range(LEVELS):
        value, low, high = anchor.intervals(codes, rows, level, value)
        kept = high >= _kth(low, k)
        rows, value = rows[kept], value[kept]
    scores = _scores(x[rows], q)
    best = _best(scores, ids[rows], k)
    return rows[best], scores[best]


def below_positives(
    anchor: Anchor, q: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: Codes, rows: np.ndarray,
    positives: Sequence[int], k: int, share: int,
):
    """For every positive score: (rows, scores) of the k best within its band."""
    bands = [(-(-share * p // 100), p) for p in positives]
    value = np.zeros(len(rows))
    for level in range(LEVELS):
        value, low, high = anchor.intervals(codes, rows, level, value)
        kept = np.zeros(len(rows), bool)
        for least, most in bands:
            if least <= most:
                sure = low[(low >= least) & (high <= most)]
                kept |= (high >= max(least, _kth(sure, k))) & (low <= most)
        rows, value = rows[kept], value[kept]
    scores = _scores(x[rows], q)
    for least, most in bands:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        best = inside[_best(scores[inside], ids[rows[inside]], k)]
        yield rows[best], scores[best]


def _matrix(column: pa.ChunkedArray, n: int, kind) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, len(flat) // n if n else 0)


class Cell:
    """Candidates and anchors that meet in one task."""

    def __init__(self, table: pa.Table):
        is_anchor = table.column("is_anchor").to_numpy(zero_copy_only=False).astype(bool)
        rows = table.filter(pa.array(~is_anchor))
        self.anchors = table.filter(pa.array(is_anchor))
        n = rows.num_rows
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.x = _matrix(rows.column("v"), n, float)
        bits = _matrix(rows.column("bits"), n, np.int64)
        self.codes = Codes(
            np.ascontiguousarray(bits).view(np.uint64).reshape(n, LEVELS, bits.shape[1] // LEVELS),
            _matrix(rows.column("align"), n, float), _matrix(rows.column("rest"), n, float),
            rows.column("norm").to_numpy(),
        )

    def each(self) -> Iterator[tuple[int, int, int, np.ndarray, Anchor]]:
        """(position, id, label, vector, anchor); none where there is nobody to meet."""
        if not self.anchors.num_rows or not len(self.ids):
            return
        q = _matrix(self.anchors.column("v"), self.anchors.num_rows, float)
        norm, unit = _units(q)
        ids, labels = self.anchors.column("vec_id").to_pylist(), self.anchors.column("label").to_pylist()
        for i in range(len(q)):
            yield i, ids[i], labels[i], q[i], Anchor(unit[i], float(norm[i]))


_FOUND = "anchor long, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _table(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _find_positives(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        cell, out = Cell(table), []
        order = np.argsort(cell.labels, kind="stable")
        sorted_labels = cell.labels[order]
        keys = cell.anchors.column("anchor").to_pylist()
        for i, anchor_id, label, q, anchor in cell.each():
            own = order[np.searchsorted(sorted_labels, label) : np.searchsorted(sorted_labels, label, "right")]
            own = own[cell.ids[own] != anchor_id]
            rows, scores = nearest(anchor, q, cell.x, cell.ids, cell.codes, own, k)
            out += [(keys[i], anchor_id, None, None, int(cell.ids[r]), int(s)) for r, s in zip(rows, scores)]
        return _table(out)

    return run


def _find_negatives(k: int, share: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        cell, out = Cell(table), []
        keys = cell.anchors.column("anchor").to_pylist()
        wanted = cell.anchors.column("positives").to_pylist()
        for i, anchor_id, label, q, anchor in cell.each():
            other = np.flatnonzero(cell.labels != label)
            scores = sorted({p["score"] for p in wanted[i]})
            found = below_positives(anchor, q, cell.x, cell.ids, cell.codes, other, scores, k, share)
            for p_score, (rows, values) in zip(scores, found):
                for p in wanted[i]:
                    if p["score"] == p_score:
                        out += [(keys[i], anchor_id, p["vec_id"], p_score, int(cell.ids[r]), int(s))
                                for r, s in zip(rows, values)]
        return _table(out)

    return run


_CODED = "row long, vec_id long, label long, v array<double>, bits array<long>, align array<double>, rest array<double>, norm double"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # vectors of one length at a time
        lengths = np.diff(batch.column("v").offsets.to_numpy())
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            n = part.num_rows
            codes = encode(_matrix(pa.chunked_array([part.column("v")]), n, float))
            lists = lambda table, kind: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * (table.size // n)), pa.array(table.ravel(), kind)
            )
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("row", "vec_id", "label", "v")],
                 lists(codes.bits.reshape(n, -1).view(np.int64), pa.int64()), lists(codes.align, pa.float64()),
                 lists(codes.rest, pa.float64()), pa.array(codes.norm)],
                names=[f.split()[0] for f in _CODED.split(", ")],
            )


def store_codes(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v) with codes, alignments, rests and lengths, as a stored table."""
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v")
    return settle(numbered.mapInArrow(_coded, _CODED), "one-bit-codes")


def _meet(coded: DataFrame, anchors: DataFrame, dim: int, n: int, n_anchors: int, find) -> DataFrame:
    """All cells of the vectors of one length."""
    cores = coded.sparkSession.sparkContext.defaultParallelism
    most = max(CELL_ROWS[0], min(CELL_ROWS[1], CELL_BYTES // (8 * max(1, dim))))
    x_blocks = max(-(-n // most), min(cores, -(-n // CELL_ROWS[0])))
    q_blocks = max(1, -(-n_anchors // ANCHORS_PER_CELL))
    across = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    no = lambda kind: F.lit(None).cast(kind)
    own = F.size("v") == dim
    x = coded.where(own).select(
        F.lit(False).alias("is_anchor"), no("long").alias("anchor"), "vec_id", "label", "v", "bits", "align", "rest",
        "norm", no(_POSITIVES).alias("positives"), block(x_blocks).alias("xb"), across(q_blocks).alias("qb"),
    )
    q = anchors.where(own).select(
        F.lit(True).alias("is_anchor"), F.col("row").alias("anchor"), "vec_id", "label", "v",
        no("array<long>").alias("bits"), no("array<double>").alias("align"), no("array<double>").alias("rest"),
        no("double").alias("norm"), "positives", across(x_blocks).alias("xb"), block(q_blocks).alias("qb"),
    )
    return x.unionByName(q).groupBy("xb", "qb").applyInArrow(find, _FOUND)


_POSITIVES = "array<struct<vec_id:long,score:long>>"


def mine(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_share: int = LEAST_SHARE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has (vec_id, label, v) as `whole_vectors` gives them; `anchors` says which rows
    are anchors. Positives and negatives have another vec_id than the anchor; repeated rows
    count each, repeated anchors once, and different vectors under one id are anchors of
    their own. Only vectors of the same length are compared; scores are clipped to a long. An anchor without positives, a
    positive below zero and one without negatives give no rows; empty tables give none.
    """
    coded = store_codes(vectors)
    first = coded.where(anchors).groupBy("vec_id", "label", "v").agg(F.min("row").alias("row"))
    chosen = settle(first, "anchors")
    sizes = dict(coded.groupBy(F.size("v")).count().collect())  # as many as there are models
    of_anchors = dict(chosen.groupBy(F.size("v")).count().collect())

    def all_cells(rows: DataFrame, find) -> DataFrame:
        found = coded.sparkSession.createDataFrame([], _FOUND)
        for dim, n in sorted(of_anchors.items()):
            found = found.unionByName(_meet(coded, rows, dim, sizes[dim], n, find))
        return found

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = (
        all_cells(chosen.withColumn("positives", F.lit(None).cast(_POSITIVES)), _find_positives(positives))
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
        .groupBy(F.col("anchor").alias("row"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
        .select("row", F.transform("positives", lambda p: p.dropFields("place")).alias("positives"))
    )
    with_positives = settle(chosen.join(near, "row"), "positives")
    # two positives may be rows of one id and score; they are one
    distinct = with_positives.withColumn("positives", F.array_distinct("positives"))
    order = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    return (
        all_cells(distinct, _find_negatives(negatives, least_share))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
    )
