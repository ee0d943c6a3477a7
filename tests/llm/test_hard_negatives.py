"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest

from fleetlens.llm import hard_negatives as hn
from fleetlens.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Every row against every anchor with whole numbers."""
    sound = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        sound.append((vec_id, label, tuple(math.floor(256 * c) for c in v)))
    out = []
    for a_id, a_label, a in sorted({r for r in sound if r[0] % 100 == 0}):
        scored = [(-sum(x * y for x, y in zip(a, v)), i, label) for i, label, v in sound if i != a_id and len(v) == len(a)]
        best = sorted((s, i) for s, i, label in scored if label == a_label)[:5]
        for p, p_id in dict.fromkeys(best):
            near = sorted((s, i) for s, i, label in scored if label != a_label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a_id, p_id, n, i, -p, -s) for n, (s, i) in enumerate(near, 1)]
    return out


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=dim)
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(10))))
    return rows


@pytest.mark.parametrize("dim,spread", [(64, 0.3), (64, 2.0), (7, 0.5), (100, 0.2), (1, 1.0)])
def test_query_against_all_pairs(spark, store, with_clashes, dim, spread):
    rows = vectors(700, dim, dim, spread)
    # ties, copies, zero vectors, and rows that take no part
    rows += [(1000 + i, rows[100][1], 3) for i in range(8)] + [(i, rows[200][1], rows[200][2]) for i in (1100, 1101, 1200)]
    rows += [(1300, [0.0] * dim, 1), (1301, [0.0] * dim, 1), (1302, [0.0] * dim, 2)]
    rows += [(1400, None, 1), (1500, rows[0][1], None), (None, rows[0][1], 1), (1600, [float("nan")] * dim, 1),
             (1700, [None] * dim, 1), (1800, [float("inf")] + [0.0] * (dim - 1), 2), (1900, [1.0, 2.0, 3.0, 4.0, 5.0], 4),
             (2000, [], 1), (2001, [], 1), (2002, [], 2)]
    frame = with_clashes(spark.createDataFrame(rows, VECTORS)).drop("rank")
    found = QUERIES["op12_hard_negatives"](spark, store(embeddings=frame))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows))


def test_repeated_rows(spark, store):
    """A repeated anchor is one; repeated rows are negatives each."""
    rows = vectors(120, 16, 5)
    rows += [rows[0], rows[100], rows[3], rows[3]]
    found = QUERIES["op12_hard_negatives"](spark, store(embeddings=spark.createDataFrame(rows, VECTORS)))
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows))


def test_empty_table(spark, store):
    empty = spark.createDataFrame([], VECTORS)
    assert QUERIES["op12_hard_negatives"](spark, store(embeddings=empty)).collect() == []


def test_huge_components(spark, store):
    """Products beyond 64 bits are clipped to them."""
    rows = [(100, [2e18, 1.0], 1), (101, [1e18, 3.0], 1), (102, [9e17, 2.0], 2), (103, [1.0, 1.0], 2)]
    found = QUERIES["op12_hard_negatives"](spark, store(embeddings=spark.createDataFrame(rows, VECTORS))).collect()
    assert [(r.positive_id, r.rank, r.negative_id) for r in found] == [(101, 1, 102), (101, 2, 103)]
    assert found[0].positive_score == (1 << 63) - 1


@pytest.mark.parametrize("dim", [1, 3, 64, 65, 384])
def test_intervals_hold(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.normal(size=(300, dim)) * rng.exponential(size=(300, 1)))
    x[5] = 0
    x[6] = x[7] * 2  # parallel vectors touch the ends of their intervals
    codes = hn.encode(x)
    norm, unit = hn._units(x)
    widths = []
    for i in range(40):
        anchor = hn.Anchor(unit[i], norm[i])
        exact, value, rows = x @ x[i], np.zeros(len(x)), np.arange(len(x))
        for level in range(hn.LEVELS):
            value, low, high = anchor.intervals(codes, rows, level, value)
            assert (low <= exact + 1e-6).all() and (exact - 1e-6 <= high).all()
            widths.append((level, float(np.mean(high - low))))
    mean = [np.mean([w for level, w in widths if level == k]) for k in range(hn.LEVELS)]
    if dim > 3:  # finer levels tell more
        assert mean[-1] < mean[0] / 2


def test_rotation_keeps_products():
    x = np.random.default_rng(1).normal(size=(20, 100))
    turned = hn.rotated(x)
    assert np.allclose(turned @ turned.T, x @ x.T)
