"""Shards with more small blocks than medium groups fit into."""

import numpy as np
import pytest
from test_groups_shards import assigned


@pytest.mark.parametrize("heavy,block,n", [(4096, 8, 6000), (64, 60, 6000)])
def test_medium_groups_beside_a_heavy_one(spark, heavy, block, n):
    rng = np.random.default_rng(block)
    small = rng.integers(20, 60, n).tolist()
    light = sum(small)
    # above a shard's share of a block, below a heavy group
    low, high = light * 3 // (8 * (n // block)), light // heavy
    medium = [low + i % 7 for i in range(n // block // 3)] if low <= high else [high - i % 3 for i in range(n // block)]
    sizes = [*small, *medium, light // 20, light // 70]
    loads = assigned(spark, sizes, heavy=heavy, block=block)
    assert max(loads) - min(loads) <= 60


def test_all_bytes_in_medium_groups(spark):
    sizes = [1000 + i % 37 for i in range(3000)] + [300_000]
    loads = assigned(spark, sizes, heavy=1024, block=40)  # no small group to fill up with
    assert max(loads) - min(loads) <= 1100
