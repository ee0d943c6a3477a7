"""Near-duplicate groups and shards against brute force, and odd rows."""

import collections
import zlib

import numpy as np
import pytest
from odd_rows import DOCUMENTS, odd_rows, prose
from pyspark.sql import functions as F

from fleetlens.llm import components, sharding, simhash
from fleetlens.llm.queries import QUERIES


def merged(prints):
    """Group of every fingerprint, by comparing all pairs."""
    root = np.arange(len(prints))
    for i in range(0, len(prints), 500):
        a, b = np.nonzero(np.bitwise_count(prints[i : i + 500, None] ^ prints[None, :]) <= simhash.DISTANCE)
        root = simhash._merge(root, a + i, b)
    return root


def brute_groups(rows):
    prints = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    root = merged(prints)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return [(doc_id, format(int(f), "016x"), least.get(r)) for (doc_id, _), f, r in zip(rows, prints, root)]


def test_fingerprint_by_definition():
    import xxhash

    text = "Ab b\tC ä\n\x0bE ab b c"
    w = ["ab", "b", "c", "ä", "e", "ab", "b", "c"]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(6)]
    bits = [sum(h >> b & 1 for h in hashes) * 2 > 6 for b in range(64)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if bits[b])
    assert simhash.fingerprint("A  b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def cluster(seed, n, spread):
    rng = np.random.default_rng(seed)
    out = []
    for center in rng.integers(0, 2**63, n, dtype=np.uint64):
        for _ in range(80):
            for b in rng.integers(0, 64, rng.integers(0, spread)):
                center ^= np.uint64(1) << np.uint64(b)
            out.append(center)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_finds_all_groups(seed):
    prints = cluster(seed, 12, 4)  # chains of small steps and dense clusters
    prints = prints[np.argsort(simhash.gray_rank(prints), kind="stable")]
    found = simhash.GrayIndex(np.zeros(len(prints), int), prints).links(3)
    assert (found == merged(prints)).all()


def test_gray_rank_orders_single_bit_steps():
    codes = np.arange(64, dtype=np.uint64)
    gray = codes ^ (codes >> np.uint64(1))
    assert (simhash.gray_rank(gray) == codes).all()


def test_links_connect_all_groups(spark, monkeypatch):
    prints = cluster(7, 25, 3)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    expected = merged(prints)
    for hot in (simhash.HOT, 20):  # 20: all large buckets take the second level of blocks
        monkeypatch.setattr(simhash, "HOT", hot)
        roots = simhash.group_roots(frame).collect()
        got = collections.defaultdict(set)
        for r in roots:
            got[r["root"]].add(r["fp"])
        want = collections.defaultdict(set)
        for p, r in zip(prints.view(np.int64), expected):
            want[r].add(int(p))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7), (2000, 2001)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op4_simhash_groups"](spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(brute_groups([tuple(d) for d in docs]))


def test_groups_of_odd_rows(spark, odd, none, store):
    got = [tuple(r) for r in QUERIES["op4_simhash_groups"](spark, store(documents=odd)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups([r[:2] for r in odd_rows()])))
    assert QUERIES["op4_simhash_groups"](spark, store(documents=none)).count() == 0


def test_one_document_of_each_group_stays(odd, none, with_clashes):
    kept = simhash.deduplicate(with_clashes(odd))
    assert kept.columns == with_clashes(odd).columns
    rows = kept.collect()
    groups = brute_groups([r[:2] for r in odd_rows()])
    assert len(rows) == len({g[2] for g in groups})
    # the least id of each group; NULL, empty and blank texts are one group, and it has ids
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(
        {g[2] for g in groups if g[2] is not None}
    )
    assert {r["row"] for r in rows} == {"own row"}
    assert simhash.deduplicate(none).count() == 0


@pytest.mark.parametrize("parts", [[5], [8, 7, 6, 5, 4], [1] * 33, [100, 1, 1, 1], list(range(1, 200)), [0, 0]])
def test_difference_places_every_part(parts):
    sums, places = sharding.difference([[p, 0, 0] for p in parts])
    got = [0, 0, 0]
    for p, place in zip(parts, places):
        assert sorted(place) == [0, 1, 2]
        got[place[0]] += p
    spread = max(got) - min(got)
    assert sorted(got) == sorted(s - min(sums) + min(got) for s in sums) or sums == got
    assert spread <= max(parts)


def test_difference_of_two_ways_is_karmarkar_karp():
    sums, _ = sharding.difference([[x, 0] for x in (8, 7, 6, 5, 4)])
    assert abs(sums[0] - sums[1]) == 2  # the textbook result; the best split has 0


def assigned(spark, sizes, **options):
    groups = spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)], "key string, bytes long")
    shards = dict(sharding.assign(groups, 8, **options).collect())
    assert sorted(shards) == sorted(map(str, range(len(sizes))))
    loads = [0] * 8
    for key, shard in shards.items():
        loads[shard] += sizes[int(key)]
    return loads


def test_blocks_and_levels_stay_level(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 3)
    sizes = [100 + i * i % 3001 for i in range(6000)]
    loads = assigned(spark, sizes, block=500)  # twelve blocks, three levels, nothing heavy
    assert max(loads) - min(loads) <= 30
    loads = assigned(spark, [*sizes, sum(sizes) // 10, sum(sizes) // 30], block=500)  # levelled around two
    assert max(loads) - min(loads) <= 30
    heavy = sum(sizes)  # one group outweighs all others together
    loads = sorted(assigned(spark, [*sizes, heavy], block=500))
    assert loads[-1] == heavy and loads[-2] - loads[0] <= 60


def test_shards_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    check_shards(QUERIES["op3_shards"](spark, folder).collect(), spark.read.parquet(f"{folder}/documents.parquet").collect())


def check_shards(rows, docs):
    texts = collections.Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    together = collections.defaultdict(set)
    for r in rows:
        together[r["size"], r["text_crc32"]].add(r["shard"])
    loads = collections.Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    if len(together) > 500:
        assert all(len(s) == 1 for s in together.values())
        assert max(loads.values()) - min(loads[i] for i in range(16)) < 100


def test_shards_of_odd_rows(spark, odd, none, store, with_clashes):
    rows = QUERIES["op3_shards"](spark, store(documents=with_clashes(odd))).collect()
    check_shards(rows, odd.collect())
    assert QUERIES["op3_shards"](spark, store(documents=none)).count() == 0


def test_many_copies_get_slots_of_one_shard(spark):
    docs = spark.createDataFrame(
        [(i, "the very same text" if i % 3 == 0 else prose(i, 12), "en", "a", None) for i in range(9000)], DOCUMENTS
    )
    rows = sharding.shard(docs).where("doc_id % 3 = 0").agg(F.countDistinct("shard"), F.countDistinct("slot")).first()
    assert tuple(rows) == (1, 3000)
