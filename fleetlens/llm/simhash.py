"""Near-duplicate groups by SimHash with a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its
3-word shingles. Fingerprints that differ in at most three bits are linked, and
linked documents form one group.

Search. Two fingerprints that differ in three bits agree in one of four blocks of
16 bits, so each distinct fingerprint goes to four buckets (block, value). A task
holds many buckets and indexes them all at once:

* the fingerprints of a bucket are sorted by Gray rank, which places those with
  equal leading bits and few differences side by side;
* every eight neighbours form a node, every eight nodes a node above it. A node
  keeps the bits all its members share (mask) and their values (pattern), and of
  these only the ones that its parent does not have;
* a query walks from the bucket's root downwards and accumulates the differences
  on shared bits; beyond three the whole node is dropped. At the leaves the sum
  over all levels is the exact distance.

Members of a bucket that are already in one group need no further link, so a node
whose members all share the query's group is dropped as well. That keeps dense
clusters from costing the square of their size, and it changes no group. What
leaves a task is one link per fingerprint and bucket at most. A bucket above
`HOT` members is split by a second level of blocks (four of 12 bits of the other
48, by the same argument) before it is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.text import fresh
from fleetlens.session import settle

SEED = 42
SHINGLE = 3
DISTANCE = 3
FAN = 8
HOT = 4096
#: (query, node) pairs held at once by a task.
FRONTIER = 1 << 18


def fingerprint(text: str | None) -> int:
    """Majority of the shingle hashes; 0 without words.

    Bytes are lowered and split as ASCII, which is exactly A-Z and the six blanks.
    A text of one or two words is one shingle.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < SHINGLE:
        hashes = [h(b" ".join(w), SEED)]
    else:
        hashes = [h(a + b" " + b + b" " + c, SEED) for a, b, c in zip(w, w[1:], w[2:])]
    ones = np.zeros(64, np.int64)
    array = np.array(hashes, dtype="<u8")
    for start in range(0, len(array), 1 << 16):
        octets = array[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(array), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(
            (fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(prints.view(np.int64))],
            names=["doc_id", "row", "fp"],
        )


def row_key(doc_id: str, text: str):
    """Tells documents apart that share an id; repeated rows share it."""
    return F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit("|"), F.col(f"`{text}`"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp): `row` is a hash of id and text, fp the 64 bits as a signed long."""
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(doc_id, text).alias("row"),
        F.col(f"`{text}`").alias("text"),
    ).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.uint8)


class GrayIndex:
    """The index over the fingerprints of many buckets, all searched at once.

    `bucket` must be sorted, and within a bucket the prints must be in Gray order.
    """

    def __init__(self, bucket: np.ndarray, prints: np.ndarray):
        self.prints = prints
        n = len(prints)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, int)
        home = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1 if n else np.zeros(0, int)
        # levels[0] are the prints; a level is (mask, pattern, first child, end child, home bucket)
        ones, some = prints.copy(), prints.copy()
        first, end = np.arange(n), np.arange(n) + 1
        self.levels = [(np.full(n, ~np.uint64(0)), prints.copy(), first, end)]
        count = np.diff(np.r_[starts, n])
        while len(count) and count.max() > 1:
            offset = np.r_[0, np.cumsum(count)[:-1]]
            groups = -(-count // FAN)
            above = np.r_[0, np.cumsum(groups)[:-1]]
            parent = above[home] + (np.arange(len(home)) - offset[home]) // FAN
            cut = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            ones = np.bitwise_and.reduceat(ones, cut)
            some = np.bitwise_or.reduceat(some, cut)
            shared = ~(ones ^ some)
            mask, pattern, a, b = self.levels[-1]
            own = mask & ~shared[parent]  # shared bits are factored out into the parent
            self.levels[-1] = (own, pattern & own, a, b)
            self.levels.append((shared, ones & shared, cut, np.r_[cut[1:], len(parent)]))
            home, count = home[cut], groups
        self.roots = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))

    def links(self, distance: int) -> np.ndarray:
        """The least position of every print's group of linked prints."""
        n = len(self.prints)
        root = np.arange(n)
        near = np.flatnonzero(
            (self.roots[1:] == self.roots[:-1])
            & (_bits(self.prints[1:] ^ self.prints[:-1]) <= distance)
        )
        root = _merge(root, near, near + 1)
        step = max(1, FRONTIER // FAN)
        for start in range(0, n, step):
            query = np.arange(start, min(n, start + step))
            uniform = self._uniform(root)
            a, b = self._search(query, root, uniform, distance)
            root = _merge(root, a, b)
        return root

    def _uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """The group all members of a node share, or -1, for every level."""
        low = high = root
        found = [root]
        for _, _, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            found.append(np.where(low == high, low, -1))
        return found

    def _search(self, query, root, uniform, distance):
        pairs = []
        top = len(self.levels) - 1
        stack = [(top, query, self.roots[query], np.zeros(len(query), np.uint8))]
        while stack:
            level, q, node, spent = stack.pop()
            mask, pattern, first, end = self.levels[level]
            spent = spent + _bits((self.prints[q] ^ pattern[node]) & mask[node])
            keep = (spent <= distance) & (uniform[level][node] != root[q])
            q, node, spent = q[keep], node[keep], spent[keep]
            if not len(q):
                continue
            if level == 0:
                pairs.append((q, node))
                continue
            width = end[node] - first[node]
            ends = np.cumsum(width)
            for lo, hi in _slices(ends, FRONTIER):
                w = width[lo:hi]
                inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                stack.append((
                    level - 1, np.repeat(q[lo:hi], w), np.repeat(first[node[lo:hi]], w) + inner,
                    np.repeat(spent[lo:hi], w),
                ))
        if not pairs:
            none = np.zeros(0, np.int64)
            return none, none
        return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _slices(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield lo, hi
        lo, done = hi, ends[hi - 1]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the groups of a[i] and b[i]: hook the larger root below the smaller, then flatten."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root = flat


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    bucket = table.column("bucket").to_numpy()
    prints = table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(prints), bucket))
    bucket, prints = bucket[order], prints[order]
    root = GrayIndex(bucket, prints).links(DISTANCE)
    linked = np.flatnonzero(root != np.arange(len(root)))
    for start in range(0, len(linked), 1 << 16):
        part = linked[start : start + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(prints[part].view(np.int64)), pa.array(prints[root[part]].view(np.int64))],
            names=["a", "b"],
        )


def _block(fp, width: int, number: int):
    return F.shiftrightunsigned(fp, width * number).bitwiseAND((1 << width) - 1)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links that connect all fingerprints within DISTANCE; `prints` has distinct fp."""
    fp = F.col("fp")
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(*[_block(fp, 16, i) + F.lit(i * (1 << 16)) for i in range(4)])
        ).alias("block"),
    )
    sizes = keyed.groupBy("block").count()
    hot = settle(sizes.where(F.col("count") > HOT).select("block"), "hot-buckets")
    cold = keyed.join(hot, "block", "left_anti").select("fp", F.col("block").alias("bucket"))
    # the other 48 bits, moved together: those below the block and those above it
    low = F.expr("fp & (shiftleft(1L, CAST(block DIV 65536 AS INT) * 16) - 1)")
    high = F.expr(
        "CASE WHEN block DIV 65536 = 3 THEN 0L ELSE "
        "shiftleft(shiftrightunsigned(fp, CAST(block DIV 65536 AS INT) * 16 + 16), CAST(block DIV 65536 AS INT) * 16) END"
    )
    rest = keyed.join(hot, "block", "left_semi").select(
        "fp", "block", low.bitwiseOR(high).alias("rest")
    )
    finer = rest.select(
        "fp",
        F.explode(
            F.array(*[
                (F.col("block") + (1 << 18)) * (1 << 14) + i * (1 << 12) + _block(F.col("rest"), 12, i)
                for i in range(4)
            ])
        ).alias("bucket"),
    )
    dealt = cold.unionByName(finer)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").select("bucket", "fp").mapInArrow(
        _bucket_links, "a long, b long"
    )


def group_roots(prints: DataFrame) -> DataFrame:
    """Distinct (fp) -> (fp, root): the least fingerprint of the group, as a signed long."""
    linked = settle(components(links(prints.select("fp"))), "components")
    return prints.join(linked, prints["fp"] == linked["id"], "left").select(
        prints["fp"], F.coalesce("root", prints["fp"]).alias("root")
    )


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    component_id is the least doc_id of the group; NULL only if no member has one.
    NULL and blank texts have fingerprint 0 and are linked like any other. Repeated
    rows stay repeated. An empty table gives an empty result.
    """
    found = settle(fingerprints(docs, doc_id, text), "fingerprints")
    prints = settle(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    whole = settle(group_roots(prints).join(prints, "fp"), "print-roots")
    least = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = whole.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns unchanged, as `keep_least` picks it."""
    found = settle(fingerprints(docs), "fingerprints")
    prints = settle(found.select("fp").distinct(), "distinct-prints")
    return keep_least(docs, found, settle(group_roots(prints), "print-roots"))


def keep_least(docs: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """The document with the least doc_id of each group, all columns unchanged.

    `found` has the doc_id, row and fp of every document, `roots` the group of every fp.

    Among documents with the same id the hash of id and text decides; a document without
    an id stays only if no member of its group has one. Of repeated rows one stays.

    The documents meet the kept rows in a merge join at every size: broadcasting them
    would do for small tables only. Repeated rows among the kept ones, if there are any,
    are reduced by an aggregate, so a row that fills the table does not meet in one task.
    """
    best = found.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best"),
    )
    kept = roots.join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    times = found.groupBy("row").agg(F.count("*").alias("times"))
    chosen = settle(kept.join(times, "row"), "kept-documents")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = fresh(docs, "row")
    keyed = docs.withColumn(own, row_key("doc_id", "text"))
    pick = lambda which: chosen.where(which).select(F.col("row").alias(own)).hint("merge")
    once = keyed.join(pick("times = 1"), own, "left_semi").select(*columns)
    if chosen.where("times > 1").isEmpty():
        return once
    again = (
        keyed.join(pick("times > 1"), own, "left_semi")
        .groupBy(own)
        .agg(F.first(F.struct(*columns)).alias("kept"))
        .select("kept.*")
    )
    return once.unionByName(again)
