"""Benchmark passages in training text, by a positional inverted index.

The index holds the postings of every token of every training text. It is cut into
blocks of some megabytes of text, one row each: the block's own terms, and for each term
its positions in ascending order, four bytes each. Positions count the block's words, text after text,
with a gap between texts, so neighbouring positions are neighbouring words of one text. Very
long texts are cut into segments that repeat `CONTEXT` words of their neighbours and own the
rest; every window of up to `CONTEXT` + 1 words that touches an owned word lies inside.
A token costs four bytes, and no posting is shuffled.

A query is a window of words. In each block its terms are ordered by how rare they are
there. The list of the rarest, moved by the word's offset, gives the possible starts; each
further list, moved alike, is intersected with them. What is left after the last is an
exact phrase match (`phrases`). With a reach instead of offsets, the lists are
intersected as far as `reach` words around, which gives stretches that hold all the terms in
any order (`proximity`).

Benchmarks larger than `QUERY_WORDS` are searched part by part. Each part is bounded, sent
to all blocks and its result stored; the parts' results are added up.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import settle

WINDOW = 10
#: Words of a long text that a segment shares with each neighbour, and words it owns.
CONTEXT = 63
SEGMENT = 1 << 18
#: Bytes of text in a block, and of a long text cut at once.
BLOCK_BYTES = 8 << 20
SLICE = 4 << 20
#: A block is a row group of its own: a task writes and reads one at a time, however many it has. Statistics
#: would keep two whole values of each until the file is closed.
ROW_BY_ROW = {
    "parquet.block.row.count.limit": 1, "parquet.column.statistics.enabled": False, "parquet.enable.dictionary": False,
}
#: Words of the queries that are searched together.
QUERY_WORDS = 1 << 18
#: Starts that are intersected together.
STARTS = 1 << 22

# words are digits, letters and everything beyond ASCII; A-Z are lowered, the rest is blank
_LOWERED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWERED).split() if text else []


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time, cut at blanks."""
    start = 0
    while start < len(text):
        part = text[start : start + SLICE].translate(_LOWERED)
        if start + SLICE < len(text):
            cut = part.rfind(b" ") + 1
            if not cut:  # a word longer than a slice
                end = start + SLICE
                while end < len(text) and b" " not in (more := text[end : end + SLICE].translate(_LOWERED)):
                    end += SLICE
                cut = (end - start) + (more.find(b" ") + 1 if end < len(text) else 0)
                part = text[start : start + cut].translate(_LOWERED)
            part = part[:cut]
        start += len(part)
        yield part.split()


def segments(text: bytes | None) -> Iterator[tuple[list[bytes], int, int, int]]:
    """(words, position of the first, first owned, end of the owned) of the segments of a text."""
    if not text or len(text) <= SLICE:
        words = words_of(text)
        yield words, 0, 0, len(words)
        return
    held: list[bytes] = []
    base = own = 0
    for words in _slices(text):
        held += words
        while len(held) - own > SEGMENT + CONTEXT:
            yield held[: own + SEGMENT + CONTEXT], base, own, own + SEGMENT
            cut = max(0, own + SEGMENT - CONTEXT)
            held, base, own = held[cut:], base + cut, own + SEGMENT - cut
    yield held, base, own, len(held)


class _Builder:
    """One block under construction."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.at: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.place = self.bytes = 0

    def add(self, row: int, doc_id: int | None, words: list[bytes], base: int, own: int, end: int) -> None:
        self.at.append(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)) << 32
                       | np.arange(self.place, self.place + len(words)))
        self.rows.append((row, doc_id, self.place, base, own, end, len(words)))
        self.place += len(words) + CONTEXT + 1

    def finish(self) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(self.at))
        counts = np.bincount(keys >> 32, minlength=len(self.terms))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        columns = list(zip(*self.rows))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), *[one(c, k) for c, k in zip(columns, kinds)],
             one(list(self.terms), pa.binary()), *[pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (counts, keys & 0xFFFFFFFF)]],
            names=_NAMES,
        )


_INDEX = (
    "block long, rows array<long>, ids array<long>, starts array<int>, bases array<long>, owns array<int>, "
    "ends array<int>, lengths array<int>, terms array<binary>, counts binary, postings binary"
)
_NAMES = [f.split()[0] for f in _INDEX.split(", ")]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Builder()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows, ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
        for i, (row, doc_id) in enumerate(zip(rows, ids)):
            text = texts[i].as_py()
            for words, base, own, end in segments(text):
                block.add(row, doc_id, words, base, own, end)
                block.bytes += len(text or b"") if base == 0 else SLICE
                if block.bytes >= BLOCK_BYTES:
                    yield block.finish()
                    block = _Builder()
    if block.rows:
        yield block.finish()


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all words of all texts, one row per block.

    `rows` number the table's rows, so that repeated rows and NULL ids stay apart.
    """
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
    )
    return settle(named.mapInArrow(_build, _INDEX), "postings", **ROW_BY_ROW)


@dataclass
class Queries:
    """Windows of words: `words` are positions in `terms`, -1 behind a short window's end."""

    terms: pa.Array
    items: np.ndarray
    words: np.ndarray
    at: np.ndarray

    @cached_property
    def width(self) -> np.ndarray:
        return (self.words >= 0).sum(axis=1)

    @cached_property
    def names(self) -> np.ndarray:
        """The different items."""
        return np.unique(self.items)

    @cached_property
    def numbers(self) -> np.ndarray:
        """Every window's item as a position in `names`."""
        return np.searchsorted(self.names, self.items)


def windows(texts: list[tuple[int, list[bytes], int]], size: int = WINDOW) -> Queries:
    """All windows of `size` words of (item, words, first); a shorter text is one window, an empty one none.

    `first` tells where the words begin in the item's text, `at` where a window does.
    """
    terms: defaultdict[bytes, int] = defaultdict(count().__next__)
    owner, rows, at = [np.zeros(0, np.int64)], [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
    for item, text, first in texts:
        words = np.fromiter(map(terms.__getitem__, text), np.int32, len(text))
        if len(words) >= size:
            found = np.lib.stride_tricks.sliding_window_view(words, size)
        elif len(words) and not first:
            found = np.full((1, size), -1, np.int32)
            found[0, : len(words)] = words
        else:
            continue
        rows.append(found)
        owner.append(np.full(len(found), item))
        at.append(first + np.arange(len(found)))
    return Queries(pa.array(list(terms), pa.binary()), np.concatenate(owner), np.concatenate(rows), np.concatenate(at))


class Block:
    """One row of the index, ready to be searched."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(name)[row].values
        self.rows, self.ids = get("rows").to_pylist(), get("ids").to_pylist()
        self.starts, self.bases = get("starts").to_numpy(), get("bases").to_numpy()
        self.owns, self.ends, self.lengths = (get(n).to_numpy() for n in ("owns", "ends", "lengths"))
        self.terms = get("terms")
        self.counts, self.postings = (
            np.frombuffer(batch.column(name)[row].as_buffer(), "<i4").astype(np.int64) for name in ("counts", "postings")
        )
        self.offsets = np.cumsum(self.counts) - self.counts
        self.keys = np.repeat(np.arange(len(self.counts)) << 32, self.counts) | self.postings

    def lookup(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, terms, counts): the windows all of whose terms occur, words as the block's terms."""
        place = pc.index_in(queries.terms, value_set=self.terms)
        own = np.append(place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -2)
        words = own[queries.words]
        alive = np.flatnonzero((words != -1).all(axis=1))
        words = words[alive]
        # behind the end nothing is asked for
        counts = np.where(words >= 0, self.counts[np.maximum(words, 0)], np.iinfo(np.int64).max)
        return alive, words, counts

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, position) of all postings of the given terms."""
        n = self.counts[term]
        owner = np.repeat(np.arange(len(term)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.postings[self.offsets[term][owner] + inside]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term << 32 | place
        at = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def segment(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def _pieces(n: np.ndarray) -> Iterator[slice]:
    """Slices of windows with about `STARTS` starts each."""
    upto = np.cumsum(n)
    low = 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + STARTS, "right")))
        yield slice(low, high)
        low = high


def phrase_starts(block: Block, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of all occurrences of windows in a block."""
    alive, words, counts = block.lookup(queries)
    order = np.argsort(counts, axis=1, kind="stable")
    rarest = np.take_along_axis(words, order[:, :1], 1)[:, 0]
    for part in _pieces(block.counts[rarest] if len(rarest) else np.zeros(0, np.int64)):
        term, lanes = words[part], order[part]
        owner, place = block.expand(rarest[part])
        start = place - lanes[owner, 0]
        owner, start = owner[start >= 0], start[start >= 0]
        for step in range(1, words.shape[1]):
            lane = lanes[owner, step]
            asked = term[owner, lane]
            kept = asked < 0
            some = np.flatnonzero(~kept)
            kept[some] = block.has(asked[some], start[some] + lane[some])
            owner, start = owner[kept], start[kept]
            if not len(owner):
                break
        if len(owner):
            yield alive[part.start + owner], start


def near_stretches(block: Block, queries: Queries, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, end) of the shortest stretches of up to `reach` words with all terms of a window.

    A stretch begins with one of the terms, and none that begins later ends as early.
    """
    alive, words, counts = block.lookup(queries)
    limit = np.int64(1) << 40
    for w, term, n in zip(alive, words, counts):
        asked = np.unique(term[term >= 0])
        asked = asked[np.argsort(block.counts[asked], kind="stable")]
        lists = [block.postings[block.offsets[t] : block.offsets[t] + block.counts[t]] for t in asked]
        near = lists[0]
        for other in lists[1:]:  # rarest first; keep its places that have this term around
            at = np.searchsorted(other, near - reach, "right")
            near = near[(at < len(other)) & (np.append(other, limit)[at] < near + reach)]
        if not len(near):
            continue
        starts = np.unique(np.concatenate([
            x[_around(x, near, reach)] for x in lists
        ]))
        end = starts.copy()
        for x in lists:
            at = np.searchsorted(x, starts)
            end = np.maximum(end, np.append(x, limit)[at])
        fits = end - starts < reach
        starts, end = starts[fits], end[fits]
        # a later start with the same end is the shorter stretch
        shortest = np.append(end[1:] != end[:-1], True)[: len(end)]
        if len(starts):
            starts, end = starts[shortest], end[shortest]
            yield np.full(len(starts), w), starts, end + 1


def _around(x: np.ndarray, near: np.ndarray, reach: int) -> np.ndarray:
    """Positions of x that lie before one of `near`, or on it, by less than `reach`."""
    at = np.searchsorted(near, x)
    return np.flatnonzero((at < len(near)) & (np.append(near, 1 << 40)[at] - x < reach))


def _query_parts(items: DataFrame, size: int) -> Iterator[Queries]:
    """Bounded parts of the queries. One part is on the driver at a time."""
    named = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")
    ).distinct()
    held, total = [], 0
    for item, text in named.toLocalIterator():
        for words, base, own, end in segments(bytes(text) if text is not None else None):
            # segments of a long item overlap by one word less than a window
            held.append((item, words[own : end + size - 1], base + own))
            total += end - own
            if total >= QUERY_WORDS:
                yield windows(held, size)
                held, total = [], 0
    yield windows(held, size)


def _searched(stored: DataFrame, items: DataFrame, size: int, run, schema: str) -> list[DataFrame]:
    return [settle(stored.mapInArrow(run(part), schema), "matches") for part in _query_parts(items, size)]


_SPANS = "row long, doc_id long, item_id long, item_word long, start long, end long"


def _spans(queries: Queries, reach: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                block = Block(batch, number)
                if reach is None:
                    found = ((w, s, s + queries.width[w]) for w, s in phrase_starts(block, queries))
                else:
                    found = near_stretches(block, queries, reach)
                for w, start, end in found:
                    segment = block.segment(start)
                    first = start - block.starts[segment]
                    # the segment that owns the first word reports the match
                    kept = (first >= block.owns[segment]) & (first < block.ends[segment])
                    w, segment, first, length = w[kept], segment[kept], first[kept], (end - start)[kept]
                    first = first + block.bases[segment]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.rows[s] for s in segment], pa.int64()),
                         pa.array([block.ids[s] for s in segment], pa.int64()),
                         pa.array(queries.items[w], pa.int64()), pa.array(queries.at[w], pa.int64()),
                         pa.array(first, pa.int64()), pa.array(first + length, pa.int64())],
                        names=[f.split()[0] for f in _SPANS.split(", ")],
                    )

    return run


def _check(size: int, reach: int | None = None) -> None:
    if not 0 < max(size, reach or 0) <= CONTEXT + 1:
        raise ValueError(f"windows and reaches have 1 to {CONTEXT + 1} words")


def phrases(stored: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(row, doc_id, item_id, item_word, start, end): every occurrence of every window, in words."""
    _check(size)
    return _united(_searched(stored, items, size, lambda q: _spans(q, None), _SPANS))


def proximity(stored: DataFrame, items: DataFrame, reach: int, size: int = WINDOW) -> DataFrame:
    """The same for stretches of up to `reach` words that hold all words of a window in any order."""
    _check(size, reach)
    return _united(_searched(stored, items, size, lambda q: _spans(q, reach), _SPANS))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_HITS = "row long, doc_id long, base long, n_words long, hit array<struct<a:long,b:long>>, items array<long>"
_STRETCHES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _hits(queries: Queries):
    """Per segment: its owned words, the stretches of them that are hit, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = len(queries.names) + 1
        for batch in batches:
            for number in range(batch.num_rows):
                block = Block(batch, number)
                low, high = block.starts + block.owns, block.starts + block.ends
                marks = np.zeros(int(block.starts[-1] + block.lengths[-1]) + 2, np.int32)
                pairs = [np.zeros(0, np.int64)]
                for w, start in phrase_starts(block, queries):
                    end = start + queries.width[w]
                    segment = block.segment(start)
                    kept = (start < high[segment]) & (end > low[segment])
                    w, segment, start, end = w[kept], segment[kept], start[kept], end[kept]
                    np.add.at(marks, np.maximum(start, low[segment]), 1)
                    np.add.at(marks, np.minimum(end, high[segment]), -1)
                    pairs.append(np.unique(segment * np.int64(names) + queries.numbers[w]))
                edges = np.flatnonzero(np.diff(np.append(0, np.cumsum(marks) > 0).astype(np.int8)))
                hit: list[list] = [[] for _ in block.rows]
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    s = int(block.segment(np.int64(a)))
                    hit[s].append({"a": a - int(block.starts[s]), "b": b - int(block.starts[s])})
                found: list[list[int]] = [[] for _ in block.rows]
                for pair in np.unique(np.concatenate(pairs)).tolist():
                    found[pair // names].append(int(queries.names[pair % names]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.rows, pa.int64()), pa.array(block.ids, pa.int64()),
                     pa.array(block.bases + block.owns), pa.array((block.ends - block.owns).astype(np.int64)),
                     pa.array(hit, _STRETCHES), pa.array(found, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "base", "n_words", "hit", "items"],
                )

    return run


def _length(stretches: Column) -> Column:
    """Words in the union of stretches."""
    return F.aggregate(
        F.array_sort(stretches), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], x["b"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every row.

    A word is hit if it lies in an occurrence of a window; an item counts if one of its
    windows occurs. Items without an id take no part, rows of one id are one item. NULL and
    empty texts have no words; repeated rows and rows without an id are judged each; without
    items nothing is hit, and an empty table gives no rows.
    """
    _check(size)
    found = _united(_searched(index(docs), items, size, _hits, _HITS))
    # one row for each segment and part of the queries: parts are united, segments added up
    per_segment = found.groupBy("row", "base").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        _length(F.flatten(F.collect_list("hit"))).alias("n_hit"), F.flatten(F.collect_list("items")).alias("items"),
    )
    rows = per_segment.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("n_hit").alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )
