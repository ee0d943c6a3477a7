"""Phrase and proximity matches against a plain search."""

import hashlib
import re
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from odd_rows import DOCUMENTS, prose

from fleetlens.llm import decontaminate as dc
from fleetlens.llm.queries import QUERIES

ITEMS = "item_id long, text string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_windows(items, size=10):
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for at in range(max(1, len(w) - size + 1)):
                yield item, at, tuple(w[at : at + size])


def plain(docs, items):
    wanted = list(plain_windows(items))
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for item, _, window in wanted:
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item)
        listed = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def benchmark_rows():
    passage = prose(21, 40)
    return [
        (3, passage), (3, passage), (12, prose(22, 10)), (4, "mi Fa-so"), (5, "the"), (6, None), (7, ""), (8, "... !"),
        (None, prose(3, 20)), (9, "Straße é漢 über"), (10, prose(1, 14)), (11, prose(8, 60)), (100, prose(21, 30)),
    ]


def leaking(odd):
    rows = [tuple(r) for r in odd.collect()]
    p = prose(21, 40)
    inside = " ".join(p.split()[7:22])
    return rows + [
        (50, f"start {p.upper()} end", "en", "a", 1), (51, f"x,{inside}.y", "en", "a", 1),
        (52, " ".join(p.split()[:9]) + " other", "en", "a", 1), (53, "So mi fa so mi FA\tso the", "en", "a", 1),
        (54, "the the the", None, None, None), (55, prose(22, 10) + " " + prose(22, 10), "en", "a", 1),
        (56, "straße É漢 über straße é漢 über", "de", "a", 1),
    ]


def test_query_against_plain_search(spark, odd, store, with_clashes):
    docs = leaking(odd)
    frame = spark.createDataFrame(docs, DOCUMENTS).repartition(4)
    items = spark.createDataFrame(benchmark_rows(), ITEMS)
    found = QUERIES["op13_benchmark_hits"](spark, store(documents=with_clashes(frame), benchmark=with_clashes(items)))
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = plain(docs, benchmark_rows())
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_empty_tables(spark, odd, none, store):
    no_items = spark.createDataFrame([], ITEMS)
    items = spark.createDataFrame(benchmark_rows(), ITEMS)
    assert QUERIES["op13_benchmark_hits"](spark, store(documents=none, benchmark=items)).collect() == []
    found = QUERIES["op13_benchmark_hits"](spark, store(documents=odd, benchmark=no_items)).collect()
    assert len(found) == odd.count() and not any(r.contaminated for r in found)


def test_long_documents_in_segments(spark):
    """Windows across the borders of segments and slices, in a text beyond both."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    passage = " ".join(f"p{i}" for i in range(30))
    body = rng.choice(vocabulary, 600_000)
    # around the first border of owned words, and between slices
    pieces = [*body[: dc.SEGMENT - 12], *passage.split(), *body[dc.SEGMENT : 500_000], *passage.split(), *body[500_000:]]
    text = " ".join(pieces) + " " + "z" * (dc.SLICE + 100) + " " + passage
    docs = [(1, text, None, None, None), (2, passage, None, None, None)]
    items = [(1, passage), (2, " ".join(body[dc.SEGMENT - 20 : dc.SEGMENT - 12]) + " p0 p1 p2 p3")]
    found = dc.contamination(spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(items, ITEMS))
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1].n_words, rows[1].n_hit) == (len(words(text)), 90 + 8)
    assert sorted(rows[1].items) == [1, 2]
    assert (rows[2].n_words, rows[2].n_hit, list(rows[2].items)) == (30, 30, [1])


def test_segments_repeat_their_context(monkeypatch):
    monkeypatch.setattr(dc, "SLICE", 40)
    monkeypatch.setattr(dc, "SEGMENT", 7)
    monkeypatch.setattr(dc, "CONTEXT", 3)
    text = (" ".join(f"a{i}" for i in range(50)) + " " + "y" * 130 + " tail " + "x" * 95).encode()
    whole = dc.words_of(text)
    parts = list(dc.segments(text))
    owned = [w for held, base, own, end in parts for w in held[own:end]]
    assert owned == whole
    for held, base, own, end in parts:
        assert held == whole[base : base + len(held)]
        assert own == min(3, base + own) and len(held) - end in (0, 3)


def test_queries_in_parts(spark, odd, monkeypatch):
    """The benchmark cut into many parts gives what one part gives."""
    docs = spark.createDataFrame(leaking(odd), DOCUMENTS)
    items = spark.createDataFrame(benchmark_rows(), ITEMS)
    whole = dc.contamination(docs, items)
    monkeypatch.setattr(dc, "QUERY_WORDS", 45)
    parts = dc.contamination(docs, items)
    rows = lambda f: sorted((tuple(r) for r in f.drop("items").collect()), key=key)
    assert rows(parts) == rows(whole)


def test_phrase_spans(spark, odd):
    docs = leaking(odd)
    stored = dc.index(spark.createDataFrame(docs, DOCUMENTS).coalesce(1))
    found = dc.phrases(stored, spark.createDataFrame(benchmark_rows(), ITEMS))
    got = {(r.row, r.item_id, r.item_word, r.start, r.end) for r in found.collect()}
    expected = set()
    for row, (_, text, *_) in enumerate(docs):
        w = words(text)
        for item, at, window in plain_windows(benchmark_rows()):
            for start in range(len(w) - len(window) + 1):
                if tuple(w[start : start + len(window)]) == window:
                    expected.add((row, item, at, start, start + len(window)))
    assert got == expected


@pytest.mark.parametrize("reach", [3, 6, 12])
def test_proximity(spark, reach):
    rng = np.random.default_rng(reach)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 60))), None, None, None) for i in range(30)]
    items = [(1, "a b c"), (2, "h"), (3, "a a g"), (4, "c d e f"), (5, "a q")]
    stored = dc.index(spark.createDataFrame(docs, DOCUMENTS).coalesce(1))
    found = dc.proximity(stored, spark.createDataFrame(items, ITEMS), reach)
    got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in found.collect())
    expected = []
    for doc_id, text, *_ in docs:
        w = text.split()
        for item, asked in items:
            terms = set(asked.split())
            stretches = [(s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + reach) + 1) if terms <= set(w[s:e])]
            # the shortest: none inside another
            expected += [(doc_id, item, s, e) for s, e in stretches
                         if not any((a, b) != (s, e) and s <= a and b <= e for a, b in stretches)]
    assert got == sorted(expected)


def test_bounds_are_checked(spark, odd):
    with pytest.raises(ValueError, match="1 to"):
        dc.contamination(odd, spark.createDataFrame([], ITEMS), size=dc.CONTEXT + 2)


def test_the_blocks_of_a_task_are_stored_one_by_one(spark):
    """Memory of writing and reading the index holds for one block, however many a task has."""
    text = "alpha beta gamma delta " * (dc.BLOCK_BYTES // 23 + 1)
    stored = dc.index(spark.createDataFrame([(i, text, None, None, None) for i in range(3)], DOCUMENTS).coalesce(1))
    groups = []
    for name in stored.inputFiles():
        footer = pq.ParquetFile(urlparse(name).path).metadata
        groups += [footer.row_group(i).num_rows for i in range(footer.num_row_groups)]
    assert len(groups) > 2 and set(groups) == {1}
