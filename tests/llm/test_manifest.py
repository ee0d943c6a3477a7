"""The Merkle manifest against a plain statement of its rules."""

import hashlib
import zlib

import pytest
from odd_rows import DOCUMENTS
from pyspark.sql import functions as F

from fleetlens.llm import merkle
from fleetlens.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def plain_path(levels, place):
    """(siblings before, siblings after) level by level."""
    for nodes in levels[:-1]:
        run, at = nodes[place // 8 * 8 : place // 8 * 8 + 8], place % 8
        yield run[:at], run[at + 1 :]
        place //= 8


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], plain_leaf(row), plain_leaf(row, True)))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees[name] = plain_tree([leaf for _, leaf, _ in groups[name]])
    top = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for place, (doc_id, leaf, shown) in enumerate(groups[name]):
            path = [*plain_path(trees[name], place), *plain_path(top, at)]
            folded = shown
            for before, after in path:
                folded = sha("".join([*before, folded, *after]))
            proof = sha("".join("".join(before + after) for before, after in path))
            root = top[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, proof, folded, folded == root))
    return out


def rows_of(frame):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()]


def key(row):
    return tuple((v is not None, v) for v in row)


def test_query_against_plain_rules(spark, odd, store, with_clashes):
    found = QUERIES["op11_merkle_manifest"](spark, store(documents=with_clashes(odd.repartition(3))))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_manifest(rows_of(odd)), key=key)


def test_empty_table(spark, none, store):
    assert QUERIES["op11_merkle_manifest"](spark, store(documents=none)).collect() == []


def many(sizes):
    return [(i * 3 + 1, f"Text {n} {i}", n, None, i) for n, size in sizes.items() for i in range(size)]


def test_trees_of_several_blocks(spark):
    """Groups around the sizes at which runs, blocks and levels end, and more than one block."""
    rows = many({"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "f": 4096, "g": 4097, None: 9000, "é": 7, "Z": 513})
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = merkle.witnesses(merkle.manifest(docs))
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()]
    expected = plain_manifest(rows)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert 0 < sum(r[-1] for r in expected) < len(expected)
    # the witness itself leads from the leaf to the root
    for r in found.where("id % 301 = 1").collect():
        node = r.leaf
        for run in r.runs:
            assert run.nodes[run.place] == node
            node = sha("".join(run.nodes))
        assert node == r.root


def test_one_row(spark):
    rows = [(7, "one", "en", "s", 3)]
    found = merkle.witnesses(merkle.manifest(spark.createDataFrame(rows, DOCUMENTS))).first()
    assert found.leaf == found.subroot == found.root == plain_leaf(rows[0])
    assert found.proof_sha256 == sha("") and found.runs == []


def test_appends_equal_one_build(spark):
    """Blocks that are extended twice are those of all rows at once, full blocks untouched."""
    rows = many({"a": 9000, "b": 3, "c": 4096, None: 40})
    later = [(10**6 + i, f"later {i}", n, "s", 1) for n, size in {"a": 20, "b": 5000, "c": 2, "new": 3}.items() for i in range(size)]
    last = [(2 * 10**6, "last", "b", None, None)]
    frame = lambda r: merkle.leaves(spark.createDataFrame(r, DOCUMENTS))
    first = merkle.blocks(frame(rows))
    grown = merkle.extend(merkle.extend(first, frame(later)), frame(last))
    expected = plain_manifest(rows + later + last)
    got = merkle.witnesses(merkle.build(grown), with_runs=False)
    columns = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(expected, key=key)
    full = {(r.tree, r.block): r.root for r in first.where(F.size("ids") == merkle.BLOCK).collect()}
    after = {(r.tree, r.block): r.root for r in grown.collect()}
    assert full and all(after[k] == v for k, v in full.items())


def test_append_out_of_order_is_refused(spark):
    frame = lambda r: merkle.leaves(spark.createDataFrame(r, DOCUMENTS))
    stored = merkle.blocks(frame(many({"a": 20})))
    with pytest.raises(Exception, match="does not follow"):
        merkle.extend(stored, frame([(5, "early", "a", None, None)]))
    with pytest.raises(Exception, match="does not follow"):
        merkle.extend(stored, frame([(None, "no id", "a", None, None)]))


def test_frontier_keeps_partial_witnesses():
    tree = merkle.Frontier()
    for i in range(9):
        tree.append(sha(str(i)))
    # the first run is complete: its leaves know their siblings; the ninth waits
    assert [len(w) for w in tree.witness] == [1] * 8 + [0]
    tree.append(sha("9"))
    tree.close()
    assert [len(w) for w in tree.witness] == [2] * 10
