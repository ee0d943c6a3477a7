"""A Merkle manifest of a dataset, with witnesses that grow as rows are appended.

Every row is a leaf. Leaves of one group ascend by id and make a tree: runs of `FAN`
consecutive nodes become one node of the next level, until one is left, the subroot.
Subroots, in order of their groups, make the last tree in the same way.

A tree is written by aligned appends (`Frontier`). Each level keeps one open run. A node
that is appended starts an open subtree; when its run is complete, the run's parent is
appended one level higher, and every leaf below gets the siblings that its witness lacked.
So a witness is partial while its subtree is open, and each later completion extends it.

Trees larger than one task are appended block by block: `BLOCK` leaves, aligned, are
one task's append. Block roots are then nothing but further appends, to trees whose leaves
are block roots, block by block again, and so are the subroots. Their witnesses come down
the same way: what a block root still lacks is what every leaf below it lacks.

The blocks are a table (`blocks`). `extend` appends to a stored one: full blocks stay as
they are, only the open last block of each group is taken up again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.session import settle

FAN = 8
#: Levels and leaves of a block.
DEPTH = 4
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """Hex SHA-256 of hex digests on end."""
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def field(value: bytes | int | None) -> bytes:
    """`-` for NULL, else the number of bytes, a colon and the bytes."""
    if value is None:
        return b"-"
    raw = value if isinstance(value, bytes) else b"%d" % value
    return b"%d:%s" % (len(raw), raw)


def leaf_digest(*values: bytes | int | None) -> str:
    h = hashlib.sha256()
    for value in values:
        h.update(field(value))
    return h.hexdigest()


class Frontier:
    """One tree under aligned appends.

    `open[l]` is the open run of level l: (digest, leaves below). A leaf's witness is a
    list of runs (digests, own place), lowest level first. `siblings` are what it lacks
    in a run: all but its own.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[str, range]]] = [[]]
        self.witness: list[list[tuple[list[str], int]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, leaf, range(at, at + 1))

    def _add(self, level: int, node: str, leaves: range) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        run.append((node, leaves))
        if len(run) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _ in run]
        for place, (_, leaves) in enumerate(run):
            for leaf in leaves:
                self.witness[leaf].append((nodes, place))
        self._add(level + 1, digest(*nodes), range(run[0][1].start, run[-1][1].stop))

    def close(self, depth: int | None = None) -> str:
        """Complete the open runs, lowest first, and return the root.

        Without `depth` the tree ends where one node remains; with it, the tree is a block of
        a larger one, and runs of one node are hashed as well until that level is reached.
        """
        level = 0
        while True:
            above = any(self.open[level + 1 :])
            run = self.open[level]
            if depth is None and not above and len(run) == 1 or level == depth:
                return run[0][0]
            if run:
                self._complete(level)
            level += 1


def _fold(node: str, witness: Sequence[tuple[list[str], int]]) -> str:
    for nodes, place in witness:
        node = digest(*nodes[:place], node, *nodes[place + 1 :])
    return node


def _siblings(witness: Sequence[tuple[list[str], int]]) -> str:
    return "".join("".join(nodes[:place] + nodes[place + 1 :]) for nodes, place in witness)


def _tree(leaves: list[str], many: bool) -> tuple[str, Frontier]:
    tree = Frontier()
    for leaf in leaves:
        tree.append(leaf)
    return tree.close(DEPTH if many else None), tree


def tampered(doc_id: int | None, text: bytes | None) -> bytes | None:
    """The text as somebody changed it: A-Z lower-cased where 3 divides the id's CRC-32."""
    if doc_id is None or text is None or zlib.crc32(b"%d" % doc_id) % 3:
        return text
    return text.lower()


def leaves(docs: DataFrame, shown=tampered) -> DataFrame:
    """(id, tree, leaf, shown): the leaf of every row, and that of the row as it is shown later.

    `shown` gives the text that is presented for verification.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            rows = [c.to_pylist() for c in raw[:-1]]
            out: list[list] = [[], []]
            for i, values in enumerate(zip(*rows)):
                text = raw[-1][i].as_py()
                leaf = leaf_digest(*values, text)
                seen = shown(values[0], text)
                out[0].append(leaf)
                out[1].append(leaf if seen == text else leaf_digest(*values, seen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *[pa.array(c, pa.string()) for c in out]],
                names=["id", "tree", "leaf", "shown"],
            )

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"),
        "text",
    )
    return named.mapInArrow(run, "id long, tree string, leaf string, shown string")


def _placed(rows: DataFrame, order: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """Add `place`, counted from 0 in every tree, and `size`, the rows of the tree.

    Rows are sorted in ranges that reach across trees, so a large tree has many ranges and
    many small ones share one; a row's place is its place in the range and the sum of the
    tree's earlier ranges. `before` (tree, held) tells how many leaves a tree has already.
    """
    part = F.shiftright("__at", 33)
    ranged = rows.repartitionByRange(F.col("tree").asc_nulls_first(), *order).sortWithinPartitions(
        F.col("tree").asc_nulls_first(), *order
    )
    stored = settle(ranged.withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    # one row for each tree and range it reaches into
    counted = stored.groupBy("tree", part.alias("__part")).agg(
        F.count("*").alias("__n"), F.min("__at").alias("__first")
    )
    own = Window.partitionBy("tree")
    earlier = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        F.col("tree").alias("__tree"), "__part", "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(own).alias("size"),
    )
    if before is not None:
        held = before.select(F.col("tree").alias("__of"), "held")
        offsets = offsets.join(held, F.col("__of").eqNullSafe(F.col("__tree")), "left").withColumn(
            "held", F.coalesce("held", F.lit(0))
        ).withColumns({"__before": F.col("__before") + F.col("held"), "size": F.col("size") + F.col("held")}).drop(
            "__of", "held"
        )
    joined = stored.withColumn("__part", part).join(
        offsets.withColumnRenamed("__part", "__of_part"),
        (F.col("__part") == F.col("__of_part")) & F.col("tree").eqNullSafe(F.col("__tree")),
    )
    return joined.withColumn("place", F.col("__at") - F.col("__first") + F.col("__before")).select(
        *rows.columns, "place", "size"
    )


_BLOCK = "tree string, block long, many boolean, ids array<long>, leaves array<string>, shown array<string>, root string"


def _packed(placed: DataFrame) -> DataFrame:
    """One row per block from (tree, id, leaf, shown, place, size): its leaves and its root."""
    def pack(group: pa.Table) -> pa.Table:
        rows = group.sort_by("place").combine_chunks()
        found, many = rows.column("leaf").to_pylist(), rows.column("size")[0].as_py() > BLOCK
        root, _ = _tree(found, many)
        one = lambda name: pa.array([rows.column(name).to_pylist()])
        return pa.table({
            "tree": rows.column("tree").slice(0, 1), "block": pa.array([rows.column("place")[0].as_py() // BLOCK]),
            "many": pa.array([many]), "ids": one("id").cast(pa.list_(pa.int64())), "leaves": pa.array([found]),
            "shown": one("shown").cast(pa.list_(pa.string())), "root": pa.array([root]),
        })

    rows = placed.select("tree", F.col("id").cast("long").alias("id"), "leaf", "shown", "place", "size")
    return rows.groupBy(rows.tree, F.expr(f"place div {BLOCK}")).applyInArrow(lambda _, t: pack(t), _BLOCK)


@dataclass
class Manifest:
    """Blocks of the groups' trees, of the trees above them, and of the tree of subroots.

    Each level is (tree, block, many, ids, leaves, shown, root). What is a leaf on one level
    is a block of the level below: id is that block's number. `tops` has (tree, subroot), the
    place of the tree among all being its leaf in the last level.
    """

    blocks: DataFrame
    upper: list[DataFrame]
    tops: DataFrame
    last: list[DataFrame]
    root: str | None


def _climb(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of block roots until every tree has one block; and (tree, subroot)."""
    levels, tops, now = [], None, blocks
    while True:
        done = now.where(~F.col("many")).select("tree", F.col("root").alias("subroot"))
        tops = done if tops is None else tops.unionByName(done)
        rest = now.where("many")
        sizes = rest.groupBy("tree").agg(F.count("*").alias("size"))
        rows = rest.select("tree", F.col("block").alias("id"), F.col("root").alias("leaf"))
        if rest.isEmpty():
            return levels, settle(tops, "merkle-tops")
        sized = rows.join(
            sizes.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree"))
        ).select("tree", "id", "leaf", F.lit(None).cast("string").alias("shown"), F.col("id").alias("place"), "size")
        now = settle(_packed(sized), "merkle-level")
        levels.append(now)


def blocks(rows: DataFrame) -> DataFrame:
    """The stored blocks of (id, tree, leaf, shown): ids ascend, NULL first; equal ids by leaf."""
    return settle(_packed(_placed(settle(rows, "merkle-leaves"), ["id", "leaf"])), "merkle-blocks")


def extend(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The blocks after appending rows (id, tree, leaf, shown) whose ids follow the stored ones.

    Full blocks are taken over. The open last block of a tree goes on: its leaves get the
    witnesses that the new siblings complete. A row that would have to go before a stored
    one is an error, as it would change blocks that are closed.
    """
    last = stored.groupBy("tree").agg(
        F.max_by(F.struct("ids", "leaves", "shown", "block"), "block").alias("b")
    )
    held = last.select(
        F.col("tree").alias("__tree"), F.element_at("b.ids", -1).alias("__last"),
        (F.col("b.block") * BLOCK + F.size("b.ids")).alias("held"),
    )
    joined = rows.join(held, F.col("tree").eqNullSafe(F.col("__tree")), "left")
    early = F.col("held").isNotNull() & (F.col("id").isNull() | F.coalesce(F.col("id") <= F.col("__last"), F.lit(False)))
    wrong = F.raise_error(F.lit("an appended id does not follow the stored ones")).cast("string")
    checked = joined.withColumn("leaf", F.when(early, wrong).otherwise(F.col("leaf"))).select(*rows.columns)
    placed = _placed(settle(checked, "merkle-leaves"), ["id", "leaf"], held.select(F.col("__tree").alias("tree"), "held"))
    grown = placed.groupBy("tree").agg(F.max("size").alias("size"))
    opened = last.where(F.size("b.ids") < BLOCK).select("tree", "b.*").join(
        grown.select(F.col("tree").alias("__tree"), "size"), F.col("tree").eqNullSafe(F.col("__tree"))
    )
    reopened = opened.select(
        "tree", "block", "size", F.posexplode(F.arrays_zip("ids", "leaves", "shown")).alias("pos", "row")
    ).select(
        F.col("row.ids").alias("id"), "tree", F.col("row.leaves").alias("leaf"), F.col("row.shown").alias("shown"),
        (F.col("block") * BLOCK + F.col("pos")).alias("place"), "size",
    )
    fresh = settle(_packed(placed.unionByName(reopened)), "merkle-fresh")
    kept = stored.join(
        fresh.select(F.col("tree").alias("__tree"), F.col("block").alias("__block")),
        F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")), "left_anti",
    )
    both = kept.unionByName(fresh)
    # a tree that had one full block has several now
    sizes = both.groupBy("tree").agg((F.max("block") > 0).alias("__many")).withColumnRenamed("tree", "__tree")
    return settle(
        both.join(sizes, F.col("tree").eqNullSafe(F.col("__tree"))).withColumn("many", F.col("__many")).select(*both.columns),
        "merkle-blocks",
    )


def build(stored: DataFrame) -> Manifest:
    """The trees above stored blocks, up to the root; NULL for no rows."""
    upper, tops = _climb(stored)
    roots = tops.select(
        F.lit("").alias("tree"), F.col("tree").alias("__name"), F.col("subroot").alias("leaf"),
        F.lit(None).cast("string").alias("shown"),
    )
    placed = settle(_placed(roots, [F.col("__name").asc_nulls_first()]), "merkle-roots")
    first = settle(_packed(placed.withColumn("id", F.col("place"))), "merkle-level")
    above, top = _climb(first)
    root = top.first()
    tops = placed.select(F.col("__name").alias("tree"), F.col("leaf").alias("subroot"), "place")
    return Manifest(stored, upper, tops, [first, *above], root["subroot"] if root else None)


def _down(levels: list[DataFrame], lacking: DataFrame | None) -> DataFrame | None:
    """(tree, id, runs): what each leaf of the lowest level lacks up to the top of these levels.

    `lacking` (tree, runs) is what the tree itself lacks. A run is (nodes, place).
    """
    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, tree = _tree(row["leaves"], row["many"])
                above = row["runs"] or []
                runs = [[{"nodes": n, "place": p} for n, p in w] + above for w in tree.witness]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(runs), pa.string()), pa.array(row["ids"], pa.int64()),
                     pa.array(runs, _RUNS_ARROW)],
                    names=["tree", "id", "runs"],
                )

    found = None
    for level in reversed(levels):
        found = _with_runs(level, found, lacking).select("tree", "ids", "leaves", "many", "runs").mapInArrow(
            witnesses, f"tree string, id long, runs {_RUNS}"
        )
    return found


_RUNS = "array<struct<nodes:array<string>,place:int>>"
_RUNS_ARROW = pa.list_(pa.struct([("nodes", pa.list_(pa.string())), ("place", pa.int32())]))


def _with_runs(level: DataFrame, above: DataFrame | None, lacking: DataFrame | None) -> DataFrame:
    """Blocks with the runs their roots lack: from the level above, or those of the tree itself."""
    out = level
    same = F.col("tree").eqNullSafe(F.col("__tree"))
    runs = []
    if above is not None:
        rest = above.select(F.col("tree").alias("__tree"), F.col("id").alias("__id"), F.col("runs").alias("__above"))
        out = out.join(rest, same & (F.col("block") == F.col("__id")), "left").drop("__tree", "__id")
        runs.append(F.col("__above"))
    if lacking is not None:
        # a block below others gets the tree's part with what comes from above
        rest = lacking.select(F.col("tree").alias("__tree"), F.col("runs").alias("__tops"))
        out = out.join(rest, same, "left").drop("__tree")
        runs.append(F.when(~F.col("many"), F.col("__tops")))
    value = F.coalesce(*runs) if runs else F.lit(None).cast(_RUNS)
    return out.withColumn("runs", value).drop("__above", "__tops")


def witnesses(manifest: Manifest, with_runs: bool = True) -> DataFrame:
    """(id, leaf, tree, subroot, root, proof_sha256, folded_root, verified and runs) of every row.

    `runs` is the whole witness: the completed runs from the leaf up to the root, each with
    the leaf's own place in it. proof_sha256 is the digest of all siblings, lowest level
    first, left to right; folded_root is computed from the shown leaf and these siblings.

    A group of one row has its leaf as subroot, and one group alone its subroot as root; no
    siblings give the digest of nothing. NULL ids come first, equal ids go by their leaves
    and repeated rows are leaves of their own. An empty table gives no rows and no root.
    """
    root = manifest.root
    of_roots = _down(manifest.last, None)
    tops = manifest.tops
    if of_roots is not None:
        tops = tops.join(of_roots.select("id", "runs"), tops["place"] == of_roots["id"], "left").drop("id")
    tops = settle(tops.select("tree", "subroot", "runs"), "merkle-tops")
    blocks_with = _with_runs(manifest.blocks, _down(manifest.upper, tops), tops)
    named = blocks_with.join(
        tops.select(F.col("tree").alias("__tree"), "subroot"), F.col("tree").eqNullSafe(F.col("__tree"))
    )

    schema = (
        "id long, leaf string, tree string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean"
    ) + (f", runs {_RUNS}" if with_runs else "")
    names = [f.split()[0] for f in schema.split(", ")][: 8 + with_runs]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, tree = _tree(row["leaves"], row["many"])
                above = [(r["nodes"], r["place"]) for r in row["runs"] or []]
                n = len(row["leaves"])
                upper = _siblings(above)
                proofs = [digest(_siblings(w), upper) for w in tree.witness]
                folded = [_fold(s, w + above) for s, w in zip(row["shown"], tree.witness)]
                columns = [
                    pa.array(row["ids"], pa.int64()), pa.array(row["leaves"]), pa.array([row["tree"]] * n, pa.string()),
                    pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded),
                    pa.array([f == root for f in folded]),
                ]
                if with_runs:
                    runs = [[{"nodes": a, "place": p} for a, p in w + above] for w in tree.witness]
                    columns.append(pa.array(runs, _RUNS_ARROW))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return named.select("tree", "ids", "leaves", "shown", "many", "runs", "subroot").mapInArrow(verify, schema)


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of documents: leaves, blocks and the trees above them."""
    return build(blocks(leaves(docs)))
