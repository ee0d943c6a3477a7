"""Sampled segmentations without replacement: Gumbel top-k by A* search.

A text is encoded as SentencePiece does (a blank becomes the space mark, one mark is
put in front) and all segmentations over the vocabulary form a lattice. A segmentation
has probability proportional to the product of its piece weights; the vocabulary's
scores are merge ranks, so a piece of rank r weighs (r + 2.7) ** -ALPHA (Zipf's law,
flattened for more variety).

Adding independent Gumbel noise to the log probabilities of all segmentations and
taking the k largest sums draws k distinct ones without replacement. The search never
lists them: the largest sum within a set of segmentations is a Gumbel variable at the
log of the set's total probability, so sets are split top down and each part gets a
sum that is conditioned on the whole's:

* from the best set, a path is drawn step by step through the lattice (backward sums
  give the probabilities); it inherits the set's sum and is the next segmentation;
* what remains of the set falls apart into one set for every step of the path, "same
  pieces before, another piece here". Each gets a Gumbel at its log probability,
  truncated at the sum of the set it came from;
* the set with the largest sum is next. The sums bound what is inside exactly, so
  segmentations come out in falling order, and the largest sum left after the k-th
  is the threshold t of their inclusion probabilities 1 - exp(-exp(log p - t)).

Random numbers are hashes of the row's key, the sample, and the step, so they don't
depend on batches, partitions or retries.

Pieces never reach across a border between two parts of the text, a part being blanks
and what follows them up to the next blank or control character (`check_borders`
proves that for the vocabulary). Lattices are therefore built once for every different
part of a batch, and paths of all rows of a batch are drawn together.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import lattice as lt

K = 2
ALPHA = 0.5
SEED = 20
#: Steps of a path that are split off one by one; later ones are one set until needed.
NEAR = 48
#: Characters encoded together.
BATCH = 4 << 20
# control characters but the carriage return, with which some pieces end
_CONTROL = "\x00-\x0c\x0e-\x1f\x7f"
_PART = re.compile(f"▁+[^▁{_CONTROL}]*|[^▁{_CONTROL}]+|[{_CONTROL}]")


_MASK = (1 << 64) - 1


def check_borders(pieces: lt.Pieces) -> bool:
    """Whether no piece continues beyond the border of a part."""
    inner = re.compile(f"[^▁]▁|[{_CONTROL}].|.[{_CONTROL}]", re.S)
    return not any(inner.search(t) for t in pieces.texts)


def parts_of(text: str) -> list[str]:
    return _PART.findall(lt.SPACE + text.replace(" ", lt.SPACE)) if text else []


def _hash(x: np.ndarray) -> np.ndarray:
    """SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _one(*parts: int) -> float:
    """A number in (0, 1) from whole numbers, by the same mixing as `_hash`."""
    x = 0
    for part in parts:
        x = (x ^ part) + 0x9E3779B97F4A7C15 & _MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
        x ^= x >> 31
    return ((x >> 12) + 0.5) / float(1 << 52)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashed keys."""
    return ((_hash(x) >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _gumbel(u: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at - np.log(-np.log(u))


def _below(u: float, at: float, limit: float) -> float:
    """`_truncated` for one number."""
    g = at - math.log(-math.log(u))
    return min(g, limit) - math.log1p(math.exp(-abs(g - limit)))


def _truncated(u: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """A Gumbel at `at` that is known not to exceed `limit`."""
    g = _gumbel(u, at)
    # -log(exp(-limit) + exp(-g)), without overflow
    return np.minimum(g, limit) - np.log1p(np.exp(-np.abs(g - limit)))


class Sampler:
    def __init__(self, model: str = lt.MODEL):
        self.pieces = lt.load(model)
        if not check_borders(self.pieces):
            raise ValueError("a piece of this vocabulary reaches across parts")
        self.score = -ALPHA * np.log(self.pieces.ranks + 2.7)

    def lattices(self, names: list[str]):
        """Flat tables for drawing: per node the first edge, per edge target and the shares up to it."""
        graph = lt.build(names, self.pieces)
        graph.owner = None
        weight = lt.label_sums(graph, self.pieces, self.score)
        behind = lt.backward(graph, weight)
        # what is not needed any more is given up at once: a batch has millions of edges
        weight += behind[graph.target]
        weight -= behind[graph.source]
        # by node, long pieces first: they are the likely ones
        width = graph.target - graph.source
        span = int(width.max(initial=0)) + 1
        # no two edges have the same place and width; short numbers are sorted faster
        kind = np.int32 if (graph.nodes + 1) * span < 1 << 31 else np.int64
        order = np.argsort(graph.source.astype(kind) * kind(span) - width.astype(kind)).astype(np.int32)
        del width, behind
        source, graph.source = graph.source[order].astype(np.int32, copy=False), None
        target, graph.target = graph.target[order].astype(np.int32, copy=False), None
        label, graph.label = graph.label[order].astype(np.int32, copy=False), None
        log_p = weight[order]
        del weight, order
        count = np.bincount(source, minlength=graph.nodes)
        first = np.cumsum(count) - count
        # added up node by node, so that a part's shares don't depend on what else is in the batch
        upto = np.exp(log_p)
        many, left = first, count
        for place in range(1, int(count.max(initial=0))):
            more = np.flatnonzero(left > place)
            many, left = many[more], left[more]
            at = many + place
            upto[at] += upto[at - 1]
        upto[(first + count - 1)[count > 0]] = 2.0  # above any number drawn
        # a character of one byte, such as a line break, is that byte's piece
        single = np.flatnonzero((label >= graph.size) & (label < graph.size + 128))
        label[single] = self.pieces.byte[label[single] - graph.size]
        return _Tables(graph, source, target, label, log_p, upto, first, count)

    def draw(self, tables: _Tables, starts: np.ndarray, keys: np.ndarray):
        """Draw the rest of a part's path for many nodes at once.

        Returns (edges, offsets): path j is edges[offsets[j]:offsets[j + 1]].
        """
        node, active = starts.copy(), np.flatnonzero(tables.count[starts] > 0)
        length = np.zeros(len(starts), np.int64)
        rounds = []
        step = 0
        while len(active):
            u = _uniform(keys[active] + np.uint64(step * 0x9E37 + 1))
            at = node[active]
            edge = tables.first[at]
            beyond = np.flatnonzero(u >= tables.upto[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= tables.upto[edge[beyond]]]
            rounds.append((active, edge))
            length[active] += 1
            node[active] = tables.target[edge]
            active = active[tables.count[node[active]] > 0]
            step += 1
        offsets = np.r_[0, np.cumsum(length)]
        edges = np.zeros(offsets[-1], np.int64)
        for step, (rows, edge) in enumerate(rounds):
            edges[offsets[rows] + step] = edge
        return edges, offsets

    def sample(self, texts: list[str | None], keys: list[int], k: int = K) -> Iterator[list[Sample]]:
        """The k samples of every text, fewer where there are fewer segmentations."""
        index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        at = []
        for text in texts:
            found = parts_of(text or "")
            at.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
        tables = self.lattices(list(index))
        starts = [tables.graph.start[a] for a in at]
        rows = [_Row(s, key, k) for s, key in zip(starts, keys)]
        for number in range(k):
            jobs = [(r, job) for r in rows if (job := r.next(tables, number)) is not None]
            if not jobs:
                break
            sizes = [len(job.starts) for _, job in jobs]
            flat = np.concatenate([job.starts for _, job in jobs]) if jobs else np.zeros(0, int)
            place = np.concatenate([np.arange(job.skip, job.skip + n) for (_, job), n in zip(jobs, sizes)])
            seeds = np.repeat(np.array([r.key for r, _ in jobs], np.uint64), sizes)
            draw_keys = _hash(_hash(seeds + np.uint64(number)) + place.astype(np.uint64))
            edges, offsets = self.draw(tables, flat, draw_keys)
            begin = 0
            for (row, job), n in zip(jobs, sizes):
                row.take(job, edges[offsets[begin] : offsets[begin + n]], tables)
                begin += n
        for row in rows:
            yield row.finish(tables, self.pieces)


class _Tables:
    def __init__(self, graph, source, target, label, log_p, upto, first, count):
        self.graph, self.source, self.target, self.label = graph, source, target, label
        self.log_p, self.upto, self.first, self.count = log_p, upto, first, count
        self.spelled = bool((label >= graph.size).any())  # some characters have no piece


class Sample:
    """One segmentation: piece ids, log probability, perturbed sum, inclusion probability."""

    __slots__ = ("ids", "log_p", "perturbed", "inclusion")

    def __init__(self, ids, log_p, perturbed, inclusion):
        self.ids, self.log_p, self.perturbed, self.inclusion = ids, log_p, perturbed, inclusion


class _Job:
    """A set to draw a path from: the pieces before, and the nodes to go on from."""

    def __init__(self, prefix, starts, skip, total):
        self.prefix, self.starts, self.skip, self.total = prefix, starts, skip, total


class _Row:
    """The search of one row. A set is (sum, path, step, edges not allowed there, late)."""

    def __init__(self, starts: np.ndarray, key: int, k: int):
        self.starts, self.key, self.k = starts, key & _MASK, k
        self.sets: list[tuple] = []
        self.paths: list[np.ndarray] = []
        self.sums: list[float] = []

    def _add(self, found: list[tuple]) -> None:
        """Of all sets only the k largest can still be opened or be the threshold."""
        self.sets = sorted(self.sets + found, key=lambda s: -s[0])[: self.k + 1]

    def next(self, tables: _Tables, number: int) -> _Job | None:
        if number == 0:
            top = -math.log(-math.log(_one(self.key, 0)))
            return _Job(np.zeros(0, np.int64), self.starts, 0, top)
        while self.sets:
            total, path, step, barred, late = self.sets.pop(0)
            if late:  # steps not yet split off: do that now; one of them has the sum itself
                self._split(tables, path, step, total, exact=True)
                continue
            edges = self.paths[path]
            node = tables.source[edges[step]]
            options = np.arange(tables.first[node], tables.first[node] + tables.count[node])
            for other in barred:  # a few at most
                options = options[options != other]
            p = np.exp(tables.log_p[options])
            pick = int(np.searchsorted(np.cumsum(p), _one(self.key, 1, number) * p.sum()))
            edge = int(options[min(pick, len(options) - 1)])
            rest = options[options != edge]
            if len(rest):
                mass = float(tables.log_p[edges[:step]].sum() + np.log(np.exp(tables.log_p[rest]).sum()))
                self._add([(
                    _below(_one(self.key, 2, number), mass, total), path, step, [*barred, edge], False
                )])
            prefix = np.append(edges[:step], edge)
            done = int((tables.count[tables.target[prefix]] == 0).sum())  # whole parts so far
            here = tables.target[edge]
            follow = self.starts[done:]
            if tables.count[here]:
                follow = np.concatenate(([here], self.starts[done + 1 :]))
            return _Job(prefix, follow, done, total)
        return None

    def take(self, job: _Job, edges: np.ndarray, tables: _Tables) -> None:
        self.paths.append(np.concatenate((job.prefix, edges)) if len(job.prefix) else edges)
        self.sums.append(job.total)
        self._split(tables, len(self.paths) - 1, len(job.prefix), job.total)

    def _split(self, tables, path, step, limit, exact=False):
        """Sets that leave the path at `step` or later, with sums below `limit`.

        If `exact`, one of them is known to have the sum `limit`: it is drawn by its share.
        """
        edges = self.paths[path]
        end = len(edges) if exact else min(len(edges), step + NEAR)
        if step >= len(edges):
            return
        log_p = tables.log_p[edges[step:end]]
        ahead = float(tables.log_p[edges[:step]].sum()) + np.cumsum(log_p) - log_p
        stay = np.expm1(log_p)  # minus the share of the other edges
        some = np.flatnonzero((stay < 0) & (tables.count[tables.source[edges[step:end]]] > 1))
        found = []
        if len(some):
            mass = ahead[some] + np.log(-stay[some])
            salt = np.uint64((self.key * 3 + path * 0x10001 + 0x5DEECE66D) & _MASK)
            g = _truncated(_uniform(_hash(salt + (step + some).astype(np.uint64))), mass, limit)
            if exact:
                p = np.cumsum(np.exp(mass - mass.max()))
                g[min(int(np.searchsorted(p, _one(self.key, 3, path) * p[-1])), len(some) - 1)] = limit
            best = np.argpartition(-g, self.k)[: self.k + 1].tolist() if len(g) > self.k + 1 else range(len(g))
            sums = g.tolist()
            for i in sorted(best, key=lambda i: -sums[i]):
                at = step + int(some[i])
                found.append((sums[i], path, at, [edges[at]], False))
        if end < len(edges):
            rest = float(tables.log_p[edges[end:]].sum())
            if rest < 0:
                mass = float(ahead[-1] + log_p[-1]) + math.log(-math.expm1(rest))
                found.append((_below(_one(self.key, 4, path, end), mass, limit), path, end, [], True))
        self._add(found)

    def finish(self, tables: _Tables, pieces: lt.Pieces) -> list[Sample]:
        threshold = self.sets[0][0] if self.sets else -math.inf
        out = []
        for path, total in zip(self.paths, self.sums):
            log_p = float(tables.log_p[path].sum())
            inclusion = 1.0
            if threshold > -math.inf and log_p - threshold < 50.0:
                inclusion = -math.expm1(-math.exp(log_p - threshold))
            ids = tables.label[path]
            out.append(Sample(_ids(ids, pieces) if tables.spelled else ids, log_p, total, inclusion))
        return out


def _ids(labels: np.ndarray, pieces: lt.Pieces) -> np.ndarray:
    """Piece ids of edge labels: characters without a piece become their bytes."""
    wide = np.flatnonzero(labels >= pieces.size)
    if not len(wide):
        return labels
    codes, kind = np.unique(labels[wide] - pieces.size, return_inverse=True)
    spelled = [pieces.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes]
    width = np.ones(len(labels), np.int64)
    width[wide] = np.array([len(b) for b in spelled])[kind]
    out = np.repeat(labels, width)
    begin = (np.cumsum(width) - width)[wide]
    for number, b in enumerate(spelled):
        at = begin[kind == number]
        for offset, piece in enumerate(b):
            out[at + offset] = piece
    return out.astype(np.int32)


def spelling(ids: np.ndarray, model: str = lt.MODEL) -> bytes:
    """The bytes of the pieces on end."""
    return b"".join(_spellings(model)[ids].tolist())


def decode(ids, model: str = lt.MODEL) -> str:
    """The text of piece ids: bytes are put together, marks are blanks, the first is dropped."""
    return spelling(np.asarray(ids, np.int64), model).decode("utf-8", "surrogatepass").replace(lt.SPACE, " ")[1:]


def marked_bytes(text: str) -> bytes | None:
    """What the pieces of a text spell; None if it has a mark of its own, which would not come back."""
    if lt.SPACE in text:
        return None
    return (lt.SPACE + text.replace(" ", lt.SPACE)).encode("utf-8", "surrogatepass") if text else b""


@functools.cache
def _spellings(model: str) -> np.ndarray:
    """The bytes of every piece."""
    pieces = lt.load(model)
    raw = np.empty(pieces.size, object)
    raw[:] = [t.encode("utf-8") for t in pieces.texts]
    for value, piece in enumerate(pieces.byte):
        if piece >= 0:
            raw[piece] = bytes([value])
    return raw


@functools.cache
def _sampler(model: str) -> Sampler:
    return Sampler(model)


def row_key(doc_id: int | None, text: str | None, seed: int = SEED) -> int:
    """From the id; rows without one are told apart by their text."""
    name = f"{seed}|{doc_id}" if doc_id is not None else f"{seed}|?{zlib.crc32((text or '').encode('utf-8', 'surrogatepass'))}"
    low = zlib.crc32(name.encode())
    return low | zlib.crc32(name[::-1].encode(), 77) << 32


def sample_segmentations(
    docs: DataFrame, k: int = K, seed: int = SEED, model: str = lt.MODEL,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = True,
) -> DataFrame:
    """doc_id, rank, n_pieces, log_p, perturbed, inclusion, round_trip, ids_crc32 and ids.

    One row for each of the up to k different segmentations of a document, best sum
    first. A NULL text is encoded like an empty one, as a single segmentation without
    pieces. round_trip tells whether the ids decode to the text. Repeated rows give the
    same samples again; an empty table gives none.
    """
    fields = "doc_id long, rank int, n_pieces int, log_p double, perturbed double, inclusion double, round_trip boolean, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                ids, texts, size = [], [], 0
                while start < batch.num_rows and size < BATCH:
                    texts.append(batch.column(1)[start].as_py())
                    ids.append(batch.column(0)[start].as_py())
                    size += len(texts[-1] or "")
                    start += 1
                keys = [row_key(i, t, seed) for i, t in zip(ids, texts)]
                rows, held = [], []
                for i, t, samples in zip(ids, texts, sampler.sample(texts, keys, k)):
                    wanted = marked_bytes(t or "")
                    for rank, s in enumerate(samples, 1):
                        same = spelling(s.ids, model) == wanted
                        rows.append((i, rank, len(s.ids), s.log_p, s.perturbed, s.inclusion, same, zlib.crc32(s.ids)))
                        held.append(s.ids)
                names = [f.split()[0] for f in fields.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = fields + (", ids array<int>" if with_ids else "")
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")
    ).mapInArrow(run, schema)
