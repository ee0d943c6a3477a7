"""Segmentation lattices over an existing piece vocabulary, for many strings at once.

A lattice has a node before and after every character of a string and an edge for
every piece that spells the characters between two nodes. All strings of a batch
share flat arrays: string k owns len(k) + 1 consecutive nodes. Pieces are found by
walking one trie from all positions together, one character per step.

A character without a piece of its own gets one edge that stands for its UTF-8
bytes as byte pieces, so every string has at least one segmentation.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: How these vocabularies write a blank.
SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Bits of the hash by which children in the trie are found.
HASH_BITS = 19


@dataclass
class Pieces:
    """Pieces of a vocabulary as a trie: sorted keys (node << 21 | character) -> child."""

    texts: list[str]
    ranks: np.ndarray  # position by score among the usable pieces, 0 is the best
    keys: np.ndarray
    children: np.ndarray
    piece: np.ndarray  # of a trie node, or -1
    byte: np.ndarray  # piece of every byte value

    def __post_init__(self):
        self.size = len(self.texts)
        # most walks end after one or two characters, so the first step has a table
        self.first = np.full(0x110000, -1, np.int32)
        root = self.keys < 1 << 21
        self.first[self.keys[root]] = self.children[root]
        self.children = self.children.astype(np.int32)
        self.piece = self.piece.astype(np.int32)
        self._hash_keys()

    def _hash_keys(self) -> None:
        """Places of the keys by hash; the few hashes that several keys share are searched by order."""
        at = self._places(self.keys)
        self.slots = np.zeros(1 << HASH_BITS, np.int32)
        self.slots[at] = np.arange(len(self.keys))
        self.shared = np.bincount(at, minlength=1 << HASH_BITS) > 1
        self.inner = np.zeros(len(self.piece), bool)  # nodes with children
        self.inner[self.keys >> 21] = True

    @staticmethod
    def _places(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)

    def step(self, state: np.ndarray, code: np.ndarray, depth: int) -> np.ndarray:
        """Children in the trie, -1 where there is none."""
        if depth == 0:
            return self.first[code]
        key = state.astype(np.int64) << 21 | code
        place = self._places(key)
        slot = self.slots[place]
        shared = np.flatnonzero(self.shared[place])
        if len(shared):
            slot[shared] = np.minimum(np.searchsorted(self.keys, key[shared]), len(self.keys) - 1)
        return np.where(self.keys[slot] == key, self.children[slot], np.int32(-1))

    def initial(self) -> np.ndarray:
        return np.array([t.startswith(SPACE) for t in self.texts])


@functools.cache
def processor(model: str = MODEL):
    """The library's own reader of a SentencePiece model."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


@functools.cache
def load(model: str = MODEL) -> Pieces:
    """Read a SentencePiece model; control pieces and the unknown piece are left out."""
    source = processor(model)
    texts, byte = [], np.full(256, -1)
    scores, usable = [], []
    for i in range(source.get_piece_size()):
        text = source.id_to_piece(i)
        texts.append(text)
        scores.append(source.get_score(i))
        if source.is_byte(i):
            byte[int(text[3:5], 16)] = i
        elif not (source.is_control(i) or source.is_unknown(i) or source.is_unused(i)):
            usable.append(i)
    ranks = np.empty(len(texts), np.int64)
    ranks[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(texts))
    nodes: dict[tuple[int, int], int] = {}
    ends = {}
    for i in usable:
        node = 0
        for c in texts[i]:
            node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
        ends[node] = i
    keys = np.array([node << 21 | c for node, c in nodes], np.int64)
    order = np.argsort(keys)
    piece = np.full(len(nodes) + 1, -1)
    piece[list(ends)] = list(ends.values())
    return Pieces(texts, ranks, keys[order], np.array(list(nodes.values()))[order], piece, byte)


@dataclass
class Lattice:
    """Edges ordered by string position, then length; `start[k]` is the first node of string k."""

    start: np.ndarray
    length: np.ndarray
    source: np.ndarray
    target: np.ndarray
    label: np.ndarray  # piece, or size of the vocabulary + character for its bytes
    owner: np.ndarray  # the string an edge belongs to
    steps: np.ndarray  # borders between groups of edges that never share a target
    size: int  # of the vocabulary

    @property
    def nodes(self) -> int:
        return int(self.length.sum()) + len(self.length)

    def groups(self, backwards: bool = False) -> Iterator[slice]:
        pairs = [slice(a, b) for a, b in zip(self.steps, self.steps[1:])]
        return reversed(pairs) if backwards else iter(pairs)


def build(strings: list[str], pieces: Pieces) -> Lattice:
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    # positions in a batch are small numbers; there are millions of them in every array
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), length)
    first = np.cumsum(length) - length
    limit = (first + length).astype(np.int32)[owner] if len(owner) else owner
    at = np.arange(len(code), dtype=np.int32)
    state, position = np.zeros(len(code), np.int32), at
    found = []
    alone = np.ones(len(code), bool)  # characters without a piece of one character
    depth = 0
    while len(position):
        state = pieces.step(state, code[position + depth], depth)
        hit = np.flatnonzero(state >= 0)
        position, state = position[hit], state[hit]
        depth += 1
        piece = pieces.piece[state]
        whole = np.flatnonzero(piece >= 0)
        ending = position[whole]
        found.append((ending, np.full(len(whole), depth, np.int32), piece[whole]))
        if depth == 1:
            alone[ending] = False
        inside = np.flatnonzero(pieces.inner[state] & (position + depth < limit[position]))
        position, state = position[inside], state[inside]
    rest = np.flatnonzero(alone).astype(np.int32)
    found.append((rest, np.ones(len(rest), np.int32), np.int32(pieces.size) + code[rest]))
    where, width, label = (np.concatenate([f[i] for f in found]) for i in range(3))
    del found, state, position, limit, alone, rest, at  # millions of entries each
    local = where - first.astype(np.int32)[owner[where]] if len(where) else where
    span = int(width.max()) + 1 if len(width) else 1
    # a byte edge never meets a piece of the same place and width, so (place, width) is unique
    level = local.astype(np.int64) * span + width
    # most strings are short, and short numbers are sorted by their digits
    order = np.argsort(level.astype(np.uint16) if span * (int(local.max(initial=0)) + 2) < 1 << 16 else level, kind="stable")
    del local
    where, width, label, level = where[order], width[order], label[order], level[order]
    del order
    steps = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(level) else np.zeros(1, int)
    own = owner[where] if len(where) else where
    source = where + own
    return Lattice(first + np.arange(len(strings)), length, source, source + width, label, own, steps, pieces.size)


def label_sums(lattice: Lattice, pieces: Pieces, values: np.ndarray) -> np.ndarray:
    """values[label] of every edge; for byte edges the sum over the character's bytes."""
    out = values[np.minimum(lattice.label, pieces.size - 1)]
    wide = np.flatnonzero(lattice.label >= pieces.size)
    if len(wide):
        codes, inverse = np.unique(lattice.label[wide] - pieces.size, return_inverse=True)
        sums = [values[pieces.byte[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in codes]
        out[wide] = np.array(sums)[inverse]
    return out


def forward(lattice: Lattice, score: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all paths from the string's first node to each node."""
    total = np.full(lattice.nodes, -np.inf)
    total[lattice.start] = 0.0
    for g in lattice.groups():
        target = lattice.target[g]
        total[target] = np.logaddexp(total[target], total[lattice.source[g]] + score[g])
    return total


def backward(lattice: Lattice, score: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all paths from each node to the string's last node."""
    total = np.full(lattice.nodes, -np.inf)
    total[lattice.start + lattice.length] = 0.0
    for g in lattice.groups(backwards=True):
        source = lattice.source[g]
        total[source] = np.logaddexp(total[source], total[lattice.target[g]] + score[g])
    return total
