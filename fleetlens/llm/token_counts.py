"""Token counts of whole documents, huge ones by overlapping chunks.

A tokenizer library takes a text at once, so a huge document would need memory
and time without bound in one call. It is cut into chunks that overlap, and each
chunk is encoded with offsets into the document. Two neighbouring chunks are
spliced at a position in their overlap that is a *proven* boundary:

* the text has a blank before it and a non-blank at it. The pre-tokenizer removes
  blanks and never matches across one, the normalizer maps each run of blanks to
  one blank, and no composition, piece or special token contains a blank, so
  nothing right of the position can depend on anything left of it or vice versa
  (`blank_separated` verifies these properties on the tokenizer at hand);
* both encodings have a token that starts there, and from there on to the end of
  the overlap they agree token by token, ids and offsets.

If an overlap has no such position, because it lies inside an unbroken string or
because the encodings disagree, the next chunk starts earlier: the overlap is
doubled until a boundary is found or the last proven boundary is reached. What lies
before a boundary is settled and never looked at again, so a count keeps the tokens
of a few chunks at a time, however long the document is.

Documents of up to `CHUNK` characters are a single chunk. Since their blanks are
proven boundaries too, the parts between blanks are encoded once per worker and
remembered: a large batch holds few different ones. Counts are those of the
library for the whole text, without begin, end or added special tokens.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CHUNK = 32768
OVERLAP = 256
#: Words, and bytes of words, remembered by a worker before its memory is emptied.
REMEMBERED = 400_000
REMEMBERED_BYTES = 1 << 25
#: Characters handed to the library in one call.
CALL = 1 << 18

_BLANKS = frozenset(" \t\n\x0b\x0c\r")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def blank_separated(path: str) -> bool:
    """Whether no token of this tokenizer can depend on text beyond a blank."""
    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    special = [t for t in spec.get("added_tokens", ())]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or _BLANKS & set(t["content"]) for t in special):
        return False
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    for step in steps:
        blanks = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if not (blanks or step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")):
            return False
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    # every alternative is free of blanks: literals, classes of letters or numbers, or "not blank"
    plain = all(
        part.startswith("'") or part in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")
        for part in pattern.split("|")
    )
    return bool(removes and pattern and plain)


class Resync:
    """Encodes whole documents by chunks; `encode` gives ids and offsets, `count` numbers."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = _load(path)
        self.chunk, self.overlap = chunk, overlap
        self.separated = blank_separated(path)
        self.known: dict[bytes, int] = {}
        self.held = 0

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def chunks(self, text: str) -> list[tuple[int, int]]:
        """Chunk c covers [c * chunk, (c + 1) * chunk + overlap)."""
        n = len(text)
        spans = [(s, min(n, s + self.chunk + self.overlap)) for s in range(0, n, self.chunk)]
        while len(spans) > 1 and spans[-2][1] >= n:
            spans.pop()
        return spans or [(0, n)]

    def _boundary(self, text: str, left: list, right: list, start: int, end: int) -> tuple[int, int, int] | None:
        """(position, tokens of left before it, of right before it), or None.

        `left` and `right` are (id, start, end) in document offsets, both covering
        [start, end), which is the overlap.
        """
        i = len(left)
        while i and left[i - 1][1] >= start:
            i -= 1
        at = {token[1]: k for k, token in enumerate(right) if token[1] < end}
        for k in range(i, len(left)):
            position = left[k][1]
            if position <= start or text[position - 1] not in _BLANKS or text[position] in _BLANKS:
                continue
            other = at.get(position)
            if other is None:
                continue
            # the last word of the left chunk may be cut, so agreement is asked up to there
            whole = [t for t in left[k:] if t[2] < end and _ends_word(text, t[2])]
            upto = len(whole) and left.index(whole[-1], k) - k + 1
            if upto and left[k : k + upto] == right[other : other + upto]:
                return position, k, other
        return None

    def _chunked(self, text: str) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(start, end, tokens) of every chunk; the library gets some of them in one call."""
        batch, size = [], 0
        spans = self.chunks(text)
        for span in spans:
            batch.append(span)
            size += span[1] - span[0]
            if size >= CALL or span is spans[-1]:
                for (a, b), piece in zip(batch, self._encode([text[a:b] for a, b in batch])):
                    yield a, b, _shifted(piece, a)
                batch, size = [], 0

    def _settled(self, text: str, widened: list[int]) -> Iterator[list[tuple[int, int, int]]]:
        """The tokens of the text in order, up to one proven boundary after the other.

        The start of every widened overlap is added to `widened`.
        """
        chunks = self._chunked(text)
        floor, done_end, done = next(chunks)
        for start, end, tokens in chunks:
            overlap = done_end - start
            while not (found := self._boundary(text, done, tokens, start, done_end)):
                overlap *= 2
                start = max(floor, done_end - overlap)
                widened.append(start)
                tokens = self._tokens(text, start, end)
                if start == floor:  # nothing before the last boundary has a say
                    done = tokens
                    break
            else:
                floor, k, other = found
                yield done[:k]
                done = tokens[other:]
            done_end = end
        yield done

    def encode(self, text: str | None) -> tuple[list[tuple[int, int, int]], int]:
        """((id, start, end) of all tokens, number of widenings)."""
        text = text or ""
        if not self.separated:
            return self._tokens(text, 0, len(text)), 0
        widened: list[int] = []
        tokens = [t for part in self._settled(text, widened) for t in part]
        return tokens, len(widened)

    def _tokens(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        return _shifted(self._encode([text[start:end]])[0], start)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.separated:
            return len(self._encode([text])[0].ids)
        if len(text) > self.chunk:
            return sum(map(len, self._settled(text, [])))
        parts = text.encode("utf-8").split()
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            fresh = list({p for p in parts if p not in known})
            if len(known) > REMEMBERED or self.held > REMEMBERED_BYTES:
                known.clear()
                self.held, fresh = 0, list(set(parts))
            for p, e in zip(fresh, self._encode([p.decode("utf-8") for p in fresh])):
                known[p] = len(e.ids)
                self.held += len(p)
            return sum(map(known.__getitem__, parts))


@functools.cache
def _encoder(name: str, chunk: int, overlap: int) -> Resync:
    """One per Python worker, so that its tasks share what it has learned about words."""
    return Resync(vocabulary_path(name), chunk, overlap)


def _ends_word(text: str, position: int) -> bool:
    return position < len(text) and text[position] in _BLANKS


def _shifted(encoding, start: int) -> list[tuple[int, int, int]]:
    return [(i, a + start, b + start) for i, (a, b) in zip(encoding.ids, encoding.offsets)]


def counts(
    docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document; no shuffle.

    NULL and empty texts have no bytes and no tokens; repeated rows are counted each;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, chunk, overlap)
        for batch in batches:
            n = pa.array([encoder.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n], names=["doc_id", "n_bytes", "n_tokens"]
            )

    t = F.col(f"`{text}`")
    n_bytes = F.coalesce(F.octet_length(t), F.lit(0)).cast("long")
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), t.alias("text")
    ).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
