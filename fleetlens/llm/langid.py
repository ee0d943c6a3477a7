"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF values of hashed character 1- to 3-grams over letters, each
document scaled to length 1. Weights are learned by FTRL-proximal with an elastic
net (the L1 part keeps untouched and useless weights at exactly 0), and the
probabilities are calibrated by one temperature, fitted on a part of the sample
that training has not seen.

Document frequencies are counted over all labelled documents that may be learned from,
by partial sums per task, and all of them teach the classifier. Up to `SAMPLE` documents of
each language (`SAMPLES` in all) are fitted in one place. More are dealt by a hash of the id
to blocks that learn side by side, a block one document after the other, and the weights of
the blocks are averaged; temperature and threshold then come from all documents kept back.
Model and document frequencies have 2^16 slots, so the driver holds 1 MB and a task a few for
each language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import uniform
from fleetlens.session import settle

SLOTS = 1 << 16
#: Documents of a language, and of all, up to which the classifier is fitted in one place.
SAMPLE = 600
SAMPLES = 64 * SAMPLE
EPOCHS = 4
#: A block goes over its first documents `EPOCHS` times; it keeps at most so many n-gram counts of them.
WARM_ENTRIES = 4_000_000
#: Blocks that learn side by side are at most so many.
BLOCKS = 256
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
UNKNOWN = "und"
#: Share of the documents kept for calibration whose best probability may lie below the upper end
#: of the range in which the pipeline's threshold is put.
DOUBTFUL = 0.005


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _slot(code: np.ndarray, factor: int) -> np.ndarray:
    return ((code * np.uint64(factor)) >> np.uint64(48)).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(slots, counts) of the text's n-grams; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return None
    keep = letter | np.r_[True, letter[:-1]]  # the first of a run of others stays, as a blank
    c = np.where(letter, code, 32)[keep].astype(np.uint64)
    c = np.r_[np.uint64(32), c, np.uint64(32)]
    pair = c[:-1] << np.uint64(21) | c[1:]
    slots = np.concatenate([
        _slot(c, 0x9E3779B97F4A7C15),
        _slot(pair, 0xC2B2AE3D27D4EB4F),
        _slot(pair[:-1] << np.uint64(21) | c[2:], 0xD6E8FEB86659FD93),
    ])
    counts = np.bincount(slots, minlength=SLOTS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[found]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (slot, language)
    idf: np.ndarray
    temperature: float = 1.0
    #: Below this probability the pipeline takes a document for no language. It lies halfway
    #: between chance and what all but `DOUBTFUL` of the calibration documents reach.
    threshold: float = 0.0

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _vector(found, counts, self.idf) @ self.weights[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (`und`, 0) without a letter or a model."""
        features = grams(text)
        if features is None or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*features) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class _Learner:
    """FTRL-proximal, one document after the other."""

    def __init__(self, k: int, idf: np.ndarray):
        self.z, self.n, self.idf = np.zeros((SLOTS, k)), np.zeros((SLOTS, k)), idf

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, language: int, found: np.ndarray, counts: np.ndarray) -> None:
        x = _vector(found, counts, self.idf)
        w = self.weights(found)
        p = _softmax(x @ w)
        p[language] -= 1.0
        g = x[:, None] * p[None, :]
        square = g * g
        n = self.n[found]
        sigma = (np.sqrt(n + square) - np.sqrt(n)) / ALPHA
        self.z[found] += g - sigma * w
        self.n[found] += square


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Fit on (language, slots, counts), given in an order that does not depend on language.

    Every fifth sample is kept for the temperature.
    """
    languages = sorted({s[0] for s in samples})
    index = {name: i for i, name in enumerate(languages)}
    k = len(languages)
    learner = _Learner(k, idf)
    held = samples[::5] if len(samples) >= 10 else samples
    taught = [s for i, s in enumerate(samples) if i % 5] if len(samples) >= 10 else samples
    for _ in range(EPOCHS):
        for name, found, counts in taught:
            learner.learn(index[name], found, counts)
    model = Model(languages, learner.weights(slice(None)).astype(np.float32), idf)
    if held and k > 1:
        model.temperature = _temperature(
            np.array([model.logits(f, c) for _, f, c in held]), np.array([index[s[0]] for s in held])
        )
    if held:
        best = [_softmax(model.logits(f, c) / model.temperature).max() for _, f, c in held]
        model.threshold = _threshold(k, float(np.quantile(best, DOUBTFUL)))
    return model


def _threshold(k: int, doubtful: float) -> float:
    return min(1.0, (1.0 / k + doubtful) / 2)


def _block_weights(k: int, idf: np.ndarray, warm: int):
    """Weights learned from one block; its first documents, up to `warm`, are gone over `EPOCHS` times."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, first = _Learner(k, idf), []
        number, held, warming = 0, 0, True
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                features = grams(text.as_py())
                if features is None:
                    continue
                learner.learn(language, *features)
                number += 1
                if warming:
                    first.append((language, *features))
                    held += len(features[0])
                    warming = number < warm and held < WARM_ENTRIES
                    if not warming:
                        _again(learner, first)
        _again(learner, first)
        weights = learner.weights(slice(None))
        found = np.flatnonzero(weights.any(axis=1))
        values = pa.array(weights[found].ravel())
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, found].astype(np.int32)),
             pa.concat_arrays([pa.array([[float(number)] * k], pa.list_(pa.float64())), pa.ListArray.from_arrays(ends, values)])],
            names=["slot", "w"],
        )

    return learned


def _again(learner: _Learner, first: list) -> None:
    for _ in range(EPOCHS - 1):
        for features in first:
            learner.learn(*features)
    first.clear()


def _all_logits(model: Model):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                features = grams(text.as_py())
                if features is not None:
                    rows.append((language, model.logits(*features).astype(float).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                names=["language", "logits"],
            )

    return judged


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column(1).to_pylist(), float)


def _log_losses(own: np.ndarray, steps: np.ndarray):
    """Sums of the log loss at every temperature of `steps` (logarithms)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(steps))
        for batch in batches:
            if batch.num_rows:
                logits, truth = _matrix(batch), batch.column(0).to_numpy()
                target = _targets(truth, own)
                sums += [_loss(logits, target, t) * len(truth) for t in steps]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return summed


def _best(temperature: float):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [float(_softmax(z / temperature).max()) for z in _matrix(batch)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64())], names=["p"])

    return best


def fit_blocks(taught: DataFrame, sizes: dict[str, int], idf: np.ndarray, sample: int = SAMPLE) -> Model:
    """Fit on all rows of (doc_id, text, lang); a fifth is kept for temperature and threshold."""
    languages = sorted(sizes)
    k, warm = len(languages), 4 * sample
    blocks = max(1, min(BLOCKS, sum(sizes.values()) // (4 * warm)))
    numbers = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    rows = taught.select(
        F.element_at(numbers, F.col("lang")).alias("language"), "text", "lang",
        uniform(F.col("doc_id"), F.lit("lang")).alias("u"), uniform(F.col("doc_id"), F.lit("held")).alias("v"),
        F.floor(uniform(F.col("doc_id"), F.lit("block")) * blocks).cast("int").alias("block"),
    )
    kept = F.col("v") < 0.2
    dealt = rows.where(~kept).repartitionById(blocks, F.col("block")).sortWithinPartitions("u", "lang", "text")
    learned = settle(
        dealt.select("language", "text").mapInArrow(_block_weights(k, idf, warm), "slot int, w array<double>"), "blocks"
    )
    # the entry -1 of a block is the number of its documents; one without any has no say
    voted = learned.where((F.col("slot") < 0) & (F.col("w")[0] > 0)).count()
    weights = np.zeros((SLOTS, k), np.float32)
    total = learned.where("slot >= 0").groupBy("slot").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(k)]).alias("w"))
    for slot, w in total.collect():  # at most SLOTS rows
        weights[slot] = np.array(w) / voted
    model = Model(languages, weights, idf)
    logits = settle(
        rows.where(kept).select("language", "text").mapInArrow(_all_logits(model), "language int, logits array<double>"),
        "logits",
    )
    own = np.zeros(k)
    for language, n in logits.groupBy("language").count().collect():  # one row for each language
        own[language] = n
    if not own.any():
        return model
    if k > 1:
        low, high = np.log(0.05), np.log(20.0)
        for _ in range(3):
            steps = np.linspace(low, high, 33)
            parts = logits.mapInArrow(_log_losses(own, steps), "sums array<double>").collect()  # one row a task
            at = int(np.sum([r["sums"] for r in parts], axis=0).argmin())
            low, high = steps[max(0, at - 1)], steps[min(32, at + 1)]
        model.temperature = float(np.exp((low + high) / 2))
    doubtful = logits.mapInArrow(_best(model.temperature), "p double").agg(
        F.percentile_approx("p", DOUBTFUL, 100_000)
    ).first()[0]
    model.threshold = _threshold(k, doubtful)
    return model


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    Targets are Platt's: a class counts with (n + 1) / (n + k) at most, n samples of it and
    k languages, since n right answers in a row don't prove certainty.
    """
    target = _targets(truth, np.bincount(truth, minlength=logits.shape[1]))

    def loss(log_t: float) -> float:
        return _loss(logits, target, log_t)

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _targets(truth: np.ndarray, own: np.ndarray) -> np.ndarray:
    k, mine = len(own), own[truth]
    target = np.repeat((1.0 / (mine + k))[:, None], k, axis=1)
    target[np.arange(len(truth)), truth] = (mine + 1.0) / (mine + k)
    return target


def _loss(logits: np.ndarray, target: np.ndarray, log_t: float) -> float:
    z = logits / np.exp(log_t)
    z = z - z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return float(-(target * log_p).sum(axis=1).mean())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, documents = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            documents += 1
            features = grams(text.as_py())
            if features:
                seen[features[0]] += 1
    found = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[-1, found].astype(np.int32)), pa.array(np.r_[documents, seen[found]])],
        names=["slot", "n"],
    )


def inverse_frequencies(taught: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + frequency)) + 1 for every slot, over all given texts."""
    sums = taught.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(
        F.sum("n").alias("n")
    )
    total, seen = 0, np.zeros(SLOTS)
    for slot, n in sums.collect():  # at most SLOTS + 1 rows
        if slot < 0:
            total = n
        else:
            seen[slot] = n
    return np.log((1.0 + total) / (1.0 + seen)) + 1.0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            part = batch.slice(row, 64)
            found = [grams(t.as_py()) for t in part.column(2)]
            keep = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(keep, pa.int32())),
                    part.column(1).take(pa.array(keep, pa.int32())),
                    pa.array([found[i][0].astype(np.int32) for i in keep], pa.list_(pa.int32())),
                    pa.array([found[i][1].astype(np.int32) for i in keep], pa.list_(pa.int32())),
                ],
                names=["lang", "u", "slots", "counts"],
            )


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on the rows of (doc_id, text, lang) that are `allowed` and have a language."""
    taught = docs.where(allowed & F.col("lang").isNotNull())
    sizes = taught.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(SLOTS))
    sample = min(sample, max(1, SAMPLES // len(sizes)))
    idf = inverse_frequencies(taught)
    if max(count for _, count in sizes) > sample:
        return fit_blocks(taught, dict(map(tuple, sizes)), idf, sample)
    rows = taught.select("lang", uniform(F.col("doc_id"), F.lit("lang")).alias("u"), "text").mapInArrow(
        _features, "lang string, u double, slots array<int>, counts array<int>"
    ).collect()  # at most SAMPLES
    rows.sort(key=lambda r: (r["u"], r["lang"]))
    samples = [(r["lang"], np.array(r["slots"]), np.array(r["counts"])) for r in rows]
    return fit(samples, idf)


def predictor(model: Model):
    """Text column -> struct of lang_pred and score."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def identify(docs: DataFrame, allowed: Column) -> DataFrame:
    """All rows with the column `found` (lang_pred, score), by a model learned from the allowed rows.

    NULL texts and texts without letters are `und` with score 0; so is everything if no
    row may be learned from. lang, source and doc_id play no part in a prediction.
    """
    model = train(docs.select("doc_id", "text", "lang"), allowed)
    return docs.withColumn("found", predictor(model)(F.col("text")))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified with confidence, columns unchanged."""
    allowed = remainder(F.col("doc_id"), 4) != 2
    model = train(docs.select("doc_id", "text", "lang"), allowed)
    found = predictor(model)(F.col("text"))
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= model.threshold))
