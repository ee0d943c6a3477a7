"""Token counts, language model, sampling and language identification."""

import collections
import dataclasses
import math
import zlib

import numpy as np
import pytest
from odd_rows import DOCUMENTS, odd_rows, prose
from pyspark.sql import functions as F

from fleetlens.llm import langid, lattice, lattice_lm, sampling, token_counts
from fleetlens.llm.text import uniform
from fleetlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "it's  don't <|endoftext|> x<|startoftext|>y\u00a0z", "a" * 700 + " b c", "", " ", "\u0301e \u00e9 e\u0301 \u03a3\u03c2 \u0130I\u0307",
    "\t1234 5,6\n" * 40, "漢字 かな \U0001f600" * 20, prose(2, 300), "word " * 300,
]


# ---- token counts ----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return token_counts._load(token_counts.vocabulary_path())


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (37, 3), (500, 64)])
def test_spliced_chunks_equal_the_library(library, chunk, overlap):
    encoder = token_counts.Resync(token_counts.vocabulary_path(), chunk, overlap)
    assert encoder.separated
    for text in TEXTS:
        whole = library.encode(text, add_special_tokens=False)
        found, _ = encoder.encode(text)
        assert [t[0] for t in found] == whole.ids and [(a, b) for _, a, b in found] == whole.offsets
        assert encoder.count(text) == len(whole.ids)


def test_unbroken_strings_widen_the_overlap():
    encoder = token_counts.Resync(token_counts.vocabulary_path(), 200, 40)
    assert encoder.encode("x" * 400)[1] > 0 and encoder.encode(prose(1, 200))[1] == 0


def test_long_texts_are_counted_in_little_memory():
    """4 M characters: all (id, start, end) at once would take over 200 MB."""
    import tracemalloc

    encoder = token_counts.Resync(token_counts.vocabulary_path())
    text = (prose(8, 2000) + " ") * (4_000_000 // (len(prose(8, 2000)) + 1))
    tracemalloc.start()
    found = encoder.count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert found == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_long_words_do_not_fill_the_memory(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", 3000)
    encoder = token_counts.Resync(token_counts.vocabulary_path())
    for i in range(9):
        text = " ".join("xyzab"[i % 5] * (900 + i) for i in range(i, i + 3))
        assert encoder.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert encoder.held <= 6000


def test_other_tokenizers_are_not_split_at_blanks():
    assert not token_counts.blank_separated(token_counts.vocabulary_path("byte_bpe_50k.json"))
    encoder = token_counts.Resync(token_counts.vocabulary_path("byte_bpe_50k.json"), 64, 8)
    whole = encoder.tokenizer.encode(TEXTS[0], add_special_tokens=False)
    assert encoder.count(TEXTS[0]) == len(whole.ids)


def test_remembered_words_may_overflow(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    encoder = token_counts.Resync(token_counts.vocabulary_path())
    for text in TEXTS * 2:
        assert encoder.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_query(spark, odd, none, store, with_clashes, library):
    for folder, rows in ((SMALL, None), (store(documents=with_clashes(odd)), odd_rows())):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        expected = collections.Counter()
        for doc_id, text in docs:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            expected[doc_id, len((text or "").encode()), n, n > 2048] += 1
        assert collections.Counter(map(tuple, QUERIES["op5_token_counts"](spark, folder).collect())) == expected
    assert QUERIES["op5_token_counts"](spark, store(documents=none)).count() == 0


# ---- lattices and the language model ---------------------------------------------


def segmentations(text, pieces):
    """All ways to write `text` with pieces, as id lists (characters that are pieces only)."""
    ids = {t: i for i, t in enumerate(pieces.texts) if i not in set(pieces.byte.tolist()) and i > 2}
    out = []

    def walk(start, taken):
        if start == len(text):
            out.append(taken)
        for end in range(start + 1, len(text) + 1):
            if text[start:end] in ids:
                walk(end, [*taken, ids[text[start:end]]])

    walk(0, [])
    return out


def test_lattice_sums_match_all_segmentations():
    pieces = lattice.load()
    words = ["▁the", "▁a", "▁there", "▁éte", "▁queen"]
    score = -np.log(pieces.ranks + 3.0)
    graph = lattice.build(words, pieces)
    weight = lattice.label_sums(graph, pieces, score)
    ahead, behind = lattice.forward(graph, weight), lattice.backward(graph, weight)
    for k, word in enumerate(words):
        total = math.log(math.fsum(math.exp(score[s].sum()) for s in segmentations(word, pieces)))
        assert ahead[graph.start[k] + graph.length[k]] == pytest.approx(total)
        assert behind[graph.start[k]] == pytest.approx(total)


def test_word_probabilities_sum_to_one_over_short_words():
    """All words of up to two of three letters, plus what is longer, is the whole of it."""
    pieces = lattice.load()
    rng = np.random.default_rng(1)
    scores = lattice_lm.Scores(pieces, rng.random(pieces.size), rng.random(pieces.size), rng.random(pieces.size) / 2)
    words = [a + b for a in "abc" for b in ["", *"abc"]]
    for word, found in zip(words, lattice_lm.word_scores(words, [scores], pieces)[0]):
        total = 0.0
        for s in segmentations("▁" + word, pieces):
            p = scores.start[s[0]] + scores.inner[s[1:]].sum() + scores.go[s[:-1]].sum() + scores.stop[s[-1]]
            total += math.exp(p)
        assert math.exp(found) == pytest.approx(total)


def test_expected_counts_match_all_segmentations():
    pieces = lattice.load()
    scores = lattice_lm.Scores.initial(pieces)
    words, counts = ["the", "then", "on"], np.array([5, 2, 7])
    found = lattice_lm.expected(words, counts, scores, pieces)
    table = np.zeros((3, pieces.size))
    for word, n in zip(words, counts):
        ways = segmentations("▁" + word, pieces)
        p = np.array([
            math.exp(scores.start[s[0]] + scores.inner[s[1:]].sum() + scores.go[s[:-1]].sum() + scores.stop[s[-1]])
            for s in ways
        ])
        for s, share in zip(ways, n * p / p.sum()):
            table[0, s[0]] += share
            table[2, s[-1]] += share
            for piece in s[1:]:
                table[1, piece] += share
    assert np.allclose(found, table)


def brute_scores(docs):
    words = [(i, (t or "").encode().lower().split()) for i, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in words]
    seen: collections.Counter = collections.Counter()
    ends = 0
    for (_, w), out in zip(words, held):
        if not out:
            seen.update(w)
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + (v + 1)))
    return [
        (i, out, len(w) + 1, sum(x in seen for x in w) + (ends > 0), n, math.fsum(log(seen[x]) for x in w) + log(ends))
        for (i, w), out in zip(words, held)
    ]


def test_scores_of_the_table(spark):
    found = QUERIES["op6_lattice_scores"](spark, "/root/testdata/sf0.01").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    expected = {r[0]: r for r in brute_scores(docs)}
    assert len(found) == len(docs)
    for r in found:
        want = expected[r["doc_id"]]
        assert tuple(r)[:5] == want[:5] and r["base_score"] == pytest.approx(want[5], rel=1e-9)
        assert -math.inf < r["score"] < 0
    held = [r for r in found if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    # the base gives every unseen word the same share, as often as it likes; still close to it
    assert sum(r["score"] for r in held) / tokens > sum(r["base_score"] for r in held) / tokens - 0.1


def test_scores_of_odd_rows(spark, odd, none, store, with_clashes):
    found = QUERIES["op6_lattice_scores"](spark, store(documents=with_clashes(odd))).collect()
    expected = brute_scores([r[:2] for r in odd_rows()])
    key = lambda r: (str(r[0]), r[2], r[5])
    for r, want in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert r[:5] == want[:5] and r[5] == pytest.approx(want[5]) and -math.inf < r[6] < 0
    assert QUERIES["op6_lattice_scores"](spark, store(documents=none)).count() == 0


# ---- sampling --------------------------------------------------------------------


@pytest.fixture(scope="module")
def sampler():
    return sampling.Sampler()


@pytest.mark.parametrize("near", [48, 1])
def test_samples_follow_successive_drawing(sampler, monkeypatch, near):
    monkeypatch.setattr(sampling, "NEAR", near)
    monkeypatch.setattr(sampler, "score", sampler.score * 0.15)  # flat, so that all ways occur
    text, n = "the an", 6000
    ways = segmentations(sampling.parts_of(text)[0] + sampling.parts_of(text)[1], sampler.pieces)
    p = np.array([math.exp(sampler.score[list(w)].sum()) for w in ways])
    p /= p.sum()
    first, second = collections.Counter(), collections.Counter()
    keys = np.random.default_rng(3).integers(0, 2**62, n).tolist()
    for samples in sampler.sample([text] * n, keys, 3):
        ids = [tuple(s.ids.tolist()) for s in samples]
        assert len(set(ids)) == 3 and sorted((s.perturbed for s in samples), reverse=True) == [s.perturbed for s in samples]
        first[ids[0]] += 1
        second[ids[1]] += 1
    after = [sum(p[i] * p[j] / (1 - p[i]) for i in range(len(p)) if i != j) for j in range(len(p))]
    for way, a, b in zip(ways, p, after):
        assert first[tuple(way)] / n == pytest.approx(a, abs=0.022)
        assert second[tuple(way)] / n == pytest.approx(b, abs=0.022)


def test_inclusion_is_unbiased(sampler, monkeypatch):
    """Sums weighted by 1 / inclusion estimate sums over all segmentations."""
    monkeypatch.setattr(sampler, "score", sampler.score * 0.15)
    n = 4000
    total = sum(
        sum(math.exp(s.log_p) / s.inclusion for s in samples)
        for samples in sampler.sample(["then"] * n, list(range(1, n + 1)), 4)
    )
    assert total / n == pytest.approx(1.0, abs=0.03)


def test_all_segmentations_come_out_once(sampler):
    (samples,) = sampler.sample(["then"], [9], 500)
    ways = segmentations("▁then", sampler.pieces)
    assert sorted(tuple(s.ids.tolist()) for s in samples) == sorted(map(tuple, ways))
    assert all(s.inclusion == 1.0 for s in samples)
    assert math.fsum(math.exp(s.log_p) for s in samples) == pytest.approx(1.0)


def test_round_trip_of_odd_texts(sampler):
    texts = [r[1] for r in odd_rows()] + TEXTS + ["  two  blanks ", "line\r\nend\r", "▁mark ▁▁", "\x00\x7f"]
    texts = [t for t in texts if t is None or len(t) < 50000]
    for text, samples in zip(texts, sampler.sample(texts, list(range(len(texts))), 3)):
        assert samples
        for s in samples:
            assert sampling.decode(s.ids) == (text or "").replace("▁", " ")


def test_sampling_query(spark, odd, none, store, with_clashes):
    frame = store(documents=with_clashes(odd))
    found = QUERIES["op9_sampled_segmentations"](spark, frame).collect()
    again = QUERIES["op9_sampled_segmentations"](spark, store(documents=odd.repartition(5))).collect()
    whole = lambda rows: collections.Counter((*r[:-1], tuple(r["ids"])) for r in rows)
    assert whole(found) == whole(again)
    rows = collections.Counter((r["doc_id"], r["rank"]) for r in found)
    assert rows[1, 1] == 1 and rows[1, 2] == 1 and rows[2, 1] == 2 and rows[4, 1] == 1 and rows[4, 2] == 0
    assert all(r["round_trip"] or r["doc_id"] == 10 for r in found)  # 10 has space marks of its own
    assert QUERIES["op9_sampled_segmentations"](spark, store(documents=none)).count() == 0


@pytest.mark.parametrize("bits", [4, 19])
def test_children_are_found_by_hash(monkeypatch, bits):
    """However many keys share a hash; lattices keep short numbers."""
    monkeypatch.setattr(lattice, "HASH_BITS", bits, raising=False)
    own = dataclasses.replace(lattice.load())
    rng = np.random.default_rng(1)
    some = rng.integers(0, len(own.keys), 500)
    state, code = own.keys[some] >> 21, own.keys[some] & (1 << 21) - 1
    assert own.step(state, code, 1).tolist() == own.children[some].tolist()
    known = set(own.keys.tolist())
    other = rng.integers(0, 0x110000, 500)
    absent = [(int(s) << 21 | int(c)) not in known for s, c in zip(state, other)]
    assert (own.step(state, other, 1)[absent] == -1).all() and sum(absent) > 400
    graph = lattice.build(["▁the", "▁größe 中"], own)
    assert graph.source.dtype == graph.target.dtype == graph.label.dtype == np.int32


# ---- language identification -----------------------------------------------------


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op10_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    # calibrated: the mean score is near the share that is right
    assert np.mean([r["score"] for r in held]) == pytest.approx(1.0, abs=0.15)


def test_predictions_do_not_look_at_other_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    allowed = langid.remainder(F.col("doc_id"), 4) != 2
    plain = langid.identify(docs, allowed).where(~allowed).select("doc_id", "found").collect()
    other = docs.withColumn("lang", F.when(allowed, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("s"))
    assert sorted(plain) == sorted(langid.identify(other, allowed).where(~allowed).select("doc_id", "found").collect())


def test_languages_of_odd_rows(spark, odd, none, store, with_clashes):
    rows = QUERIES["op10_language_id"](spark, store(documents=with_clashes(odd))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (4, 5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de", "es", "fr") and 0 < r["score"] <= 1
    assert QUERIES["op10_language_id"](spark, store(documents=none)).count() == 0
    nothing = QUERIES["op10_language_id"](spark, store(documents=odd.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_untouched_weights_are_zero_and_the_fit_is_bounded(spark):
    rows = [(i, prose(i, 60) + (" zażółć" if i % 2 else " größe"), "ab"[i % 2], "s", None) for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, DOCUMENTS), F.lit(True), sample=40)
    assert model.languages == ["a", "b"] and (model.weights == 0).mean() > 0.9
    assert model.predict("zażółć zażółć " + prose(5, 60))[0] == "b"


def test_every_document_teaches_the_model(spark):
    """One document in 300 has letters of its own; a sample of 40 would leave most of them out."""
    rows = [(i, prose(i, 30) + (" zażółć" if i % 2 else " größe"), "ab"[i % 2], "s", None) for i in range(600)]
    rare = [(1000 + i, "  ".join(chr(0x4E00 + 7 * i + j) for j in range(7)), "a", "s", None) for i in range(30)]
    docs = spark.createDataFrame(rows + rare, DOCUMENTS)
    model = langid.train(docs, F.lit(True), sample=40)
    kept = docs.where(uniform(F.col("doc_id"), F.lit("held")) >= 0.2).collect()
    taught = [r["text"] for r in kept if r["doc_id"] >= 1000]
    touched = [bool(model.weights[langid.grams(t)[0]].any(axis=1).sum() > 3) for t in taught]
    assert len(taught) > 15 and all(touched)
    assert 0 < model.threshold < 1 and 0.05 <= model.temperature <= 20
    again = langid.train(docs.repartition(7), F.lit(True), sample=40)
    assert np.allclose(model.weights, again.weights) and model.threshold == pytest.approx(again.threshold, abs=1e-6)


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 3000)
    logits = rng.normal(0, 1, (3000, 3))
    logits[np.arange(3000), truth] += 1.5
    # logits that are right on average get back the factor they were scaled by
    base = langid._temperature(logits, truth)
    assert langid._temperature(logits * 4.0, truth) == pytest.approx(4 * base, rel=1e-3)


def test_language_filter_takes_effect(odd, none, with_clashes):
    kept = langid.filter_documents(with_clashes(odd))
    assert kept.columns == with_clashes(odd).columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {4, 5, 6, 7} and {1, 2, 8, 11} <= ids
    assert langid.filter_documents(none).count() == 0


def test_more_languages_than_a_dozen(spark):
    """All of 70 languages are learned and found; the sample is shared among them."""
    rng = np.random.default_rng(70)
    letters = [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for lang in range(70):
        own = rng.choice(letters, 6, replace=False)
        for i in range(12):
            text = " ".join("".join(rng.choice(own, rng.integers(2, 7))) for _ in range(40))
            rows.append((lang * 100 + i, text, f"l{lang:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.remainder(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, ~held).where(held).collect()
    assert {r.found.lang_pred for r in langid.identify(docs, ~held).collect()} == {f"l{n:02d}" for n in range(70)}
    assert sum(r.found.lang_pred == r.lang for r in found) > 0.9 * len(found)


def test_samples_do_not_depend_on_the_batch(sampler):
    """A text gives bit for bit the same samples alone and among others."""
    texts = [r[1] for r in odd_rows() if r[1] and len(r[1]) < 5000]
    alone = [next(iter(sampler.sample([t], [n], 2))) for n, t in enumerate(texts)]
    for found, expected in zip(sampler.sample(texts + [prose(5, 3000)], list(range(len(texts) + 1)), 2), alone):
        assert [(s.ids.tolist(), s.log_p, s.perturbed, s.inclusion) for s in found] == [
            (s.ids.tolist(), s.log_p, s.perturbed, s.inclusion) for s in expected]
