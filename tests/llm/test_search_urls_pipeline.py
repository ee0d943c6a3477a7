"""Exact search, URL verdicts and the pipeline, by brute force and on odd rows."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_queries
import corpus_pipeline
from fleetlens.llm import langid, mixing, sampling, topk, url_filter
from fleetlens.llm.queries import ORACLES, QUERIES
from test_groups_shards import brute_groups

SMALL = "/root/testdata/sf0.001"


# ---- exact search ----------------------------------------------------------------


def test_search_against_sql(spark):
    _, verdict = check_queries.compare(spark, SMALL, "op8_exact_topk")
    assert verdict.startswith("ok"), verdict


def brute_topk(rows, k=5):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for i, q in good:
        if i % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i and len(x) == len(q))
        out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)}
    return out


def found_topk(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = topk.quantized(frame)
    return {tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 50 = 0")).collect()}


@pytest.mark.parametrize("dim,cell", [(64, 2048), (7, 40), (1, 40)])
def test_search_with_many_cells_and_ties(spark, monkeypatch, dim, cell):
    monkeypatch.setattr(topk, "CANDIDATES_PER_CELL", cell)
    monkeypatch.setattr(topk, "QUERIES_PER_CELL", 2)
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.integers(-3, 4, dim) / 8).tolist(), 0) for i in range(230)]
    assert found_topk(spark, rows) == brute_topk([r[:2] for r in rows])


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (50, [0.5, -0.25], 0), (1, None, 0), (2, [None, 1.0], 0), (3, [nan, 1.0], 0),
            (4, [inf, 1.0], 0), (5, [1.0], 0), (6, [], 0), (100, [], 0), (None, [1.0, 1.0], 0), (7, [1e30, -1e30], 0),
            (8, [0.1, 0.2], 0), (9, [0.1, 0.2], 0), (150, [3.0], 0)]
    def clipped(found):
        return {(*r[:3], max(-(1 << 63), min((1 << 63) - 1, r[3]))) for r in found}

    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], x) for i, v, x in rows]
    assert found_topk(spark, rows) == clipped(brute_topk([r[:2] for r in rows]))
    assert found_topk(spark, rows[:0]) == set()
    assert found_topk(spark, [(1, [1.0], 0)]) == set()  # no query


# ---- urls ------------------------------------------------------------------------


URLS = [
    ("HTTP://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://example.org", "example.org", "", None, None),
    ("http://x.com/fr/a://b", "x.com", "/fr/a://b", "com/fr/", "allow"),
    ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://x.com?/de/", "x.com", "", None, None),
    ("no scheme.org/es/", "", "", None, None),
    ("://\nh.org/\nq", "\nh.org", "/\nq", "org/", "allow"),
    ("ÄB://ÄB.net#f", "Äb.net", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def pages(spark, urls, html="<p>the <b>green fields</b> of the example</p><script>var hidden;</script>"):
    return spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")


def test_hosts_paths_and_rules(spark, store):
    folder = store(pages=pages(spark, [u[0] for u in URLS]).withColumn("host", F.lit("own")).withColumn("rule", F.lit(1)))
    rows = sorted(QUERIES["op1_url_verdicts"](spark, folder).collect())
    for r, (_, host, path, rule, verdict) in zip(rows, URLS, strict=True):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_verdicts_of_the_table(spark):
    rows = QUERIES["op1_url_verdicts"](spark, "/root/testdata/sf0.01").collect()
    stored = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert len(rows) == stored.count() == len({r["page_id"] for r in rows})
    assert all("".join(r["words"]) == r["host"].replace(".", "") for r in rows)


def test_words_of_any_length(spark):
    """A host label that is a counted word of 34 letters stays whole; one of two such words is split there."""
    word, other = "donaudampfschifffahrtsgesellschaft", "rindfleischetikettierungsgesetz"
    pages = spark.createDataFrame(
        [(1, f"http://{word}.de/x", f"<p>{word} {other} a b c d e f</p>"), (2, f"http://{word}{other}.org/", None),
         (3, "http://" + "q" * 400 + ".com/", "")], "page_id long, url string, html string",
    )
    found = {r.page_id: list(r.words) for r in url_filter.judge(pages).collect()}
    assert found[1] == [word, "d", "e"] and found[2][:2] == [word, other] and found[3][:400] == ["q"] * 400


def test_viterbi_finds_the_best_split():
    counts = {"green": 50, "fields": 40, "field": 60, "s": 5, "gre": 3, "en": 30, "greenfield": 1}
    total = sum(counts.values())
    assert url_filter.viterbi("greenfields", counts, total) == ["green", "fields"]
    rng = np.random.default_rng(0)
    for _ in range(50):
        words = {"".join(rng.choice(list("ab"), rng.integers(1, 4))): int(rng.integers(1, 9)) for _ in range(6)}
        label, n = "".join(rng.choice(list("abc"), 8)), sum(words.values())
        unknown = -math.log(n + 1) - 1

        def best(s):
            if not s:
                return 0.0
            ways = [unknown + best(s[:-1])]
            ways += [math.log(words[s[i:]] / n) + best(s[:i]) for i in range(len(s)) if s[i:] in words]
            return max(ways)

        split = url_filter.viterbi(label, words, n)
        got = sum(math.log(words[w] / n) if w in words else unknown for w in split)
        assert "".join(split) == label and got == pytest.approx(best(label))


def test_bayes_by_hand(spark):
    urls = ["http://a.com/de/x", "http://b.com/de/y", "http://a.com/fr/x", "http://q.net/de/z", "http://q.net/fr/z"]
    urls += ["http://c.com/fr/y"] * 3
    frame = url_filter.tokenized(pages(spark, urls)).collect()
    seen = {False: collections.Counter(), True: collections.Counter()}
    n = collections.Counter()
    for r in frame:
        if r["rule"]:
            seen[r["rule"]["verdict"] == "block"].update(r["slots"])
            n[r["rule"]["verdict"] == "block"] += 1
    judged = {r["page_id"]: r for r in url_filter.judge(pages(spark, urls)).collect()}
    for r in frame:
        odds = math.log((n[True] + 1) / (n[False] + 1))
        for s in r["slots"]:
            odds += math.log((seen[True][s] + 1) / (sum(seen[True].values()) + url_filter.SLOTS))
            odds -= math.log((seen[False][s] + 1) / (sum(seen[False].values()) + url_filter.SLOTS))
        assert judged[r["page_id"]]["log_odds"] == pytest.approx(odds)
    assert judged[3]["log_odds"] > judged[4]["log_odds"]  # /de/ speaks for a block, /fr/ against it


def test_hidden_text_and_empty_pages(spark, store):
    words = {r["word"]: r["n"] for r in url_filter.word_counts(pages(spark, ["u"])).collect()}
    assert words == {"the": 2, "green": 1, "fields": 1, "of": 1, "example": 1}
    assert QUERIES["op1_url_verdicts"](spark, store(pages=pages(spark, []))).count() == 0
    bare = pages(spark, ["http://www.greenfields.net/a", "http://www.greenfields.net/a"], None)
    rows = url_filter.judge(bare).collect()
    assert [r["verdict"] for r in rows] == ["allow", "allow"]


# ---- pipeline --------------------------------------------------------------------


def test_stages_of_odd_rows(spark, odd, none, store, with_clashes):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for rows in (with_clashes(odd), none):
        folder = store(documents=rows, labels=labels)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == rows.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert (last.count() > 0) == (rows is not none)


def test_pipeline_against_its_parts(spark):
    """Each stage against a plain statement of what it has to keep."""
    folder = SMALL
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, folder).where("kept").collect()}
    table = spark.createDataFrame([docs[i] for i in sorted(kept)])
    model = langid.train(table, langid.remainder(F.col("doc_id"), 4) != 2)
    judged = {i: model.predict(docs[i]["text"]) for i in kept}
    kept = {i for i, (lang, score) in judged.items() if lang != "und" and score >= model.threshold}
    alone = sorted({least for _, _, least in brute_groups([(i, docs[i]["text"]) for i in sorted(kept)])})
    mixed = mixing.mix(spark.createDataFrame([docs[i] for i in alone])).collect()
    copies = {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}
    found = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in found if r["rank"] == 1) == collections.Counter(copies)
    one = next(iter(copies))
    (samples,) = sampling.Sampler().sample([docs[one]["text"]], [sampling.row_key(one, docs[one]["text"])], sampling.K)
    assert {round(s.log_p, 6) for s in samples} == {round(r["log_p"], 6) for r in found if r["doc_id"] == one}


def test_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [n.split("_")[0] for n in QUERIES] and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(ORACLES) <= set(entry.oracle_sql()) and len(corpus_pipeline.STAGES) == 5
