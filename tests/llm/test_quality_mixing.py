"""Quality rules and mixing: brute force, SQL, guarantees, odd rows."""

import collections
import math
import re

import duckdb
import pytest
from odd_rows import DOCUMENTS, odd_rows, prose
from pyspark.sql import functions as F

import check_queries
from fleetlens.llm import mixing, quality_rules
from fleetlens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_mix_sources"])
def test_against_sql(spark, name):
    _, verdict = check_queries.compare(spark, SMALL, name)
    assert verdict.startswith("ok"), verdict


def test_counts_of_odd_texts(spark, odd):
    more = ["a b c a b c", "a a a a", "x y z\nx y z\n\nx y z", "a b", "# a*b\t$%&|<>"]
    frame = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in more], "text string"))
    counted, name = quality_rules.with_counts(frame)
    for row in counted.collect():
        assert tuple(row[name][c] for c in quality_rules.COUNTS) == counts(row["text"])


@pytest.mark.parametrize("n,k", [(700, 0), (3000, 4), (100000, 430), (50, 0), (10, 10), (1000, 5)])
def test_binomial_tail_is_exact(spark, n, k):
    share = 0.005
    found = spark.range(1).select(
        quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), share).alias("p")
    ).first()["p"]
    log = lambda i: (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(share) + (n - i) * math.log1p(-share)
    )
    expected = 1.0 if k >= n * share else math.fsum(math.exp(log(i)) for i in range(k + 1))
    assert found == pytest.approx(expected, rel=1e-9)


def judged(spark, n_good, n_bad_good):
    """Good documents of which some have symbols; all are labelled good."""
    clean, symbols = prose(5, 60), " ".join(w + "###" for w in prose(6, 60).split())
    rows = [(i, symbols if i < n_bad_good else clean, "en", "s", None) for i in range(n_good)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    labels = spark.createDataFrame([(i, 1) for i in range(n_good)], "doc_id long, quality int")
    narrow, name = quality_rules.counted_once(docs)
    found = quality_rules.labelled(narrow, name, labels)
    return quality_rules.choose_cutoffs(found, name, "lang", F.col("__quality") == 1).collect()


def test_cutoffs_need_enough_labels(spark):
    assert judged(spark, 300, 0) == []  # even without an error 300 labels prove nothing at 0.5 %
    chosen = judged(spark, 2500, 0)
    assert [r["stratum"] for r in chosen] == ["en"]
    assert chosen[0]["symbol_share"] == 0.05
    # 1 % of the good documents have a third of symbols: no cutoff below that is safe
    assert judged(spark, 2500, 25)[0]["symbol_share"] > 0.3


def test_small_strata_are_judged_together(spark, store):
    """Cutoffs act in the SQL as well: en alone, de and fr as one, it and pt not at all."""
    assert quality_rules.labels_needed() == 1290
    clean, symbols = prose(5, 60), " ".join(w + "###" for w in prose(6, 60).split())
    langs = ["en"] * 1400 + ["de"] * 800 + ["fr"] * 700
    rows = [(i, clean, lang, "s", None) for i, lang in enumerate(langs)]
    labels = [(i, 1) for i in range(len(rows))]
    for lang in ("en", "de", "fr", "it", "pt"):
        for j in range(3):
            rows.append((len(rows), symbols, lang, "s", None))
            labels += [(len(rows) - 1, 0)] if lang != "pt" else []
    folder = store(
        documents=spark.createDataFrame(rows, DOCUMENTS),
        labels=spark.createDataFrame(labels, "doc_id long, quality int"),
    )
    found = QUERIES["op2_quality_rules"](spark, folder)
    lost = collections.Counter(rows[r["doc_id"]][2] for r in found.where("NOT kept").collect())
    assert lost == {"en": 3, "de": 3, "fr": 3}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    sql = con.execute(ORACLES["op2_quality_rules"])
    theirs = check_queries.table([d[0] for d in sql.description], sql.fetchall())
    assert check_queries.table(found.columns, [tuple(r) for r in found.collect()]) == theirs


def test_filter_keeps_columns_and_clean_documents(spark, odd, none, with_clashes):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    kept = quality_rules.filter_documents(with_clashes(odd), labels)
    assert kept.columns == with_clashes(odd).columns
    expected = sorted(str(r[0]) for r in odd_rows() if counts(r[1])[0] >= 50 and 2 * counts(r[1])[4] <= counts(r[1])[0])
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == expected
    assert {r["kept"] for r in rows} == {"own kept"}
    assert quality_rules.filter_documents(none, labels).count() == 0
    assert quality_rules.filter_documents(odd, labels.limit(0)).count() == len(expected)


def test_targets_fill_the_sources_like_water(spark):
    sizes = {None: 4000, "a": 10, "b": 500, "c": 0, "d": 9000}
    frame = spark.createDataFrame(
        list(sizes.items()), "source string, source_size long"
    )
    found = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:  # the excess is shared again until none is above
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        share = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in order}
        above = {s for s in order if share[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    assert found == {s: pytest.approx(v) for s, v in share.items()}


def test_mix_meets_targets_and_repeats(spark, odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0


def test_words_taken_are_near_the_target(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), "en", "abc"[i % 3], None) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    by = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")
    )
    assert all(abs(r["taken"] - r["target"]) <= 97 for r in by.collect())


def test_inclusion_follows_the_weight(spark):
    rows = [(i, "w w w w", "en", "a", 1 + i % 2 * 3) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = mixing.mix(docs, weight="n_chars", share=0.25, most=1).join(docs.select("doc_id", "n_chars"), "doc_id")
    taken = dict(found.groupBy("n_chars").agg(F.avg(F.col("taken") / 4)).collect())
    assert taken[1] == pytest.approx(0.1, abs=0.03) and taken[4] == pytest.approx(0.4, abs=0.04)


def test_inclusion_follows_the_size_and_large_documents_are_certain(spark):
    rows = [(i, " ".join(["w"] * (2 if i % 4 else 6)), "en", "a", None) for i in range(8000)]
    rows += [(9000 + i, " ".join(["w"] * 60), "en", "a", None) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = mixing.mix(docs, share=0.25, most=1).collect()
    total, wanted = sum(r["size"] for r in found), 0.25 * sum(r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - wanted) <= 6 and total == 24600
    by = collections.defaultdict(list)
    for r in found:
        by[r["size"]].append(r["copies"])
    assert all(by[60])  # 60 times the scale is more than 1
    scale = (wanted - 600) / (6000 * 2 * 2 + 2000 * 6 * 6)
    for size in (2, 6):
        assert sum(by[size]) / len(by[size]) == pytest.approx(size * scale, abs=0.03)


def test_weights_are_rounded_and_never_missing(spark):
    given = [None, float("nan"), -1.0, 0.0, 1.0, 7.0, 1234.5, 0.04567, float("inf")]
    frame = spark.createDataFrame([(w,) for w in given], "w double")
    found = [r[0] for r in frame.select(mixing.three_digits(F.col("w"))).collect()]
    assert found == pytest.approx([1e-3] * 4 + [1.0, 7.0, 1230.0, 0.0457, 1e300])


def test_mixed_documents_keep_columns(odd, none, with_clashes):
    mixed = mixing.mix_documents(with_clashes(odd))
    assert mixed.columns == with_clashes(odd).columns
    times = collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    copies = mixing.mix(odd).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()
    by_size: collections.Counter = collections.Counter()
    for (doc_id, text), n in times.items():
        by_size[doc_id, counts(text)[0]] += n
    assert {(r["doc_id"], r["size"]): r["n"] for r in copies if r["n"]} == dict(by_size)
    assert mixing.mix_documents(none).count() == 0
