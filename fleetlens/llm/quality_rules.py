"""Quality rules whose cutoffs come with a bound on false rejection.

Every rule rejects a document whose statistic lies beyond a cutoff. Which cutoff
may be used is decided on labelled documents: for a stratum (the language) and a
cutoff, the exact binomial test asks whether the rule rejects less than a share
`risk` of good documents. With k of n good documents beyond the cutoff the
p-value is P(Binomial(n, risk) <= k), which is the Clopper-Pearson upper bound
turned around. Cutoffs of one rule are tested from the mildest to the strictest
and the first failure ends the sequence, so a sequence costs its level once;
Bonferroni divides `error` among all sequences (rules x strata). With probability
1 - error, no chosen rule rejects more than `risk` of the good documents of its
stratum. No test can succeed on fewer than log(level) / log(1 - risk) good labels, 1,290
here; languages with fewer, which is known before any test, are one stratum together, and
the bound holds for that one as a whole. Where even they have too few labels, and in a
language without labels, no cutoff is set and no document lost.

Everything is DataFrame code: the statistics are array expressions inside a row,
without exploding words, and only counts per (stratum, rule, cutoff) are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.text import fresh, let, words
from fleetlens.session import settle

#: Languages with their own stratum; all others, and NULL, share one.
STRATA = ("de", "en", "es", "fr", "it", "nl", "pt")
OTHER = "other"

#: (statistic, cutoffs from the mildest to the strictest); above is rejected.
RULES: dict[str, Sequence[float]] = {
    "symbol_share": (1.0, 0.5, 0.35, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "word_length": (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0, 8.0),
}
RISK = 0.005
ERROR = 0.05
MIN_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash. Where all hashes differ, which a hash
    set tells, nothing repeats. Elsewhere sorting (hash, position) brings equal
    windows together; the positions of those with an equal neighbour, sorted
    again, cover min(3, distance to the next) words each.
    """
    at = F.get
    hashes = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, at(w, i + 1), at(w, i + 2))), 1, F.size(w) - 2
    )

    def covered(h: Column) -> Column:
        repeated = let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (x["h"] == at(s, i - 1)["h"]) | (x["h"] == at(s, i + 1)["h"]), x["p"]
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
        return let(
            F.sort_array(repeated),
            lambda p: F.aggregate(
                F.transform(
                    p, lambda x, i: F.least(F.lit(3), F.coalesce(at(p, i + 1) - x, F.lit(3)))
                ),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    found = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    )
    return F.when(F.size(w) >= 4, found).otherwise(F.lit(0))


def text_counts(text: Column) -> Column:
    """Struct of the counts a rule needs; all zero for NULL and blank texts."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(
        lines,
        lambda found: F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        ),
    )
    of_words = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    symbols = F.size(F.split(t, "[#*$%&|<>]")) - 1
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"), symbols.cast("long").alias("n_symbols")
    )


def with_counts(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Add the counts as one struct column, computed once; returns its name too."""
    name = fresh(df, "counts")
    raw = fresh(df, "raw")
    # the generator keeps later filters from copying the expressions below it
    staged = df.select("*", F.explode(F.array(text_counts(F.col(f"`{text}`")))).alias(raw))
    r = F.col(raw)
    counts = F.struct(
        r["w"]["n_words"].alias("n_words"),
        r["w"]["word_chars"].alias("word_chars"),
        r["n_symbols"].alias("n_symbols"),
        r["l"]["n_dup_lines"].alias("n_dup_lines"),
        r["w"]["n_repeat_words"].alias("n_repeat_words"),
        r["l"]["n_lines"].alias("n_lines"),
    )
    return staged.withColumn(name, counts).drop(raw), name


def counted_once(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> tuple[DataFrame, str]:
    """doc_id, lang and the counts of every document, settled: texts are read once."""
    counted, counts = with_counts(docs)
    return settle(counted.select(doc_id, lang, counts), "quality-counts"), counts


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def shares(c: Column) -> dict[str, Column]:
    """The statistic of every rule; 0 where its denominator is 0."""
    share = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit(OTHER))


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k), summed exactly from 0 to k in log space.

    1 where k >= n * share: no test can succeed there, and the sum stays as short
    as the share of documents it stands for.
    """
    first = n * F.log(F.lit(1.0 - share))
    odds = float(share / (1.0 - share))
    state = lambda log, total: F.struct(log.alias("log"), total.alias("total"))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k.cast("long")),
        state(first, F.exp(first)),
        lambda s, i: let(
            s["log"] + F.log((n - i + 1) / i * odds), lambda v: state(v, s["total"] + F.exp(v))
        ),
        lambda s: s["total"],
    )
    return (
        F.when(k >= n * share, F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(total)
    )


def level_of(error: float = ERROR) -> float:
    """The level of one sequence of tests."""
    return error / (len(RULES) * (len(STRATA) + 1))


def labels_needed(risk: float = RISK, error: float = ERROR) -> int:
    """Good labels of which none may be rejected for the first test to succeed."""
    return math.ceil(math.log(level_of(error)) / math.log1p(-risk))


def choose_cutoffs(
    counted: DataFrame, counts: str, lang: str, good: Column, *, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """The strictest admissible cutoff per stratum: one row (stratum, one column per rule).

    `counted` holds the labelled documents, one row for each label. At most
    len(STRATA) + 1 rows come out, whatever the input; a rule without an
    admissible cutoff is NULL, and a stratum without labels has no row. Strata with fewer
    than `labels_needed` are tested together and have the same cutoffs.
    """
    c = F.col(counts)
    values = shares(c)
    cells = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(step).alias("step"),
                F.lit(float(cut)).alias("cutoff"),
                (values[rule] > cut).cast("long").alias("beyond"),
            )
            for rule, cuts in RULES.items()
            for step, cut in enumerate(cuts)
        ]
    )
    tested = (
        counted.where(good & ~base_failed(c))
        .select(stratum(F.col(f"`{lang}`")).alias("stratum"), F.explode(cells).alias("cell"))
        .groupBy("stratum", "cell.rule", "cell.step", "cell.cutoff")
        .agg(F.count("*").alias("n"), F.sum("cell.beyond").alias("k"))
    )
    alone = F.col("n") >= labels_needed(risk, error)
    pool = Window.partitionBy("pool", "rule", "step")
    pooled = tested.withColumn("pool", F.when(alone, F.col("stratum")).otherwise(F.lit(OTHER))).select(
        "stratum", "rule", "step", "cutoff", F.sum("n").over(pool).alias("n"), F.sum("k").over(pool).alias("k")
    )
    passed = F.when(binomial_tail(F.col("n"), F.col("k"), risk) <= level_of(error), 1).otherwise(0)
    sequence = Window.partitionBy("stratum", "rule").orderBy("step")
    chosen = (
        pooled.withColumn("ok", passed)
        .withColumn("still", F.min("ok").over(sequence))
        .where("still = 1")
    )
    return chosen.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule in RULES]
    )


def judge(counted: DataFrame, counts: str, lang: str, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed, kept and the first rule that rejects (`rejected_by`, or NULL).

    The cutoffs are broadcast: at most len(STRATA) + 1 rows by construction.
    """
    c = F.col(counts)
    values = shares(c)
    key = fresh(counted, "stratum")
    limits = cutoffs.select(
        F.col("stratum").alias(key), *[F.col(rule).alias(f"{key}_{rule}") for rule in RULES]
    )
    joined = counted.withColumn(key, stratum(F.col(f"`{lang}`"))).join(
        F.broadcast(limits), key, "left"
    )
    rejected = F.coalesce(
        F.when(base_failed(c), F.lit("base")),
        *[F.when(values[rule] > F.col(f"{key}_{rule}"), F.lit(rule)) for rule in RULES],
    )
    return (
        joined.withColumn("base_failed", base_failed(c))
        .withColumn("rejected_by", rejected)
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop(*limits.columns)
    )


def labelled(counted: DataFrame, counts: str, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of the documents that have a quality label, one row for each label."""
    found = labels.where("quality IS NOT NULL").select(
        F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")
    )
    return counted.join(found, F.col(f"`{doc_id}`") == F.col("__id"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, all columns as they were.

    Counts are computed twice, once for the cutoffs and once beside the text, so
    that no text is shuffled. Rows are judged one by one: repeated rows share
    their verdict, rows with a NULL doc_id are judged like any other but cannot
    be labelled, NULL and blank texts fail the base rule, and an empty labels
    table leaves the base rule alone.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), "doc_id", "lang", "text")
    counted, counts = with_counts(packed)
    narrow = counted.select("doc_id", "lang", counts)
    cutoffs = choose_cutoffs(labelled(narrow, counts, labels), counts, "lang", F.col("__quality") == 1)
    judged = judge(counted.select("doc", "lang", counts), counts, "lang", cutoffs)
    return judged.where("kept").select(*[F.col("doc")[n].alias(n) for n in names])
