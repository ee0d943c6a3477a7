"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

A rule names a host and the beginning of a path; it fits the host with all its
subdomains, and the longest fitting rule decides. Urls without a rule are judged
by a multinomial naive Bayes model that learns from the urls the rules decide.

Host names are concatenated words ("greenfields"). Each host label is split by a
unigram Viterbi search: the most probable sequence of words, with word
probabilities counted over the visible text of all pages. A character outside any
known word is a word of its own at the least probability.

Only different host labels are segmented, and only the words that occur inside
one are fetched, by a join on the label's substrings; the word counts themselves
never leave the cluster. The model is hashed to a fixed number of slots, so its
size does not depend on the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import settle

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SLOTS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_WORD = re.compile(r"[^\W\d_]+")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or NULL."""
    fitting = [
        F.when(
            ((host == name) | host.endswith("." + name)) & path.startswith(start),
            F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for name, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*fitting)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for html in batch.column(0):
            text = html.as_py()
            if text:
                counts.update(_WORD.findall(_MARKUP.sub(" ", text).lower()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages, lower case."""
    return pages.select("html").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words; between equals the one whose last word is longer.

    Words of any length are tried: those of the counted lengths, and single characters.
    """
    lengths = sorted({len(w) for w in counts}, reverse=True)
    unknown = -np.log(max(total, 1) + 1.0) - 1.0
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        choice, start = best[end - 1] + unknown, end - 1
        for length in lengths:
            begin = end - length
            n = counts.get(label[begin:end]) if begin >= 0 else None
            if n:
                value = best[begin] + np.log(n / total)
                if value > choice or (value == choice and begin < start):
                    choice, start = value, begin
        best.append(choice)
        back.append(start)
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label) with distinct labels -> (label, words)."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = F.length("label")
    longest = labels.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    # lengths that words have and labels can hold: no more than the longest label has characters
    fitting = words.select(F.length("word").alias("length")).where(F.col("length") <= longest).distinct()
    lengths = F.array(*[F.lit(r[0]) for r in sorted(fitting.collect())]).cast("array<int>")
    parts = labels.where(size > 0).select(
        "label", F.explode(F.sequence(F.lit(1), size)).alias("begin")
    ).select(
        "label",
        F.explode(
            F.transform(
                F.filter(lengths, lambda n: n <= F.length("label") - F.col("begin") + 1),
                lambda n: F.substring(F.col("label"), F.col("begin"), n),
            )
        ).alias("word"),
    ).distinct()
    known = parts.join(words, "word").groupBy("label").agg(
        F.collect_list(F.struct("word", "n")).alias("known")  # one per character and length at most
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [
                viterbi(name, {k["word"]: k["n"] for k in known or ()}, total)
                for name, known in zip(names, batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "words"]
            )

    return labels.join(known, "label", "left").select("label", "known").mapInArrow(
        run, "label string, words array<string>"
    )


def path_tokens(path: Column) -> Column:
    """Runs of letters as they are (lower case); runs of digits by their length."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"(\p{L}+|\p{N}+)"), 1)
    return F.transform(
        runs,
        lambda t: F.when(
            t.rlike(r"^\p{N}"), F.concat(F.lit("#"), F.length(t).cast("string"))
        ).otherwise(F.concat(F.lit("/"), t)),
    )


def _slots(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int"))


def tokenized(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (struct), words (of the host) and slots of every url."""
    parsed = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    hosts = settle(parsed.select("host").distinct(), "hosts")
    named = hosts.select("host", F.posexplode(F.split("host", r"\.")).alias("place", "label"))
    split = segment(
        named.select("label").where("label <> ''").distinct(), settle(word_counts(pages), "words-of-pages")
    )
    # a host has at most a few dozen labels, so its words are a small group
    in_words = named.join(split, "label").groupBy("host").agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("place", "words"))), lambda s: s["words"]
            )
        ).alias("words")
    )
    segmented = settle(hosts.join(in_words, "host", "left").select(
        "host", F.coalesce("words", F.array().cast("array<string>")).alias("words")
    ), "segmented-hosts")
    tokens = F.concat(F.col("words"), path_tokens(F.col("path")))
    return parsed.join(segmented, "host").select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "words",
        _slots(tokens).alias("slots"),
    )


def bayes(urls: DataFrame) -> np.ndarray:
    """Log odds of block against allow: one number per slot, the prior at the end."""
    decided = urls.where("rule IS NOT NULL").select(
        (F.col("rule.verdict") == "block").cast("int").alias("block"),
        F.explode(F.concat("slots", F.array(F.lit(SLOTS)))).alias("slot"),
    )
    sums = decided.groupBy("slot").agg(F.sum("block").alias("b"), F.count("*").alias("n")).collect()
    counts = np.zeros((SLOTS + 1, 2))  # at most SLOTS + 1 rows
    for slot, b, n in sums:
        counts[slot] = (n - b, b)
    smooth = np.log(counts + 1.0)
    totals = np.log(counts[:-1].sum(axis=0) + SLOTS)
    odds = smooth[:, 1] - smooth[:, 0]
    odds[:-1] -= totals[1] - totals[0]
    return odds


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words, log_odds of every row of `pages`.

    A NULL url and one without :// have empty host and path and no rule; the model
    then knows the prior only. Without urls that rules decide the log odds are 0, and
    0 allows. NULL and empty html add no words. Repeated rows are judged each.
    """
    urls = settle(tokenized(pages, rules), "urls")
    odds = bayes(urls)

    @F.pandas_udf("double")
    def log_odds(slots: pd.Series) -> pd.Series:
        return pd.Series([odds[np.asarray(s, int)].sum() + odds[-1] for s in slots], dtype=float)

    judged = urls.withColumn("log_odds", log_odds(F.col("slots")))
    by_model = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"),
        F.coalesce(F.col("rule.verdict"), by_model).alias("verdict"), "words", "log_odds",
    )
