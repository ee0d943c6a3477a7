"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of `share` times all
words, at most `most` times its own words, the excess going to the others by
weight (water filling: target = min(most * size, level * weight)). A source whose
target is r times its size takes floor(r) whole copies of every document; the
rest is a sample without replacement in which a document has inclusion probability

    pi = scale * weight,   sum of min(1, pi) * words = words still wanted.

The weight is the document's number of words, or a named column. Documents whose
pi reaches 1 are certain: they are taken whole, and the scale of the others is what
remains after them. Pareto order sampling ranks the others by

    Q = (u / (1 - u)) / (pi / (1 - pi)),   u uniform from the document's id,

and takes the smallest Q. The sample size is fixed in words: documents are taken
in rank order while that brings the source nearer to its target.

No source sits in one task. The scale is found over the different weights of a
source: with n words in all there are at most sqrt(2 n) different sizes, and a named
weight is rounded to three decimal digits, at most 900 values for each power of ten. Ranks are cut into 256 ranges of their own scale, so
what is counted and ordered per source is at most 256 sums. The range where the
target is reached is cut into 256 again, and only the documents of one such leaf,
about 1/65,536 of a source, are ordered one by one. The result is one cutoff per
source, which joins the documents again. Only one row per source goes through a
single task, since sources are ordered and weighed as a whole.

Documents without words take nothing and are not ranked; a weight that is NULL, no
number or below a thousandth counts as a thousandth; a NULL source is a source
of its own, and an empty table gives an empty mix. The random number depends on
the id and the size, so reruns agree; repeated rows, and rows without an id that
have the same size, share it and are taken or left together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.text import fresh, uniform, words
from fleetlens.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
_RANGES = 256


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, source_size) -> the same with target, copies and rest.

    Sources are ordered by code point, NULL last, and take the weights in turn.
    One row per source passes one task.
    """
    everywhere = Window.partitionBy()
    by_name = everywhere.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    cap = F.col("source_size") * most
    # Water filling: in the order of cap / weight, level_k = (all words of the mix - caps
    # of the sources before k) / (weights from k on). It rises while sources are full
    # and falls afterwards, so the level is the largest one whose source is not full.
    by_cap = everywhere.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    filled = share * F.sum("source_size").over(everywhere) - most * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    open_weight = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = sizes.withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)
    ).withColumn("level", filled / open_weight)
    level = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(everywhere)
    goal = F.least(cap.cast("double"), F.coalesce(level * F.col("weight"), cap.cast("double")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return leveled.withColumn("target", goal).select(
        "source",
        "source_size",
        "target",
        F.floor(ratio).alias("copies"),
        (ratio - F.floor(ratio)).alias("rest"),
    )


def rank(u: Column, pi: Column) -> Column:
    """Pareto's Q as Q / (1 + Q), which keeps the order and lies between 0 and 1."""
    q = (u / (1.0 - u)) / (pi / (1.0 - pi))
    return q / (1.0 + q)


def _inclusion() -> Column:
    """scale * pull; NULL, which no comparison accepts, where the source is not sampled."""
    return F.when(F.col("rest") > 0, F.col("pull") * F.col("scale"))


def _below_one(pi: Column) -> Column:
    return F.greatest(F.lit(1e-9), F.least(pi, F.lit(1.0 - 1e-9)))


def three_digits(weight: Column) -> Column:
    """A weight of at least a thousandth, rounded to three decimal digits."""
    w = F.when(weight.isNull() | F.isnan(weight), F.lit(1e-3)).otherwise(F.greatest(weight, F.lit(1e-3)))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.least(w, F.lit(1e300)))) - 2)
    return F.round(F.least(w, F.lit(1e300)) / unit) * unit


def scales(goals: DataFrame, classes: DataFrame) -> DataFrame:
    """Per sampled source: `scale` of the weights and `sure`, the words of certain documents.

    `classes` has the words of every (source, pull). From the largest weight down, a
    weight is certain if it is so when all larger ones are taken whole; the first that
    is not gives the scale. One always is not, as less than all words are wanted.
    """
    down = Window.partitionBy("source").orderBy(F.col("pull").desc())
    joined = classes.alias("c").join(
        goals.where("rest > 0").alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))
    )
    want = F.col("target") - F.col("copies") * F.col("source_size")
    larger = F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.sum(F.col("pull") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    return (
        joined.select("c.source", "pull", "words", want.alias("want"))
        .select("source", "pull", "want", F.coalesce(larger, F.lit(0)).alias("sure"), onward.alias("onward"))
        .withColumn("scale", (F.col("want") - F.col("sure")) / F.col("onward"))
        .where("pull * scale < 1")
        .groupBy("source")
        .agg(F.max_by(F.struct("scale", "sure"), "pull").alias("found"))
        .select("source", "found.scale", "found.sure")
    )


def _running(name: str, keys: Sequence[str], order: str) -> Column:
    """The sum of `name` over the rows before this one."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(ahead), F.lit(0))


def _reached(sums: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The one range of every key in which `want` is reached, with what is still wanted."""
    return (
        sums.withColumn("before", _running("words", keys, order))
        .where("before <= want AND want < before + words")
        .select(*keys, order, (F.col("want") - F.col("before")).alias("left"))
    )


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def cutoffs(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """One row per source: source_size, target, copies, rest, scale, edge, last.

    `rows` has source, size, pull (the document's weight) and u. A document of positive
    size is sampled if it is certain, or its rank is below `edge` or at most `last`.
    """
    classes = settle(rows.groupBy("source", "pull").agg(F.sum("size").alias("words")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    plain = settle(targets(sizes, weights, share, most), "mix-targets")
    goals = settle(
        plain.alias("g").join(
            scales(plain, classes.where("words > 0")).alias("s"),
            F.col("g.source").eqNullSafe(F.col("s.source")), "left",
        ).select("g.*", "scale", "sure"),
        "mix-scales",
    )
    joined = rows.where("size > 0").alias("r").join(
        goals.where("rest > 0").alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))
    )
    want = F.col("target") - F.col("copies") * F.col("source_size") - F.col("sure")
    ranked = joined.where(_inclusion() < 1).select(
        "r.source", "size", want.alias("want"), rank(F.col("u"), _below_one(_inclusion())).alias("rank")
    ).select(
        "*",
        F.floor(F.col("rank") * _RANGES).alias("d1"),
        (F.floor(F.col("rank") * _RANGES * _RANGES) % _RANGES).alias("d2"),
    )
    words_ = F.sum("size").alias("words")
    first = _reached(
        ranked.groupBy("source", "d1").agg(words_, F.first("want").alias("want")), ["source"], "d1"
    )
    inside = ranked.alias("r").join(
        first.alias("f"),
        F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.d1") == F.col("f.d1")),
    ).select("r.source", "r.d1", "r.d2", "size", "rank", F.col("left").alias("want"))
    inside = settle(inside, "mix-range")
    second = _reached(
        inside.groupBy("source", "d1", "d2").agg(words_, F.first("want").alias("want")),
        ["source", "d1"],
        "d2",
    )
    leaf = inside.alias("r").join(
        second.alias("f"),
        F.col("r.source").eqNullSafe(F.col("f.source"))
        & (F.col("r.d1") == F.col("f.d1"))
        & (F.col("r.d2") == F.col("f.d2")),
    ).select("r.source", "r.d1", "r.d2", "size", "rank", "left")
    steps = leaf.groupBy("source", "d1", "d2", "rank").agg(words_, F.first("left").alias("left"))
    upto = _running("words", ["source"], "rank") + F.col("words")
    cut = (
        steps.withColumn("upto", upto)
        .groupBy("source")
        .agg(
            F.min((F.col("d1") * _RANGES + F.col("d2")) / float(_RANGES * _RANGES)).alias("edge"),
            F.min_by(
                F.struct("rank", (F.abs(F.col("upto") - F.col("left")) < F.col("left")).alias("nearer")),
                F.struct(F.abs(F.col("upto") - F.col("left")), F.col("rank")),
            ).alias("best"),
        )
        .select("source", "edge", F.when(F.col("best.nearer"), F.col("best.rank")).alias("last"))
    )
    return goals.alias("g").join(
        cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left"
    ).select(
        "g.source", "source_size", "target", "copies", "rest", "scale",
        F.coalesce("edge", F.lit(0.0)).alias("edge"), F.coalesce("last", F.lit(-1.0)).alias("last"),
    )


def _times(size: Column, u: Column) -> Column:
    """How often a document is taken, beside its source's cutoffs and its own pull."""
    pi = _inclusion()
    position = rank(u, _below_one(pi))
    sampled = (size > 0) & ((pi >= 1) | (position < F.col("edge")) | (position <= F.col("last")))
    return (F.col("copies") + F.coalesce(sampled, F.lit(False)).cast("int")).cast("int")


def sized(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None
) -> DataFrame:
    """(doc_id, source, size, pull, u) of every document, settled: the text is read once."""
    counted = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        *([three_digits(F.col(f"`{weight}`").cast("double")).alias("pull")] if weight else []),
    )
    found = settle(counted, "mix-sizes").withColumn("u", uniform(F.col("doc_id"), F.col("size")))
    return found if weight else found.withColumn("pull", F.col("size").cast("double"))


def mix(docs: DataFrame, weight: str | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies."""
    rows = sized(docs, weight=weight)
    cuts = settle(cutoffs(rows, **options), "mix-cutoffs")
    joined = rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
    return joined.withColumn("times", _times(F.col("size"), F.col("u"))).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("times")).alias("taken"), F.col("times").alias("copies"),
    )


def mix_documents(docs: DataFrame, weight: str | None = None, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, columns unchanged.

    The cutoffs, one row per source, join the documents; as a settled table they
    are broadcast only if their file is small, else the join is split by AQE.
    """
    cuts = settle(cutoffs(sized(docs, weight=weight), **options), "mix-cutoffs")
    own = fresh(docs, "mix")
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias(own),
        *([three_digits(F.col(f"`{weight}`").cast("double")).alias("pull")] if weight else []),
        F.explode(F.array(word_count(F.col("text")))).alias("size"),
    )
    if not weight:
        rows = rows.withColumn("pull", F.col("size").cast("double"))
    joined = rows.join(cuts, F.col(f"{own}.source").eqNullSafe(F.col("source")))
    u = uniform(F.col(f"{own}.doc_id"), F.col("size"))
    return (
        joined.select(own, _times(F.col("size"), u).alias("times"))
        .where("times > 0")
        .select(own, F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*[F.col(own)[n].alias(n) for n in docs.columns])
    )
