"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    decontaminate,
    hard_negatives,
    langid,
    lattice_lm,
    merkle,
    mixing,
    quality_rules,
    sampling,
    sharding,
    simhash,
    token_counts,
    topk,
    url_filter,
)
from fleetlens.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, with the SQL text that another engine checks it by."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


#: Words of a DuckDB text column.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULE_VALUES = """
    (VALUES {values}) AS r(rule, step, cutoff)
"""

_QUALITY = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
positions AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 4),
grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM positions),
twice AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams)
  WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
counted AS (
  SELECT *, CASE WHEN lang IN {quality_rules.STRATA!r} THEN lang ELSE '{quality_rules.OTHER}' END AS stratum,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
    CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length
  FROM c),
long AS (
  SELECT doc_id, stratum, base_failed, rule, value
  FROM (UNPIVOT (SELECT doc_id, stratum, base_failed, symbol_share::DOUBLE AS symbol_share,
      dup_line_share::DOUBLE AS dup_line_share, repeat_share::DOUBLE AS repeat_share,
      word_length::DOUBLE AS word_length FROM counted)
    ON symbol_share, dup_line_share, repeat_share, word_length INTO NAME rule VALUE value)),
rules(rule, step, cutoff) AS (VALUES {{rules}}),
tested AS (
  SELECT stratum, rules.rule, step, cutoff, count(*) AS n,
    sum(CASE WHEN value > cutoff THEN 1 ELSE 0 END)::BIGINT AS k
  FROM long JOIN labels USING (doc_id) JOIN rules ON rules.rule = long.rule
  WHERE quality = 1 AND NOT base_failed GROUP BY ALL),
pooled AS (
  SELECT stratum, rule, step, cutoff, (sum(n) OVER pool)::BIGINT AS n, (sum(k) OVER pool)::BIGINT AS k FROM tested
  WINDOW pool AS (PARTITION BY rule, step,
    CASE WHEN n >= {quality_rules.labels_needed()} THEN stratum ELSE '{quality_rules.OTHER}' END)),
terms AS (SELECT *, unnest(range(0, k + 1)) AS i FROM pooled WHERE k < n * {quality_rules.RISK}),
tail AS (
  SELECT stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK}))) AS p
  FROM terms GROUP BY ALL),
run AS (
  SELECT *, min(CASE WHEN p <= {quality_rules.ERROR} / {len(quality_rules.RULES) * (len(quality_rules.STRATA) + 1)}
      THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS still
  FROM pooled LEFT JOIN tail USING (stratum, rule, step)),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM run WHERE still = 1 GROUP BY ALL),
rejected AS (
  SELECT DISTINCT doc_id FROM long JOIN chosen USING (stratum, rule) WHERE value > chosen.cutoff)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM counted LEFT JOIN rejected USING (doc_id)
""".replace(
    "{rules}",
    ", ".join(
        f"('{rule}', {step}, {cut})"
        for rule, cuts in quality_rules.RULES.items()
        for step, cut in enumerate(cuts)
    ),
)


@query("op2_quality_rules", _QUALITY)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow, counts = quality_rules.counted_once(docs)
    cutoffs = quality_rules.choose_cutoffs(
        quality_rules.labelled(narrow, counts, table(spark, sf_dir, "labels")),
        counts, "lang", F.col("__quality") == 1,
    )
    judged = quality_rules.judge(narrow, counts, "lang", cutoffs)
    return judged.select(
        "doc_id", *[F.col(counts)[c].alias(c) for c in quality_rules.COUNTS], "base_failed", "kept"
    )


_MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT *, least(2.0::DOUBLE * source_size,
    max(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER () * weight) AS target FROM l),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS rest FROM g),
u AS (
  SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || '|' || size), 1, 13))::BIGINT::DOUBLE + 0.5)
    / 4503599627370496.0::DOUBLE AS u FROM d),
classes AS (SELECT source, size, sum(size)::DOUBLE AS words FROM d WHERE size > 0 GROUP BY ALL),
down AS (
  SELECT c.source, c.size, target - whole * source_size AS want,
    coalesce(sum(words) OVER (larger ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
    sum(c.size * words) OVER (larger ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM classes AS c JOIN goal ON c.source IS NOT DISTINCT FROM goal.source WHERE rest > 0
  WINDOW larger AS (PARTITION BY c.source ORDER BY c.size DESC)),
scales AS (
  SELECT source, arg_max((want - sure) / onward, size) AS scale, arg_max(sure, size) AS sure
  FROM down WHERE size * ((want - sure) / onward) < 1 GROUP BY source),
p AS (
  SELECT doc_id, u.source, size, u, whole, source_size, target, scales.sure,
    CASE WHEN rest > 0 AND size > 0 THEN size * scale END AS pi
  FROM u JOIN goal ON u.source IS NOT DISTINCT FROM goal.source
    LEFT JOIN scales ON u.source IS NOT DISTINCT FROM scales.source),
q AS (
  SELECT *, CASE WHEN pi < 1 THEN (u / (1.0 - u)) / (greatest(1e-9::DOUBLE, least(pi, 1.0 - 1e-9::DOUBLE))
    / (1.0 - greatest(1e-9::DOUBLE, least(pi, 1.0 - 1e-9::DOUBLE)))) END AS q FROM p),
ranked AS (
  SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (
      PARTITION BY source ORDER BY q / (1.0 + q) NULLS LAST) AS upto,
    target - whole * source_size - sure AS want FROM q),
best AS (
  SELECT source, min_by(CASE WHEN abs(upto - want) < want - below THEN upto ELSE below END,
    abs(upto - want)) AS take
  FROM (SELECT *, coalesce(max(CASE WHEN upto <= want THEN upto END) OVER (PARTITION BY source), 0) AS below
    FROM ranked WHERE q IS NOT NULL) GROUP BY source),
times AS (
  SELECT ranked.*, (whole + CASE WHEN pi >= 1 OR q IS NOT NULL AND upto <= take THEN 1 ELSE 0 END)::INT AS copies
  FROM ranked LEFT JOIN best ON ranked.source IS NOT DISTINCT FROM best.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM times
"""


@query("op7_mix_sources", _MIX)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op3_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.groups(table(spark, sf_dir, "documents"))
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Documents with more tokens than this do not fit one context.
CONTEXT = 2048


@query("op5_token_counts")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM v AS q JOIN v AS x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_topk", _TOPK)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    left = langid.remainder(F.col("doc_id"), 4)
    return langid.identify(docs, left != 2).select(
        "doc_id", F.coalesce(left == 2, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score"
    )


@query("op1_url_verdicts")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op6_lattice_scores")
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return lattice_lm.score(table(spark, sf_dir, "documents"), held_out)


@query("op9_sampled_segmentations")
def sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_segmentations(table(spark, sf_dir, "documents"))


#: Hex SHA-256 of the fields of a row, and the CRC-32 of its id as text by its definition.
_MERKLE = """
WITH RECURSIVE crc(n, c, step) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS r(i)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc WHERE step < 8),
crc_table AS (SELECT n, c FROM crc WHERE step = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS t FROM documents WHERE doc_id IS NOT NULL),
walk(doc_id, t, c, i) AS (
  SELECT doc_id, t, 4294967295::BIGINT, 1 FROM ids
  UNION ALL
  SELECT doc_id, t, xor(crc_table.c, walk.c >> 8), i + 1
  FROM walk JOIN crc_table ON crc_table.n = xor(walk.c & 255, ascii(substr(t, i, 1))) WHERE i <= length(t)),
changed AS (
  SELECT doc_id FROM walk WHERE i = length(t) + 1 AND xor(c, 4294967295) % 3 = 0),
rows_ AS (
  SELECT lang, doc_id, {start} AS head, text,
    CASE WHEN doc_id IN (FROM changed)
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later
  FROM documents),
leaves AS (
  SELECT lang, doc_id, sha256(head || {text}) AS leaf, sha256(head || {later}) AS shown FROM rows_),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS place,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves),
nodes(tree, level, place, node, total) AS (
  SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 7) // 8
  FROM nodes WHERE total > 1 GROUP BY tree, level, place // 8),
subroots AS (SELECT tree, level AS height, node AS subroot FROM nodes WHERE total = 1),
tops(level, place, node, total) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 7) // 8
  FROM tops WHERE total > 1 GROUP BY level, place // 8),
runs AS (
  SELECT tree, level, place // 8 AS run, list(node ORDER BY place) AS run_nodes
  FROM nodes WHERE total > 1 GROUP BY ALL),
top_runs AS (
  SELECT level, place // 8 AS run, list(node ORDER BY place) AS run_nodes FROM tops WHERE total > 1 GROUP BY ALL),
folded(key, tree, level, place, node, siblings) AS (
  SELECT row_number() OVER () AS key, tree, 0, place, shown, '' FROM placed
  UNION ALL
  SELECT key, f.tree, f.level + 1, f.place // 8,
    sha256(array_to_string(run_nodes[: f.place % 8], '') || node || array_to_string(run_nodes[f.place % 8 + 2 :], '')),
    siblings || array_to_string(run_nodes[: f.place % 8], '') || array_to_string(run_nodes[f.place % 8 + 2 :], '')
  FROM folded AS f JOIN runs ON runs.tree = f.tree AND runs.level = f.level AND runs.run = f.place // 8),
to_subroot AS (
  SELECT key, f.tree, node, siblings FROM folded AS f JOIN subroots ON subroots.tree = f.tree AND f.level = height),
upper_(key, level, place, node, siblings) AS (
  SELECT key, 0, tree, node, siblings FROM to_subroot
  UNION ALL
  SELECT key, f.level + 1, f.place // 8,
    sha256(array_to_string(run_nodes[: f.place % 8], '') || node || array_to_string(run_nodes[f.place % 8 + 2 :], '')),
    siblings || array_to_string(run_nodes[: f.place % 8], '') || array_to_string(run_nodes[f.place % 8 + 2 :], '')
  FROM upper_ AS f JOIN top_runs ON top_runs.level = f.level AND top_runs.run = f.place // 8),
done AS (SELECT key, node, siblings FROM upper_ WHERE level = (SELECT max(level) FROM tops)),
numbered AS (SELECT *, row_number() OVER () AS key FROM placed),
named AS (
  SELECT f.key, p.doc_id, p.leaf, p.tree
  FROM (SELECT key, tree, place FROM folded WHERE level = 0) AS f JOIN placed AS p ON p.tree = f.tree AND p.place = f.place)
SELECT doc_id, leaf, subroot, top.node AS root, sha256(siblings) AS proof_sha256, done.node AS folded_root,
  done.node = top.node AS verified
FROM named JOIN done USING (key) JOIN subroots ON subroots.tree = named.tree,
  (SELECT node FROM tops WHERE total = 1) AS top
"""


def _fields(*names: str) -> str:
    return " || ".join(
        f"CASE WHEN {n} IS NULL THEN '-' ELSE octet_length(encode({n}::VARCHAR)) || ':' || {n}::VARCHAR END" for n in names
    )


@query("op11_merkle_manifest", _MERKLE.format(
    start=_fields("doc_id", "source", "lang", "n_chars"), text=_fields("text"), later=_fields("later")))
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.witnesses(merkle.manifest(table(spark, sf_dir, "documents")), with_runs=False)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score
  FROM v AS a JOIN v AS x ON a.vec_id % 100 = 0 AND x.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", _NEGATIVES)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


_PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
sizes AS (SELECT DISTINCT least(10, len(w)) AS size FROM b WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS gram
  FROM (SELECT *, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
grams AS (
  SELECT row, size, p, array_to_string(w[p : p + size - 1], ' ') AS gram
  FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT row, item_id, p, size FROM grams JOIN asked USING (size, gram)),
hit AS (SELECT row, count(DISTINCT word) AS n FROM (SELECT row, unnest(range(p, p + size)) AS word FROM found) GROUP BY row),
items AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
""".replace("{words}", r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')""")


@query("op13_benchmark_hits", _PHRASES)
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("items")
