"""Fault classification built from the rule list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.functions.text import compute

# i: any case, d: only \n ends a line, U: Unicode classes and case folding.
FLAGS = "(?idU)"


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _case(text: str, level: str, rules: Sequence[R.Rule], benign: Sequence[str]) -> str:
    """The rules as one CASE: tried in order, the first match ends the search."""
    def matches(pattern: str) -> str:
        return f"`{text}` RLIKE {_literal(FLAGS + pattern)}"

    branches = [(matches("|".join(benign)), "NULL")] if benign else []
    branches += [(matches(rule.pattern), str(n)) for n, rule in enumerate(rules, 1)]
    listed = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {listed} {_by_level(level, len(rules))} END"


def _by_level(level: str, n: int) -> str:
    return (
        f"WHEN `{level}` <= {R.CATCH_ALL_CRITICAL_LEVEL} THEN {n + 1} "
        f"WHEN `{level}` <= {R.CATCH_ALL_LEVEL} THEN {n + 2}"
    )


def rule_number(
    text: str, level: str, rules: Sequence[R.Rule] = R.RULES, benign: Sequence[str] = R.BENIGN
) -> Column:
    """1..n for the first matching rule, n+1 / n+2 for the catch-all, else NULL."""
    return F.expr(_case(text, level, rules, benign))


NO_RULE, HARMLESS, UNUSUAL = 0, -1, -2


def quick_finder(rules: Sequence[R.Rule], benign: Sequence[str]):
    """An Arrow function text -> rule number, or None when a pattern does not suit it.

    Nearly every line of a log matches nothing. Arrow's automaton tells that for
    all patterns together in about a third of a microsecond a line, where trying
    forty patterns in the JVM takes tens. It works on printable ASCII, where both
    agree; other texts come back as UNUSUAL and take the CASE.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    patterns = [rule.pattern for rule in rules]
    harmless = "|".join(benign) if benign else None
    try:
        for pattern in [*patterns, *benign]:
            pc.match_substring_regex(pa.array([""]), pattern, ignore_case=True)
    except pa.ArrowInvalid:
        return None
    anything = "|".join(f"(?:{p})" for p in [*patterns, *benign])

    def find(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def hits(values, pattern):
            found = pc.match_substring_regex(values, pattern, ignore_case=True)
            return found.fill_null(False).to_numpy(zero_copy_only=False)

        plain = hits(texts, r"^[ -~\t]*$")
        codes = np.where(plain, 0, -2).astype("int32")
        suspects = np.flatnonzero(plain & hits(texts, anything))
        if len(suspects):
            few = texts.take(pa.array(suspects))
            number = np.zeros(len(suspects), dtype="int32")
            for n in range(len(patterns), 0, -1):
                number[hits(few, patterns[n - 1])] = n
            if harmless:
                number[hits(few, harmless)] = -1
            codes[suspects] = number
        return pa.array(codes)

    return F.arrow_udf(find, "int")


def with_rule_number(
    records: DataFrame,
    text: str,
    level: str,
    into: str,
    rules: Sequence[R.Rule] = R.RULES,
    benign: Sequence[str] = R.BENIGN,
) -> DataFrame:
    """Add the rule number of every record."""
    finder = quick_finder(rules, benign)
    if finder is None:
        return compute(records, **{into: rule_number(text, level, rules, benign)})
    coded = records.withColumn("__code", finder(F.col(text)))
    number = (
        f"CASE WHEN __code > {NO_RULE} THEN __code WHEN __code = {HARMLESS} THEN NULL "
        f"WHEN __code = {UNUSUAL} THEN {_case(text, level, rules, benign)} "
        f"{_by_level(level, len(rules))} END"
    )
    return compute(coded, **{into: F.expr(number)}).drop("__code")


def rule_fields(number: str, rules: Sequence[R.Rule] = R.RULES) -> dict[str, Column]:
    """kind, severity and note of a rule number, NULL for NULL."""
    unknown = "Kernel error no rule knows."
    entries = [
        *rules,
        R.Rule(R.CATCH_ALL, R.CRITICAL, "", unknown),
        R.Rule(R.CATCH_ALL, R.ERROR, "", unknown),
    ]

    def entry(values: Sequence[str]) -> Column:
        return F.expr(f"get(array({', '.join(map(_literal, values))}), `{number}` - 1)")

    return {
        "kind": entry([e.kind for e in entries]),
        "severity": entry([e.severity for e in entries]),
        "note": entry([e.note for e in entries]),
    }


def xid_code(text: Column) -> Column:
    found = F.regexp_extract(text, FLAGS + R.XID_PATTERN, 1)
    return F.when(found != "", found.try_cast("decimal(38,0)"))


def xid_detail(text: Column) -> Column:
    """`Xid N: meaning`, NULL when the text holds no code."""
    code = xid_code(text)
    pairs = [F.lit(part) for item in R.XID_MEANINGS.items() for part in item]
    meaning = F.try_element_at(F.create_map(*pairs), code.try_cast("int"))
    return F.when(
        code.isNotNull(),
        F.concat(
            F.lit("Xid "), code.cast("string"), F.lit(": "),
            F.coalesce(meaning, F.lit("unlisted code")),
        ),
    )


def event_message(kind: Column, text: Column) -> Column:
    """The stored text: Xid messages start with their meaning."""
    detail = F.when(kind == R.XID_KIND, xid_detail(text))
    return F.when(detail.isNotNull(), F.concat(detail, F.lit(" — "), text)).otherwise(text)


def truncated(message: Column) -> Column:
    return F.left(message, F.lit(R.MESSAGE_MAX))
