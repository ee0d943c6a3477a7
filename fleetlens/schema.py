"""Table schemas and the naming contract for metric columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("ts", T.LongType(), False),
    T.StructField("boot_id", T.StringType(), False),
])
BOOTS = T.StructType([
    T.StructField("boot_id", T.StringType()),
    T.StructField("ts_first", T.LongType()),
    T.StructField("kernel", T.StringType()),
    T.StructField("notes", T.StringType()),
])
EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("dedup", T.StringType()),
])
LABELS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts_start", T.LongType()),
    T.StructField("ts_end", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("notes", T.StringType()),
])
SNAPSHOTS = T.StructType([
    T.StructField("boot_id", T.StringType()),
    T.StructField("tick", T.LongType()),
    T.StructField("mono_us", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

# The column name pattern, the reserved names, the metric types.
IDENTIFIER = re.compile(r"[a-z_][a-z0-9_]{0,62}")
RESERVED = ("sample_id", "ts", "boot_id")
# The partition column of a sample table written by day: days since 1970.
DAY = "day"
DAY_MS = 86_400_000
METRIC_TYPES: dict[str, T.DataType] = {
    "REAL": T.DoubleType(),
    "INTEGER": T.LongType(),
    "TEXT": T.StringType(),
}


class ContractError(ValueError):
    """A source or request that breaks the column contract."""


def check_name(name: object) -> str:
    if not isinstance(name, str) or IDENTIFIER.fullmatch(name) is None:
        raise ContractError(f"not a column name: {name!r}")
    return name


def check_contract(
    fields: Sequence[str],
    text_fields: Iterable[str] = (),
    types: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Check what a source declares and return its columns with their types."""
    if not isinstance(fields, (list, tuple)):
        raise ContractError("fields must be a list of column names")
    if isinstance(text_fields, str):
        raise ContractError("text_fields must be a collection of column names")
    for name in fields:
        if check_name(name) in RESERVED:
            raise ContractError(f"{name} is reserved")
    repeated = sorted({name for name in fields if list(fields).count(name) > 1})
    if repeated:
        raise ContractError(f"declared twice: {', '.join(repeated)}")
    texts = set(text_fields)
    if texts - set(fields):
        raise ContractError(f"text columns not declared: {sorted(texts - set(fields))}")
    declared = {name: "TEXT" if name in texts else "REAL" for name in fields}
    for name, kind in (types or {}).items():
        if name not in declared:
            raise ContractError(f"type given for an undeclared column: {name}")
        if kind not in METRIC_TYPES:
            raise ContractError(f"{name} has an unknown type: {kind!r}")
        if (kind == "TEXT") is not (name in texts):
            raise ContractError(f"{name} is {kind} but text_fields says otherwise")
        declared[name] = kind
    return declared


def check_range(since: int | None, until: int | None) -> None:
    """Ranges are half-open, so an empty or reversed one is a mistake."""
    if since is not None and until is not None and until <= since:
        raise ValueError("until must lie after since")


def check_selection(available: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    """Columns of an export in the chosen order."""
    wanted = list(available) if columns is None else list(columns)
    if not wanted:
        raise ValueError("no column selected")
    missing = sorted(set(wanted).difference(available))
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    if len(wanted) != len(set(wanted)):
        raise ValueError("a column is selected twice")
    if "labels_json" in wanted:
        raise ValueError("labels_json is added by the export itself")
    return wanted
