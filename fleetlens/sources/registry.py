"""Metric sources as plug-ins: a name, declared columns and a transform.

A transform takes the landed rows and returns one row per tick with the declared
columns. It may come with a second transform that returns event rows. A source that
cannot be planned leaves its columns NULL and is named in `failed`; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.context import assemble_ticks
from fleetlens.operators.derive import mask_failed, reader_failures
from fleetlens.operators.quality import sanitize
from fleetlens.schema import ContractError, check_contract

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MetricSource:
    name: str
    fields: Sequence[str]
    transform: Transform
    text_fields: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    events: Transform | None = None


class SourceRegistry:
    """Sources of one job. A column belongs to the first source that declares it."""

    def __init__(self) -> None:
        self.sources: dict[str, MetricSource] = {}
        self.columns: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.failed: dict[str, str] = {}

    def register(self, source: MetricSource) -> None:
        """Refuse the whole source when its contract or any of its columns fails."""
        declared = check_contract(source.fields, source.text_fields, source.types)
        if source.name in self.sources:
            raise ContractError(f"source {source.name} is registered already")
        for column in declared:
            if column in self.columns:
                raise ContractError(f"{column} belongs to {self.columns[column]}")
        self.sources[source.name] = source
        self.columns.update(dict.fromkeys(declared, source.name))
        self.types.update(declared)

    def rows(self, name: str, raw: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """Clean rows of one source and the undeclared columns that were dropped."""
        source = self.sources[name]
        made = source.transform(raw)
        undeclared = sorted(set(made.columns) - set(source.fields) - set(keys))
        present = [c for c in source.fields if c in made.columns]
        clean = sanitize(made.select(*keys, *present), {c: self.types[c] for c in present})
        for column in source.fields:
            if column not in present:
                kind = {"REAL": "double", "INTEGER": "bigint", "TEXT": "string"}[self.types[column]]
                clean = clean.withColumn(column, F.lit(None).cast(kind))
        return clean, undeclared

    def _isolated(self, name: str, raw: DataFrame, keys: Sequence[str]) -> DataFrame | None:
        try:
            return self.rows(name, raw, keys)[0]
        except Exception as error:  # one source's mistake is not the job's
            self.failed[name] = str(error).splitlines()[0]
            return None

    def _empty(self, name: str, raw: DataFrame, keys: Sequence[str]) -> DataFrame:
        kinds = {"REAL": "double", "INTEGER": "bigint", "TEXT": "string"}
        columns = [F.lit(None).cast(kinds[self.types[c]]).alias(c) for c in self.sources[name].fields]
        return raw.limit(0).select(*keys, *columns)

    def assemble(
        self,
        raw: DataFrame,
        spine: DataFrame,
        keys: Sequence[str] = ("boot_id", "tick"),
        polls: DataFrame | None = None,
    ) -> DataFrame:
        """One wide row per tick of the spine from all sources.

        `polls` (boot_id, tick, source, ok) tells which readings worked: a source that
        failed too often in a row is off for the rest of its boot.
        """
        failures = None if polls is None else reader_failures(polls)
        parts = []
        for name, source in self.sources.items():
            rows = self._isolated(name, raw, keys)
            if rows is None:
                rows = self._empty(name, raw, keys)
            elif failures is not None:
                own = failures.where(F.col("source") == name).drop("source")
                rows = mask_failed(rows, own, ["boot_id"], source.fields)
            parts.append(rows)
        return assemble_ticks(spine, parts, keys)

    def events(self, raw: DataFrame) -> DataFrame | None:
        """Events of all sources that emit some; every row names its source."""
        emitted = [
            s.events(raw).withColumn("source", F.lit(s.name))
            for s in self.sources.values() if s.events is not None
        ]
        if not emitted:
            return None
        out = emitted[0]
        for more in emitted[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out
