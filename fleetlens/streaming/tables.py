"""Result tables of streaming jobs, one folder per run and micro-batch.

A run is one checkpoint: its id is the query id that Spark keeps there. A batch
overwrites its own folder only, so a batch that runs again after a failure leaves
the same result, and neither a new checkpoint nor a second stream into the same
table can touch what another run stored. What a batch may look at is everything
but itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.plans.dataset import exists


@dataclass(frozen=True)
class Batch:
    run: str
    number: int


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query of this checkpoint before its first batch."""
    lines = spark.read.text(f"{checkpoint}/metadata").collect()
    return json.loads("".join(r[0] for r in lines))["id"]


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self, batch: Batch) -> str:
        return f"{self.path}/run={batch.run}/batch_id={batch.number}"

    def write(self, rows: DataFrame, batch: Batch) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(batch))

    def read(self, but: Batch | None = None, between: tuple | None = None) -> DataFrame:
        """All rows, or those that other batches stored.

        `between` is (column, low, high), both included: a bound that reaches the scan,
        so that files and row groups of other times are skipped by their statistics.
        """
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([
            *self.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())
        ])
        rows = self.spark.read.schema(full).parquet(self.path)
        if but is not None:
            # a repeated batch must not see itself, nor what the failed attempt left after it
            rows = rows.where((F.col("run") != but.run) | (F.col("batch_id") < but.number))
        if between is not None:
            column, low, high = between
            rows = rows.where(F.col(column).between(low, high))
        return rows.drop("run", "batch_id")

    def read_runs(self, but: str) -> DataFrame:
        """What other runs have stored; the runs are folders, so only theirs are read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema.fields, T.StructField("run", T.StringType())])
        return self.spark.read.schema(full).parquet(self.path).where(F.col("run") != but).drop("run")

    def read_batch(self, batch: Batch) -> DataFrame:
        path = self._folder(batch)
        if batch.number < 0 or not exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)
