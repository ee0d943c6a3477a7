"""Reading, extending, copying and upgrading the dataset tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.faults import truncated
from fleetlens.operators.events import new_only
from fleetlens.operators.labels import as_commands, fold_commands
from fleetlens.operators.ordered import numbered
from fleetlens.operators.quality import conform
from fleetlens.plans.commits import CommitLog
from fleetlens.plans.keys import KeyIndex
from fleetlens.schema import DAY, DAY_MS
from fleetlens.session import settle

TABLES = ("samples", "boots", "events", "labels")
HOUR_MS = 3_600_000


def _path(spark: SparkSession, name: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at the path; names starting with an underscore are no part of it."""
    fs, p = _path(spark, path)
    return fs.exists(p) and any(not s.getPath().getName().startswith("_") for s in fs.listStatus(p))


def read_dataset(spark: SparkSession, root: str, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The dataset's tables. Files are listed once, so all sections of a job that
    share these DataFrames see the same data; a missing table is an error."""
    return {
        name: spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}") for name in tables
    }


def require_identity(rows: DataFrame) -> DataFrame:
    """Fail the job that meets a sample without ts or boot_id."""
    missing = {"ts", "boot_id"} - set(rows.columns)
    if missing:
        raise ValueError(f"samples need {sorted(missing)}")
    whole = F.col("ts").isNotNull() & F.col("boot_id").isNotNull()
    refusal = F.raise_error(F.lit("a sample without ts or boot_id")).cast("bigint")
    return rows.withColumn("ts", F.when(whole, F.col("ts")).otherwise(refusal))


def with_ids(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Number a batch by arrival, with the next range of ids of the table's log.

    Arrival is the order of rows in the batch's partitions. The batch is settled, so that
    counting and numbering see the same order; positions are counted per partition. The
    stored ids are read once, for a table that has no log yet.
    """
    spark = rows.sparkSession
    arrived = settle(rows.withColumn("__arrival", F.monotonically_increasing_id()), "arrived")
    log, start = CommitLog(spark, path, column), 0
    if log.last() is None and has_rows(spark, path):
        start = spark.read.parquet(path).agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    first = log.reserve(arrived.count(), start).first
    placed = numbered(arrived, [], ["__arrival"], into=column, width=1 << 33).drop("__arrival")
    return placed.select((F.col(column) + (first - 1)).alias(column), *rows.columns)


STAGED = "_staged"


def add_files(spark: SparkSession, writer: DataFrameWriter, path: str) -> None:
    """Write a batch below a hidden folder of its own and move its files into the table.

    Jobs that append to one folder share the committer's job folder, and the first to end takes
    it away from the others. A batch whose job fails has moved nothing.
    """
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}"
    fs, source = _path(spark, staged)
    try:
        writer.parquet(staged)
        base, names = fs.resolvePath(source).toString(), []
        found = fs.listFiles(source, True)
        while found.hasNext():
            names.append(found.next().getPath().toString()[len(base) + 1 :])
        for name in names:
            if name.startswith(("_", ".")):
                continue
            moved, target = (_path(spark, f"{root}/{name}")[1] for root in (staged, path))
            fs.mkdirs(target.getParent())
            if not fs.rename(moved, target):
                raise OSError(f"{name} was not moved to {path}")
    finally:
        fs.delete(source, True)


def append_samples(
    rows: DataFrame, path: str, schema: T.StructType | None = None, *, by_day: bool = False
) -> list[str]:
    """Append a batch as a whole and return the names of dropped columns.

    Rows get a `sample_id` in order of arrival, which ts cannot give as it repeats and
    goes back; rows that bring one as a declared column keep it. Several writers may append
    at once: each takes a range of ids first. A table is written `by_day` from its first
    batch on or never.

    One row without ts or boot_id fails the write job, which then leaves nothing of the
    batch. Columns a row lacks are NULL.
    """
    kept, dropped = conform(rows, schema) if schema is not None else (rows, [])
    checked = require_identity(kept)
    if "sample_id" not in checked.columns:
        checked = with_ids(checked, "sample_id", path)
    if by_day:
        day = F.floor(F.col("ts") / DAY_MS).cast("bigint")
        add_files(checked.sparkSession, checked.withColumn(DAY, day).write.partitionBy(DAY), path)
    else:
        add_files(checked.sparkSession, checked.write, path)
    return dropped


def stack_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of different sources under the union of their columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def append_events(events: DataFrame, path: str, order: Sequence[str] = ("ts",)) -> None:
    """Append events whose key is not stored yet, with an id; long messages are cut.

    Stored keys are looked up in the index beside the table (`<path>_keys`), which is built
    once where it is missing. Keys are indexed before the rows are stored, and an append that
    broke off in between is settled by the next one. Ids are safe with several writers;
    that no two of them store the same key is up to one writer at a time.
    """
    spark = events.sparkSession
    index, there = KeyIndex(spark, f"{path}_keys"), has_rows(spark, path)
    if there:
        table = spark.read.parquet(path)
        if index.exists():
            index.recover(table, "dedup")
        else:
            index.add(table.select("dedup"), "before")
    if "message" in events.columns:
        events = events.withColumn("message", truncated(F.col("message")))
    events = settle(events, "events")
    known = index.known(events.select("dedup")).select(F.col("key").alias("dedup")) if there else None
    fresh = settle(new_only(events, known, order), "new-events")
    begun = index.begin(fresh.select("dedup"))
    placed = fresh if "id" in fresh.columns else with_ids(fresh, "id", path)
    add_files(spark, placed.write, path)
    index.commit(begun)


def write_labels(commands: DataFrame, target: str, stored: str | None = None) -> None:
    """Fold the command log and write the resulting windows to a new table.

    With `stored`, the path of an earlier result, the commands go on from its windows:
    open ones may be closed, and ids continue to mean the same windows.
    """
    if stored is not None:
        windows = commands.sparkSession.read.parquet(stored)
        commands = as_commands(windows).unionByName(commands, allowMissingColumns=True)
    fold_commands(commands).write.mode("errorifexists").parquet(target)


def fingerprint(table: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of all values."""
    return table.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        .alias("checksum"),
    )


def verified_copy(
    spark: SparkSession, source: str, target: str, tables: Sequence[str] = TABLES
) -> DataFrame:
    """Copy a dataset, check every table and return the fingerprints.

    An existing target is refused. Whoever creates the marker file below the target
    makes the copy; a second copy to the same place fails without touching it. A copy
    that fails or differs is removed again, so what stands at the target without a
    marker is complete. Days stay partitions.
    """
    fs, path = _path(spark, target)
    if fs.exists(path):
        raise FileExistsError(target)
    _, marker = _path(spark, f"{target}/_copying")
    try:
        fs.create(marker, False).close()
    except Exception as error:  # another copy was faster
        raise FileExistsError(target) from error
    try:
        found = read_dataset(spark, source, tables)
        prints = None
        for name, table in found.items():
            writer = table.write.mode("errorifexists")
            writer = writer.partitionBy(DAY) if DAY in table.columns else writer
            writer.parquet(f"{target}/{name}")
            copy = spark.read.schema(table.schema).parquet(f"{target}/{name}").select(*table.columns)
            for side in (table, copy):
                line = fingerprint(side).select(F.lit(name).alias("table"), "rows", "checksum")
                prints = line if prints is None else prints.unionByName(line)
        distinct = {tuple(line) for line in prints.collect()}
        if len(distinct) != len(found):
            raise RuntimeError(f"the copy differs: {sorted(distinct)}")
        fs.delete(marker, False)
    except BaseException:
        fs.delete(path, True)
        raise
    return spark.createDataFrame(
        [(name, rows) for name, rows, _ in sorted(distinct)], "table string, rows bigint"
    )


def upgrade_samples(samples: DataFrame, *, width: int = HOUR_MS) -> DataFrame:
    """Old layouts keyed samples by ts; they get a sample_id in ts order.

    Numbering goes by hours: counts per hour first, then positions inside one.
    """
    if "sample_id" in samples.columns:
        return samples
    rest = [c for c in samples.columns]
    return numbered(samples, [], ["ts"], into="sample_id", width=width).select("sample_id", *rest)


def upgrade_events(events: DataFrame) -> DataFrame:
    """Old event tables have no key; it reads as NULL."""
    if "dedup" in events.columns:
        return events
    return events.withColumn("dedup", F.lit(None).cast("string"))
