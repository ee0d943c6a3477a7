"""Versions of a dataset: which files of all its tables belong together.

A version is published between appends and names the files of every table, the tables'
schemas, and per file the bounds of boot_id and ts. A reader resolves a version once, so all
sections of a report see the same state beside a running append; no footer is read for the
schema, and a boot or time filter leaves out whole files before any of them is opened.

Only files that the version before did not name are looked into. A table whose append is under
way is waited for. Versions are numbered by creating the next entry exclusively, as `commits` does.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.plans.commits import PATIENCE
from fleetlens.plans.dataset import STAGED, TABLES, _path, exists
from fleetlens.plans.export import in_range

FILES = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("boot_low", T.StringType()),
    T.StructField("boot_high", T.StringType()),
    T.StructField("ts_low", T.LongType()),
    T.StructField("ts_high", T.LongType()),
])


def _listed(spark: SparkSession, path: str) -> set[str]:
    """Names of a table's files; Spark lists them and opens none."""
    if not exists(spark, path):
        return set()
    names = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.parquet").inputFiles()
    return {f"{urlparse(n).scheme}:{unquote(n.partition(':')[2])}" for n in names}


def _busy(spark: SparkSession, path: str) -> bool:
    """Whether a job writes to the table or an append still moves its files."""
    fs, staged = _path(spark, f"{path}/{STAGED}")
    return exists(spark, f"{path}/_temporary") or (fs.exists(staged) and len(fs.listStatus(staged)) > 0)


def _settled(spark: SparkSession, path: str, patience: float) -> set[str]:
    """A table's files while no job writes there: two equal listings and no job folder between.

    A commit moves its files one by one, and the folder of the job goes last.
    """
    end = time.monotonic() + patience
    while True:
        found = _listed(spark, path)
        if not _busy(spark, path) and _listed(spark, path) == found:
            return found
        if time.monotonic() > end:
            raise RuntimeError(f"an append to {path} is under way")
        time.sleep(0.2)


def _bounds(table: DataFrame, name: str) -> DataFrame:
    """One row per file with its rows and the bounds of boot_id and ts, NULL where it has none."""
    def bound(pick, column: str, kind: str) -> Column:
        return pick(column) if column in table.columns else F.lit(None).cast(kind)

    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"),
        bound(F.min, "boot_id", "string").alias("boot_low"),
        bound(F.max, "boot_id", "string").alias("boot_high"),
        bound(F.min, "ts", "bigint").alias("ts_low"),
        bound(F.max, "ts", "bigint").alias("ts_high"),
    ).select(F.lit(name).alias("table"), F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("file"),
             *FILES.names[2:])


class Versions:
    """The versions of the dataset below `root`; they name files by their full path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = f"{self.root}/_versions"

    def latest(self) -> int | None:
        fs, path = _path(self.spark, self.log)
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _entry(self, number: int) -> dict:
        """The entry's text; waits for a writer that has just created it."""
        fs, path = _path(self.spark, f"{self.log}/{number:012d}")
        end = time.monotonic() + PATIENCE
        while True:
            stream = fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            if time.monotonic() > end:
                raise RuntimeError(f"version {number} of {self.root} was never filled")
            time.sleep(0.05)

    def files(self, number: int) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(self._entry(number)["files"])

    def _table(self, name: str, files: Sequence[str], schema: T.StructType | None) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
        return reader.parquet(*files)

    def publish(self, tables: Sequence[str] = TABLES, patience: float = PATIENCE) -> int:
        """Make what the tables hold now a version and return its number.

        A table that does not exist yet is no part of it. Two publishers at once get a
        version each. Files that are gone since the version before are not named again.
        """
        while True:
            before = self.latest()
            old = self._entry(before) if before is not None else {"schemas": {}}
            known = self.files(before) if before is not None else self.spark.createDataFrame([], FILES)
            named: dict[str, set[str]] = {}
            for line in known.select("table", "file").toLocalIterator():
                named.setdefault(line["table"], set()).add(line["file"])
            schemas, parts, gone = {}, [], []
            for name in tables:
                found = _settled(self.spark, f"{self.root}/{name}", patience)
                fresh = sorted(found - named.get(name, set()))
                gone += [(name, file) for file in sorted(named.get(name, set()) - found)]
                schema = T.StructType.fromJson(old["schemas"][name]) if name in old["schemas"] else None
                if fresh:
                    table = self._table(name, fresh, None)
                    parts.append(_bounds(table, name))
                    if schema is not None:
                        empty = self.spark.createDataFrame([], schema)
                        table = empty.unionByName(table, allowMissingColumns=True)
                    schema = table.schema
                if schema is not None:
                    schemas[name] = schema.jsonValue()
            kept = known.where(F.col("table").isin(*schemas))
            if gone:
                lost = self.spark.createDataFrame(gone, "table string, file string")
                kept = kept.join(lost, ["table", "file"], "left_anti")
            for part in parts:
                kept = kept.unionByName(part)
            target = f"{self.log}/files-{uuid.uuid4().hex}"
            kept.select(*FILES.names).write.parquet(target)
            number = 0 if before is None else before + 1
            if self._create(number, {"files": target, "schemas": schemas}):
                return number

    def _create(self, number: int, entry: dict) -> bool:
        fs, path = _path(self.spark, f"{self.log}/{number:012d}")
        try:
            stream = fs.create(path, False)
        except Exception:
            if not fs.exists(path):
                raise
            return False  # another publisher was faster
        try:
            stream.write(bytearray((json.dumps(entry) + "\n").encode()))
        finally:
            stream.close()
        return True

    def _resolved(self, number: int | None) -> int:
        number = self.latest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return number

    def read(self, number: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version, the latest by default."""
        number = self._resolved(number)
        schemas, files = self._entry(number)["schemas"], {}
        for line in self.files(number).select("table", "file").toLocalIterator():
            files.setdefault(line["table"], []).append(line["file"])
        return {
            name: self._table(name, files.get(name, []), T.StructType.fromJson(schema))
            for name, schema in schemas.items()
        }

    def opened(
        self, name: str, number: int | None = None, *,
        boot_id: str | None = None, since: int | None = None, until: int | None = None,
    ) -> DataFrame:
        """Files of a table that can hold rows of the boot and range; unknown bounds can hold any."""
        files = self.files(self._resolved(number)).where(F.col("table") == name)
        for wanted, condition in (
            (boot_id, F.lit(boot_id).between(F.col("boot_low"), F.col("boot_high"))),
            (since, F.col("ts_high") >= F.lit(since)),
            (until, F.col("ts_low") < F.lit(until)),
        ):
            if wanted is not None:
                files = files.where(F.coalesce(condition, F.lit(True)))
        return files

    def read_table(
        self, name: str, number: int | None = None, *,
        boot_id: str | None = None, since: int | None = None, until: int | None = None,
    ) -> DataFrame:
        """Rows of one boot and a half-open range, from the files that can hold them."""
        number = self._resolved(number)
        schema = T.StructType.fromJson(self._entry(number)["schemas"][name])
        files = self.opened(name, number, boot_id=boot_id, since=since, until=until)
        rows = self._table(name, [line["file"] for line in files.select("file").toLocalIterator()], schema)
        rows = in_range(rows, since, until)
        return rows if boot_id is None else rows.where(F.col("boot_id") == boot_id)


def write_clustered(
    rows: DataFrame, path: str, keys: Sequence[str] = ("boot_id", "sample_id"), partitions: int | None = None
) -> None:
    """Write a table as files that each cover a range of the keys, sorted inside.

    With a boot's rows in few files, their bounds leave out all others. A boot of any size is cut
    at its sample ids, so none sits in one task. The ranges are found on a sample, which reads the
    input twice: settle a dear one before.
    """
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)
