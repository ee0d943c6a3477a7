"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str, cores: int = 8, **extra: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    Executors on other machines must see what is written here, so a
    machine-local folder is used only by a local master with nothing set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/fleetlens/{purpose}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what `settle` writes inside, as a trigger of a stream should."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _scopes.paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        _scopes.paths = outer


def settle(df: DataFrame, purpose: str, **options: str | int) -> DataFrame:
    """Compute a result once, as a table in the shared scratch folder.

    For results that several later steps read: an inventory, window segments,
    the classified faults of a log. The table outlives lost executors, and its
    file size tells the planner whether it may be broadcast. `options` are those
    of the parquet writer.
    """
    path = scratch_dir(df.sparkSession, purpose)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few large files to all cores.

    Tables of many files already have more partitions than that and stay as
    they are, so this adds no shuffle to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
