"""Which of a batch's keys are stored already, without reading the keys of the past.

An index keeps the keys of every stored batch in a folder of their own, dealt to `BUCKETS` by
hash, and beside it one Bloom filter per bucket, in slices of bounded size. A look-up passes
the new keys' hashes through the filters, and reads key files only of the buckets of batches
where a filter says "perhaps"; an exact join decides there. A filter never misses a key, and
says "perhaps" to a new one in one of 100,000 cases, so the keys that are read do not grow with
the table: filters cost three bytes a key, key files are opened for keys that are there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import settle

BUCKETS = 64
#: Keys of a slice of a filter, and hashes that are looked up together.
SLICE = 1 << 20
BITS, HASHES = 24, 16
#: So many (batch, bucket) folders are opened one by one; beyond, all key files are read.
FOLDERS = 10_000

_FILTERS = "bucket int, slice int, slices int, bits binary"
_PENDING = "pending-"


def _positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """(hashes, HASHES) bit positions, each mixed by itself so that small filters are as sharp as large ones."""
    x = hashes.view(np.uint64)[:, None] + np.arange(1, HASHES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def _filter(hashes: np.ndarray) -> np.ndarray:
    size = max(1024, BITS * len(hashes))
    marks = np.zeros(size, bool)
    for start in range(0, len(hashes), 1 << 16):
        marks[_positions(hashes[start : start + (1 << 16)], size).ravel()] = True
    return np.r_[np.frombuffer(np.uint64(size).tobytes(), np.uint8), np.packbits(marks)]


def _passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    size = int(np.frombuffer(bits, np.uint64, 1)[0])
    packed = np.frombuffer(bits, np.uint8, offset=8)
    out = np.zeros(len(hashes), bool)
    for start in range(0, len(hashes), 1 << 16):
        out[start : start + (1 << 16)] = _found(packed, _positions(hashes[start : start + (1 << 16)], size))
    return out


def _found(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def _hashed(keys: DataFrame) -> DataFrame:
    """(key, hash, bucket) of the different keys that are not NULL."""
    named = keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
    return named.withColumn("hash", F.xxhash64("key")).withColumn(
        "bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int")
    )


def _slice(slices) -> F.Column:
    return F.pmod(F.shiftright("hash", 6), slices).cast("int")


class KeyIndex:
    """The keys of a table, batch by batch. A batch's name is a folder name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        #: Folders of key files that the last look-up opened.
        self.opened: list[str] = []

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs("filters")
        return fs.exists(path)

    def batches(self) -> list[str]:
        fs, path = self._fs("filters")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def add(self, keys: DataFrame, batch: str) -> None:
        """Store the keys (first column) of a batch; the same name again replaces them."""
        hashed = settle(_hashed(keys), "keys")
        n = hashed.count()
        slices = max(1, -(-n // (BUCKETS * SLICE)))
        hashed.select("key", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/keys/batch={batch}"
        )

        def build(table: pa.Table) -> pa.Table:
            hashes = table.column("hash").to_numpy()
            return pa.table({
                "bucket": table.column("bucket").slice(0, 1), "slice": table.column("slice").slice(0, 1),
                "slices": pa.array([slices], pa.int32()), "bits": pa.array([_filter(hashes).tobytes()], pa.binary()),
            })

        sliced = hashed.select("bucket", "hash", _slice(F.lit(slices)).alias("slice"))
        # the filter comes last: a batch without one has not been added
        sliced.groupBy("bucket", "slice").applyInArrow(build, _FILTERS).write.mode("overwrite").parquet(
            f"{self.path}/filters/batch={batch}"
        )

    def known(self, keys: DataFrame, batches: list[str] | None = None) -> DataFrame:
        """(key) of those keys that are stored, in the given batches or in all."""
        names = self.batches() if batches is None else batches
        none = self.spark.createDataFrame([], "key string")
        self.opened = []
        if not names:
            return none
        hashed = settle(_hashed(keys), "keys")
        parts = max(1, -(-hashed.count() // (BUCKETS * SLICE)))
        packed = hashed.groupBy("bucket", _slice(F.lit(parts)).alias("part")).agg(
            F.collect_list("hash").alias("hashes")  # about SLICE at most
        )
        filters = self.spark.read.schema(f"{_FILTERS}, batch string").option("basePath", f"{self.path}/filters").parquet(
            *[f"{self.path}/filters/batch={name}" for name in names]
        )

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in batches:
                for row in range(found.num_rows):
                    get = lambda name: found.column(name)[row].as_py()
                    hashes = found.column("hashes")[row].values.to_numpy()
                    own = (hashes >> 6) % get("slices") == get("slice")
                    if own.any() and _passes(get("bits"), hashes[own]).any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([get("batch")]), pa.array([get("bucket")], pa.int32())], names=["batch", "bucket"]
                        )

        hits = filters.join(packed, "bucket").select("batch", "bucket", "slice", "slices", "bits", "hashes").mapInArrow(
            check, "batch string, bucket int"
        ).distinct()
        folders = [f"{self.path}/keys/batch={b}/bucket={k}" for b, k in hits.limit(FOLDERS + 1).collect()]
        if not folders:
            return none
        if len(folders) > FOLDERS:
            folders = [f"{self.path}/keys/batch={name}" for name in names]
        self.opened = sorted(folders)
        stored = self.spark.read.schema("key string").parquet(*folders)
        return hashed.select("key").join(stored, "key", "left_semi")

    # ---- batches beside a table that is written at the same time ----

    def begin(self, keys: DataFrame) -> str:
        """Add a batch whose rows are about to be stored; `commit` it afterwards."""
        name = f"{_PENDING}{uuid.uuid4().hex}"
        self.add(keys, name)
        return name

    def commit(self, name: str) -> None:
        for part in ("keys", "filters"):
            fs, old = self._fs(f"{part}/batch={name}")
            _, new = self._fs(f"{part}/batch={name.removeprefix(_PENDING)}")
            fs.rename(old, new)

    def recover(self, table: DataFrame, column: str) -> None:
        """Settle batches that were begun and not committed: their rows are in the table or are not."""
        fs, root = self._fs("keys")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        for name in (n.removeprefix("batch=") for n in names):
            if not name.startswith(_PENDING):
                continue
            keys = self.spark.read.schema("key string").parquet(f"{self.path}/keys/batch={name}")
            # a write is stored as a whole or not at all
            if table.select(F.col(column).alias("key")).join(keys, "key", "left_semi").isEmpty():
                for part in ("filters", "keys"):
                    fs.delete(self._fs(f"{part}/batch={name}")[1], True)
            else:
                self.add(keys, name.removeprefix(_PENDING))
                for part in ("filters", "keys"):
                    fs.delete(self._fs(f"{part}/batch={name}")[1], True)
