"""Appends of several writers to one table: a log of reserved id ranges.

A writer that knows how many rows it has takes the next number of the log by creating that
file, which succeeds for one writer only, and writes there the range of ids it takes. So ids
of concurrent appends never meet, a commit's ids have no gaps, and the largest id is in the
log's last file instead of in the table. A writer that fails leaves its range unused and no
rows: the rows come into view by the table format's own commit.

Where a store cannot create a file exclusively, one writer at a time has to be ensured outside.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: How long a writer may take between creating a file of the log and filling it.
PATIENCE = 10.0


@dataclass(frozen=True)
class Range:
    """Ids `first` to `first + rows - 1`, taken by entry `number`."""

    number: int
    first: int
    rows: int

    @property
    def last(self) -> int:
        return self.first + self.rows - 1


class CommitLog:
    """The log below a table; names starting with an underscore are no data."""

    def __init__(self, spark: SparkSession, table: str, column: str):
        self.spark, self.root = spark, f"{table}/_ids/{column}"

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, number: int) -> Range | None:
        fs, path = self._fs(f"{number:012d}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Range(number, **json.loads(text)) if text.endswith("}") else None

    def last(self) -> Range | None:
        """The latest entry; waits for a writer that has just created it."""
        fs, root = self._fs()
        if not fs.exists(root):
            return None
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()]
        if not numbers:
            return None
        end = time.monotonic() + PATIENCE
        while (found := self._read(max(numbers))) is None:
            if time.monotonic() > end:
                raise RuntimeError(f"entry {max(numbers)} of {self.root} was never filled")
            time.sleep(0.05)
        return found

    def reserve(self, rows: int, start: int = 0) -> Range:
        """Take the next `rows` ids; `start` is the largest id of a table that has no log yet."""
        while True:
            before = self.last()
            number, first = (before.number + 1, before.last + 1) if before else (0, start + 1)
            fs, path = self._fs(f"{number:012d}")
            try:
                stream = fs.create(path, False)
            except Exception:
                if not fs.exists(path):
                    raise
                continue  # another writer was faster
            try:
                stream.write(bytearray(json.dumps({"first": first, "rows": rows}).encode()))
            finally:
                stream.close()
            return Range(number, first, rows)
