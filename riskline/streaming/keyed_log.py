"""Keyed tables that grow by change logs: what a micro-batch writes is what it changed.

A log is a folder of changes, one sub-folder a batch (``changes/batch_id=n``), and of
compacted bases (``base/v=n``: everything up to batch n). Rows of one key are merged
by aggregates that may be taken in any order and any grouping (a maximum by an order,
a sum), so reading is one ``groupBy(key)`` over the newest base and the changes after
it, and a late row needs no state that was kept for it.

A batch overwrites its own changes, so replaying it changes nothing. The log is
compacted once the changes outweigh the base: each row is then rewritten a bounded
number of times on average, whatever the number of keys. A base counts only once
Spark has marked it complete, and the files the newest base was made from stay until
the next one, so a batch that is replayed, or a reader that has just looked up the
newest base, finds what it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "_SUCCESS"


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def numbered(spark: SparkSession, path: str, prefix: str, complete: bool = False) -> list[int]:
    """Numbers of the sub-folders ``prefix<n>`` of a folder, ascending; ``complete``: only those Spark has finished."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(prefix):
            if not complete or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), DONE)):
                out.append(int(name[len(prefix):]))
    return sorted(out)


@dataclass(frozen=True)
class KeyedLog:
    """One log. ``merge`` maps column names of the rows to the aggregate that merges them, e.g. a sum."""

    spark: SparkSession
    path: str
    keys: list[str]
    merge: Callable[[], list[Column]]
    schema: str

    @property
    def _changes(self) -> str:
        return f"{self.path}/changes"

    def _base(self, v: int) -> str:
        return f"{self.path}/base/v={v}"

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        return rows.groupBy(*self.keys).agg(*self.merge())

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch's rows, merged by key, then compact if it is time."""
        self.merged(rows).write.mode("overwrite").parquet(f"{self._changes}/batch_id={batch_id}")
        if self._due(batch_id):
            self.compact(batch_id)

    def _parts(self, before: int) -> tuple[int | None, list[int]]:
        """Newest base and the changes after it, of batches < ``before``."""
        bases = [v for v in numbered(self.spark, f"{self.path}/base", "v=", complete=True) if v < before]
        base = bases[-1] if bases else None
        changes = numbered(self.spark, self._changes, "batch_id=")
        return base, [b for b in changes if b < before and (base is None or b > base)]

    def _paths(self, base: int | None, changes: list[int]) -> list[str]:
        return ([] if base is None else [self._base(base)]) + [f"{self._changes}/batch_id={b}" for b in changes]

    def rows(self, before: int = 1 << 62) -> DataFrame:
        """Unmerged rows written by batches < ``before``; none if there are none."""
        paths = self._paths(*self._parts(before))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # the paths are named one by one: a folder's name is no column here
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: int = 1 << 62) -> DataFrame:
        """The table as of the batches < ``before``."""
        return self.merged(self.rows(before))

    def _bytes(self, paths: list[str]) -> int:
        total = 0
        for path in paths:
            p, fs = file_system(self.spark, path)
            total += fs.getContentSummary(p).getLength()
        return total

    def _due(self, batch_id: int) -> bool:
        base, changes = self._parts(batch_id + 1)
        if len(changes) < 2:
            return False
        return self._bytes(self._paths(None, changes)) >= self._bytes(self._paths(base, []))

    def compact(self, batch_id: int) -> None:
        """Write the base of all batches <= ``batch_id``; remove what only the base before the last was made from."""
        last, _ = self._parts(batch_id)
        self.read(batch_id + 1).write.mode("overwrite").parquet(self._base(batch_id))
        if last is None:
            return
        for path in [f"{self._changes}/batch_id={b}" for b in numbered(self.spark, self._changes, "batch_id=") if b <= last] + \
                    [self._base(v) for v in numbered(self.spark, f"{self.path}/base", "v=") if v < last]:
            p, fs = file_system(self.spark, path)
            fs.delete(p, True)


def latest_log(spark: SparkSession, path: str, key: str, order: str, fields: list[tuple[str, str]]) -> KeyedLog:
    """Per key the row with the greatest ``order``; ``fields`` are the (name, type) of key, order and further columns."""
    names = [n for n, _ in fields if n != key]

    def merge():
        row = F.max_by(F.struct(*names), order)
        return [row.getField(n).alias(n) for n in names]
    return KeyedLog(spark, path, [key], merge, ", ".join(f"`{n}` {t}" for n, t in fields))
