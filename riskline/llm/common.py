"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.session import scratch_path
from riskline.sources.tables import table

__all__ = ["documents", "table", "materialize", "scratch_path", "remainder", "WORD_BYTES"]

#: The six ASCII white-space bytes that separate words in the contracts.
WORD_BYTES = " \t\n\x0b\x0c\r"

#: Spark setting: remove a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text, *extra) with a null text read as empty; other columns are left out."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"),
                     *[F.col(c) for c in extra])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Later stages then start from files every executor can read: losing an
    executor costs no recomputation of what came before. The shuffle files of the
    write are not needed after it and are removed at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def row_key(df: DataFrame) -> Column:
    """A row's name: equal for rows of equal id and text."""
    return F.xxhash64(df["doc_id"], F.coalesce(df["text"], F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``row_key`` is in ``keys`` (one column); all its columns stay."""
    name = unused(df, "row_key")
    bad = keys.toDF(name).distinct()
    return df.join(bad, row_key(df) == bad[name], "left_anti")


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def count_cut(counts: DataFrame, most: int, col: str = "n") -> int:
    """Smallest count c such that at most ``most`` rows of ``counts`` have ``col`` >= c.

    Only a histogram of the counts reaches the driver: one row per count below 1024
    and per 1/64 power of two above it, whatever the size of the table.
    """
    bin_ = F.when(F.col(col) < 1024, F.col(col)).otherwise(
        F.ceil(F.pow(F.lit(2.0), F.floor(F.log2(col) * 64) / 64))).cast("long")
    rows = sorted(((r.b, r["count"]) for r in counts.groupBy(bin_.alias("b")).count().collect()), reverse=True)
    cut, held = (rows[0][0] + 1 if rows else 1), 0
    if rows and rows[0][0] >= 1024:
        cut = 1 << 62
    for b, k in rows:
        if held + k > most:
            break
        held, cut = held + k, b
    return int(cut)


class Counter64(dict):
    """word -> row number in order of first sight."""

    def __missing__(self, word):
        self[word] = k = len(self)
        return k


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(concatenated pieces of ``flat`` for ``rows``, their lengths)."""
    size = lengths[rows]
    ends = np.cumsum(size)
    at = np.repeat(starts[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], size


def extended(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``a`` with ``more`` behind its first ``used`` items; its room doubles, so that items are seldom moved."""
    if used + len(more) > len(a):
        a = np.concatenate([a[:used], np.empty(max(used, len(more)), a.dtype)])
    a[used:used + len(more)] = more
    return a


def give_back() -> None:
    """Hand memory that numpy and Arrow have freed back to the system: else it stays with the driver for the session."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc keeps freed memory and has this call
    if trim:
        trim(0)
