"""Exact per-key ranks and k-smallest thresholds without single-task groups.

``key_rank`` gives ``row_number() OVER (PARTITION BY keys ORDER BY order)``
but never routes a whole key to one task: rows are range-partitioned on
``(keys, order)`` so a key holding a third of the data is cut into many
ranges; each range numbers its rows locally, and a small summary
(one row per (range, key)) supplies the offsets.

``thresholds`` finds, per stratum, the k-th smallest value of a composite unsigned
key by radix histograms: each pass is one scan plus an aggregate of at most 65,536
buckets per stratum; usually two passes settle it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.session import scratch_path


def key_rank(df: DataFrame, keys: list[str], order: list[str], rank_col: str = "rank",
             num_partitions: int | None = None) -> DataFrame:
    """Append a 1-based ``rank_col`` = position of the row within ``keys`` by ``order``.

    ``order`` must be unique within a key (add a tie-breaker column if not). The
    range-partitioned rows are written once, with their range and place, to the
    shared folder; the summary and the join both read that table. A second range
    shuffle would draw its own boundaries and number other ranges.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *keys, *order)
                .sortWithinPartitions(*keys, *order)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()))
    path = scratch_path(spark, "ranges")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    summary = (ranged.groupBy("_pid", *keys)
                     .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt")))
    # At most one row per range for each key: this window is bounded by n.
    w = Window.partitionBy(*keys).orderBy("_pid")
    summary = summary.withColumn("_offset", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    # null keys are a group like any other
    summary = summary.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(["_pid", *keys])], "_first", "_offset")
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(["_pid", *keys])]
    out = ranged.join(summary, on=same).drop(*[f"_key{i}" for i in range(len(keys) + 1)])
    return (out.withColumn(rank_col, (F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
               .drop("_pid", "_pos", "_first", "_offset"))


# ---------------------------------------------------------------------------
# k smallest by radix histogram

DIGIT_BITS = 16
_MASK = (1 << DIGIT_BITS) - 1
_MIN_LONG = -(1 << 63)


def _digits(h: Column, tie: Column) -> list[Column]:
    """Six 16-bit digits of the composite key (h: 32-bit unsigned, tie: signed long)."""
    t = tie.bitwiseXOR(F.lit(_MIN_LONG))  # signed order -> unsigned order
    ds = [F.shiftright(h, 16).bitwiseAND(F.lit(_MASK)), h.bitwiseAND(F.lit(_MASK))]
    for shift in (48, 32, 16, 0):
        ds.append(F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(_MASK)))
    return ds


def thresholds(df: DataFrame, stratum: str, h: str, tie: str, need: dict) -> DataFrame:
    """(stratum, path): the digits such that exactly ``need[s]`` = (k, rows) rows of stratum s have digits
    <= the path (compared over the path's length); the empty path takes all rows, [-1] none.

    ``need`` holds the strata worth a threshold (``split`` passes at most 1000). Each pass counts the
    rows that share a stratum's path so far by their next digit (at most 65,536 buckets a stratum) and
    picks the bucket the k-th row is in; one row a stratum reaches the driver.
    """
    spark = df.sparkSession
    kind = df.schema[stratum].dataType.simpleString()
    digits = F.array(*_digits(F.col(h), F.col(tie)))
    paths = {s: [-1] if k <= 0 else [] for s, (k, rows) in need.items() if k <= 0 or k >= rows}
    state = {s: ([], k) for s, (k, rows) in need.items() if 0 < k < rows}
    narrow = df.select(F.col(stratum).alias("_s"), digits.alias("_digits"))
    for level in range(6):
        if not state:
            break
        at = spark.createDataFrame([(s, p, k) for s, (p, k) in state.items()],
                                   f"_s {kind}, _path array<bigint>, _k bigint")
        same = F.slice("_digits", 1, level) == F.col("_path") if level else F.lit(True)
        hist = (narrow.join(F.broadcast(at), "_s").where(same)
                .groupBy("_s", "_k", F.element_at("_digits", level + 1).alias("_d")).agg(F.count(F.lit(1)).alias("_n")))
        upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_d"))
        hit = (hist.withColumn("_upto", upto)
               .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))))
        for r in hit.collect():
            path = state.pop(r["_s"])[0] + [r["_d"]]
            if r["_upto"] == r["_k"] or level == 5:
                paths[r["_s"]] = path
            else:
                state[r["_s"]] = (path, r["_k"] - r["_upto"] + r["_n"])
    return spark.createDataFrame(list(paths.items()), f"_s {kind}, _path array<bigint>")


def within(h: str, tie: str, path: str) -> Column:
    """The row's digits are within ``path``."""
    digits = F.array(*_digits(F.col(h), F.col(tie)))
    return F.slice(digits, 1, F.size(path)) <= F.col(path)
