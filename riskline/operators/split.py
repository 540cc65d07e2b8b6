"""Deterministic exact 80/20 splits (J4 random, J5 stratified).

Each row gets h = first 8 hex digits of md5('<seed>:' || id) as an unsigned
32-bit number. The test set is the ceil(0.2 * n) rows with the smallest
(h, id) — per label when stratified, with the test size allocated to labels by
largest remainder (ties -> lower label).

Labels may be many. At most 1000 (all, or of more those with a thousandth of the
rows) get a threshold from radix histograms (``ranking.thresholds``), a table of one path a
label, so assigning their rows is a projection: no global sort, no window over a
large label. The rows of the others are ranked within their label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.operators.ranking import key_rank, thresholds, within
from riskline.session import scratch_path

TEST_FRACTION = 0.2
SEED = 42
TEST = "test"
TRAIN = "train"
#: Strata that may have a threshold each; of more strata, those with this fraction of all rows have one.
MANY = 1000
_NO_LABEL = "rows without {} cannot be stratified; drop or fill them first"


def hash_key(id_col, seed: int = SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 8), 16, 10).cast("bigint")


def test_size(n: int, frac: float = TEST_FRACTION) -> int:
    """Test rows for n rows: ceil(frac * n) evaluated in floating point, as the library does."""
    return int(math.ceil(frac * n))


def allocate(counts: dict, k: int) -> dict:
    """Largest-remainder allocation of k test rows over strata sizes ``counts``."""
    n = sum(counts.values())
    if n == 0:
        return {s: 0 for s in counts}
    base = {s: (k * c) // n for s, c in counts.items()}
    rem = {s: (k * c) % n for s, c in counts.items()}
    extra = k - sum(base.values())
    order = sorted(counts, key=lambda s: (-rem[s], s))
    for s in order[:extra]:
        base[s] += 1
    return base


def split(df: DataFrame, id_col: str, label_col: str | None = None, frac: float = TEST_FRACTION,
          seed: int = SEED, split_col: str = "split") -> DataFrame:
    """Add ``split_col`` in {'train','test'}; stratified when ``label_col`` is given.

    ``id_col`` must be a stable, unique bigint row id (doc_id, or a hash of the
    row content); ``monotonically_increasing_id`` is not stable and must not be
    used. Uniqueness makes (h, id) a total order, so the boundary row is exact.
    """
    base = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_s", F.col(label_col) if label_col else F.lit(0))
    sizes = base.groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    known, quota = sizes.limit(MANY + 1).collect(), None
    if len(known) <= MANY:
        counts = {r["_s"]: r["n"] for r in known}
        if None in counts:
            raise ValueError(_NO_LABEL.format(label_col))
        k = test_size(sum(counts.values()), frac)
        need = {s: (q, counts[s]) for s, q in (allocate(counts, k) if label_col else {0: k} if counts else {}).items()}
    else:
        quota = quotas(sizes, frac, label_col)
        rows = quota.agg(F.sum("n")).first()[0]
        need = {r["_s"]: (r["k"], r["n"]) for r in quota.where(F.col("n") * MANY >= rows).collect()}
    paths = thresholds(base, "_s", "_h", id_col, need)
    label = lambda test: F.when(test, F.lit(TEST)).otherwise(F.lit(TRAIN))
    met = base.join(F.broadcast(paths), "_s", "left")
    out = met.withColumn(split_col, label(within("_h", id_col, "_path")))
    columns = [F.col(c) for c in df.columns] + [F.col(split_col)]
    if quota is None:
        return out.select(*columns)
    few = met.where("_path is null").join(quota.select("_s", "k"), "_s")
    few = few.withColumn("_rank", F.row_number().over(Window.partitionBy("_s").orderBy("_h", id_col)))
    few = few.withColumn(split_col, label(F.col("_rank") <= F.col("k")))
    return out.where("_path is not null").select(*columns).unionByName(few.select(*columns))


def quotas(sizes: DataFrame, frac: float, label_col: str | None) -> DataFrame:
    """(_s, n, k): test rows of every stratum of ``sizes`` (_s, n), by largest remainder as in ``allocate``.

    Written once. The remainders of any number of strata are ranked in ranges.
    """
    spark = sizes.sparkSession
    path = scratch_path(spark, "strata")
    sizes.write.parquet(path)
    sizes = spark.read.schema(sizes.schema).parquet(path)
    n, missing = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("_s").isNull())).first()
    if missing:
        raise ValueError(_NO_LABEL.format(label_col))
    k = F.lit(test_size(n, frac)).cast("decimal(19, 0)")
    share = k * F.col("n")
    part = sizes.select("_s", "n", share.alias("share"), F.lit(n).cast("decimal(19, 0)").alias("all"))
    part = part.withColumn("base", F.expr("share div all"))
    part = part.withColumn("rem", (F.col("share") - F.col("base") * F.col("all")).cast("decimal(19, 0)"))
    extra = test_size(n, frac) - (part.agg(F.sum("base")).first()[0] or 0)
    ranked = key_rank(part.select("_s", "n", "base", (-F.col("rem")).alias("order"), F.lit(0).alias("all")),
                      ["all"], ["order", "_s"], "place")
    return ranked.select("_s", "n", (F.col("base") + (F.col("place") <= extra).cast("bigint")).alias("k"))


def split_sizes(df: DataFrame, split_col: str = "split", *by: str) -> DataFrame:
    """H4: rows per split, and per value of ``by`` where given."""
    return df.groupBy(split_col, *by).agg(F.count(F.lit(1)).alias("n_rows"))
