"""Feature cache (A11 read, B5 write) and the injected batch encoder.

The reference caches a whole embedding matrix and reuses it all-or-nothing
(stale if the texts changed). Here the cache is a parquet table keyed by
(row id, md5 of the cleaned text): rows whose key is present are read back,
the rest are found with a ``left_anti`` join, encoded, appended to the cache
and unioned. A changed text gets a new key, so it is never served stale.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from riskline.functions.text import clean_mask

BATCH_SIZE = 32  # texts per encoder call


def text_key(text_col: str) -> "F.Column":
    """Cache key of a text: md5 of its masked, cleaned form (what the encoder sees)."""
    return F.md5(clean_mask(F.coalesce(F.col(text_col), F.lit(""))))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_features(df: DataFrame, id_col: str, key_col: str, cache_path: str,
                    encode: Callable[[DataFrame], DataFrame], vec_col: str = "embedding") -> DataFrame:
    """A11 + B5: (id, key, vec, from_cache) for every row of ``df``.

    ``df`` carries ``id_col`` and ``key_col``; ``encode(missing_rows)`` must
    return them plus ``vec_col``. New vectors are appended to ``cache_path``
    before being returned, so a rerun finds them. Both joins are on the
    unique (id, key) pair and shuffle-partitioned by it; no side is assumed small.
    """
    spark = df.sparkSession
    keys = [id_col, key_col]
    if _exists(spark, cache_path):
        # Two runs may have encoded the same missing row; one vector per key.
        # The join hash-partitions the cache on the keys anyway, so the
        # de-duplication rides on the same exchange.
        cache = spark.read.parquet(cache_path).select(*keys, vec_col).dropDuplicates(keys)
        hits = df.select(*keys).join(cache, keys, "inner").withColumn("from_cache", F.lit(True))
        missing = df.join(cache.select(*keys), keys, "left_anti")
    else:
        hits = None
        missing = df
    # Each run writes its own folder (overwritten on retry, so a replay adds no
    # duplicates); the rows are then read back instead of being encoded twice.
    run_path = f"{cache_path}/run={uuid.uuid4().hex}"
    encode(missing).select(*keys, vec_col).write.mode("overwrite").parquet(run_path)
    computed = (spark.read.parquet(run_path).select(*keys, vec_col)
                .withColumn("from_cache", F.lit(False)))
    return computed if hits is None else hits.unionByName(computed)


def encoder_udf(make_encoder: Callable, batch_size: int = BATCH_SIZE):
    """F9 as a column function: texts -> ``array<float>`` in batches of ``batch_size``.

    ``make_encoder()`` loads the model, once a Python worker (it is kept for the worker's later tasks);
    the callable it returns maps an array of texts to an array of vectors, one row each.
    """
    return predict_batch_udf(make_encoder, return_type=Ty.ArrayType(Ty.FloatType()), batch_size=batch_size)


def encode_batches(df: DataFrame, make_encoder: Callable, text_col: str, out_col: str = "embedding",
                   batch_size: int = BATCH_SIZE) -> DataFrame:
    """texts -> vectors with a user-supplied encoder, in batches of ``batch_size``.

    ``make_encoder()`` is called once per task (load the model there);
    the returned callable maps a list of texts to a sequence of float vectors.
    Runs over Arrow batches (``mapInPandas``); Spark partitions the work.
    """
    schema = Ty.StructType(df.schema.fields + [Ty.StructField(out_col, Ty.ArrayType(Ty.FloatType()))])

    def run(batches):
        enc = make_encoder()
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                vecs = enc(part[text_col].fillna("").tolist())
                yield part.assign(**{out_col: [list(map(float, v)) for v in vecs]})

    return df.mapInPandas(run, schema)
