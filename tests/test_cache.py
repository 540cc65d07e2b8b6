import os

from pyspark.sql import functions as F

from riskline.sources import cache as Ca


def test_encode_batches_and_cache_rerun(spark, tmp_dir):
    def make_encoder():
        calls = []

        def enc(texts):
            calls.append(len(texts))
            assert len(texts) <= 3  # batch size honoured
            return [[float(len(t)), float(t.count(" "))] for t in texts]
        return enc

    df = spark.createDataFrame([(i, f"text number {i}" + " x" * i) for i in range(10)], "id long, text string")
    df = df.withColumn("key", Ca.text_key("text"))
    path = os.path.join(tmp_dir, "cache")

    def encode(missing):
        return Ca.encode_batches(missing, make_encoder, "text", "vec", batch_size=3)

    first = {r.id: (r.vec, r.from_cache) for r in Ca.cached_features(df, "id", "key", path, encode, "vec").collect()}
    assert len(first) == 10 and not any(fc for _, fc in first.values())
    second = {r.id: (r.vec, r.from_cache) for r in Ca.cached_features(df, "id", "key", path, encode, "vec").collect()}
    assert all(fc for _, fc in second.values())
    assert {k: v for k, (v, _) in first.items()} == {k: v for k, (v, _) in second.items()}
    # a changed text gets a new key and is encoded again, never served stale
    changed = df.withColumn("text", F.when(F.col("id") == 3, F.lit("new words")).otherwise(F.col("text"))) \
                .withColumn("key", Ca.text_key("text"))
    third = {r.id: r for r in Ca.cached_features(changed, "id", "key", path, encode, "vec").collect()}
    assert third[3].from_cache is False and third[3].vec == [9.0, 1.0]
    assert sum(1 for r in third.values() if r.from_cache) == 9
