"""Baseline flow end to end: mail CSV -> strict labels -> baseline fit -> run metrics."""

import os

from pyspark.sql import functions as F

from paths import SF001
from riskline.functions.labels import STRICT_PHISHING, STRICT_SAFE, strict_label
from riskline.operators import model as Mo
from riskline.sources import mail as M
from riskline.sources import sinks as S


def test_baseline_flow_from_csv(spark, tmp_dir):
    d = spark.read.parquet(f"{SF001}/documents.parquet").join(spark.read.parquet(f"{SF001}/labels.parquet"), "doc_id")
    mail = d.select(F.col("text").alias("Email Text"),
                    F.when(F.col("toxic") == 1, F.lit(STRICT_PHISHING)).otherwise(F.lit(STRICT_SAFE)).alias("Email Type"),
                    "doc_id")
    csv_dir = S.write_csv(mail.coalesce(1), os.path.join(tmp_dir, "mail"))
    back = M.valid_text(M.read_mail_csv(spark, csv_dir))
    assert back.count() == d.count()  # multi-line texts survive the CSV round trip
    rows = back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("`Email Text`").alias("text"),
                       strict_label(F.col("`Email Type`")).alias("label"))
    res = Mo.train_variant(rows, "doc_id", "baseline")
    m = res.metrics.first()
    assert m.n_rows == res.n_test == 18 and 0.0 <= m.accuracy <= 1.0
    runs = os.path.join(tmp_dir, "runs")
    Mo.write_run_metrics(spark, runs, "emails", "tfidf-lr-baseline", res.metrics)
    rec = spark.read.parquet(runs).first()
    assert rec.dataset == "emails" and rec.accuracy == round(m.accuracy, 3)
