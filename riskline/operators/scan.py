"""Scan report (K8): files or texts -> extracted text -> score -> rounded score and band, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.functions import risk as R
from riskline.functions.text import round_score
from riskline.session import scratch_path
from riskline.sources.extract import extract_text


def native(extract: Callable[[Column], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """An extractor of column functions; what it cannot read is empty text."""
    return lambda df, input_col: df.withColumn("text", F.coalesce(extract(F.col(input_col)), F.lit("")))


def batches(extract: Callable, on_unreadable: str = "empty") -> Callable[[DataFrame, str], DataFrame]:
    """An extractor of pandas batches (``extract_text``) under a policy for unreadable input."""
    return lambda df, input_col: extract_text(df, extract, input_col, on_unreadable)


def scan_report(files: DataFrame, extractor: Callable[[DataFrame, str], DataFrame],
                scorer: Callable[[DataFrame], DataFrame], input_col: str = "content") -> DataFrame:
    """K8: (filename, risk_score, risk_band) of every file of ``files`` (filename, ``input_col``), sorted by name.

    ``extractor`` adds ``text`` (``native`` or ``batches``), ``scorer`` maps (filename, text) to
    (filename, risk_score), blank text to 0.0. The report is written once and then sorted: extraction
    runs once a file, and neither the files' bytes nor their texts are shuffled. The band is that of the
    unrounded score.
    """
    texts = extractor(files.select("filename", input_col), input_col).select("filename", "text")
    report = scorer(texts).select("filename", round_score("risk_score").alias("risk_score"),
                                  R.band("risk_score").alias("risk_band"))
    path = scratch_path(files.sparkSession, "scan-report")
    report.write.parquet(path)
    return files.sparkSession.read.schema(report.schema).parquet(path).orderBy("filename")
