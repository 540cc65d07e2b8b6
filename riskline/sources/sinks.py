"""Sinks (B1, B2): combined dataset and score report as CSV with header.

Written by the executors (one file per partition); no data passes through the
driver. Readers use the same options, so a report reads back equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPORT_COLUMNS = ["filename", "risk_score", "risk_band"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header; every field quoted, embedded quotes doubled, newlines kept."""
    (df.write.mode(mode).option("header", True).option("quoteAll", True)
       .option("escape", '"').option("multiLine", True).csv(path))
    return path


def write_report(report: DataFrame, path: str) -> str:
    """B2: (filename, risk_score, risk_band) report."""
    return write_csv(report.select(*REPORT_COLUMNS), path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema("filename string, risk_score double, risk_band string").csv(path))


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """B1: the combined dataset from its CSV."""
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema("text string, label int, source_file string").csv(path))
