"""Evaluation aggregates (H1-H8).

All metrics derive from one four-cell confusion aggregate (map-side
combinable ``count_if``s); the report arithmetic runs on that single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_DIGITS = 4


def row_counts(df: DataFrame, valid: Column) -> DataFrame:
    """H1: rows read and rows kept, one job."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(F.coalesce(valid, F.lit(False))).alias("rows_after"))


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """H2: rows per label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows"))


def rows_by_source(df: DataFrame, source_col: str = "source_file") -> DataFrame:
    """H3: rows per source, largest first."""
    return (df.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_rows"))
              .orderBy(F.col("n_rows").desc(), F.col(source_col)))


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """H7: one row (tn, fp, fn, tp); cells with no rows are 0."""
    y, p = F.col(label_col), F.col(pred_col)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"),
                  F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_long(cm: DataFrame) -> DataFrame:
    """H7 as rows (true_label, predicted_label, n_rows), always four rows."""
    return cm.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) "
                            "AS (true_label, predicted_label, n_rows)"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def accuracy_f1(cm: DataFrame) -> DataFrame:
    """H5 + H6: accuracy and F1 of class 1 (0 when undefined)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return cm.select(n.alias("n_rows"), _safe_div(tn + tp, n).alias("accuracy"),
                     _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(cm: DataFrame, digits: int = REPORT_DIGITS) -> DataFrame:
    """H8: per-class precision / recall / F1 / support, accuracy, macro and weighted averages.

    Rows: '0', '1', 'accuracy', 'macro avg', 'weighted avg'. Undefined ratios
    are 0; the accuracy row carries only f1 (= accuracy) and support.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    f1_0 = _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _safe_div(tn + tp, n)
    wavg = lambda a, b: _safe_div(a * s0 + b * s1, n)
    m = cm.select(p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
                  p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"),
                  acc.alias("acc"), n.alias("n"),
                  ((p0 + p1) / 2).alias("mp"), ((r0 + r1) / 2).alias("mr"), ((f1_0 + f1_1) / 2).alias("mf"),
                  wavg(p0, p1).alias("wp"), wavg(r0, r1).alias("wr"), wavg(f1_0, f1_1).alias("wf"))
    rows = m.select(F.expr(
        "stack(5, "
        "'0', p0, r0, f0, s0, "
        "'1', p1, r1, f1, s1, "
        "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
        "'macro avg', mp, mr, mf, n, "
        "'weighted avg', wp, wr, wf, n) AS (class, precision, recall, f1_score, support)"))
    return rows.select("class", *(F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")),
                       F.col("support").cast("bigint").alias("support"))
