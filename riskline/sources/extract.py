"""Text extraction stage (A6, A7, D5) and the scan report input listing.

The reference turns images into text with an OCR program. Here extraction is
a pluggable stage: ``extract_text`` runs any ``pandas.Series -> pandas.Series``
extractor over Arrow batches (``mapInPandas``), so an OCR package can be
plugged in where one is installed. The shipped extractor is
``page_text``: raw HTML -> visible text with built-in regex functions only.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from riskline.functions.text import collapse_ws, has_suffix, strip_ws

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]
# HTML removal, applied in this order (each match -> one space).
HTML_SCRIPT = r"(?is)<script\b.*?</script>"
HTML_STYLE = r"(?is)<style\b.*?</style>"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"(?s)<[^>]*>"
# ---------------------------------------------------------------------------

STATUS_OK = "ok"
STATUS_UNREADABLE = "unreadable"
STATUS_ERROR = "error"
ON_UNREADABLE = ("empty", "skip", "fail")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_image_name(col, strict_case: bool = False) -> Column:
    """Names ending in .png/.jpg/.jpeg; case-insensitive unless ``strict_case``."""
    return has_suffix(col, IMAGE_SUFFIXES, case_sensitive=strict_case)


def read_media(spark, folder: str, strict_case: bool = False) -> DataFrame:
    """Image files of a folder (top level) as (filename, path, content).

    Uses the ``binaryFile`` source, so files are read by the executors; a name
    pattern of the listing leaves out all other files. The rows are in no order:
    the bytes are never shuffled, what is reported of them is sorted (J1, ``scan_report``).
    """
    exact = ",".join(s.lstrip(".") for s in IMAGE_SUFFIXES)
    either = ",".join("".join(f"[{c}{c.upper()}]" for c in s.lstrip(".")) for s in IMAGE_SUFFIXES)
    # the glob keeps other files from being listed, so their bytes are never read
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
          .option("pathGlobFilter", "*.{" + (exact if strict_case else either) + "}").load(folder)
          .select(F.element_at(F.split(F.col("path"), "/"), -1).alias("_encoded"), "path", "content"))
    # ``path`` is a percent-encoded URI: decode only the file name for display.
    name = F.expr("reflect('java.net.URLDecoder', 'decode', replace(_encoded, '+', '%2B'), 'UTF-8')")
    df = df.select(name.alias("filename"), "path", "content")
    return df.where(is_image_name("filename", strict_case))


def page_text(col) -> Column:
    """A7 shipped extractor: visible text of an HTML page (entities kept)."""
    t = _c(col)
    for pat in (HTML_SCRIPT, HTML_STYLE, HTML_COMMENT, HTML_TAG):
        t = F.regexp_replace(t, pat, " ")
    return collapse_ws(t)


def extract_text(df: DataFrame, extractor: Callable, input_col: str, on_unreadable: str = "empty",
                 out: str = "text") -> DataFrame:
    """A7 + D5: apply a batch extractor; unreadable input -> '' / skipped / job failure.

    ``extractor(pandas.Series) -> pandas.Series`` returns a string, or None for
    an unreadable input. If the extractor raises for a batch, its rows are tried
    one by one; only rows that raise again are errors (status 'error', message
    kept), and the job goes on, unless ``on_unreadable == 'fail'``. Output adds ``out``, ``status``,
    ``error``; extracted text is stripped.
    """
    if on_unreadable not in ON_UNREADABLE:
        raise ValueError(f"on_unreadable must be one of {ON_UNREADABLE}")
    schema = Ty.StructType(df.schema.fields + [
        Ty.StructField(out, Ty.StringType()), Ty.StructField("status", Ty.StringType()),
        Ty.StructField("error", Ty.StringType())])

    def alone(row):
        try:
            text = extractor(row).iloc[0]
            return (None, STATUS_UNREADABLE, None) if pd.isna(text) else (text, STATUS_OK, None)
        except Exception as e:  # noqa: BLE001 - the row's own failure is its result
            return None, STATUS_ERROR, str(e)

    def run(batches):
        for pdf in batches:
            try:
                texts = extractor(pdf[input_col])
                status = texts.isna().map({True: STATUS_UNREADABLE, False: STATUS_OK})
                errors = [None] * len(pdf)
            except Exception:  # noqa: BLE001 - failure isolation per row
                if on_unreadable == "fail":
                    raise
                one_by_one = [alone(pdf[input_col].iloc[i:i + 1]) for i in range(len(pdf))]
                texts, status, errors = (pd.Series(list(c), dtype=object) for c in zip(*one_by_one))
            if on_unreadable == "fail" and (status != STATUS_OK).any():
                raise ValueError("unreadable input")
            yield pdf.assign(**{out: texts.values, "status": status.values, "error": list(errors)})

    res = df.mapInPandas(run, schema)
    res = res.withColumn(out, strip_ws(F.coalesce(F.col(out), F.lit(""))))
    if on_unreadable == "skip":
        res = res.where(F.col("status") == STATUS_OK)
    return res
