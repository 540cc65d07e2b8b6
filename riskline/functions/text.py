"""Text scalar functions as Spark Column expressions.

Everything here is a pure ``Column -> Column`` built from ``pyspark.sql.functions``;
no Python UDF is involved, so each function stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
# Whitespace = Python's str-mode \s: Spark's \s misses 23 of these characters.
WS = r"[\s\x0B\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = r"[^\s\x0B\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Masks: URL runs first, then e-mail-like runs; masks stay upper-case.
URL_RUN = f"http{NON_WS}+|www{NON_WS}+"
EMAIL_RUN = f"{NON_WS}+@{NON_WS}+"
URL_MASK = " URL "
EMAIL_MASK = " EMAIL "
# Vectoriser token: maximal run of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Names of captures and the time format of run reports.
REPORT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
CAPTURE_PREFIX = "capture_"
CAPTURE_SUFFIX = ".png"
PREVIEW_CHARS = 200
NO_TEXT_PLACEHOLDER = "[No text detected]"
# ---------------------------------------------------------------------------

# Spark-side forms of the fixed patterns (same matches, faster in Java's engine).
# Python's whitespace set is Unicode White_Space plus \x1c-\x1f; Java tests that
# as one property instead of a chain of ranges (equality over the whole BMP is
# checked in tests/test_text.py). DuckDB's SQL keeps the explicit classes above,
# so the oracle cross-checks both forms.
WS_JAVA = r"[\p{IsWhite_Space}\x1c-\x1f]"
NON_WS_JAVA = r"[^\p{IsWhite_Space}\x1c-\x1f]"
URL_RUN_JAVA = f"http{NON_WS_JAVA}++|www{NON_WS_JAVA}++"
# EMAIL_RUN without quadratic backtracking: a match can only start where a
# non-whitespace run starts and always ends at the run's end; it exists iff the
# first '@' after the run's first character is followed by a non-whitespace one.
EMAIL_RUN_LINEAR = (f"(?<!{NON_WS_JAVA}){NON_WS_JAVA}"
                    f"(?=[^@\\p{{IsWhite_Space}}\\x1c-\\x1f]*+@{NON_WS_JAVA}){NON_WS_JAVA}*+")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col) -> Column:
    """Collapse Unicode whitespace runs to one space and strip both ends.

    After the collapse every run is a single U+0020, so Spark's ``trim`` (which
    removes only U+0020) strips exactly what Python's ``str.strip`` would.
    """
    return F.trim(F.regexp_replace(_c(col), f"{WS_JAVA}+", " "))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^{WS_JAVA}+|{WS_JAVA}+$", "")


def is_blank(col) -> Column:
    """True when the text is empty or only whitespace (D3/D8). Null stays null."""
    return F.regexp_replace(_c(col), f"{WS_JAVA}+", "") == F.lit("")


def clean_basic(col) -> Column:
    """Null -> '', lower-case, collapse whitespace, strip."""
    return collapse_ws(F.lower(F.coalesce(_c(col).cast("string"), F.lit(""))))


def clean_mask(col) -> Column:
    """Lower, URL runs -> ' URL ', then e-mail runs -> ' EMAIL ', collapse, strip.

    No null guard (callers drop null texts first); null in, null out.
    """
    t = F.lower(_c(col).cast("string"))
    t = F.regexp_replace(t, URL_RUN_JAVA, URL_MASK)
    t = F.regexp_replace(t, EMAIL_RUN_LINEAR, EMAIL_MASK)
    return collapse_ws(t)


def tokenize(col) -> Column:
    """E5: vectoriser tokens of a text as ``array<string>`` (lower-cased)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(TOKEN), 0)


def has_suffix(col, suffixes, case_sensitive: bool = True) -> Column:
    """Name ends with one of ``suffixes``."""
    c = _c(col) if case_sensitive else F.lower(_c(col))
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | c.endswith(s if case_sensitive else s.lower())
    return cond


def round_score(col, digits: int = 3) -> Column:
    """Half-even rounding of a double, as Python's ``round``."""
    return F.bround(_c(col), digits)


def format_score(col) -> Column:
    """C14: ``%.3f`` text rendering."""
    return F.format_string("%.3f", _c(col))


def preview(col, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(col), 1, n)


def display_text(col) -> Column:
    """Empty extracted text shows a placeholder."""
    c = _c(col)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(NO_TEXT_PLACEHOLDER)).otherwise(c)


def capture_name(ts_col) -> Column:
    """``capture_<yyyyMMdd_HHmmss>.png`` (one-second resolution).

    Written from the time's fields as they stand, so a time without a zone has one
    name under every session time zone (also in the hours a zone skips).
    """
    at = _c(ts_col).cast("timestamp_ntz").cast("string")
    return F.concat(F.lit(CAPTURE_PREFIX), F.replace(F.substring(at, 1, 10), F.lit("-"), F.lit("")), F.lit("_"),
                    F.replace(F.substring(at, 12, 8), F.lit(":"), F.lit("")), F.lit(CAPTURE_SUFFIX))


def report_time(ts_col) -> Column:
    """C17: ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_c(ts_col), REPORT_TIME_FORMAT)
