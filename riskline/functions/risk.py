"""Risk band expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskline.functions.text import is_blank

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
HIGH_THRESHOLD = 0.8
MEDIUM_THRESHOLD = 0.5
BAND_HIGH = "HIGH"
BAND_MEDIUM = "MEDIUM"
BAND_LOW = "LOW"
DISPLAY_HIGH = "🚨 HIGH RISK: Likely phishing"
DISPLAY_MEDIUM = "⚠️  MEDIUM RISK: Review recommended"
DISPLAY_LOW = "✅ LOW RISK: Likely safe"
SEVERITY_HIGH = "danger"
SEVERITY_MEDIUM = "warning"
SEVERITY_LOW = "success"
ALERT_BANDS = [BAND_MEDIUM, BAND_HIGH]
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def band(score, high: float = HIGH_THRESHOLD, medium: float = MEDIUM_THRESHOLD) -> Column:
    """>= high -> HIGH, >= medium -> MEDIUM, else LOW (on the unrounded score)."""
    s = _c(score)
    return (F.when(s >= F.lit(float(high)), F.lit(BAND_HIGH))
             .when(s >= F.lit(float(medium)), F.lit(BAND_MEDIUM))
             .otherwise(F.lit(BAND_LOW)))


def display(score, high: float = HIGH_THRESHOLD, medium: float = MEDIUM_THRESHOLD) -> Column:
    """C11: same thresholds, long wording."""
    s = _c(score)
    return (F.when(s >= F.lit(float(high)), F.lit(DISPLAY_HIGH))
             .when(s >= F.lit(float(medium)), F.lit(DISPLAY_MEDIUM))
             .otherwise(F.lit(DISPLAY_LOW)))


def severity(band_col) -> Column:
    """HIGH -> danger, MEDIUM -> warning, anything else -> success."""
    b = _c(band_col)
    return (F.when(b == BAND_HIGH, F.lit(SEVERITY_HIGH))
             .when(b == BAND_MEDIUM, F.lit(SEVERITY_MEDIUM))
             .otherwise(F.lit(SEVERITY_LOW)))


def is_alert(band_col) -> Column:
    """Band in (MEDIUM, HIGH)."""
    return _c(band_col).isin(ALERT_BANDS)


def blank_guard(text, probability) -> Column:
    """A blank text scores exactly 0.0 before the model is consulted."""
    return F.when(F.coalesce(is_blank(_c(text)), F.lit(True)), F.lit(0.0)).otherwise(_c(probability))
