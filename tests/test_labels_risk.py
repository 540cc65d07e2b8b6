import pytest
from pyspark.sql import functions as F

from riskline.functions import labels as L
from riskline.functions import risk as R

WORD_CASES = [
    ("1", 1), (" Phishing ", 1), ("SPAM", 1), ("fraud", 1), ("malicious", 1), ("unsafe", 1),
    ("Phishing Email", 1), ("0", 0), ("Safe", 0), ("legitimate", 0), ("ham", 0), ("benign", 0),
    ("normal", 0), ("safe email", 0), ("2", None), ("maybe", None), ("1.0", None), (None, None),
]


def test_word_labels(spark):
    df = spark.createDataFrame([(w,) for w, _ in WORD_CASES], "raw string")
    got = [r[0] for r in df.select(L.normalize_label("raw", L.KIND_STRING)).collect()]
    assert got == [e for _, e in WORD_CASES]


def test_numeric_and_boolean_labels(spark):
    df = spark.createDataFrame([("1.9",), ("0.7",), ("-0.5",), ("2.0",), (None,)], "raw string")
    assert [r[0] for r in df.select(L.normalize_label("raw", L.KIND_NUMERIC)).collect()] == [1, 0, 0, None, None]
    b = spark.createDataFrame([("True",), ("False",)], "raw string")
    assert [r[0] for r in b.select(L.normalize_label("raw", L.KIND_BOOLEAN)).collect()] == [1, 0]


def test_column_kind(spark):
    def kind(vals):
        df = spark.createDataFrame([(v,) for v in vals], "raw string")
        return df.agg(L.column_kind("raw")).first()[0]
    assert kind(["1", "0.5", None]) == L.KIND_NUMERIC
    assert kind(["True", "false", None]) == L.KIND_BOOLEAN
    assert kind(["1", "spam"]) == L.KIND_STRING


def test_strict_and_source_labels(spark):
    df = spark.createDataFrame([("Safe Email", "Enron.csv"), ("Phishing Email", "Ling.csv"),
                                ("safe email", "x.csv")], "t string, f string")
    got = df.select(L.strict_label("t"), L.label_from_source("f")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (None, None)]


def test_na_values(spark):
    df = spark.createDataFrame([("NA",), ("None",), ("null",), ("",), ("ok",)], "c string")
    assert [r[0] for r in df.select(L.na_to_null("c")).collect()] == [None, None, None, None, "ok"]


BANDS = [(0.0, "LOW"), (0.4999999, "LOW"), (0.5, "MEDIUM"), (0.7999999, "MEDIUM"), (0.8, "HIGH"), (1.0, "HIGH")]


def test_bands_and_class_at_half(spark):
    df = spark.createDataFrame([(s,) for s, _ in BANDS], "s double")
    rows = df.select(R.band("s").alias("b"), R.severity(R.band("s")).alias("sev"),
                     (F.col("s") > 0.5).cast("int").alias("cls"), R.is_alert(R.band("s")).alias("al")).collect()
    assert [r.b for r in rows] == [b for _, b in BANDS]
    assert rows[2].cls == 0 and rows[2].b == "MEDIUM"
    assert [r.sev for r in rows] == ["success", "success", "warning", "warning", "danger", "danger"]
    assert [r.al for r in rows] == [False, False, True, True, True, True]


def test_blank_guard(spark):
    df = spark.createDataFrame([("", 0.9), (" ", 0.9), ("\t\n", 0.9), ("x", 0.9), (None, 0.9)],
                               "t string, p double")
    assert [r[0] for r in df.select(R.blank_guard("t", "p")).collect()] == [0.0, 0.0, 0.0, 0.9, 0.0]


def test_strict_label_policies(spark):
    import pytest
    from riskline.functions import labels as L
    df = spark.createDataFrame([(1, "Safe Email"), (2, "safe email"), (3, None), (4, "Phishing Email")], "id int, `a b` string")
    get = lambda p: sorted((r.id, r.label) for r in L.apply_strict_label(df, "a b", on_unmapped=p).collect())
    assert get("null") == [(1, 0), (2, None), (3, None), (4, 1)] and get("drop") == [(1, 0), (4, 1)]
    with pytest.raises(Exception, match="no label for"):
        get("fail")
    assert L.apply_strict_label(df.where("id in (1, 4)"), "a b", on_unmapped="fail").count() == 2
    with pytest.raises(ValueError):
        get("other")
