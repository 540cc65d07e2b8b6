import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskline.sources import extract as Ex


def test_page_text_order_matters(spark):
    html = ('<html><head><title>T &amp; x</title><style>p{x}</style>'
            '<script>var t="</p>";</script></head><body><!-- c <b>no</b> --><p>Hello\n <b>World</b></p></body></html>')
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(Ex.page_text("h")).first()[0] == "T &amp; x Hello World"


def test_image_names(spark):
    df = spark.createDataFrame([("a.png",), ("b.JPG",), ("c.jpeg",), ("d.txt",), ("e.PNG",)], "n string")
    loose = [r[0] for r in df.where(Ex.is_image_name("n")).collect()]
    strict = [r[0] for r in df.where(Ex.is_image_name("n", strict_case=True)).collect()]
    assert loose == ["a.png", "b.JPG", "c.jpeg", "e.PNG"] and strict == ["a.png", "c.jpeg"]


def test_extract_policies(spark):
    def _fake_ocr(s: pd.Series) -> pd.Series:
        # "unreadable" inputs give None; others are upper-cased with padding
        return s.map(lambda b: None if b.startswith("bad") else f"  {b.upper()}\n")

    df = spark.createDataFrame([(1, "good one"), (2, "bad bytes")], "id long, raw string")
    empty = {r.id: (r.text, r.status) for r in Ex.extract_text(df, _fake_ocr, "raw", "empty").collect()}
    assert empty == {1: ("GOOD ONE", "ok"), 2: ("", "unreadable")}
    skip = [r.id for r in Ex.extract_text(df, _fake_ocr, "raw", "skip").collect()]
    assert skip == [1]
    with pytest.raises(Exception):
        Ex.extract_text(df, _fake_ocr, "raw", "fail").collect()


def test_extract_failure_isolation(spark):
    def broken(s):
        raise RuntimeError("engine down")
    df = spark.createDataFrame([(1, "x")], "id long, raw string")
    r = Ex.extract_text(df, broken, "raw", "empty").first()
    assert (r.text, r.status, r.error) == ("", "error", "engine down")


def test_media_folder_scan_report(spark, tmp_dir):
    """A6 -> A7 -> K6 -> C13/C10 over real files, with a byte-decoding extractor."""
    import os
    from riskline.functions import risk as R
    from riskline.functions.text import round_score
    from riskline.operators import features as Fe
    files = {"b.png": "urgent verify", "a b.JPG": "hello", "c.jpeg": " \n", "d.txt": "urgent", "e.gif": "urgent"}
    for n, body in files.items():
        with open(os.path.join(tmp_dir, n), "wb") as f:
            f.write(body.encode())
    media = Ex.read_media(spark, tmp_dir)
    assert sorted(r.filename for r in media.collect()) == ["a b.JPG", "b.png", "c.jpeg"]
    strict = Ex.read_media(spark, tmp_dir, strict_case=True)
    assert sorted(r.filename for r in strict.collect()) == ["b.png", "c.jpeg"]

    def decode(s):
        return s.map(lambda b: bytes(b).decode("utf-8"))

    texts = Ex.extract_text(media.select("filename", "content"), decode, "content", "empty")
    model = spark.createDataFrame([("urgent", 1.0, 3.0)], "term string, idf double, coef double")
    rep = Fe.score_linear(texts, "filename", "text", model).select(
        "filename", round_score("risk_score").alias("risk_score"), R.band("risk_score").alias("risk_band"))
    got = {r.filename: (r.risk_score, r.risk_band) for r in rep.collect()}
    assert got == {"b.png": (0.953, "HIGH"), "a b.JPG": (0.5, "MEDIUM"), "c.jpeg": (0.0, "LOW")}
    # the report operator over the same files, in order of their names
    from riskline.operators import scan as Sc
    scorer = lambda d: Fe.score_linear(d, "filename", "text", model)
    report = Sc.scan_report(media, Sc.batches(decode), scorer)
    assert [(r.filename, r.risk_score, r.risk_band) for r in report.collect()] == sorted((k, *v) for k, v in got.items())
    assert "content" not in report._jdf.queryExecution().executedPlan().toString()  # only the report is sorted


def test_one_bad_row_does_not_take_its_batch(spark):
    def extractor(s):
        if (s == "bad").any():
            raise ValueError("broken")
        return s.str.upper()

    df = spark.range(1000).selectExpr("id", "case when id = 500 then 'bad' else 'ok' end as raw").coalesce(1)
    out = {r.status: r["count"] for r in Ex.extract_text(df, extractor, "raw").groupBy("status").count().collect()}
    assert out == {"ok": 999, "error": 1}
