import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF001
from riskline.operators import model as Mo
from riskline.operators import split as Sp


def _labelled(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    lab = spark.read.parquet(f"{SF001}/labels.parquet")
    return d.join(lab, "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))


def _gradient(model, rows, vec_stage_model=None):
    """||w + sum (p - y) x||_inf / n and |sum (p - y)| / n at the fitted optimum (C = 1)."""
    lr = model.stages[-1]
    pdf = model.transform(rows).select("features", "label", Mo.probability().alias("p")).toPandas()
    X = np.stack([v.toArray() for v in pdf.features])
    r = pdf.p.values - pdf.label.values
    n = len(r)
    g = lr.coefficients.toArray() + X.T @ r
    return np.abs(g).max() / n, abs(r.sum()) / n


def test_lr_tfidf_reaches_the_l2_optimum(spark):
    data = _labelled(spark)
    res = Mo.train(data, "doc_id", stratify=True)
    assert res.n_train + res.n_test == data.count() and res.n_test == Sp.test_size(data.count())
    train_rows = Sp.split(data, "doc_id", "label").where("split = 'train'")
    g, resid = _gradient(res.model, train_rows)
    assert g < 1e-4 and resid < 1e-4
    rep = {r["class"]: r for r in res.report.collect()}
    assert rep["accuracy"].support == res.n_test


def test_lr_vectors_reaches_the_l2_optimum(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        "vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    res = Mo.train_vectors(e, "vec_id", "embedding", "label")
    rows = Sp.split(e, "vec_id", "label").where("split = 'train'").withColumn(
        "features", __import__("pyspark.ml.functions", fromlist=["array_to_vector"]).array_to_vector("embedding"))
    g, resid = _gradient(res.model, rows)
    assert g < 1e-4 and resid < 1e-4


def test_separable_fixture_and_scoring_forms(spark, tmp_dir):
    rows = [(i, "good fine lovely day", 0) for i in range(20)] + [(100 + i, "urgent verify password now", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    res = Mo.train(df, "doc_id", fit_on="all")
    pred = res.model.transform(df)
    assert pred.where("prediction = label").count() == 40
    probe = spark.createDataFrame([(1, "urgent password"), (2, "   "), (3, "")], "doc_id long, text string")
    scored = {r.doc_id: r for r in Mo.classify(probe, res.model, "text").collect()}
    assert scored[2].risk_score == 0.0 and scored[3].risk_score == 0.0 and scored[2].risk_band == "LOW"
    assert scored[1].risk_score > 0.5
    st = {r.doc_id: r.prediction for r in Mo.predict_struct(probe, res.model, "text").collect()}
    b = res.model.stages[-1].intercept
    assert st[2].phishing_probability == pytest.approx(1 / (1 + np.exp(-b)))
    assert st[1].label == 1 and isinstance(st[1].label, int)
    # save / load round trip gives identical probabilities
    path = os.path.join(tmp_dir, "model")
    Mo.save(res.model, path, "enhanced")
    again, variant = Mo.load(spark, path)
    assert variant == "enhanced"
    a = [r.p for r in res.model.transform(df).select(Mo.probability().alias("p")).collect()]
    c = [r.p for r in again.transform(df).select(Mo.probability().alias("p")).collect()]
    assert a == c


def test_load_or_train(spark, tmp_dir):
    rows = [(i, "good fine", 0) for i in range(5)] + [(10 + i, "bad evil", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    calls = []

    def fit():
        calls.append(1)
        return Mo.train(df, "doc_id", fit_on="all").model

    path = os.path.join(tmp_dir, "m")
    m1, v1 = Mo.load_or_train(spark, path, fit, "baseline")
    m2, v2 = Mo.load_or_train(spark, path, fit, "baseline")
    assert calls == [1] and v1 == v2 == "baseline"


def test_run_metrics_sink(spark, tmp_dir):
    m = spark.createDataFrame([(10, 0.96349, 0.95549)], "n_rows long, accuracy double, f1 double")
    p = os.path.join(tmp_dir, "runs")
    Mo.write_run_metrics(spark, p, "emails", "tfidf-lr", m)
    Mo.write_run_metrics(spark, p, "emails", "tfidf-lr", m)
    back = spark.read.parquet(p).collect()
    assert len(back) == 2 and back[0].accuracy == 0.963 and back[0].f1 == 0.955


def test_variants(spark):
    rows = [(i, "good fine lovely day", 0) for i in range(20)] + [(100 + i, "urgent verify password now", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    base = Mo.train_variant(df, "doc_id", "baseline")
    assert (base.n_train, base.n_test) == (32, 8)
    serve = Mo.train_variant(df, "doc_id", "serve")
    assert (serve.n_train, serve.n_test, serve.report) == (40, 0, None)
    with pytest.raises(ValueError):
        Mo.train_variant(df, "doc_id", "other")


def _separable(spark):
    rows = [(i, "good fine lovely day", 0) for i in range(20)] + [(100 + i, "urgent verify password now", 1) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_a_torn_save_is_never_loaded(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m")
    model = Mo.train(_separable(spark), "doc_id", fit_on="all").model
    assert Mo.load(spark, path) is None
    # a first trainer fell over before it had pointed to its version
    model.write().overwrite().save(f"{path}/v=1/pipeline")
    assert Mo.load(spark, path) is None
    assert Mo.save(model, path, "serve") == 2 and Mo.load(spark, path)[1] == "serve"
    # a second one overtakes: the version pointed to last with the highest number counts, files never mix
    os.makedirs(f"{path}/v=3/pipeline")
    assert Mo.load(spark, path)[1] == "serve"
    assert Mo.save(model, path, "fallback") == 4 and Mo.load(spark, path)[1] == "fallback"


def test_vector_form_scores_texts_after_a_round_trip(spark, tmp_dir):
    from riskline.sources.cache import encoder_udf

    def _toy():
        def encode(texts):
            return np.array([[t.count("urgent"), t.count("lovely"), len(t) / 100] for t in texts], dtype=np.float32)
        return encode

    df = Mo.with_vectors(_separable(spark), encoder_udf(_toy))
    res = Mo.train_variant(df.withColumn("features", F.lit(1)).drop("features"), "doc_id", "vectors")
    assert (res.n_train, res.n_test) == (32, 8)
    path = os.path.join(tmp_dir, "vm")
    Mo.save(res.model, path, "vectors")
    model, variant = Mo.load(spark, path)
    assert variant == "vectors"
    probe = spark.createDataFrame([(1, "URGENT  urgent"), (2, " \t"), (3, None), (4, "lovely http://x.y")], "doc_id long, text string")
    got = {r.doc_id: r for r in Mo.classify_vectors(probe, model, encoder_udf(_toy), keep=["doc_id"]).collect()}
    assert got[2].risk_score == got[3].risk_score == 0.0 and got[1].risk_score > 0.5 > got[4].risk_score
    lr = model.stages[-1]
    clean = "lovely URL"  # what the encoder sees
    z = lr.intercept + lr.coefficients.dot([0, 1, np.float32(len(clean) / 100)])
    assert got[4].risk_score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_certificate_tells_an_unfinished_fit(spark):
    df = _labelled(spark)
    good = Mo.train(df, "doc_id", fit_on="all", tol=1e-10).model
    cert = Mo.optimality(good, df)
    assert cert.where("not optimal").count() == 0 and cert.count() == len(good.stages[-1].coefficients) + 1
    early = Mo.train(df, "doc_id", fit_on="all", max_iter=1).model
    assert Mo.optimality(early, df).where("not optimal").count() > 0
    # the values equal a dense computation
    pdf = early.transform(df).select("features", "label", Mo.probability().alias("p")).toPandas()
    x, r = np.stack([v.toArray() for v in pdf.features]), pdf.p.values - pdf.label.values
    want = (early.stages[-1].coefficients.toArray() + x.T @ r) / len(r)
    terms = early.stages[1].vocabulary
    assert len(terms) == len(want)
    got = {c.feature: c.gradient for c in Mo.optimality(early, df).collect()}
    assert max(abs(got[t] - w) for t, w in zip(terms, want)) < 1e-12 and abs(got["(intercept)"] - r.sum() / len(r)) < 1e-12
