import math
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF001
from riskline.operators import evaluate as Ev
from riskline.operators import features as Fe
from riskline.operators import split as Sp
from riskline.operators.ranking import key_rank

TOK = re.compile(r"(?u)\b\w\w+\b")


def brute_tfidf(texts: dict, k: int):
    """Straight Python form of the vectoriser: top-k by total count (ties by term), smooth idf, L2."""
    counts = {i: Counter(TOK.findall(t.lower())) for i, t in texts.items()}
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:k]
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for i, c in counts.items():
        w = {t: c[t] * idf[t] for t in vocab if t in c}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            out[(i, t)] = v / norm
    return vocab, idf, out


FIXTURE = {1: "Win win WIN money now", 2: "money later", 3: "", 4: "a b c", 5: "now now zebra apple"}


def test_tfidf_matches_brute_force_fixture(spark):
    df = spark.createDataFrame(list(FIXTURE.items()), "id long, text string")
    vocab_idf, n = Fe.fit_tfidf(df, "id", "text", 3)
    assert n == 5
    vocab, idf, w = brute_tfidf(FIXTURE, 3)
    got_vocab = [r.term for r in vocab_idf.orderBy("idx").collect()]
    assert got_vocab == vocab  # ties (money/now: 2 each? win: 3) broken by term
    got = {(r.id, r.term): r.weight for r in Fe.tfidf(Fe.term_counts(df, "id"), vocab_idf, "id").collect()}
    assert set(got) == set(w)
    for key, v in w.items():
        assert got[key] == pytest.approx(v, rel=1e-12)


def test_term_counts_empty_and_whole_text(spark):
    long_text = " ".join(["alpha"] * 50000 + ["beta"])
    df = spark.createDataFrame([(1, ""), (2, long_text), (3, "x y")], "id long, text string")
    got = sorted(tuple(r) for r in Fe.term_counts(df, "id").collect())
    assert got == [(2, "alpha", 50000), (2, "beta", 1)]


def test_tfidf_matches_brute_force_documents(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    vocab_idf, _ = Fe.fit_tfidf(d, "doc_id", "text", 500)
    vocab, idf, w = brute_tfidf(texts, 500)
    assert [r.term for r in vocab_idf.orderBy("idx").collect()] == vocab
    got = {(r.doc_id, r.term): r.weight for r in Fe.tfidf(Fe.term_counts(d, "doc_id"), vocab_idf, "doc_id").collect()}
    assert len(got) == len(w)
    assert max(abs(got[k] - v) for k, v in w.items()) < 1e-12


def test_score_linear_blank_and_unknown(spark):
    model = spark.createDataFrame([("win", 1.5, 2.0)], "term string, idf double, coef double")
    df = spark.createDataFrame([(1, "win"), (2, "   "), (3, "zzz qqq"), (4, None)], "id long, text string")
    got = {r.id: r.risk_score for r in Fe.score_linear(df, "id", "text", model, bias=0.3).collect()}
    assert got[1] == pytest.approx(1 / (1 + math.exp(-(0.3 + 2.0))))
    assert got[2] == 0.0 and got[4] == 0.0
    assert got[3] == pytest.approx(1 / (1 + math.exp(-0.3)))
    ng = {r.id: r.risk_score for r in Fe.score_linear(df, "id", "text", model, bias=0.3, blank_guard=False).collect()}
    assert ng[2] == pytest.approx(1 / (1 + math.exp(-0.3)))


def test_key_rank_hot_key_equals_row_number(spark):
    from pyspark.sql import Window
    # One key holds 60% of the rows: the range partitioning must split it and the
    # offsets must stitch the ranges back together exactly.
    df = spark.range(0, 20000).select(F.when(F.col("id") % 5 < 3, F.lit(7)).otherwise(F.col("id") % 13).alias("k"),
                                      ((F.col("id") * 7919) % 20011).alias("o"), "id")
    got = key_rank(df, ["k"], ["o", "id"], "r", num_partitions=16)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    assert got.exceptAll(ref.select(*got.columns)).count() == 0
    assert got.count() == 20000
    hot = got.where("k = 7").agg(F.count("*"), F.min("r"), F.max("r"), F.countDistinct("r")).first()
    assert hot[0] == 12615 and (hot[1], hot[2], hot[3]) == (1, 12615, 12615)


@pytest.mark.parametrize("n", [1, 5, 15, 99, 399])
def test_test_size_rounds_like_library(n):
    assert Sp.test_size(n) == math.ceil(0.2 * n)


def test_allocate_largest_remainder():
    assert Sp.allocate({0: 348, 1: 51}, 80) == {0: 70, 1: 10}
    assert sum(Sp.allocate({0: 7, 1: 3, 2: 1}, 3).values()) == 3


def test_split_matches_brute_force(spark):
    from pyspark.sql import Window
    d = spark.read.parquet(f"{SF001}/documents.parquet").join(spark.read.parquet(f"{SF001}/labels.parquet"), "doc_id")
    d = d.select("doc_id", F.col("toxic").alias("label"))
    for label in (None, "label"):
        s = Sp.split(d, "doc_id", label)
        counts = {r[0]: r[1] for r in d.withColumn("_s0", F.col(label) if label else F.lit(0)).groupBy("_s0").count().collect()}
        k = Sp.test_size(sum(counts.values()))
        need = Sp.allocate(counts, k) if label else {0: k}
        strat = F.col(label) if label else F.lit(0)
        w = Window.partitionBy(strat).orderBy(Sp.hash_key("doc_id"), "doc_id")
        ref = d.withColumn("rn", F.row_number().over(w)).withColumn("_s", strat)
        lim = F.lit(None)
        for st, kk in need.items():
            lim = F.when(F.col("_s") == st, F.lit(kk)).otherwise(lim)
        ref = ref.withColumn("split", F.when(F.col("rn") <= lim, "test").otherwise("train"))
        a = {r.doc_id: r.split for r in s.collect()}
        b = {r.doc_id: r.split for r in ref.collect()}
        assert a == b
        assert sum(1 for v in a.values() if v == "test") == k


def test_pooling_masks_and_truncation(spark):
    rows = [(1, p, [1.0, 2.0], 1) for p in range(200)] + [(2, 0, [5.0, 5.0], 0), (2, 1, [7.0, 1.0], 0)]
    rows += [(3, 0, [2.0, 4.0], 1), (3, 1, [4.0, 8.0], 0), (3, 2, [6.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, pos int, vec array<double>, mask int")
    got = {r.id: r.pooled for r in Fe.masked_mean_pool(df, "id", "pos", "vec", "mask", 128).collect()}
    assert got[1] == [1.0, 2.0]
    assert got[2] == [0.0, 0.0]          # all masked -> zero vector
    assert got[3] == [4.0, 2.0]
    df2 = spark.createDataFrame([(1, p, [float(p)], 1) for p in range(200)], "id long, pos int, vec array<double>, mask int")
    assert Fe.masked_mean_pool(df2, "id", "pos", "vec", "mask", 128).first().pooled == [63.5]


def test_metrics_edge_cases(spark):
    one = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, p int")
    rep = {r["class"]: r for r in Ev.classification_report(Ev.confusion(one, "y", "p")).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1_score == 0.0
    assert rep["accuracy"].f1_score == round(1 / 3, 4) and rep["accuracy"].support == 3
    perfect = spark.createDataFrame([(0, 0), (1, 1)], "y int, p int")
    m = Ev.accuracy_f1(Ev.confusion(perfect, "y", "p")).first()
    assert (m.accuracy, m.f1) == (1.0, 1.0)
    cm = Ev.confusion_long(Ev.confusion(perfect, "y", "p")).collect()
    assert sorted(tuple(r) for r in cm) == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)]


def test_four_cell_case_from_labels(spark):
    lab = spark.read.parquet(f"{SF001}/labels.parquet")
    cm = Ev.confusion(lab, "toxic", "quality").first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (9, 67, 2, 9)
    rep = {r["class"]: r for r in Ev.classification_report(Ev.confusion(lab, "toxic", "quality")).collect()}
    assert rep["1"].precision == round(9 / 76, 4) and rep["1"].recall == round(9 / 11, 4)
    assert rep["weighted avg"].support == 87


def test_key_rank_with_payload_and_tiny_samples(spark):
    """Ranks stay right when the range boundaries come from few samples and no exchange is reused."""
    n = 20_000
    df = spark.range(n).selectExpr("id", "id % 3 as k", "hash(id) as o", "repeat('x', 20) as payload")
    keep = {c: spark.conf.get(c, None) for c in
            ("spark.sql.execution.rangeExchange.sampleSizePerPartition", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            got = key_rank(df, ["k"], ["o", "id"], "r", num_partitions=8)
            w = Window.partitionBy("k").orderBy("o", "id")
            want = df.withColumn("r", F.row_number().over(w).cast("bigint"))
            assert got.select("id", "k", "r").exceptAll(want.select("id", "k", "r")).count() == 0
            assert got.count() == n
    finally:
        for c, v in keep.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_split_of_many_strata_equals_a_plain_split(spark):
    """More strata than may have thresholds, one of them with a third of the rows."""
    df = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("s"), F.col("id") % 2_001)).alias("y"), F.repeat(F.lit("x"), 50).alias("text"))
    got = {r.id: r.split for r in Sp.split(df, "id", "y").collect()}
    rows = df.withColumn("h", Sp.hash_key("id")).collect()
    of = {}
    for r in rows:
        of.setdefault(r.y, []).append((r.h, r.id))
    need = Sp.allocate({y: len(v) for y, v in of.items()}, Sp.test_size(len(rows)))
    test = {i for y, v in of.items() for _, i in sorted(v)[:need[y]]}
    assert len(of) > Sp.MANY and {i for i, s in got.items() if s == "test"} == test and len(got) == 9_000


def test_split_of_a_hundred_thousand_strata(spark):
    df = spark.range(150_000).select("id", F.concat(F.lit("s"), F.col("id") % 100_000).alias("y"))
    s = Sp.split(df, "id", "y")
    assert s.where("split = 'test'").count() == 30_000 and s.count() == 150_000
    # two rows or one a stratum: largest remainders take the pairs, ties in label order
    got = s.where("split = 'test'").groupBy("y").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert tuple(got) == (1, 30_000)


def test_split_of_an_empty_table_and_of_null_labels(spark):
    df = spark.createDataFrame([], "id long, y int")
    assert Sp.split(df, "id", "y").count() == 0 and Sp.split(df, "id").count() == 0
    with pytest.raises(ValueError):
        Sp.split(spark.createDataFrame([(1, None), (2, 1)], "id long, y int"), "id", "y")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_built_inside_the_row(spark):
    model = Fe.TermModel(("now", "win"), (1.5, 1.25), (2.0, -1.0), 3)
    df = spark.createDataFrame([(1, "Win win now"), (2, ""), (3, None), (4, "zzz")], "id long, text string")
    plan = _plan(Fe.score_linear(df, "id", "text", model)) + _plan(Fe.tfidf_rows(df, model, "id"))
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    w = [1.5, 2 * 1.25]
    norm = math.sqrt(w[0] ** 2 + w[1] ** 2)
    got = {(r.id, r.term): (r.idx, r.weight) for r in Fe.tfidf_rows(df, model, "id").collect()}
    assert got == {(1, "now"): (0, pytest.approx(w[0] / norm)), (1, "win"): (1, pytest.approx(w[1] / norm))}
    score = {r.id: r.risk_score for r in Fe.score_linear(df, "id", "text", model, 0.5).collect()}
    assert score[1] == pytest.approx(1 / (1 + math.exp(-(0.5 + (2 * w[0] - w[1]) / norm))))
    assert score[2] == score[3] == 0.0 and score[4] == pytest.approx(1 / (1 + math.exp(-0.5)))
    empty = Fe.TermModel((), (), (), 0)
    assert {r.risk_score for r in Fe.score_linear(df.where("id = 4"), "id", "text", empty).collect()} == {0.5}


def test_joined_form_for_large_vocabularies_equals_the_row_form(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    table = Fe.fitted_vocabulary(docs, "text", 300).withColumn("coef", Fe.hash_weight("term"))
    want = {r.doc_id: r.risk_score for r in Fe.score_linear(docs, "doc_id", "text", table).collect()}
    monkeypatch.setattr(Fe, "MAX_ROW_LOCAL", 299)
    got = {r.doc_id: r.risk_score for r in Fe.score_linear(docs, "doc_id", "text", table).collect()}
    assert len(got) == 200 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_rows_match_brute_force_documents(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    model = Fe.TermModel.of(Fe.fitted_vocabulary(d, "text", 500))
    vocab, idf, w = brute_tfidf({r.doc_id: r.text for r in d.collect()}, 500)
    assert list(model.terms) == vocab and model.n_docs == 200
    got = {(r.doc_id, r.term): r.weight for r in Fe.tfidf_rows(d, model, "doc_id").collect()}
    assert len(got) == len(w) and max(abs(got[k] - v) for k, v in w.items()) < 1e-12


def test_spread_deals_out_tables_of_few_row_groups(spark, tmp_dir):
    from riskline.sources.tables import spread_table, table
    cores = spark.sparkContext.defaultParallelism
    spark.range(300_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1) \
        .write.parquet(f"{tmp_dir}/one.parquet")
    spark.range(2 * cores).repartition(2 * cores).write.parquet(f"{tmp_dir}/many.parquet")
    one = spread_table(spark, tmp_dir, "one")
    assert one.rdd.getNumPartitions() == cores
    assert one.exceptAll(table(spark, tmp_dir, "one")).count() == 0 and one.count() == 300_000
    assert "Exchange" not in _plan(spread_table(spark, tmp_dir, "many"))
