import os

from pyspark.sql import functions as F

from paths import SF001
from riskline.plans import catalog as C
from riskline.sources import sinks as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_round_trip(spark, tmp_dir):
    rep = C.q_scan_report(spark, SF001)
    p = S.write_report(rep, os.path.join(tmp_dir, "report"))
    back = S.read_report(spark, p)
    assert back.exceptAll(rep).count() == 0 and rep.exceptAll(back).count() == 0


def test_csv_keeps_quotes_and_newlines(spark, tmp_dir):
    df = spark.createDataFrame([('say "hi"\nthere', 1, "a.csv")], "text string, label int, source_file string")
    p = S.write_csv(df, os.path.join(tmp_dir, "combined"))
    back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema("text string, label int, source_file string").csv(p))
    assert back.first().text == 'say "hi"\nthere'


def test_text_operators_stay_in_the_jvm(spark):
    for q in ("clean_basic", "clean_mask", "tokens", "vocabulary", "score_linear", "extract_page_text"):
        plan = _plan(C.QUERIES[q](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, q


def test_scoring_is_a_projection_of_a_pruned_scan(spark):
    df = C.q_score_linear(spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = _plan(df)
    assert not any(node in plan for node in ("Join", "Aggregate", "hashpartitioning", "rangepartitioning", "Window"))
    # only doc_id and text are read from documents
    assert "struct<doc_id:bigint,text:string>" in plan


def test_top_k_of_the_vocabulary_is_taken_in_order(spark):
    plan = _plan(C.q_vocabulary(spark, SF001))
    assert "TakeOrderedAndProject" in plan and "struct<text:string>" in plan


def test_pushed_filter_reaches_scan(spark):
    from riskline.sources.tables import table
    df = table(spark, SF001, "labels").where(F.col("toxic") == 1).select("doc_id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in plan


def test_no_single_partition_exchange_in_split_and_rank(spark):
    for q in ("split_stratified", "frame_sample", "mean_pool"):
        df = C.QUERIES[q](spark, SF001)
        df.write.format("noop").mode("overwrite").save()
        assert "SinglePartition" not in _plan(df), q


def test_bucketed_landing_joins_without_shuffle(spark, tmp_dir):
    from riskline.sources.tables import land_bucketed, table
    docs = land_bucketed(table(spark, SF001, "documents").select("doc_id", "text"), "docs_b", "doc_id", 4,
                         os.path.join(tmp_dir, "docs_b"))
    labs = land_bucketed(table(spark, SF001, "labels"), "labels_b", "doc_id", 4, os.path.join(tmp_dir, "labels_b"))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = docs.join(labs, "doc_id")
        j.write.format("noop").mode("overwrite").save()
        plan = _plan(j)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 87
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
