"""Registry of named queries over the driver tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables (or data
Spark derives from them). Computed columns carry the same names as in
``riskline.plans.oracle``; doubles are rounded to 6 places in both so the two
engines hash equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.functions import labels as L
from riskline.functions import risk as R
from riskline.functions import text as T
from riskline.operators import evaluate as Ev
from riskline.operators import features as Fe
from riskline.operators import scan as Sc
from riskline.operators import split as Sp
from riskline.operators.ranking import key_rank
from riskline.sources import extract as Ex
from riskline.sources import mail as M
from riskline.sources.tables import spread_table, table

VOCAB_K = 5000
DIGITS = 6


def _r(col, name):
    return F.round(F.col(col) if isinstance(col, str) else col, DIGITS).alias(name)


# ---------------------------------------------------------------------------
# Text (E*)

def q_clean_basic(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", T.clean_basic("text").alias("clean_text"))


def q_clean_mask(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"),
                                             F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.lit("page_url").alias("kind"),
                                         F.col("page_id").alias("id"), F.col("url").alias("text"))
    u = d.unionByName(p)
    return u.select("kind", "id", T.clean_mask("text").alias("masked"))


def _texts(spark, sf):
    """documents, dealt out for work on their texts."""
    return spread_table(spark, sf, "documents")


def q_tokens(spark, sf):
    return Fe.term_counts(_texts(spark, sf), "doc_id")


# ---------------------------------------------------------------------------
# Features (F*)

def doc_linear_model(spark, sf) -> Fe.TermModel:
    """Vocabulary + idf fitted on all documents, fixed hash weights (K5)."""
    vocab = Fe.fitted_vocabulary(_texts(spark, sf), "text", VOCAB_K)
    return Fe.TermModel.of(vocab.withColumn("coef", Fe.hash_weight("term")))


def q_vocabulary(spark, sf):
    return Fe.fitted_vocabulary(_texts(spark, sf), "text", VOCAB_K).select("term", "total", "df", "idx")


def q_idf(spark, sf):
    return Fe.fitted_vocabulary(_texts(spark, sf), "text", VOCAB_K).select("term", _r("idf", "idf"))


def q_tfidf(spark, sf):
    docs = _texts(spark, sf)
    w = Fe.tfidf_rows(docs, Fe.TermModel.of(Fe.fitted_vocabulary(docs, "text", VOCAB_K)), "doc_id")
    return w.select("doc_id", "term", _r("weight", "weight"))


def q_score_linear(spark, sf):
    s = Fe.score_linear(_texts(spark, sf), "doc_id", "text", doc_linear_model(spark, sf))
    return s.select("doc_id", _r("risk_score", "risk_score"), R.band("risk_score").alias("risk_band"))


# ---------------------------------------------------------------------------
# Labels (C2-C5) and assembly

# Derivations of raw label cells from the labels table (every row kept).
RAW_WORDS = L.PHISHING_WORDS + L.SAFE_WORDS + ["maybe", "2", "1.0", "Phishing Email", "SAFE EMAIL"]
PSEUDO_FILES = [*L.SAFE_SOURCES, *L.PHISHING_SOURCES, *M.EXCLUDED_FILES, "unknown.csv", "A b.csv"]


def _docs_labelled(spark, sf):
    return _texts(spark, sf).join(table(spark, sf, "labels"), "doc_id")


def q_assemble_text(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("urls"),
        F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.col("html")).alias("body"))
    return M.build_text(p).select("page_id", "text")


def _email_type():
    i = F.pmod("doc_id", F.lit(3))
    return (F.when(i == 0, F.when(F.col("toxic") == 1, F.lit(L.STRICT_PHISHING)).otherwise(F.lit(L.STRICT_SAFE)))
             .when(i == 1, F.when(F.col("toxic") == 1, F.lit("phishing email")).otherwise(F.lit("Safe Email ")))
             .otherwise(F.lit(None).cast("string")))


def q_strict_label(spark, sf):
    d = _docs_labelled(spark, sf).withColumn("email_type", _email_type())
    d = M.valid_text(d, "text")
    return d.select("doc_id", "email_type", L.strict_label("email_type").alias("label"))


def q_strict_label_drop(spark, sf):
    d = M.valid_text(_docs_labelled(spark, sf).withColumn("email_type", _email_type()), "text")
    return L.apply_strict_label(d, "email_type", on_unmapped="drop").select("doc_id", "label")


def _raw_word():
    w = F.element_at(F.array(*[F.lit(x) for x in RAW_WORDS]), (F.pmod("doc_id", F.lit(len(RAW_WORDS))) + 1).cast("int"))
    deco = F.pmod("doc_id", F.lit(3))
    w = (F.when(deco == 1, F.upper(w)).when(deco == 2, F.concat(F.lit("  "), w, F.lit(" "))).otherwise(w))
    return F.when(F.pmod("doc_id", F.lit(23)) == 0, F.lit(None).cast("string")).otherwise(w)


def q_normalize_label(spark, sf):
    lab = table(spark, sf, "labels")
    d = lab.select("doc_id", _raw_word().alias("raw_word"),
                   ((F.pmod("doc_id", F.lit(9)) - 3) * F.lit(0.7)).alias("raw_num"),
                   F.when(F.col("toxic") == 1, F.lit("True")).otherwise(F.lit("false")).alias("raw_bool"))
    return d.select("doc_id", "raw_word", L.normalize_label("raw_word", L.KIND_STRING).alias("word_label"),
                    _r("raw_num", "raw_num"), L.normalize_label("raw_num", L.KIND_NUMERIC).alias("num_label"),
                    "raw_bool", L.normalize_label("raw_bool", L.KIND_BOOLEAN).alias("bool_label"))


def _pseudo_file():
    n = F.substring("source", 4, 10).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in PSEUDO_FILES]),
                        (F.pmod(n, F.lit(len(PSEUDO_FILES))) + 1).cast("int"))


def q_label_from_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _pseudo_file().alias("source_file"))
    d = d.select("doc_id", "source_file", L.label_from_source("source_file").alias("label"))
    return d.where(F.col("label").isNotNull())


def q_label_precedence(spark, sf):
    """Three pseudo-files with different headers; the label rule is chosen per file."""
    d = _docs_labelled(spark, sf)
    k = F.pmod("doc_id", F.lit(4))
    word = (F.when(F.pmod("doc_id", F.lit(8)) == 0, F.lit("maybe"))
             .when(F.col("toxic") == 1, F.lit("Phishing")).otherwise(F.lit("ham")))
    files = {
        "CEAS_08.csv": d.where(k == 0).select("doc_id", F.col("text").alias("body"), word.alias("label")),
        "Nazario.csv": d.where(k == 1).select("doc_id", F.col("text").alias("body"),
                                              F.when(F.col("toxic") == 1, F.lit(L.STRICT_PHISHING))
                                               .otherwise(F.lit(L.STRICT_SAFE)).alias("Email Type")),
        "Enron.csv": d.where(k == 2).select("doc_id", F.col("text").alias("body")),
        "emails.csv": d.where(k == 3).select("doc_id", F.col("text").alias("body"), word.alias("label")),
    }
    parts = []
    for name, df in files.items():
        if name in M.EXCLUDED_FILES:
            continue
        rule = M.label_rule(df.columns, name)
        if rule is None:
            continue
        df = df.withColumn("source_file", F.lit(name))
        label = (L.normalize_label(F.col(f"`{rule[1]}`"), L.KIND_STRING) if rule[0] == "column"
                 else L.label_from_source("source_file"))
        parts.append(df.select("doc_id", "source_file", label.alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_union_sources(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    d = M.build_text(table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id", "left"))
    d = d.select(F.lit("documents").alias("source_file"), F.col("doc_id").alias("row_id"), "text", "label")
    p = M.build_text(table(spark, sf, "pages").select("page_id", F.col("url").alias("urls"), F.col("html").alias("body")))
    p = p.select(F.lit("pages").alias("source_file"), F.col("page_id").alias("row_id"), "text",
                 F.lit(None).cast("int").alias("label"))
    c = M.build_text(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    c = c.select(F.lit("conversations").alias("source_file"), (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
                 "text", F.lit(None).cast("int").alias("label"))
    return d.unionByName(p).unionByName(c)


def q_mail_ingest(spark, sf):
    """Labelled documents as CSV files of unlike headers in the shared folder, read back as one collection."""
    from riskline.session import scratch_path
    from riskline.sources.sinks import write_csv
    d = _docs_labelled(spark, sf)
    folder = scratch_path(spark, "mails")
    part = lambda k: d.where(F.pmod("doc_id", F.lit(5)) == k)
    named = F.when(F.col("toxic") == 1, F.lit(L.STRICT_PHISHING)).otherwise(F.lit(L.STRICT_SAFE))
    files = {
        "a b+c%.csv": part(0).select("doc_id", F.col("source").alias("subject"), F.col("text").alias("body"),
                                     F.col("toxic").alias("label"), F.lit("x").alias("source_file")),
        "words.csv": part(1).select(F.lit("no").alias("Body"), F.lit("no").alias("_path"), F.lit("no").alias("_kind"),
                                    F.col("text").alias("Email Text"), named.alias("Email Type")),
        "Enron.csv": part(2).select("text", F.col("source").alias("Subject"), F.col("lang").alias("sender")),
        "unknown.csv": part(3).select("text"),
        "emails.csv": part(4).select("text", F.col("toxic").alias("label")),
    }
    for name, df in files.items():
        write_csv(df, f"{folder}/{name}")
    return M.read_mail_dir(spark, folder)


def _with_injected_blanks(spark, sf):
    """documents left-joined with labels; every 10th text replaced by its whitespace
    skeleton (blank) and the next by null, so D2/D3 have rows to drop."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    d = table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id", "left")
    i = F.pmod("doc_id", F.lit(10))
    txt = (F.when(i == 0, F.regexp_replace("text", T.NON_WS_JAVA, ""))
            .when(i == 1, F.lit(None).cast("string")).otherwise(F.col("text")))
    return d.withColumn("text", txt)


def q_valid_rows(spark, sf):
    return M.drop_unusable(_with_injected_blanks(spark, sf)).select("doc_id", "label")


def q_row_counts(spark, sf):
    return Ev.row_counts(_with_injected_blanks(spark, sf), M.usable())


def q_combined_dataset(spark, sf):
    """B1: the usable rows landed as parquet by source, and as CSV, both read back."""
    from riskline.session import scratch_path
    from riskline.sources.sinks import read_combined, write_csv
    d = _docs_labelled(spark, sf).select("text", F.col("toxic").alias("label"), F.col("source").alias("source_file"))
    d = M.drop_unusable(d)
    path = M.land(d, scratch_path(spark, "combined"))
    again = read_combined(spark, write_csv(spark.read.parquet(path).select(*d.columns), scratch_path(spark, "combined-csv")))
    return again.select("source_file", "label", F.md5("text").alias("text_md5"))


def q_report_file(spark, sf):
    """B2 + J1: the scan report written as CSV and read back, with each file's place in the order of names."""
    from riskline.session import scratch_path
    from riskline.sources.sinks import read_report, write_report
    report = read_report(spark, write_report(q_scan_report(spark, sf), scratch_path(spark, "report")))
    placed = key_rank(report.withColumn("all", F.lit(0)), ["all"], ["filename"], "place")
    return placed.select("place", "filename", "risk_score", "risk_band")


def q_run_metrics(spark, sf):
    """Two runs appended to the table of runs."""
    from riskline.operators import model as Mo
    from riskline.session import scratch_path
    path = scratch_path(spark, "runs")
    for name in ("first", "second"):
        Mo.write_run_metrics(spark, path, "labels", name, Ev.accuracy_f1(_cm(spark, sf)))
    runs = spark.read.parquet(path)
    return runs.select("dataset", "model", "accuracy", "f1", F.col("ts").rlike("^[0-9]{4}(-[0-9]{2}){2} [0-9]{2}(:[0-9]{2}){2}$").alias("dated"))


def q_unreadable_inputs(spark, sf):
    """Pages through a pandas extractor that cannot read some and fails on others, under each policy."""
    p = spread_table(spark, sf, "pages").select("page_id", "html")

    def extract(s):
        import pandas as pd
        n = s.str.len()
        if (n % 11 == 0).any():
            raise ValueError("too odd")
        return pd.Series([None if k % 7 == 0 else "read %d" % k for k in n], dtype=object)

    out = None
    for policy in ("empty", "skip"):
        part = Ex.extract_text(p, extract, "html", policy).select(F.lit(policy).alias("policy"), "page_id", "status", "text")
        out = part if out is None else out.unionByName(part)
    return out


def q_class_distribution(spark, sf):
    return Ev.class_distribution(_docs_labelled(spark, sf).withColumnRenamed("toxic", "label"))


def q_rows_by_source(spark, sf):
    return Ev.rows_by_source(_docs_labelled(spark, sf), "source")


# ---------------------------------------------------------------------------
# Splits (J4, J5, H4) and hold-out transform

def _labelled_rows(spark, sf):
    return _docs_labelled(spark, sf).select("doc_id", "text", F.col("toxic").alias("label"))


def q_split_random(spark, sf):
    return Sp.split(_labelled_rows(spark, sf), "doc_id").select("doc_id", "label", "split")


def q_split_stratified(spark, sf):
    return Sp.split(_labelled_rows(spark, sf), "doc_id", "label").select("doc_id", "label", "split")


def q_split_sizes(spark, sf):
    s = Sp.split(_labelled_rows(spark, sf), "doc_id", "label")
    return Sp.split_sizes(s, "split", "label")


def q_tfidf_holdout(spark, sf):
    s = Sp.split(_labelled_rows(spark, sf), "doc_id", "label")
    train, test = s.where(F.col("split") == Sp.TRAIN), s.where(F.col("split") == Sp.TEST)
    w = Fe.tfidf_rows(test, Fe.TermModel.of(Fe.fitted_vocabulary(train, "text", VOCAB_K)), "doc_id")
    return w.select("doc_id", "term", _r("weight", "weight"))


# ---------------------------------------------------------------------------
# Scoring, bands, preview

def q_predict_struct(spark, sf):
    d = _texts(spark, sf).select("doc_id", T.clean_basic("text").alias("clean"))
    sc = Fe.score_linear(d, "doc_id", "clean", doc_linear_model(spark, sf), blank_guard=False)
    st = F.struct((F.col("risk_score") > 0.5).cast("int").alias("label"),
                  F.col("risk_score").alias("phishing_probability"))
    out = sc.select("doc_id", st.alias("prediction"))
    return out.select("doc_id", "prediction.label", _r("prediction.phishing_probability", "phishing_probability"))


def q_risk_band(spark, sf):
    s = Fe.score_linear(_texts(spark, sf), "doc_id", "text", doc_linear_model(spark, sf))
    return s.select("doc_id", T.round_score("risk_score").alias("risk_score"),
                    T.format_score("risk_score").alias("score_text"),
                    R.band("risk_score").alias("risk_band"), R.display("risk_score").alias("display"),
                    R.severity(R.band("risk_score")).alias("severity"))


def q_risk_band_grid(spark, sf):
    g = table(spark, sf, "labels").select("doc_id", (F.pmod("doc_id", F.lit(11)) / F.lit(10.0)).alias("score"))
    return g.select("doc_id", "score", R.band("score").alias("risk_band"), R.display("score").alias("display"),
                    R.severity(R.band("score")).alias("severity"), R.is_alert(R.band("score")).alias("alert"),
                    (F.col("score") > 0.5).cast("int").alias("label"))


def q_preview(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.preview("text").alias("preview"), T.display_text("text").alias("shown"))


# ---------------------------------------------------------------------------
# Metrics (H5-H8): labels.toxic is the truth, labels.quality the prediction

def _cm(spark, sf):
    return Ev.confusion(table(spark, sf, "labels"), "toxic", "quality")


def q_confusion_matrix(spark, sf):
    return Ev.confusion_long(_cm(spark, sf))


def q_accuracy_f1(spark, sf):
    m = Ev.accuracy_f1(_cm(spark, sf))
    return m.select("n_rows", _r("accuracy", "accuracy"), _r("f1", "f1"))


def q_classification_report(spark, sf):
    return Ev.classification_report(_cm(spark, sf))


# ---------------------------------------------------------------------------
# Extraction and scan report (A6, A7, K8), capture names

IMAGE_EXTS = [".png", ".JPG", ".jpeg", ".txt"]


def q_extract_page_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", Ex.page_text("html").alias("text"))


def _page_files(spark, sf):
    """pages as files with image and other names: (filename, html)."""
    p = spread_table(spark, sf, "pages")
    ext = F.element_at(F.array(*[F.lit(e) for e in IMAGE_EXTS]), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    files = p.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), ext).alias("filename"), "html")
    return files.where(Ex.is_image_name("filename"))


def q_scan_report(spark, sf):
    texts = _page_files(spark, sf).select("filename", Ex.page_text("html").alias("text"))
    s = Fe.score_linear(texts, "filename", "text", doc_linear_model(spark, sf))
    return s.select("filename", T.round_score("risk_score").alias("risk_score"),
                    R.band("risk_score").alias("risk_band"))


def q_media_scan_report(spark, sf):
    """The pages as files of bytes, through the report operator."""
    files = _page_files(spark, sf).select("filename", F.encode("html", "UTF-8").alias("content"))
    model = doc_linear_model(spark, sf)
    return Sc.scan_report(files, Sc.native(lambda c: Ex.page_text(F.decode(c, "UTF-8"))),
                          lambda d: Fe.score_linear(d, "filename", "text", model))


#: Weights of the toy encoder's four numbers.
TOY_WEIGHTS, TOY_BIAS = [0.125, -0.5, 0.25, -0.0625], -0.75


def toy_encoder():
    """Length, digits, spaces and letters e of a text, in 64ths."""
    import numpy as np

    def encode(texts):
        return np.array([[len(t), sum(c in "0123456789" for c in t), t.count(" "), t.count("e")] for t in texts],
                        dtype=np.float32) / 64
    return encode


def q_vector_scan_report(spark, sf):
    """Masked clean -> encoder -> fixed weights, through the report operator."""
    from riskline.operators import model as Mo
    from riskline.sources import cache as Ca
    files = _page_files(spark, sf)
    encoder = Ca.encoder_udf(toy_encoder)
    return Sc.scan_report(files, Sc.native(Ex.page_text), lambda d: Mo.score_vectors(
        d, encoder, TOY_WEIGHTS, TOY_BIAS, keep=["filename"]), "html")


def q_capture_names(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", T.capture_name("ts").alias("capture_name"))
    return e.groupBy("capture_name").agg(F.max_by("event_id", "ts").alias("event_id"),
                                         F.count(F.lit(1)).alias("n_writes"))


# ---------------------------------------------------------------------------
# Pooling (F7, F8) and frame sampling

def _token_vectors(spark, sf):
    """embeddings as token-level vectors: group = label, pos = 0-based rank of vec_id."""
    e = table(spark, sf, "embeddings")
    e = key_rank(e, ["label"], ["vec_id"], "pos1")
    return e.select(F.col("label").alias("group_id"), (F.col("pos1") - 1).alias("pos"), "embedding",
                    (F.pmod("vec_id", F.lit(5)) != 0).cast("int").alias("mask"))


def q_mean_pool(spark, sf):
    pooled = Fe.masked_mean_pool_long(_token_vectors(spark, sf), "group_id", "pos", "embedding", "mask", 128)
    return pooled.select("group_id", F.col("dim").cast("int").alias("dim"), _r("value", "value"))


def q_feature_cache(spark, sf):
    """A previous run cached the vectors of even vec_ids; this run serves
    those from the cache, encodes the rest (the encoder here passes the stored
    vector through) and appends them."""
    from riskline.session import scratch_path
    from riskline.sources import cache as Ca
    e = table(spark, sf, "embeddings").select("vec_id", "embedding",
                                              F.md5(F.col("vec_id").cast("string")).alias("key"))
    path = scratch_path(spark, "vector-cache")
    (e.where(F.pmod("vec_id", F.lit(2)) == 0).select("vec_id", "key", "embedding")
      .write.mode("overwrite").parquet(f"{path}/run=seed"))
    out = Ca.cached_features(e.select("vec_id", "key", "embedding"), "vec_id", "key", path,
                             lambda missing: missing, "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return out.select("vec_id", "from_cache", _r(total, "dim_sum"))


FRAME_EVERY = 30


def q_frame_sample(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    r = key_rank(e, ["user_id"], ["ts", "event_id"], "frame_no")
    return r.where(F.col("frame_no") % FRAME_EVERY == 0).select("user_id", "event_id", "frame_no")


# ---------------------------------------------------------------------------
# Alerts and latest state (D7, L5, L6) on conversations scored by K5

def _scored_conversations(spark, sf):
    c = spread_table(spark, sf, "conversations")
    s = Fe.score_linear(c, "conv_id", "text", doc_linear_model(spark, sf), keep=("turn",))
    return s.withColumn("risk_band", R.band("risk_score"))


def q_alerts(spark, sf):
    s = _scored_conversations(spark, sf)
    return s.where(R.is_alert("risk_band")).select("conv_id", "turn", _r("risk_score", "risk_score"), "risk_band")


def q_latest_state(spark, sf):
    s = _scored_conversations(spark, sf)
    last = s.groupBy("conv_id").agg(F.max_by(F.struct("turn", "risk_score", "risk_band"), "turn").alias("s"))
    return last.select("conv_id", "s.turn", _r("s.risk_score", "risk_score"), "s.risk_band")


# ---------------------------------------------------------------------------
# MLlib fits (K1-K4): iterative, so rows-only checks plus gradient tests in pytest

def _lr_tfidf(spark, sf):
    from riskline.operators import model as Mo
    return Mo.train(_labelled_rows(spark, sf), "doc_id", "text", "label", stratify=True,
                    max_iter=Mo.MAX_ITER_TFIDF)


def q_lr_tfidf_fit(spark, sf):
    from riskline.operators import model as Mo
    return Mo.coefficients(spark, _lr_tfidf(spark, sf).model)


def q_lr_tfidf_eval(spark, sf):
    return _lr_tfidf(spark, sf).report


def q_lr_classify(spark, sf):
    from riskline.operators import model as Mo
    m = _lr_tfidf(spark, sf).model
    s = Mo.classify(table(spark, sf, "documents").select("doc_id", "text"), m, "text", keep=["doc_id"])
    return s.select("doc_id", _r("risk_score", "risk_score"), "risk_band")


def q_lr_vectors_fit(spark, sf):
    from riskline.operators import model as Mo
    return Mo.train_vectors(_labelled_vectors(spark, sf), "vec_id", "embedding", "label").report


def q_lr_tfidf_optimal(spark, sf):
    """Every feature's gradient at the fitted weights, on the rows of the fit."""
    from riskline.operators import model as Mo
    rows = _labelled_rows(spark, sf)
    fit_rows = Sp.split(rows, "doc_id", "label").where(F.col("split") == Sp.TRAIN)
    return Mo.optimality(_lr_tfidf(spark, sf).model, fit_rows).select("feature", "optimal")


def _labelled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))


def q_lr_vectors_optimal(spark, sf):
    from riskline.operators import model as Mo
    rows = _labelled_vectors(spark, sf)
    fit_rows = Sp.split(rows, "vec_id", "label").where(F.col("split") == Sp.TRAIN)
    return Mo.optimality(Mo.train_vectors(rows, "vec_id", "embedding").model, fit_rows).select("feature", "optimal")


def q_model_roundtrip(spark, sf):
    """A model published and loaded again scores every document as before."""
    from riskline.operators import model as Mo
    from riskline.session import scratch_path
    path = scratch_path(spark, "published")
    m = Mo.train_variant(_labelled_rows(spark, sf), "doc_id", "baseline").model
    Mo.save(m, path, "baseline", spark)
    again, variant = Mo.load(spark, path)
    docs = _texts(spark, sf).select("doc_id", "text")
    both = Mo.classify(Mo.classify(docs, m).withColumnsRenamed({"risk_score": "before", "risk_band": "band"})
                       .select("doc_id", "text", "before", "band"), again)
    return both.select("doc_id", F.lit(variant).alias("variant"), (F.col("before") == F.col("risk_score")).alias("equal"),
                       (F.col("band") == F.col("risk_band")).alias("equal_band"))


def q_score_linear_blanks(spark, sf):
    """K5 with blank and null texts among the rows: they score 0.0."""
    d = _with_injected_blanks(spark, sf)
    s = Fe.score_linear(d, "doc_id", "text", doc_linear_model(spark, sf))
    return s.select("doc_id", _r("risk_score", "risk_score"), R.band("risk_score").alias("risk_band"))


def q_split_by_source(spark, sf):
    """J5 with many strata."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return Sp.split(d, "doc_id", "source").select("doc_id", "source", "split")


# ---------------------------------------------------------------------------
# Streaming (L3-L8): availableNow runs into the shared checkpoint folder, read back

#: Micro-batches in which a table is streamed.
BATCHES = 4


def _as_stream(spark, sf, name, cols, order):
    """A table as a stream of several files in the shared folder, each a range of ``order``. Files that one job writes
    arrive in no certain order; each trigger takes some of them."""
    from riskline.session import scratch_path
    from riskline.streaming import stream as St
    files = max(2 * BATCHES, spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, f"stream-{name}")
    df = table(spark, sf, name).select(*cols)
    df.repartitionByRange(files, *order).write.parquet(path)
    return St.file_stream(spark, path, schema=df.schema, max_files_per_trigger=-(-files // BATCHES))


def _monitor_conversations(spark, sf) -> str:
    from riskline.session import scratch_path
    from riskline.streaming import stream as St
    model = doc_linear_model(spark, sf)
    out, ck = scratch_path(spark, "monitor"), scratch_path(spark, "monitor-ckpt")
    src = _as_stream(spark, sf, "conversations", ["conv_id", "turn", "text"], ["turn", "conv_id"])

    def scorer(batch):
        s = Fe.score_linear(batch, "conv_id", "text", model, keep=("turn",))
        return s.withColumn("risk_band", R.band("risk_score"))

    q = St.monitor(src, scorer, out, ck, key="conv_id", order="turn", trigger="availableNow")
    q.awaitTermination()
    return out


def q_stream_score(spark, sf):
    out = _monitor_conversations(spark, sf)
    s = spark.read.parquet(f"{out}/scores")
    return s.select("conv_id", "turn", _r("risk_score", "risk_score"), "risk_band")


def q_stream_alerts(spark, sf):
    out = _monitor_conversations(spark, sf)
    s = spark.read.parquet(f"{out}/alerts")
    return s.select("conv_id", "turn", _r("risk_score", "risk_score"), "risk_band")


def q_stream_latest_state(spark, sf):
    from riskline.streaming import stream as St
    s = St.read_state(spark, _monitor_conversations(spark, sf), "conv_id", "turn")
    return s.select("conv_id", "turn", _r("risk_score", "risk_score"), "risk_band")


def q_stream_dead_letter(spark, sf):
    """Conversations through an extractor that fails on every 5th turn at first, cannot read every 7th, and recovers
    but for every 10th: after one replay, what each turn came to and after how many attempts."""
    from riskline.session import scratch_path
    from riskline.streaming import stream as St
    model = doc_linear_model(spark, sf)
    out, ck = scratch_path(spark, "letters"), scratch_path(spark, "letters-ckpt")
    src = _as_stream(spark, sf, "conversations", ["conv_id", "turn", "text"], ["conv_id", "turn"])
    n = F.col("conv_id") * 31 + F.col("turn")

    def extract(df, every):
        failed, unread = F.pmod(n, F.lit(every)) == 0, F.pmod(n, F.lit(7)) == 0
        return (df.withColumn("text", F.when(failed | unread, F.lit("")).otherwise(F.col("raw")))
                .withColumn("status", F.when(failed, F.lit(Ex.STATUS_ERROR)).when(unread, F.lit(Ex.STATUS_UNREADABLE))
                            .otherwise(F.lit(Ex.STATUS_OK)))
                .withColumn("error", F.when(failed, F.lit("extractor failed"))))

    def scorer(batch):
        s = Fe.score_linear(batch, "conv_id", "text", model, keep=("turn",))
        return s.withColumn("risk_band", R.band("risk_score"))

    St.monitor(extract(src.withColumnRenamed("text", "raw"), 5), scorer, out, ck, key="conv_id", order="turn",
               trigger="availableNow").awaitTermination()
    St.replay(spark, out, lambda d: extract(d, 10), scorer, "conv_id", "turn", 0)
    scores = spark.read.parquet(f"{out}/scores")
    attempts = F.when(F.col("batch_id") >= St.REPLAYS, 2).otherwise(1)
    left = St.open_letters(spark, out, "conv_id", "turn")
    done = scores.select("conv_id", "turn", F.lit("scored").alias("came_to"), attempts.alias("attempts"),
                         _r("risk_score", "risk_score"), "risk_band")
    return done.unionByName(left.select("conv_id", "turn", F.lit("open").alias("came_to"), F.col("attempt").alias("attempts"),
                                        F.lit(None).cast("double").alias("risk_score"),
                                        F.lit(None).cast("string").alias("risk_band")))


def q_stream_frame_sample(spark, sf):
    """Frames arrive in time order, a quarter of them between two runs; each run goes on from the checkpoint."""
    from riskline.session import scratch_path
    from riskline.streaming import stream as St
    src, out, ck = (scratch_path(spark, n) for n in ("stream-events", "frames", "frames-ckpt"))
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.select(at.alias("at")).approxQuantile("at", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = e.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        part.write.mode("append").parquet(src)
        frames = St.file_stream(spark, src, schema=e.schema)
        St.count_frames(frames, "user_id", ["ts", "event_id"], out, ck, FRAME_EVERY).awaitTermination()
    return St.read_frames(spark, out).select("user_id", "event_id", "frame_no")


def q_stream_capture_names(spark, sf):
    """Files arrive in no order of time."""
    from riskline.session import scratch_path
    from riskline.streaming import stream as St
    src = _as_stream(spark, sf, "events", ["event_id", "ts"], ["event_id"])
    out, ck = scratch_path(spark, "captures"), scratch_path(spark, "captures-ckpt")
    St.capture_stream(src, "ts", "event_id", out, ck).awaitTermination()
    return St.read_captures(spark, out, "event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_basic": q_clean_basic,
    "clean_mask": q_clean_mask,
    "assemble_text": q_assemble_text,
    "strict_label": q_strict_label,
    "normalize_label": q_normalize_label,
    "label_from_source": q_label_from_source,
    "label_precedence": q_label_precedence,
    "union_sources": q_union_sources,
    "valid_rows": q_valid_rows,
    "row_counts": q_row_counts,
    "class_distribution": q_class_distribution,
    "rows_by_source": q_rows_by_source,
    "tokens": q_tokens,
    "vocabulary": q_vocabulary,
    "idf": q_idf,
    "tfidf": q_tfidf,
    "tfidf_holdout": q_tfidf_holdout,
    "split_random": q_split_random,
    "split_stratified": q_split_stratified,
    "split_sizes": q_split_sizes,
    "score_linear": q_score_linear,
    "predict_struct": q_predict_struct,
    "risk_band": q_risk_band,
    "risk_band_grid": q_risk_band_grid,
    "preview": q_preview,
    "confusion_matrix": q_confusion_matrix,
    "accuracy_f1": q_accuracy_f1,
    "classification_report": q_classification_report,
    "extract_page_text": q_extract_page_text,
    "scan_report": q_scan_report,
    "capture_names": q_capture_names,
    "mean_pool": q_mean_pool,
    "feature_cache": q_feature_cache,
    "frame_sample": q_frame_sample,
    "alerts": q_alerts,
    "latest_state": q_latest_state,
    "stream_score": q_stream_score,
    "stream_alerts": q_stream_alerts,
    "stream_latest_state": q_stream_latest_state,
    "stream_frame_sample": q_stream_frame_sample,
    "stream_capture_names": q_stream_capture_names,
    "lr_tfidf_fit": q_lr_tfidf_fit,
    "lr_tfidf_eval": q_lr_tfidf_eval,
    "lr_classify": q_lr_classify,
    "lr_vectors_fit": q_lr_vectors_fit,
    "mail_ingest": q_mail_ingest,
    "strict_label_drop": q_strict_label_drop,
    "combined_dataset": q_combined_dataset,
    "report_file": q_report_file,
    "run_metrics": q_run_metrics,
    "unreadable_inputs": q_unreadable_inputs,
    "stream_dead_letter": q_stream_dead_letter,
    "lr_tfidf_optimal": q_lr_tfidf_optimal,
    "lr_vectors_optimal": q_lr_vectors_optimal,
    "model_roundtrip": q_model_roundtrip,
    "score_linear_blanks": q_score_linear_blanks,
    "split_by_source": q_split_by_source,
    "media_scan_report": q_media_scan_report,
    "vector_scan_report": q_vector_scan_report,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
