"""Learning and scoring with MLlib.

The fitted artefact is one ``PipelineModel``:

    SQLTransformer (tokens, same regex as ``functions.text.tokenize``)
    -> CountVectorizerModel.from_vocabulary (our top-k list: ties by term)
    -> ElementwiseProduct (smooth idf: MLlib's IDF lacks the +1)
    -> Normalizer(p=2)
    -> LogisticRegressionModel

Logistic regression matches an L2 objective with C = 1 and an unpenalised
intercept: Spark minimises mean loss + regParam/2 * ||w||^2, so
regParam = 1 / (C * n_train) with standardization off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskline.functions import risk as R
from riskline.functions.text import TOKEN, clean_basic, clean_mask, report_time
from riskline.operators import evaluate as Ev
from riskline.operators import features as Fe
from riskline.operators import split as Sp

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
C_DEFAULT = 1.0
MAX_ITER_LIBRARY_DEFAULT = 100
MAX_ITER_TFIDF = 1000
MAX_ITER_VECTORS = 2000
PROBABILITY_CUT = 0.5  # class 1 iff p > 0.5 (strict)
# ---------------------------------------------------------------------------
# K9: the reference's training set-ups, as parameters of ``train``.
VARIANT_PARAMS = {
    # single mail CSV, strict labels, random split, library-default iterations
    "baseline": dict(stratify=False, fit_on="train", max_iter=MAX_ITER_LIBRARY_DEFAULT),
    # many CSVs, normalised labels, stratified split
    "enhanced": dict(stratify=True, fit_on="train", max_iter=MAX_ITER_TFIDF),
    # scoring scripts refit on every row with default iterations
    "serve": dict(stratify=False, fit_on="all", max_iter=MAX_ITER_LIBRARY_DEFAULT),
    # load-or-train fallback: every row, 1000 iterations
    "fallback": dict(stratify=False, fit_on="all", max_iter=MAX_ITER_TFIDF),
    # encoder vectors of the texts, stratified split
    "vectors": dict(stratify=True, max_iter=MAX_ITER_VECTORS),
}
VARIANTS = tuple(VARIANT_PARAMS)
TOL = 1e-7  # solver tolerance: close to the exact L2 optimum
GRADIENT = 1e-4  # a fit is optimal if no feature's gradient exceeds this per row


def vectorizer_stages(vocab: Fe.TermModel, text_col: str = "text", features_col: str = "features"):
    """Stages turning ``text_col`` into L2-normalised tf-idf vectors of a fitted vocabulary."""
    terms, idf = list(vocab.terms), list(vocab.idf)
    tokens_sql = ("SELECT *, regexp_extract_all(lower(coalesce(`" + text_col + "`, '')), r'" + TOKEN
                  + "', 0) AS _tokens FROM __THIS__")
    return [
        SQLTransformer(statement=tokens_sql),
        CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol="_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol=features_col),
    ]


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage from an array column to a vector column, so that a saved vector model scores arrays."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol())))


def fit_lr(df: DataFrame, features_col: str = "features", label_col: str = "label", C: float = C_DEFAULT,
           max_iter: int = MAX_ITER_LIBRARY_DEFAULT, tol: float = TOL, n: int | None = None):
    """K1/K2: binary logistic regression with L2 (C), intercept not penalised."""
    n = n if n is not None else df.count()
    lr = LogisticRegression(featuresCol=features_col, labelCol=label_col, family="binomial",
                            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False,
                            fitIntercept=True, maxIter=max_iter, tol=tol)
    return lr.fit(df)


@dataclass
class TrainResult:
    model: PipelineModel
    n_train: int
    n_test: int
    confusion: DataFrame | None      # one row (tn, fp, fn, tp) on the test rows
    metrics: DataFrame | None        # (n_rows, accuracy, f1)
    report: DataFrame | None         # classification report rows


def _materialise_cm(model: PipelineModel, test: DataFrame, label_col: str) -> DataFrame:
    """The four confusion cells, computed now (one aggregate) so the metrics do
    not depend on inputs that are unpersisted afterwards."""
    spark = test.sparkSession
    row = Ev.confusion(model.transform(test), label_col, "prediction").first()
    return spark.createDataFrame([tuple(int(x) for x in row)], "tn long, fp long, fn long, tp long")


def _rows_in(cm: DataFrame) -> int:
    """Rows the four cells hold."""
    return int(sum(cm.first()))


def train(df: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label",
          stratify: bool = True, fit_on: str = "train", max_iter: int = MAX_ITER_TFIDF,
          k: int = Fe.DEFAULT_VOCAB_SIZE, C: float = C_DEFAULT, tol: float = TOL) -> TrainResult:
    """Split -> vocabulary/idf on the fitting rows -> tf-idf -> logistic regression -> metrics.

    ``fit_on='all'`` fits on every row (the serving variants) and skips the
    evaluation; otherwise an exact 80/20 split (stratified or random).
    """
    # The labelled rows feed the split passes, the vocabulary, the vectoriser
    # and the evaluation: read (and join) them once, spill to disk if needed.
    data = df.select(id_col, text_col, label_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if fit_on == "all":
            fit_rows, test = data, None
        else:
            s = Sp.split(data, id_col, label_col if stratify else None)
            fit_rows = s.where(F.col("split") == Sp.TRAIN).drop("split")
            test = s.where(F.col("split") == Sp.TEST).drop("split")
        vocab = Fe.TermModel.of(Fe.fitted_vocabulary(fit_rows, text_col, k))
        n_train = vocab.n_docs
        stages = vectorizer_stages(vocab, text_col)
        vec = PipelineModel(stages)
        train_vec = vec.transform(fit_rows).select("features", F.col(label_col).cast("double").alias(label_col))
        train_vec = train_vec.cache()
        try:
            lr_model = fit_lr(train_vec, "features", label_col, C, max_iter, tol, n_train)
        finally:
            train_vec.unpersist()
        model = PipelineModel(stages + [lr_model])
        if test is None:
            return TrainResult(model, n_train, 0, None, None, None)
        cm = _materialise_cm(model, test, label_col)
        return TrainResult(model, n_train, _rows_in(cm), cm, Ev.accuracy_f1(cm), Ev.classification_report(cm))
    finally:
        data.unpersist()


def train_variant(df: DataFrame, id_col: str, variant: str, text_col: str = "text",
                  label_col: str = "label", vec_col: str = "embedding") -> TrainResult:
    """K9: train with one of the named set-ups in ``VARIANT_PARAMS``; ``vectors`` reads ``vec_col`` in place of text."""
    if variant not in VARIANT_PARAMS:
        raise ValueError(f"variant must be one of {sorted(VARIANT_PARAMS)}")
    if variant == "vectors":
        return train_vectors(df, id_col, vec_col, label_col, **VARIANT_PARAMS[variant])
    return train(df, id_col, text_col, label_col, **VARIANT_PARAMS[variant])


def train_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str = "label",
                  stratify: bool = True, max_iter: int = MAX_ITER_VECTORS, C: float = C_DEFAULT,
                  tol: float = TOL) -> TrainResult:
    """K2: logistic regression on pooled vectors (``array<float>``)."""
    # read once for the split passes, the fit and the evaluation
    to_vector = ArrayToVector(inputCol=vec_col, outputCol="features")
    data = (df.select(id_col, label_col, vec_col).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        s = Sp.split(data, id_col, label_col if stratify else None)
        fit_rows = s.where(F.col("split") == Sp.TRAIN)
        test = s.where(F.col("split") == Sp.TEST)
        train_vec = (to_vector.transform(fit_rows).select("features", F.col(label_col).cast("double").alias(label_col))
                     .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            n_train = train_vec.count()
            lr_model = fit_lr(train_vec, "features", label_col, C, max_iter, tol, n_train)
        finally:
            train_vec.unpersist()
        model = PipelineModel([to_vector, lr_model])
        cm = _materialise_cm(model, test, label_col)
        return TrainResult(model, n_train, _rows_in(cm), cm, Ev.accuracy_f1(cm), Ev.classification_report(cm))
    finally:
        data.unpersist()


def probability(col="probability"):
    """K4: probability of class 1."""
    return vector_to_array(F.col(col)).getItem(1)


def classify(df: DataFrame, model: PipelineModel, text_col: str = "text", keep=None) -> DataFrame:
    """K6: blank short-circuit, else P(class 1); adds risk_score and risk_band."""
    out = model.transform(df)
    score = R.blank_guard(text_col, probability())
    cols = keep if keep is not None else df.columns
    return out.select(*cols, score.alias("risk_score")).withColumn("risk_band", R.band("risk_score"))


def predict_struct(df: DataFrame, model: PipelineModel, text_col: str = "text", keep=None) -> DataFrame:
    """K7: E1-clean, then struct(label, phishing_probability); blank text is scored too."""
    cols = keep if keep is not None else [c for c in df.columns if c != text_col]
    cleaned = df.withColumn(text_col, clean_basic(text_col))
    out = model.transform(cleaned)
    st = F.struct(F.col("prediction").cast("int").alias("label"),
                  probability().alias("phishing_probability"))
    return out.select(*cols, st.alias("prediction"))


def classify_vectors(df: DataFrame, model: PipelineModel, encoder, text_col: str = "text",
                     vec_col: str = "embedding", keep=None) -> DataFrame:
    """K6, vector form: blank guard, else masked clean (E2) -> ``encoder`` -> P(class 1); adds risk_score and risk_band.

    ``encoder`` is a column function from texts to arrays (``cache.encoder_udf``); ``model`` is a pipeline
    of ``train_vectors``, which reads ``vec_col``.
    """
    cols = keep if keep is not None else df.columns
    out = model.transform(with_vectors(df, encoder, text_col, vec_col))
    score = R.blank_guard(text_col, probability())
    return out.select(*cols, score.alias("risk_score")).withColumn("risk_band", R.band("risk_score"))


def with_vectors(df: DataFrame, encoder, text_col: str = "text", vec_col: str = "embedding") -> DataFrame:
    """Add the encoder's vector of every masked, cleaned text (null: empty)."""
    clean = clean_mask(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn(vec_col, encoder(clean))


def score_vectors(df: DataFrame, encoder, weights: list[float], bias: float = 0.0, text_col: str = "text",
                  keep=None) -> DataFrame:
    """K6, vector form, with given weights: sigma(b + w . v), blank text 0.0; adds risk_score and risk_band."""
    cols = keep if keep is not None else df.columns
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with("_vec", w, lambda v, x: v.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(bias)) + dot)))
    out = with_vectors(df, encoder, text_col, "_vec")
    return out.select(*cols, R.blank_guard(text_col, p).alias("risk_score")).withColumn("risk_band", R.band("risk_score"))


def optimality(model: PipelineModel, rows: DataFrame, label_col: str = "label", C: float = C_DEFAULT) -> DataFrame:
    """Certificate of a fit on ``rows``: (feature, gradient, optimal) for every feature and the intercept.

    The gradient of 1/2 |w|^2 + C sum(loss), taken per row: (w + C sum (p - y) x) / n, and without w for the
    intercept. One aggregation over the non-zero features, combined before the shuffle; the weights (one a
    feature) meet its result. Features no row has keep their weight as gradient.
    """
    spark = rows.sparkSession
    v = F.unwrap_udt("features")
    d = model.transform(rows).select(v.alias("v"), (F.lit(C) * (probability() - F.col(label_col))).alias("r"))
    at = F.coalesce(F.col("v.indices"), F.sequence(F.lit(0), F.size("v.values") - 1))
    # the intercept is the feature -1, which every row has
    d = d.select("r", F.explode(F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("i"),
                                             F.concat(F.array(F.lit(1.0)), "v.values").alias("x"))).alias("f"))
    sums = d.groupBy(F.col("f.i").alias("idx")).agg(F.sum(F.col("r") * F.col("f.x")).alias("g"),
                                                    F.count(F.lit(1)).alias("rows"))
    named = coefficients(spark, model).join(sums, "idx", "left")  # one row a feature
    n = F.max("rows").over(Window.partitionBy())  # the intercept's count is the number of rows
    w = F.when(F.col("idx") < 0, F.lit(0.0)).otherwise(F.col("coef"))
    g = (w + F.coalesce("g", F.lit(0.0))) / n
    name = F.when(F.col("idx") < 0, F.lit("(intercept)")).otherwise(F.coalesce("term", F.concat(F.lit("v"), F.col("idx"))))
    return named.select(name.alias("feature"), g.alias("gradient"), (F.abs(g) < GRADIENT).alias("optimal"))


def coefficients(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(term, idx, coef) of a tf-idf pipeline plus the intercept row (term NULL)."""
    cv = [s for s in model.stages if isinstance(s, CountVectorizerModel)]
    lr = model.stages[-1]
    coef = lr.coefficients.toArray().tolist()
    terms = cv[0].vocabulary if cv else [None] * len(coef)
    rows = [(t, i, float(c)) for i, (t, c) in enumerate(zip(terms, coef))]
    rows.append((None, -1, float(lr.intercept)))
    return spark.createDataFrame(rows, "term string, idx int, coef double")


# Published models -----------------------------------------------------------------
# path/v=<n>/pipeline and path/v=<n>/variant are written first, path/current/n=<n> (an empty marker) last.

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    p, fs = _fs(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def _claim(spark: SparkSession, path: str) -> int:
    """A version number of one's own: the folder is made by whoever creates its claim file first."""
    n = (_numbers(spark, path, "v=") or [0])[-1] + 1
    while True:
        p, fs = _fs(spark, f"{path}/v={n}/claim")
        try:
            fs.create(p, False).close()  # fails where the file exists
            return n
        except Exception as e:  # noqa: BLE001 - raised through the gateway; another trainer may hold the number
            if not fs.exists(p):
                raise e
            n += 1


def save(model: PipelineModel, path: str, variant: str, spark: SparkSession | None = None) -> int:
    """Publish vectoriser, classifier and variant as a new version; returns its number.

    Each version is written under a number of its own and pointed to only when it is
    complete, so a torn save is never loaded and two trainers never mix their files.
    The version with the highest pointer is current; older ones stay for who reads them.
    """
    spark = spark or SparkSession.getActiveSession()
    n = _claim(spark, path)
    model.write().overwrite().save(f"{path}/v={n}/pipeline")
    spark.createDataFrame([(variant,)], "variant string").write.mode("overwrite").parquet(f"{path}/v={n}/variant")
    p, fs = _fs(spark, f"{path}/current/n={n}")
    fs.create(p, True).close()
    return n


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, str] | None:
    """The current version (model, variant), or None where nothing has been published."""
    done = _numbers(spark, f"{path}/current", "n=")
    if not done:
        return None
    at = f"{path}/v={done[-1]}"
    return PipelineModel.load(f"{at}/pipeline"), spark.read.parquet(f"{at}/variant").first()["variant"]


def load_or_train(spark: SparkSession, path: str, train_fn, variant: str = "enhanced"):
    """A10: load the published pipeline if there is one, else train (``train_fn() -> PipelineModel``) and publish.

    Returns (model, variant). The recorded variant is the one actually trained.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    found = load(spark, path)
    if found:
        return found
    model = train_fn()
    save(model, path, variant, spark)
    return model, variant


def write_run_metrics(spark: SparkSession, path: str, dataset: str, model_name: str,
                      metrics: DataFrame) -> None:
    """Append one row (dataset, model, accuracy, f1, ts) to a metrics table."""
    row = metrics.select(F.lit(dataset).alias("dataset"), F.lit(model_name).alias("model"),
                         F.round("accuracy", 3).alias("accuracy"), F.round("f1", 3).alias("f1"),
                         report_time(F.current_timestamp()).alias("ts"))
    row.write.mode("append").parquet(path)
