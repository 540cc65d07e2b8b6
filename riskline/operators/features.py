"""Feature operators (F1-F8, K5).

Plan shape (see ``explain``):

* the vocabulary is one aggregation on ``term`` (map-side partial aggregation
  collapses hot terms before the shuffle) followed by a top-k (TakeOrdered);
  the number of fitting rows is counted in the same pass;
* a fitted vocabulary (at most ``k`` rows, ``k`` <= ``MAX_ROW_LOCAL``) is a
  model like any other: fitting it is a job, and the driver then holds its terms;
* features of a text are built inside its row: MLlib's count-vector stage looks
  the tokens up, array functions weight, normalise and score them. A text is
  tokenised once and neither its terms nor its id are ever shuffled;
* vocabularies beyond ``MAX_ROW_LOCAL`` terms are joined (explode, join, regroup).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskline.functions.text import is_blank, tokenize

DEFAULT_VOCAB_SIZE = 5000
# Most terms of a model that travels inside the plan; larger ones are joined.
MAX_ROW_LOCAL = 1 << 18


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_term_pairs(df: DataFrame, text_col: str, keep, out: str = "pairs") -> DataFrame:
    """Add ``array<struct<term string, tf bigint>>``: the distinct tokens of each text and their counts.

    Sorts the token array once per row and measures runs of equal neighbours
    with higher-order functions: O(t log t) per text, computed inside the row,
    so counting terms per document needs no shuffle at all.
    """
    s = df.select(*keep, F.sort_array(tokenize(text_col)).alias("_s"))
    s = s.select(*keep, "_s", F.size("_s").alias("_n"))
    prev = F.when(F.col("_n") > 0,
                  F.concat(F.array(F.lit(None).cast("string")),
                           F.slice("_s", 1, F.greatest(F.col("_n") - 1, F.lit(0))))
                  ).otherwise(F.array().cast("array<string>"))
    first_of_run = F.zip_with("_s", prev, lambda a, b: b.isNull() | (a != b))
    starts = F.filter(F.transform(first_of_run, lambda f, i: F.when(f, i + 1).otherwise(F.lit(-1))),
                      lambda x: x > 0)
    s = s.select(*keep, "_s", "_n", starts.alias("_st"))
    nxt = F.when(F.size("_st") > 0,
                 F.concat(F.slice("_st", 2, F.greatest(F.size("_st"), F.lit(1))), F.array(F.col("_n") + 1))
                 ).otherwise(F.array().cast("array<int>"))
    pairs = F.zip_with("_st", nxt, lambda a, b: F.struct(
        F.element_at("_s", a).alias("term"), (b - a).cast("bigint").alias("tf")))
    return s.select(*keep, pairs.alias(out))


def term_counts(df: DataFrame, id_col: str, text_col: str = "text", keep=()) -> DataFrame:
    """(id, term, tf) for every distinct token of every text (E5 + F2, unrestricted)."""
    cols = [id_col, *keep]
    # explode_outer + null filter: a plain explode makes the optimizer infer
    # ``size(pairs) > 0`` and push it into the scan, where it would re-evaluate
    # the sort inside every lambda call.
    return (with_term_pairs(df, text_col, cols)
            .select(*cols, F.explode_outer("pairs").alias("p"))
            .where(F.col("p").isNotNull())
            .select(*cols, "p.term", "p.tf"))


def vocabulary(counts: DataFrame, k: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """top-k terms by total corpus count; ties by term ascending.

    Returns (term, total, df, idx) with idx 0-based in rank order. ``counts`` is
    the (id, term, tf) frame of the fitting rows.

    The per-term aggregate combines map-side (a hot term is one row per task
    before the shuffle). The top-k is a TakeOrderedAndProject: every partition
    keeps its own k best rows and the final merge streams them through a
    k-element heap, so memory in the merging task stays O(k) at any scale.
    """
    top = (counts.groupBy("term")
                 .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
                 .orderBy(F.col("total").desc(), F.col("term").asc())
                 .limit(k))
    # The window runs over at most k rows (the limited result).
    w = Window.orderBy(F.col("total").desc(), F.col("term").asc())
    return top.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def term_totals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, total, df): every term's corpus count and number of rows; the row of the null term has the number of
    all rows as its total. One pass: each text gives its tokens, its distinct tokens, and itself."""
    none = F.array(F.lit(None).cast("string"))
    rows = df.select(tokenize(text_col).alias("_t")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("d"), F.col("_t").alias("w")), F.struct(F.lit(1).alias("d"), F.array_distinct("_t").alias("w")),
        F.struct(F.lit(0).alias("d"), none.alias("w")))).alias("_p"))
    # explode_outer: a plain explode has a filter inferred that tokenises again; the null it gives for a text
    # without tokens is taken out by the flag below
    rows = rows.select("_p.d", F.size("_p.w").alias("_n"), F.explode_outer("_p.w").alias("term")).where("_n > 0")
    return rows.groupBy("term").agg(F.sum(1 - F.col("d")).alias("total"), F.sum("d").alias("df"))


def fitted_vocabulary(df: DataFrame, text_col: str = "text", k: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """F1 + F3 in one plan: (term, total, df, idx, idf, n_docs) of the top-k terms; ties by term ascending."""
    order = [F.col("term").isNotNull(), F.col("total").desc(), F.col("term").asc()]
    top = term_totals(df, text_col).orderBy(*order).limit(k + 1)  # the row count comes first
    w = Window.orderBy(*order)  # at most k + 1 rows
    top = top.select("term", "total", "df", (F.row_number().over(w) - 2).cast("int").alias("idx"),
                     F.first("total").over(w).alias("n_docs"))
    return with_idf(top.where("term is not null"), F.col("n_docs")).select("term", "total", "df", "idx", "idf", "n_docs")


@dataclass(frozen=True)
class TermModel:
    """A fitted vocabulary in rank order with idf, and weights where there are any: bounded by the fit's k."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    coef: tuple[float, ...] | None = None
    n_docs: int = 0

    @classmethod
    def of(cls, table: DataFrame) -> TermModel | None:
        """The model in ``table`` (term, idf, and idx, coef, n_docs where present); None beyond MAX_ROW_LOCAL terms."""
        has = [c for c in ("idx", "coef", "n_docs") if c in table.columns]
        rows = table.select("term", "idf", *has).limit(MAX_ROW_LOCAL + 1).collect()
        if len(rows) > MAX_ROW_LOCAL:
            return None
        rows.sort(key=lambda r: r["idx"] if "idx" in has else r["term"])
        return cls(tuple(r["term"] for r in rows), tuple(float(r["idf"]) for r in rows),
                   tuple(float(r["coef"]) for r in rows) if "coef" in has else None,
                   int(rows[0]["n_docs"]) if rows and "n_docs" in has else 0)

    @cached_property
    def counter(self) -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(list(self.terms) or [""], inputCol="_tokens", outputCol="_tf")

    def with_weights(self, df: DataFrame, text_col: str, keep) -> DataFrame:
        """``keep`` with _at (places of the text's terms) and _w (tf * idf), both inside the row."""
        d = self.counter.transform(df.select(*keep, tokenize(text_col).alias("_tokens")))
        v = d.select(*keep, F.unwrap_udt("_tf").alias("_v"))
        idf = _numbers(self.idf)
        return v.select(*keep, F.col("_v.indices").alias("_at"), F.zip_with(
            "_v.values", "_v.indices", lambda tf, i: tf * F.get(idf, i)).alias("_w"))


def _numbers(values) -> Column:
    """Array literal, as one expression that is folded when the plan is made."""
    return F.split(F.lit(" ".join(map(repr, values)) or "0.0"), " ").cast("array<double>")


def _square(w) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)


def tfidf_rows(df: DataFrame, model: TermModel, id_col: str, text_col: str = "text") -> DataFrame:
    """F4/F5, row-local: (id, term, idx, weight) with weight = tf*idf / ||tf*idf||_2 of each text."""
    d = model.with_weights(df, text_col, [id_col]).withColumn("_norm", F.sqrt(_square("_w")))
    # the separator of the literal cannot be part of a token
    terms = F.split(F.lit("\n".join(model.terms)), "\n")
    d = d.select(id_col, "_norm", F.explode_outer(F.arrays_zip("_at", "_w")).alias("_p")).where("_p is not null")
    return d.select(id_col, F.get(terms, F.col("_p._at")).alias("term"), F.col("_p._at").alias("idx"),
                    (F.col("_p._w") / F.col("_norm")).alias("weight"))


def with_idf(vocab: DataFrame, n_docs) -> DataFrame:
    """smooth idf = ln((1 + n) / (1 + df)) + 1, n = number of fitting rows (a number or a column)."""
    n = n_docs.cast("double") if isinstance(n_docs, Column) else F.lit(float(n_docs))
    return vocab.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def tfidf(counts: DataFrame, vocab_idf: DataFrame, id_col: str) -> DataFrame:
    """F4/F5 from (id, term, tf) rows, for vocabularies of any size: (id, term, idx, weight).

    Terms outside the vocabulary are ignored; a row without any vocabulary term
    yields no entries (its vector is all-zero).
    """
    raw = (counts.join(vocab_idf.select("term", "idx", "idf"), "term")
                 .withColumn("w", F.col("tf") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", "idx", (F.col("w") / norm).alias("weight"))


def hash_weight(term) -> Column:
    """K5 fixed weight: ((first 8 hex digits of md5(term)) mod 2001 - 1000) / 250."""
    h = F.conv(F.substring(F.md5(_c(term)), 1, 8), 16, 10).cast("bigint")
    return (F.pmod(h, F.lit(2001)) - F.lit(1000)).cast("double") / F.lit(250.0)


def score_linear(df: DataFrame, id_col: str, text_col: str, model, bias: float = 0.0, keep=(),
                 blank_guard: bool = True) -> DataFrame:
    """K5/K6: sigma(b + sum_t w_t * tfidf_t) for every row of ``df``; blank text -> 0.0
    (D8) unless ``blank_guard`` is off (the struct form K7 scores blanks as sigma(b)).

    ``model`` is a ``TermModel`` or a table (term, idf, coef), which is read here once.
    Every input row is kept and scored by itself, whatever its id, without any shuffle;
    only a model of more than MAX_ROW_LOCAL terms is joined instead.
    """
    fitted = model if isinstance(model, TermModel) else TermModel.of(model)
    if fitted is None:
        return _score_joined(df, id_col, text_col, model, bias, keep, blank_guard)
    cols = [id_col, *keep]
    d = fitted.with_weights(df.select(*cols, text_col, _blank(text_col, blank_guard)), text_col, [*cols, "_blank"])
    coef = _numbers(fitted.coef)
    dot = F.aggregate(F.zip_with("_w", "_at", lambda w, i: w * F.get(coef, i)), F.lit(0.0), lambda a, x: a + x)
    return d.select(*cols, "_blank", dot.alias("_dot"), _square("_w").alias("_sq")).select(*cols, _probability(bias))


def _blank(text_col: str, guard: bool) -> Column:
    return (F.coalesce(is_blank(text_col), F.lit(True)) if guard else F.lit(False)).alias("_blank")


def _probability(bias: float) -> Column:
    z = F.lit(float(bias)) + F.when(F.col("_sq") > 0, F.col("_dot") / F.sqrt("_sq")).otherwise(F.lit(0.0))
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return F.when(F.col("_blank"), F.lit(0.0)).otherwise(prob).alias("risk_score")


def _score_joined(df, id_col, text_col, model: DataFrame, bias, keep, blank_guard) -> DataFrame:
    """``score_linear`` with a model too large for the plan: the text's terms meet it in a join and are summed by row."""
    base = df.withColumn("_blank", _blank(text_col, blank_guard)).withColumn("_row", F.monotonically_increasing_id())
    exploded = (with_term_pairs(base, text_col, ["_row", id_col, *keep, "_blank"])
                .select("_row", id_col, *keep, "_blank", F.explode_outer("pairs").alias("p")))
    joined = exploded.select("_row", id_col, *keep, "_blank", F.col("p.term").alias("term"),
                             F.col("p.tf").alias("tf")).join(model.select("term", "idf", "coef"), "term", "left")
    w = F.col("tf") * F.col("idf")
    agg = joined.groupBy("_row", id_col, *keep).agg(
        F.max("_blank").alias("_blank"),
        F.sum(F.when(w.isNotNull(), w * F.col("coef"))).alias("_dot"),
        F.sum(F.when(w.isNotNull(), w * w)).alias("_sq"))
    return agg.select(id_col, *keep, _probability(bias))


def fit_tfidf(df: DataFrame, id_col: str, text_col: str = "text", k: int = DEFAULT_VOCAB_SIZE):
    """Fit vocabulary + idf on ``df`` in one job: returns (table of the vocabulary, n_docs)."""
    model = TermModel.of(fitted_vocabulary(df, text_col, k))
    if model is None:
        raise ValueError(f"k = {k} exceeds the {MAX_ROW_LOCAL} terms of a fitted vocabulary; use fitted_vocabulary")
    n_docs = model.n_docs or df.count()  # no token at all: the vocabulary holds no row to tell
    return vocabulary_rows(df.sparkSession, model), n_docs


def vocabulary_rows(spark: SparkSession, model: TermModel) -> DataFrame:
    """(term, idx, idf) of a fitted vocabulary."""
    rows = [(t, i, w) for i, (t, w) in enumerate(zip(model.terms, model.idf))]
    return spark.createDataFrame(rows, "term string, idx int, idf double")


# ---------------------------------------------------------------------------
# Vector pooling

def masked_mean_pool_long(df: DataFrame, id_col: str, pos_col: str, vec_col: str, mask_col: str,
                          max_length: int = 128) -> DataFrame:
    """F7+F8 in long form: (id, dim, value) = sum(v*mask) / max(sum(mask), 1).

    Positions >= max_length are dropped before aggregation; an all-masked id
    gives zeros. One aggregation on (id, dim), combined map-side.
    """
    kept = df.where(F.col(pos_col) < max_length)
    long = kept.select(id_col, F.col(mask_col).cast("double").alias("_m"),
                       F.posexplode(vec_col).alias("dim", "_v"))
    return (long.groupBy(id_col, "dim")
                .agg((F.sum(F.col("_v").cast("double") * F.col("_m"))
                      / F.greatest(F.sum("_m"), F.lit(1.0))).alias("value")))


def masked_mean_pool(df: DataFrame, id_col: str, pos_col: str, vec_col: str, mask_col: str,
                     max_length: int = 128) -> DataFrame:
    """F8 as (id, pooled array<double>); each id gathers exactly D values (bounded)."""
    long = masked_mean_pool_long(df, id_col, pos_col, vec_col, mask_col, max_length)
    return (long.groupBy(id_col)
                .agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_s"))
                .select(id_col, F.transform("_s", lambda x: x["value"]).alias("pooled")))
