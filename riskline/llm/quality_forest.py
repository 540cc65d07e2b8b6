"""Quality rules judged by an isolation forest over rule statistics.

``rule_statistics`` counts words, symbols, repeated lines and repeated words of
every whole text. An isolation forest (random axis-parallel splits on small
subsamples) is grown from the statistics of rows labelled good; a document whose
mean path is short differs from them. Cuts are drawn beyond a node's rows as
well, so a row outside all that was seen parts from them early, also in a
statistic that never varies among good rows. The score threshold is set from the
score histogram of all labelled rows of the half of the ids that the forest was
not grown from: the best separation of good and bad labels among thresholds that
reject at most ``max_false_reject`` of the good ones.

Defined results: null or empty text has zero counts and fails the base rule;
repeated ids give one row each; an empty table gives no rows; without labels of
both kinds nothing but the base rule rejects (threshold 1). Extra columns are
ignored. A null id is scored like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskline.llm.common import WORD_BYTES, documents, materialize, remainder

SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
FEATURES = ["word_len", "symbols", "dup_lines", "repeats", "log_words"]
BINS = 2000
#: A node's rows are taken to span at least this share of the good rows' middle 98 %, and this much in any case.
LEAST_SHARE, LEAST_SPAN = 0.05, 0.05


def repeated_words(words: list[bytes]) -> int:
    """Words lying in a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * len(seen) + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= hit
    return int(inside.sum())


def text_statistics(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(WORD_BYTES):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, WORD_BYTES)), sum(map(text.count, SYMBOLS)),
            dup, repeated_words(words), lines)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in STATS.split(", ")]
    for b in batches:
        rows = [text_statistics(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *names])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule counts of each whole text."""
    d = documents(docs)
    return d.mapInArrow(_statistics, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {STATS}")


def _feature_columns() -> list:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return [(F.col("word_chars") / n).alias("word_len"), (F.col("n_symbols") / n).alias("symbols"),
            (F.col("n_dup_lines") / lines).alias("dup_lines"),
            (F.col("n_repeat_words") / n).alias("repeats"), F.log1p(F.col("n_words")).alias("log_words")]


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Arrays of nodes; ``score`` walks all rows level by level.

    A cut falls anywhere within the span of a node's rows or one such span beside it.
    """

    def __init__(self, x: np.ndarray, trees: int, subsample: int, seed: int):
        rng = np.random.default_rng(seed)
        self.psi = min(subsample, len(x))
        depth = max(1, math.ceil(math.log2(max(self.psi, 2))))
        low, high = np.quantile(x, [0.01, 0.99], axis=0)
        least = np.maximum(LEAST_SHARE * (high - low), LEAST_SPAN)
        self.trees = [self._grow(x[rng.choice(len(x), self.psi, replace=False)], depth, least, rng)
                      for _ in range(trees)]

    @staticmethod
    def _grow(x, depth, least, rng):
        feat, cut, left, path = [], [], [], []

        def node():
            for a, v in ((feat, -1), (cut, 0.0), (left, -1), (path, 0.0)):
                a.append(v)
            return len(feat) - 1

        todo = [(node(), x, 0)]
        while todo:
            k, rows, d = todo.pop()
            if d >= depth or len(rows) <= 1:
                path[k] = d + average_path(len(rows))
                continue
            lo, hi = rows.min(0), rows.max(0)
            beside = np.maximum(hi - lo, least)
            f = int(rng.integers(x.shape[1]))
            c = float(rng.uniform(lo[f] - beside[f], hi[f] + beside[f]))
            below = rows[:, f] < c
            feat[k], cut[k] = f, c
            left[k] = node()
            node()
            todo += [(left[k], rows[below], d + 1), (left[k] + 1, rows[~below], d + 1)]
        return np.array(feat), np.array(cut), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that isolate at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feat, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feat[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[at] + (x[rows, np.maximum(f, 0)] >= cut[at])
                at = np.where(inner, step, at)
            total += path[at]
        return 2.0 ** (-(total / max(1, len(self.trees))) / max(average_path(self.psi), 1e-9))


def fit_forest(good: DataFrame, train_rows: int = 8192, trees: int = 100, subsample: int = 256,
               seed: int = 11) -> Forest | None:
    """A forest from at most ``train_rows`` good rows (smallest hashes of the id)."""
    # a hash range that holds about twice the wanted rows: tasks send no more than needed
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= F.lit(int(2 * train_rows / max(good.count(), 1) * (1 << 20)))
    rows = (good.where(share).select("doc_id", *_feature_columns())
            .orderBy(F.xxhash64("doc_id"), *FEATURES).limit(train_rows).collect())
    if len(rows) < 2:
        return None
    return Forest(np.array([[float(r[c]) for c in FEATURES] for r in rows]), trees, subsample, seed)


def with_score(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds ``anomaly`` (0 without a forest)."""
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0))
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    feats, columns = stats.select("*", *_feature_columns()), stats.columns

    def score(batches):
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]) \
                if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in columns], pa.array(shared.value.score(x), pa.float64())],
                [*columns, "anomaly"])

    return feats.mapInArrow(score, StructType([*stats.schema, StructField("anomaly", DoubleType())]))


def calibrate(labelled: DataFrame, max_false_reject: float = 0.002) -> float:
    """Threshold from (anomaly, quality) of every labelled row, by a histogram of fixed size."""
    h = np.zeros((2, BINS + 1))
    bins = labelled.groupBy("quality", F.floor(F.col("anomaly") * BINS).cast("int").alias("b")).count()
    for r in bins.where("quality in (0, 1)").collect():
        h[r.quality, min(max(r.b, 0), BINS)] += r["count"]
    if not h.sum(1).all():
        return 1.0
    over = h[:, ::-1].cumsum(1)[:, ::-1] / h.sum(1, keepdims=True)  # share at or above each bin
    gain = np.where(over[1] <= max_false_reject, over[0] - over[1], -1.0)
    return float(np.argmax(gain)) / BINS


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def quality_forest(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, rule counts, base_failed, anomaly and kept for every row of ``docs``."""
    stats = materialize(rule_statistics(docs), "quality-stats")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = stats.where(~base_failed()).join(known, "doc_id").withColumn("half", remainder("doc_id", 2))
    forest = fit_forest(judged.where("quality = 1 and half = 0"), **fit)
    unseen = judged.where("half = 1").drop("half", "quality")
    cut = calibrate(with_score(unseen, forest).join(known, "doc_id")) if forest else 1.0
    return (with_score(stats, forest).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(cut))))
