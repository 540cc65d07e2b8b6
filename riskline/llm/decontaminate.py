"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some of the words of a window and ignore the rest; the hash
of the words they look at survives a substitution of an ignored word. Hashes of
the benchmark and of the documents are joined; every hit names a document, an
item and a diagonal (document position minus item position). Along the hit
diagonals the words are compared in full.

The rule does not speak of masks: a diagonal counts if ``min_line`` of the item's
words stand on it, and a document leaks an item when the diagonals that count
together hold ``min_match`` of its words and a share of ``min_share``. Items of
fewer than ``min_match`` words leak when they stand in the document whole. The
masks find every unbroken run of ``min_line`` words, every whole short item and
every regular substitution down to each second word; of random substitutions
they find at least 0.96 of the leaks (README).

Before the join a bitmap of fixed size drops document hashes that no benchmark
hash can equal; it is a filter only, so a benchmark that fills it costs time and
no results. Everything is DataFrame code.

Defined results: words are runs of letters and digits, lower-cased; items of
fewer than four words name no passage and leak nowhere; null or empty texts leak
nothing; in ``leaks`` documents of equal id are judged together, and rows with a
null id cannot be named and are left out (``decontaminate`` judges every row by
itself); equal items are reported each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import row_key, without_rows

#: Word offsets that a mask looks at.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 6, 7), (0, 2, 4, 6))
BITS = 22


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(df: DataFrame, id_col: str, keep=None) -> DataFrame:
    """id, mask, pos, key of all spaced seeds of ``df`` (id_col, text); ``keep`` filters keys.

    Word hashes are looked up in the text's array from each position, so a mask costs a few array reads a word.
    """
    hashed = df.select(F.col(id_col).alias("id"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    places = hashed.select("id", "h", F.posexplode("h").alias("pos", "first"))
    keys = [F.when(F.col("pos") + max(offsets) < F.size("h"),
                   F.xxhash64(*[F.get("h", F.col("pos") + o) for o in offsets])) for offsets in MASKS]
    if keep is not None:
        some = F.lit(False)
        for key in keys:
            some = some | F.coalesce(keep(key), F.lit(False))
        places = places.where(some)
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), key.alias("key")) for k, key in enumerate(keys)]))
    out = places.select("id", "pos", at.alias("s")).select("id", "s.mask", "pos", "s.key").where("key is not null")
    return out if keep is None else out.where(keep(F.col("key")))


def seed_filter(item_seeds: DataFrame):
    """A test on keys from a bitmap of 2**BITS bits; the bitmap's size does not depend on the data."""
    slot = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    words = (item_seeds.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
             .distinct().groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect())
    bitmap = ["0"] * (1 << BITS - 6)
    for r in words:
        bitmap[r.w] = str(r.bits)
    table = F.split(F.lit(" ".join(bitmap)), " ").cast("array<bigint>")  # constant, folded once

    def keep(key: Column) -> Column:
        s = key.bitwiseAND(F.lit((1 << BITS) - 1))
        return F.getbit(F.get(table, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1

    return keep


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 10, min_share: float = 0.5,
          min_line: int = 8) -> DataFrame:
    """doc_id, item_id, n_match, item_words, share of every leaked item of every document."""
    items = (benchmark.select("item_id", F.col("text"), words_of(F.col("text")).alias("item"))
             .where(F.size("item") >= min(len(m) for m in MASKS)))
    item_seeds = seeds(items, "item_id")
    found = seeds(docs.where(F.col("doc_id").isNotNull()), "doc_id", seed_filter(item_seeds))
    hits = (found.select(F.col("id").alias("doc_id"), "mask", F.col("pos").alias("at"), "key")
            .join(item_seeds.withColumnRenamed("id", "item_id"), ["mask", "key"])
            .select("doc_id", "item_id", (F.col("at") - F.col("pos")).alias("diagonal")).distinct())
    lines = hits.groupBy("doc_id", "item_id").agg(F.collect_list("diagonal").alias("diagonals"))
    known = lines.join(items.select("item_id", "item"), "item_id")
    per_doc = known.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("items"))
    # Verified in the row of the document; all hits of a document are bounded by its own text.
    texts = docs.select("doc_id", "text").join(per_doc, "doc_id").select(
        "doc_id", words_of(F.col("text")).alias("w"), F.explode("items").alias("i"))
    size = F.size("i.item")
    # per diagonal the item's places whose word stands there; F.get gives null behind the last word
    on = lambda d: F.filter(F.sequence(F.lit(0), size - 1), lambda q: F.coalesce(
        F.when(d + q >= 0, F.get("w", d + q)) == F.get("i.item", q), F.lit(False)))
    lines = F.filter(F.transform("i.diagonals", on),
                     lambda line: F.size(line) >= F.when(size >= min_match, F.lit(min_line)).otherwise(size))
    matched = F.size(F.array_distinct(F.flatten(lines)))
    return (texts.select("doc_id", F.col("i.item_id").alias("item_id"), matched.cast("long").alias("n_match"),
                         size.cast("long").alias("item_words"))
            .where((F.col("n_match") >= F.least(F.lit(min_match), F.col("item_words")))
                   & (F.col("n_match") >= min_share * F.col("item_words")))
            .groupBy("doc_id", "item_id").agg(F.max("n_match").alias("n_match"), F.max("item_words").alias("item_words"))
            .withColumn("share", F.round(F.col("n_match") / F.col("item_words"), 6)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **rule) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; all columns stay.

    Each row is judged by its own text, whatever its id: rows of one id do not share a verdict, and a row
    without id that leaks goes like any other.
    """
    named = docs.select(row_key(docs).alias("doc_id"), "text")
    return without_rows(docs, leaks(named, benchmark, **rule).select("doc_id"))
