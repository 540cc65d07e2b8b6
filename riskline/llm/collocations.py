"""Phrase collocations by SON partitioning: mine every shard, then count the union of what they found.

``SHARDS`` is a small fixed number whatever the size of the corpus, because a shard
need not fit into a task: each is mined by a Spark job over all its documents.
A phrase with at least ``support`` occurrences in a language has, in some shard that
holds the share p of the language's words, at least p * support of them; so each
shard is mined completely at the support ceil(p * support), level by level: a
phrase is counted in a shard only where all its shorter parts are frequent (single
words: in the language as a whole; phrases: in that shard). The union of the shards'
frequent phrases is then counted over all documents, by its words, exactly.

Mining counts phrases by 64-bit hashes and hands sets on as bitmaps, whose size is
chosen from the number of entries and is at most 2^MAX_BITS bits. Both can only let
further phrases through, which the last, exact count drops; none can be lost.

Defined results: a null text is empty, a null language is ``und``; a phrase never
crosses a piece or a document; repeated rows count again, whatever their id; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.common import Counter64, lower_ascii, materialize, mix64

SUPPORT = 10
MAX_WORDS = 3
TOP = 2000
#: A longer phrase with this share (in %) of a phrase's occurrences displaces it.
COVERED = 50
SCALE = 1_000_000
SHARDS = 4
MAX_BITS = 28
#: Words held in a task before their phrases are counted.
BLOCK = 1 << 20
#: Candidates that one window of the ranking sorts, about.
ROUND = 20_000

#: Piece ends become a line feed, tabs a space; everything else belongs to words.
PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
#: Stands between pieces as a word of its own, number 0; no text holds this byte.
BREAK = b"\xff"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: One constant a shard: hashes of one phrase in two shards take different places of a bitmap.
SALTS = mix64(np.arange(1, 65, dtype=np.uint64) * GOLDEN)


def prepared(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, lang, text) of every row; the shard is a hash of id and text, so that copies spread."""
    return df.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"),
                     F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


# Inside tasks -----------------------------------------------------------------------

class Block:
    """Words of some texts as ids in order of place, 0 between pieces; one stream a (shard, language)."""

    def __init__(self):
        self.ids, self.parts, self.size = Counter64({BREAK: 0}), {}, 0

    def add(self, shard: int, lang: str, text: str) -> None:
        words = (lower_ascii(text).translate(PIECES).replace(b"\n", b" \xff ") + b" \xff").split()
        self.parts.setdefault((shard, lang), [np.zeros(1, np.int32)]).append(
            np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def close(self) -> None:
        """Hashes of the words by id, once no more texts are added."""
        self.base = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), np.uint64, len(self.ids))

    @cached_property
    def words(self) -> pa.Array:
        """The words by id; only passes that give words ask for them."""
        words = list(self.ids)
        words[0] = b""
        return pa.array(words, pa.binary()).cast(pa.string())

    def streams(self) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        """Shard, language, ids, and the hash of every word in that language."""
        for (shard, lang), parts in self.parts.items():
            seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1))
            yield shard, lang, np.concatenate(parts), mix64(self.base ^ seed)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            block.add(*row)
            if block.size >= BLOCK:
                block.close()
                yield block
                block = Block()
    block.close()
    yield block


def phrase_hash(hashes: np.ndarray, stream: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place, by their hashes."""
    h = np.full(len(at), size, np.uint64)
    for j in range(size):
        h = mix64(h * GOLDEN + hashes[stream[at + j]])
    return h


def places(stream: np.ndarray, size: int, good: np.ndarray) -> np.ndarray:
    """Where runs of ``size`` words inside a piece start whose words are all ``good`` (by id)."""
    n = len(stream) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = good[stream] & (stream > 0)
    run = ok[:n].copy()
    for j in range(1, size):
        run &= ok[j:j + n]
    return np.flatnonzero(run)


def distinct(grams: list[np.ndarray], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns ``grams`` (ids below ``words``) and how often each occurs."""
    bits = max(words - 1, 1).bit_length()
    if bits * len(grams) < 64:
        packed = np.zeros(len(grams[0]), np.int64)
        for g in grams:
            packed = packed << bits | g
        packed, counts = np.unique(packed, return_counts=True)
        return [packed >> bits * j & (1 << bits) - 1 for j in reversed(range(len(grams)))], counts
    rows, counts = np.unique(np.stack(grams, 1), axis=0, return_counts=True)
    return list(rows.T), counts


def _full(value, n: int, kind) -> pa.Array:
    return pa.array([value] * n, kind) if isinstance(value, str) or value is None else pa.array(np.full(n, value), kind)


def _count_words(batches):
    """Words of every language, and (with a null phrase) the number of words of every shard and language."""
    for block in blocks(batches):
        for shard, lang, stream, hashes in block.streams():
            counts = np.bincount(stream, minlength=len(hashes))
            counts[0] = 0
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([None] * len(seen) + [shard], pa.int32()),
                "lang": _full(lang, len(seen) + 1, pa.string()),
                "phrase": pa.concat_arrays([block.words.take(pa.array(seen)), pa.nulls(1, pa.string())]),
                "key": pa.concat_arrays([pa.array(hashes[seen].view(np.int64)), pa.array([0])]),
                "n": pa.array(np.append(counts[seen], counts.sum()).astype(np.int64))})


def _mine(size: int, words, shorter, least) -> Callable:
    """Phrases of ``size`` words with only frequent parts, by hash, with their shard's support."""
    def run(batches):
        good, known = words.value, [b.value for b in shorter]
        for block in blocks(batches):
            for shard, lang, stream, hashes in block.streams():
                at = places(stream, size, good.has(hashes))
                for length, bits in enumerate(known, 2):
                    for first in range(size - length + 1):
                        at = at[bits.has(phrase_hash(hashes, stream, at + first, length) ^ SALTS[shard])]
                keys, counts = np.unique(phrase_hash(hashes, stream, at, size), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "shard": _full(shard, len(keys), pa.int32()), "key": pa.array(keys.view(np.int64)),
                    "n": pa.array(counts.astype(np.int64)),
                    "least": _full(least.value.get((shard, lang), 1), len(keys), pa.int64())})
    return run


def _count(words, found: dict) -> Callable:
    """Occurrences of the candidates, by their words."""
    def run(batches):
        good = words.value
        for block in blocks(batches):
            for _, lang, stream, hashes in block.streams():
                ok = good.has(hashes)
                for size, bits in found.items():
                    at = places(stream, size, ok)
                    at = at[bits.value.has(phrase_hash(hashes, stream, at, size))]
                    if not len(at):
                        continue
                    grams, counts = distinct([stream[at + j] for j in range(size)], len(hashes))
                    text = pc.binary_join_element_wise(*[block.words.take(pa.array(g)) for g in grams], " ")
                    yield pa.RecordBatch.from_pydict({
                        "lang": _full(lang, len(text), pa.string()), "phrase": text,
                        "size": _full(size, len(text), pa.int32()), "n": pa.array(counts.astype(np.int64))})
    return run


# Sets of hashes as bitmaps ------------------------------------------------------------

class Bitmap:
    """Set of 64-bit hashes that may hold more than was put in, never less."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(df: DataFrame, key: Column):
    """Broadcast bitmap of the hashes ``key``: 16 bits for each row of ``df``, at most 2^MAX_BITS (32 MB) in all."""
    entries = df.count()
    bits = min(max(math.ceil(math.log2(max(entries, 1) * 16)), 16), MAX_BITS)
    at = F.shiftrightunsigned(key, 64 - bits)
    rows = (df.select(F.shiftright(at, 6).cast("int").alias("word"), at.alias("at"))
            .select("word", F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(1 << (bits - 6), np.int64)
    if entries:
        got = rows.toArrow()
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return df.sparkSession.sparkContext.broadcast(Bitmap(bits, out.view(np.uint64)))


# The jobs -----------------------------------------------------------------------------

def least_counts(totals: DataFrame, support: int):
    """Broadcast {(shard, lang): ceil(share * support)} of the languages with a thousandth of all words or more (at
    most 1000); the others are mined at support 1, which only lets more through."""
    per_lang = totals.groupBy("lang").agg(F.sum("n").alias("words"))
    whole = per_lang.agg(F.sum("words")).first()[0] or 0
    large = F.broadcast(per_lang.where(F.col("words") * 1000 >= whole))
    rows = totals.join(large, "lang").collect()
    return totals.sparkSession.sparkContext.broadcast({(r.shard, r.lang): -(-r.n * support // max(r.words, 1)) for r in rows})


def phrase_counts(df: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS,
                  shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 to ``max_words`` words (lang, phrase, size, n), words (lang, phrase, n), both with ``support``
    occurrences or more, and the number of all words of every language (lang, n)."""
    texts = prepared(df, shards)
    counted = texts.mapInArrow(_count_words, "shard int, lang string, phrase string, key long, n long")
    counted = counted.groupBy("shard", "lang", "phrase").agg(F.min("key").alias("key"), F.sum("n").alias("n"))
    counted = materialize(counted.where((F.col("n") >= support) | F.col("phrase").isNull()), "words")
    words = counted.where("phrase is not null")
    totals = counted.where("phrase is null").select("shard", "lang", "n")
    least = least_counts(totals, support)
    frequent = bitmap(words, F.col("key"))
    salt = F.element_at(F.array(*[F.lit(int(x)) for x in SALTS[:shards].view(np.int64)]), F.col("shard") + 1)
    shorter, found = [], {}
    for size in range(2, max_words + 1):
        mined = texts.mapInArrow(_mine(size, frequent, shorter, least), "shard int, key long, n long, least long")
        mined = mined.groupBy("shard", "key").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
        mined = materialize(mined.where("n >= least").select("shard", "key"), "mined")
        if size < max_words:
            shorter.append(bitmap(mined, F.col("key").bitwiseXOR(salt)))
        found[size] = bitmap(mined, F.col("key"))
    phrases = texts.mapInArrow(_count(frequent, found), "lang string, phrase string, size int, n long")
    phrases = phrases.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    phrases = materialize(phrases.where(F.col("n") >= support), "phrases")
    return phrases, words.select("lang", "phrase", "n"), totals.groupBy("lang").agg(F.sum("n").alias("n"))


def _look_up(rows: DataFrame, part: str, parts: DataFrame, hot: DataFrame, out: str) -> DataFrame:
    """Add the count of ``part``. The most frequent parts come by broadcast, so that no task gets all their phrases."""
    named = [c.select("lang", F.col("phrase").alias(part), F.col("n").alias(out)) for c in (hot, parts)]
    first = rows.join(F.broadcast(named[0]), ["lang", part], "left")
    rest = first.where(F.col(out).isNull()).drop(out).join(named[1], ["lang", part])
    return first.where(F.col(out).isNotNull()).unionByName(rest)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase: its lowest-scoring cut."""
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = words.unionByName(phrases.where(F.col("size") < max_words).select("lang", "phrase", "n"))
    # at most 1000 words and 1000 phrases of each size have a thousandth of all occurrences
    hot = parts.where(F.col("n") * 1000 >= whole)
    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"),
                          F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = materialize(_look_up(_look_up(cuts, "left", parts, hot, "l"), "right", parts, hot, "r"), "cuts")
    exact = [f"cast({c} as decimal(19, 0))" for c in ("a", "l", "r")]
    score = F.expr("({s} * ({0} * {0})) div ({1} * {2})".format(*exact, s=SCALE))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer phrase that a phrase lies in."""
    out = None
    for longer in range(3, max_words + 1):
        word = F.split("phrase", " ")
        for size in range(2, longer):
            for first in range(longer - size + 1):
                part = phrases.where(F.col("size") == longer).select(
                    "lang", F.array_join(F.slice(word, first + 1, size), " ").alias("phrase"), "n")
                out = part if out is None else out.unionByName(part)
    return None if out is None else out.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def best_of(df: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` rows with their rank. Rows meet in rounds: about ROUND of a language at once, whose
    first ``top`` go on, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    size = df.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tables = -(-size // max(ROUND, 10 * top))
    while tables > 1:
        w = Window.partitionBy("lang", "__table").orderBy(*order)
        df = (df.withColumn("__table", F.pmod(F.xxhash64("phrase"), F.lit(tables)))
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("__table", "rank"))
        tables = -(-tables // 10) if tables > 10 else 1
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return df.where(F.col("rank") <= top)


def collocations(df: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    phrases, words, totals = phrase_counts(df, support, max_words)
    out = scored(phrases, words, totals, max_words)
    inside = covered(phrases, max_words)
    if inside is not None:
        out = (out.join(inside, ["lang", "phrase"], "left")
               .where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("a"))))
    out = materialize(out.select("lang", "phrase", "a", "l", "r", "score"), "scored")
    return best_of(out, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
