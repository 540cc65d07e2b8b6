"""Byte-level BPE with Spark higher-order functions.

``encode_words`` folds ranked merges over the byte pieces of each distinct word:
every step of the fold joins the leftmost pair of lowest rank. The ranks are one
literal: a perfect-hash table held in four literal arrays, so that a lookup costs
the same whatever the size of the vocabulary.

Words are counted over the corpus. The most frequent ones (at most ``dictionary``
words, so its size is bounded) are folded once and sent to all tasks; every other
word is folded with the same expression in the block of documents it occurs in.
Texts are neither shuffled nor cut. Decoding concatenates the ids' byte pieces.

Defined results: null or empty text has no ids; repeated rows are encoded one by
one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import io
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import Counter64, count_cut, documents, extended, gather, give_back, materialize

NONE = 2147483647
BLOCK_CHARS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankTable:
    """Literal arrays of a perfect hash: displacement per bucket, and per slot hash, bytes and rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.slots = 1 << max(4, (len(ranks) * 5 // 4).bit_length())
        self.buckets = self.slots // 2
        hashed = {k: xxhash.xxh64_intdigest(k, seed=42) for k in ranks}
        groups: dict[int, list[bytes]] = {}
        for k, h in hashed.items():
            groups.setdefault(h & (self.buckets - 1), []).append(k)
        for self.by in range(20, 45):  # hash bits that tell the keys of every bucket apart
            shift, used = self._place(groups, hashed)
            if len(used) == len(ranks):
                break
        else:
            raise ValueError("ranks hash alike")
        text = lambda f: " ".join(str(f(used[s])) if s in used else "-1" for s in range(self.slots))
        literal = lambda s: F.split(F.lit(s), " ")  # noqa: E731  a constant: the optimizer folds it once
        self.arrays = F.struct(literal(" ".join(map(str, shift))).cast("array<int>").alias("shift"),
                               literal(text(lambda k: k.hex().upper())).alias("bytes"),
                               literal(text(lambda k: ranks[k])).cast("array<int>").alias("rank"))

    def _place(self, groups, hashed) -> tuple[np.ndarray, dict[int, bytes]]:
        """Displacements that send all keys to slots of their own, largest buckets first."""
        shift, used = np.zeros(self.buckets, np.int64), {}
        for b, keys in sorted(groups.items(), key=lambda g: -len(g[1])):
            high = [(hashed[k] >> self.by) & (self.slots - 1) for k in keys]
            if len(set(high)) < len(high):
                break
            d = next((d for d in range(self.slots) if not any(h ^ d in used for h in high)), None)
            if d is None:
                break
            shift[b] = d
            used.update((h ^ d, k) for h, k in zip(high, keys))
        return shift, used

    def lookup(self, arrays: Column, piece: Column) -> Column:
        """Rank of a byte piece (NONE for one without)."""
        low, high = F.lit(self.buckets - 1), F.lit(self.slots - 1)

        def rank(h: Column) -> Column:
            slot = (F.shiftright(h, self.by).bitwiseAND(high).cast("int")).bitwiseXOR(
                F.get(arrays["shift"], h.bitwiseAND(low).cast("int")))
            return F.when(F.get(arrays["bytes"], slot) == F.hex(piece), F.get(arrays["rank"], slot)).otherwise(F.lit(NONE))

        return let(F.xxhash64(piece), rank)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(words: Column, table: RankTable) -> Column:
    """array<array<int>>: the ids of each of an array of words. The literal arrays stand in the plan once."""
    return let(table.arrays, lambda arrays: F.transform(words, lambda w: _encode(w, table, arrays)))


def _encode(word: Column, table: RankTable, arrays: Column) -> Column:
    data = word.cast("binary")
    size = F.length(data)

    rank = lambda piece: table.lookup(arrays, piece)

    # Lambdas over the elements: array slices and concatenations cost more than all lookups.
    def step(st: Column) -> Column:
        p, r = st["pieces"], st["ranks"]

        def merge(k: Column) -> Column:
            """Pieces k and k+1 become one; the pairs beside it get new ranks."""
            joined = lambda m: F.filter(F.transform(p, lambda x, i: F.when(i == k, m).otherwise(x)),
                                        lambda x, i: i != k + 1)
            ranked = lambda m: F.filter(F.transform(r, lambda x, i: F.when(i == k - 1, rank(F.concat(F.get(p, k - 1), m)))
                                                    .when(i == k + 1, rank(F.concat(m, F.get(p, k + 2)))).otherwise(x)),
                                        lambda x, i: i != k)
            return let(F.concat(F.get(p, k), F.get(p, k + 1)),
                       lambda m: F.struct(joined(m).alias("pieces"), ranked(m).alias("ranks")))

        leftmost = lambda best: F.array_min(F.transform(r, lambda x, i: F.when(x == best, i)))
        return let(F.coalesce(F.array_min(r), F.lit(NONE)),
                   lambda best: F.when(best == NONE, st).otherwise(let(leftmost(best), merge)))

    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(data, i, F.lit(1)))

    def fold(pieces: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, F.lit(1), size - 1), F.slice(pieces, F.lit(2), size - 1),
                           lambda a, b: F.concat(a, b))
        start = F.struct(pieces.alias("pieces"), F.transform(pairs, rank).alias("ranks"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, lambda st, _: step(st),
                           lambda st: F.transform(st["pieces"], rank))

    return F.when(size == 0, F.array().cast("array<int>")).otherwise(
        let(rank(data), lambda whole: F.when(whole != NONE, F.array(whole)).otherwise(let(single, fold))))


def texts_of(batch: pa.RecordBatch, rows: int = 256):
    """(doc_id or None, text) of a batch; few texts at a time are Python strings."""
    ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
    for a in range(0, batch.num_rows, rows):
        yield from zip(ids[a:a + rows], batch.column("text").slice(a, rows).to_pylist())


def count_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word, n over all whole texts; words are counted inside a task before they are shuffled."""
    def run(batches):
        find, seen = regex.compile(pattern).findall, Counter()

        def rows():
            out = pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()),
                                              "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for b in batches:
            for _, t in texts_of(b):
                seen.update(find(t))
            if len(seen) > 200_000:
                yield rows()
        if seen:
            yield rows()

    part = documents(docs).select("text").mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """The frequent words as sorted hashes beside their text: some 20 bytes a word in a task, not a Python dict."""

    def __init__(self, words: pa.Array):
        some = (words.slice(a, 10_000).to_pylist() for a in range(0, len(words), 10_000))  # never all as Python strings
        h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(some)), np.uint64, len(words))
        self.order = np.argsort(h, kind="stable").astype(np.int32)
        self.hashes, self.words = h[self.order], words

    def numbers(self, words: list[str]) -> np.ndarray:
        """Number of each word, -1 for words outside."""
        if not len(self.hashes) or not words:
            return np.full(len(words), -1)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, h), len(h) and len(self.hashes) - 1)
        out = np.where(self.hashes[at] == h, self.order[at], -1)
        found = np.flatnonzero(out >= 0)
        # another word may have the hash: compare the words themselves
        same = pc.equal(self.words.take(pa.array(out[found])), pa.array([words[i] for i in found.tolist()], pa.string()))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out


def to_blocks(docs: DataFrame, known, pattern: str, id_type: str) -> DataFrame:
    """Blocks of documents: ids, words per document, word numbers, and the words outside the dictionary."""
    def run(batches):
        find, dictionary = regex.compile(pattern).findall, _dictionary(known)
        size = len(dictionary.words)

        def row(ids, counts, codes, local):
            words = list(local)
            number = dictionary.numbers(words)
            rare = np.flatnonzero(number < 0)
            number[rare] = size + np.arange(len(rare))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(ids_type)), pa.array([np.array(counts, "<i4").tobytes()], pa.binary()),
                 pa.array([number[np.concatenate(codes)].astype("<i4").tobytes()], pa.binary()),
                 pa.array([[words[i] for i in rare.tolist()]], pa.list_(pa.string()))], ["ids", "counts", "codes", "rare"])

        ids, counts, codes, local, chars = [], [], [], Counter64(), 0
        for b in batches:
            ids_type = b.column("doc_id").type
            for i, t in texts_of(b):
                words = find(t)
                ids.append(i)
                counts.append(len(words))
                codes.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                chars += len(t)
                if chars >= BLOCK_CHARS:
                    yield row(ids, counts, codes, local)
                    ids, counts, codes, local, chars = [], [], [], Counter64(), 0
        if ids:
            yield row(ids, counts, codes, local)

    return documents(docs).mapInArrow(run, f"ids array<{id_type}>, counts binary, codes binary, rare array<string>")


_cache: dict[int, Dictionary] = {}


def _dictionary(known) -> Dictionary:
    """Built once a worker."""
    if known.value[0] not in _cache:
        _cache.clear()
        with pa.ipc.open_stream(known.value[1]) as r:
            _cache[known.value[0]] = Dictionary(r.read_all().column("word").combine_chunks())
    return _cache[known.value[0]]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a list column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(a.offsets.to_numpy()), a.flatten().to_numpy(zero_copy_only=False)


def _stream(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue()


def finish_blocks(blocks: DataFrame, known, pieces: list[bytes], id_type: str) -> DataFrame:
    """doc_id, ids (4-byte little-endian) and decoded bytes of every document."""
    shared = blocks.sparkSession.sparkContext.broadcast(pieces)

    def column(ends, data):
        """Binary values that lie one behind the other."""
        if int(ends[-1]) >> 31:
            raise ValueError("ids or bytes of more than 2 GB")
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])

    def slices(ends, most=1 << 16):
        """Documents of about ``most`` words, or one longer document."""
        a = 0
        while a < len(ends) - 1:
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
            yield a, z
            a = z

    def run(batches):
        with pa.ipc.open_stream(known.value) as r:
            sizes, values = _lists(r.read_all().column("ids"))
        values, first = values.astype(np.uint32, copy=False), (np.cumsum(sizes) - sizes).astype(np.int32)
        words, held = len(sizes), len(values)
        table = pa.array(shared.value, pa.binary())
        for b in batches:
            for row in range(b.num_rows):
                # a block's own words stand behind those of the dictionary
                more, extra = _lists(b.column("rare_ids").slice(row, 1).flatten())
                sizes, values = extended(sizes, words, more), extended(values, held, extra.astype(np.uint32))
                first = extended(first, words, held + np.cumsum(more) - more)
                codes = np.frombuffer(b.column("codes")[row].as_py(), "<i4")
                counts = np.frombuffer(b.column("counts")[row].as_py(), "<i4")
                docs, ends = b.column("ids").slice(row, 1).flatten(), np.append(0, np.cumsum(counts, dtype=np.int64))
                for a, z in slices(ends):
                    ids, n = gather(first, sizes, values, codes[ends[a]:ends[z]])
                    stops = np.append(0, np.cumsum(n))[ends[a:z + 1] - ends[a]]
                    found = table.take(pa.array(ids))
                    held_bytes = np.append(0, np.cumsum(pc.binary_length(found).to_numpy()))[stops]
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(a, z - a), column(4 * stops, pa.py_buffer(ids.astype("<u4", copy=False))),
                         column(held_bytes, found.buffers()[2] or pa.py_buffer(b""))], ["doc_id", "ids", "decoded"])

    return blocks.mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``encode``."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int = 1_000_000) -> DataFrame:
    """The digests of ``encode`` for every row of ``docs``."""
    return digest(encode(docs, ranks_path, pattern, dictionary))


def encode(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int = 1_000_000) -> DataFrame:
    """doc_id, ids (4-byte little-endian), decoded (bytes of the ids) for every row of ``docs``."""
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    table = RankTable(ranks)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = materialize(count_words(docs, pattern), "bpe-words")
    frequent = counts.where(F.col("n") >= count_cut(counts, dictionary)).select("word").repartition(spark.sparkContext.defaultParallelism)
    words = frequent.select("word", F.get(encode_words(F.array("word"), table), F.lit(0)).alias("ids")).toArrow()
    data = _stream(words.select(["word"]))
    known = spark.sparkContext.broadcast((hash(data), data))
    known_ids = spark.sparkContext.broadcast(_stream(words.select(["ids"])))  # each kind of task holds what it reads
    del words, data
    pieces = [b""] * (max(ranks.values()) + 1)
    for k, r in ranks.items():
        pieces[r] = k
    blocks = to_blocks(docs, known, pattern, id_type)
    folded = blocks.select("ids", "counts", "codes",
                           encode_words(F.col("rare"), table).alias("rare_ids"))
    del ranks, table
    give_back()
    return finish_blocks(folded, known_ids, pieces, id_type)
