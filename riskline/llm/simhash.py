"""Near duplicates by SimHash fingerprints, compared bit-sliced.

Fingerprints of one bucket lie vertically: one 64-bit word holds one bit of 64
fingerprints. A query is compared with 64 of them at once: each bit plane, inverted
where the query has the bit, is added to carry-save counters (ones, twos, fours,
more), eight planes at a time, and a block of 64 is abandoned as soon as all its
counts exceed the radius; the others go on with the next planes.

Buckets come from the pigeonhole: of RADIUS + 1 runs of bits, two fingerprints
within the radius share one. A bucket with more than BUCKET fingerprints is cut
again by the same rule over its other bits, and one that is still larger into parts
that are compared pairwise, a pair to a group of rows; no bucket is too large and
no pair is lost. Only distinct fingerprints are compared, and a bucket reports a
spanning forest of its links instead of all of them.

Defined results: texts without words have the fingerprint zero, linked like any
other; a null text is empty; equal ids are rows of their own; a null id is never the
smallest, and a component without any id has a null one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import WORD_BYTES, documents, lower_ascii, materialize
from riskline.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Fingerprints of a bucket that are compared with each other in one group of rows.
BUCKET = 4096
#: Shingles voted on at once, and blocks of 64 compared at once.
VOTES, CELLS = 1 << 16, 1 << 16

_WORD = re.compile(b"[^%s]+" % WORD_BYTES.encode())
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# Fingerprints -----------------------------------------------------------------------

def fingerprint(text: str) -> int:
    """64-bit SimHash of a whole text: each bit by the majority of its shingles' hashes."""
    words = _WORD.findall(lower_ascii(text))
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, VOTES):
        h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + SHINGLE]), SEED) for i in range(a, min(a + VOTES, n))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(batches):
    for batch in batches:
        values = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "print"])


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, print (long) of every row."""
    d = documents(df)
    return d.mapInArrow(_fingerprints, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, print long")


# Bit-sliced comparison ----------------------------------------------------------------

def _add(a, b, c):
    """Carry-save sum of three bits in every lane: (sum, carry)."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def planes_of(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of fingerprints in groups of ``counts``, each group padded to whole words.

    Returns planes (64, words), the word each group starts at, and the words' lanes in use.
    """
    words = -(-counts // 64)
    starts = np.cumsum(words) - words
    group = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(prints)) - np.repeat(np.cumsum(counts) - counts, counts)
    lane = np.zeros(int(words.sum()) * 64, np.uint64)
    used = np.zeros(len(lane), np.uint8)
    at = starts[group] * 64 + inside
    lane[at], used[at] = prints, 1
    bits = np.unpackbits(lane.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane x bit
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    return planes, starts, np.packbits(used, bitorder="little").view(np.uint64)


def near(planes: np.ndarray, queries: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray,
         radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within ``radius`` of their query, for cells (query, word): (index of the cell, 64-bit mask of its lanes).

    ``lanes`` are the lanes of each cell to compare. Cells whose lanes all exceed the radius are abandoned.
    """
    cell = np.arange(len(query))
    ones, twos, fours, more = (np.zeros(len(query), np.uint64) for _ in range(4))
    value = queries[query]
    for first in range(0, BITS, 8):
        d = [planes[b][word] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1))) for b in range(first, first + 8)]
        half = []
        for k in (0, 4):
            ones, a = _add(ones, d[k], d[k + 1])
            ones, b = _add(ones, d[k + 2], d[k + 3])
            twos, c = _add(twos, a, b)
            half.append(c)
        fours, eights = _add(fours, *half)
        more = more | eights
        lanes = lanes & ~_over(ones, twos, fours, more, radius)
        live = np.flatnonzero(lanes)
        if len(live) < len(lanes):
            cell, word, value, lanes = cell[live], word[live], value[live], lanes[live]
            ones, twos, fours, more = ones[live], twos[live], fours[live], more[live]
        if not len(cell):
            break
    return cell, lanes


def _over(ones, twos, fours, more, radius):
    """Lanes whose count exceeds ``radius`` (below 8)."""
    over, equal = more, ~more
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal = equal & plane
        else:
            over = over | (equal & plane)
    return over


def bucket_links(prints: np.ndarray, side: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest inside each of many buckets, as pairs of fingerprints.

    ``counts``: rows of each bucket, in order. ``side`` 0 rows are compared with side 1 rows of their bucket,
    side 2 rows with each other.
    """
    planes, starts, used = planes_of(prints, counts)
    n, group = len(prints), np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    target = side[np.cumsum(counts) - 1] != 2  # buckets of two sides
    second = np.zeros(len(used) * 64, np.uint8)
    second[starts[group] * 64 + inside] = side == 1
    second = np.packbits(second, bitorder="little").view(np.uint64)
    words = -(-counts // 64)
    own = inside // 64
    # one-sided: the words from a query's own on; two-sided: all words, for side 0 only
    from_word = np.where(target[group], 0, own)
    cells = np.where(target[group] & (side == 1), 0, words[group] - from_word)
    parent = np.arange(n)
    out_a, out_b = [], []
    ends = np.cumsum(cells)
    a = 0
    while a < n:
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")), a + 1)
        q = np.arange(a, b)
        size = cells[q]
        query = np.repeat(q, size)
        offset = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
        word = starts[group[query]] + from_word[query] + offset
        lanes = np.where(target[group[query]], second[word], used[word])
        same = ~target[group[query]] & (offset == 0)  # the query's own word: later lanes only
        later = ALL << (inside[query] % 64).astype(np.uint64) << np.uint64(1)
        lanes = np.where(same, lanes & later, lanes)
        hit, mask = near(planes, prints, query, word, lanes)
        if len(hit):
            lane = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, k = np.nonzero(lane)
            qa = query[hit[row]]
            qb = (word[hit[row]] - starts[group[qa]]) * 64 + k + (np.cumsum(counts) - counts)[group[qa]]
            keep = _join(parent, qa, qb)
            out_a.append(qa[keep])
            out_b.append(qb[keep])
        a = b
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return prints[np.concatenate(out_a)], prints[np.concatenate(out_b)]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Add links to the forest ``parent`` (every member points at its root); indices of those that join two trees."""
    keep, live = [], np.arange(len(a))
    while True:
        x, y = parent[a[live]], parent[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.concatenate(keep) if keep else live
        high, first = np.unique(np.maximum(x, y), return_index=True)
        parent[high] = np.minimum(x, y)[first]  # a lower root each, so no cycle
        keep.append(live[first])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            np.copyto(parent, up)


def _links(batches: Iterator[pa.RecordBatch]):
    """Links of whole buckets (rows of one bucket arrive next to each other), many buckets at a time."""
    held, rows = [], 0

    def done(arrays):
        bucket, part, prints, side = (np.concatenate(c) for c in zip(*arrays))
        return bucket, part, prints.view(np.uint64), side

    def work(bucket, part, prints, side):
        if not len(prints):
            return
        first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))
        counts = np.diff(np.append(first, len(prints)))
        a, b = bucket_links(prints, side, counts)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        rows += batch.num_rows
        if rows >= 4 * BUCKET:
            bucket, part, prints, side = done(held)
            last = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            yield from work(bucket[:end], part[:end], prints[:end], side[:end])
            held = [[bucket[end:], part[end:], prints[end:].view(np.int64), side[end:]]]
            rows = len(bucket) - end
    if held:
        yield from work(*done(held))


# Buckets ------------------------------------------------------------------------------

def _runs(free: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Cut the bit ranges ``free`` into ``n`` runs of about the same number of bits, each a list of ranges."""
    bits = [b for a, e in free for b in range(a, e)]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        ranges = []
        for bit in bits[a:b]:
            if ranges and ranges[-1][1] == bit:
                ranges[-1] = (ranges[-1][0], bit + 1)
            else:
                ranges.append((bit, bit + 1))
        out.append(ranges)
    return out


def _value(print_: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of ``ranges`` as one number."""
    out = F.lit(0).cast("long")
    for a, b in ranges:
        piece = F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        out = F.shiftleft(out, b - a).bitwiseOR(piece)
    return out


def bucketed(prints: DataFrame, radius: int = RADIUS, bucket_size: int = BUCKET) -> DataFrame:
    """(bucket, part, print, side): groups of at most about 2 x ``bucket_size`` distinct fingerprints that meet every
    pair within ``radius``."""
    p = F.col("print")
    wide = _runs([(0, BITS)], radius + 1)
    first = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("t"), _value(p, r).alias("key")) for t, r in enumerate(wide)])).alias("k"))
    first = first.select("print", "k.t", F.shiftleft("k.key", 8).bitwiseOR(F.col("k.t")).alias("bucket"))
    # one count for each of at most (radius + 1) * 2^13 keys: small enough to broadcast
    crowded = first.groupBy("bucket").count().where(F.col("count") > bucket_size).select("bucket", F.lit(True).alias("crowded"))
    first = first.join(F.broadcast(crowded), "bucket", "left")
    calm = first.where(F.col("crowded").isNull()).select("bucket", F.lit(0).cast("long").alias("part"), "print",
                                                         F.lit(2).alias("side"))
    keys = []
    for t, own in enumerate(wide):
        taken = {b for a, e in own for b in range(a, e)}
        free = [(b, b + 1) for b in range(BITS) if b not in taken]
        subs = _runs(free, radius + 1)
        keys.append(F.when(F.col("t") == t, F.array(*[
            F.shiftleft(_value(p, r), 4).bitwiseOR(F.lit(s + 1).cast("long")) for s, r in enumerate(subs)])))
    fine = first.where("crowded").select("bucket", "print", F.explode(F.coalesce(*keys)).alias("part"))
    fine = materialize(fine, "fine")
    # keys that are still crowded are at most 25 / bucket_size of the fingerprints; salted, so that none is one task's
    salts = 16
    still = fine.groupBy("bucket", "part").count().where(F.col("count") > bucket_size)
    still = still.select("bucket", "part", F.ceil(F.col("count") / bucket_size).cast("int").alias("cuts"),
                         F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    fine = (fine.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(salts)).cast("int"))
            .join(still, ["bucket", "part", "salt"], "left"))
    simple = fine.where("cuts is null").select("bucket", "part", "print", F.lit(2).alias("side"))
    mine = F.pmod(F.xxhash64("print", F.lit(1)), F.col("cuts")).cast("int")
    pairs = (fine.where("cuts is not null").select("bucket", "part", "print", mine.alias("mine"),
                                                   F.explode(F.expr("sequence(0, cuts - 1)")).alias("other")))
    pairs = pairs.select("bucket", F.xxhash64("part", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"),
                         "print", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0)
                         .otherwise(1).alias("side"))
    return calm.unionByName(simple).unionByName(pairs)


def links(prints: DataFrame, radius: int = RADIUS, bucket_size: int = BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within ``radius`` that connect whatever is connected."""
    groups = bucketed(prints, radius, bucket_size).repartition("bucket", "part")
    groups = groups.sortWithinPartitions("bucket", "part", "print").select("bucket", "part", "print", "side")
    return groups.mapInArrow(_links, "a long, b long")


def near_duplicates(df: DataFrame, bucket_size: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = materialize(fingerprints(df), "prints")
    prints = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(links(prints.select("print"), bucket_size=bucket_size))
    owner = prints.join(found, prints["print"] == found["node"], "left")
    owner = owner.select("print", "low", "n", F.coalesce("component", "print").alias("component"))
    least = owner.groupBy("component").agg(F.min("low").alias("component_id"))
    owner = materialize(owner.join(least, "component").select("print", "n", "component_id"), "owners")
    # at most 1000 fingerprints have a thousandth of all rows: they come by broadcast, no task gets all their rows
    whole = rows.count()
    hot = owner.where(F.col("n") * 1000 >= whole).select("print", F.lit(True).alias("hot"), "component_id")
    first = rows.join(F.broadcast(hot), "print", "left")
    rest = first.where("hot is null").drop("hot", "component_id").join(owner.drop("n"), "print")
    out = first.where("hot").drop("hot").unionByName(rest)
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
