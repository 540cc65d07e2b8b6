"""Removal of repeated byte strings by threshold-bounded interval expansion on a BWT.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
id, or same document and earlier) is removed. The corpus is cut for Spark by
content: each window of ``length`` bytes belongs to its smallest hashed k-gram, so
equal windows always meet in one bucket. Runs of windows with one such k-gram form
a piece; pieces whose k-gram occurs once anywhere are dropped at once, and where
all pieces of a bucket have one 64-bit hash all but the first go. Of the other
buckets the bytes are fetched. Inside a
task the distinct pieces of its buckets are joined to one text, its suffixes are
sorted, and breadth-first backward extension on the Burrows-Wheeler transform
finds the common prefixes of neighbouring suffixes by increasing value, stopping
at ``length``: neighbours without a value share a window.

Equal pieces are combined within a task before their bytes are shuffled. A bucket
of more than ``crowd`` distinct pieces is not expanded in one task: its windows are hashed
one by one and grouped over the cluster instead.

Defined results: null or empty text, and text shorter than ``length`` bytes, loses
nothing; rows of equal id and equal text are one document and get equal results;
rows of equal id and different text are ordered by a hash of the text; a null id
sorts first; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.common import documents, materialize, mix64

GRAM = 24
PLACE = 20  # low bits of a k-gram's key that hold its place
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64))
JOINED = 1 << 20  # bytes of text that are hashed at a time


def gram_keys(data: np.ndarray) -> np.ndarray:
    """Key of the GRAM bytes from each place: hash above, place in the low bits."""
    h = mix64(data.astype(np.uint64) + np.uint64(1))
    width, parts = 1, {}
    while width <= GRAM:
        parts[width] = h
        if width * 2 <= GRAM:
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    out, done = None, 0
    for w in sorted(parts, reverse=True):
        if GRAM - done >= w:
            piece = parts[w][done:]
            out = piece if out is None else out[:len(piece)] * np.uint64(0xD6E8FEB86659FD93) + piece[:len(out)]
            done += w
    out = mix64(out[:len(data) - GRAM + 1])
    low = np.uint64((1 << PLACE) - 1)
    return (out & ~low) | (np.arange(len(out), dtype=np.uint64) & low)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - have:]) if have < width else out


def pieces_of(texts: list[bytes], length: int):
    """(text number, bucket, start, windows, hash) of the runs of windows with one smallest k-gram."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    low = sliding_min(gram_keys(data), length - GRAM + 1)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(low)]
    inside = np.arange(length, length + len(low)) <= ends[owner]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # windows that reach over a text's end stop the run before them
    stop = np.flatnonzero(np.append(new | ~inside, True))
    runs = stop[np.searchsorted(stop, first, side="right")] - first
    text = owner[first]
    # hash of the bytes of each piece: a difference of sums of bytes times powers, moved to one base
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), BASE)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * power[:-1])])
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), BASE_INVERSE)]))
    hashed = mix64((total[first + runs + length - 1] - total[first]) * back[first] + runs.astype(np.uint64))
    return text, (low[first] >> np.uint64(PLACE)).astype(np.int64), first - begin[text], runs, hashed.view(np.int64)


def _chunks(texts: list[bytes]):
    """(first number, texts) of about JOINED bytes."""
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= JOINED:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes sorted by at least ``depth`` symbols (beyond the end: 0)."""
    n = len(text)
    used = np.bincount(text, minlength=1) > 0  # the values in use, numbered; 0 stays 0
    used[0] = False
    sym = np.cumsum(used).astype(np.uint64)[text]
    bits = int(sym.max(initial=1)).bit_length()
    have = 64 // bits  # as many symbols as a key holds
    pad = np.append(sym, np.zeros(have, np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key = key << np.uint64(bits) | pad[k:n + k]
    while True:
        order = np.argsort(key)
        k = key[order]
        step = np.ones(n, bool)
        step[1:] = k[1:] != k[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step).astype(np.uint64)
        if have >= depth or step.all():
            return order
        key = rank * np.uint64(n + 1)
        key[:n - have if have < n else 0] += rank[have:]
        have *= 2


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable order of keys of 0 or more: small ones are sorted with their places in one number, without a merge."""
    if not len(key) or int(key.max()) >> 31 or len(key) >> 32:
        return np.argsort(key, kind="stable")
    both = key << 32 | np.arange(len(key))
    both.sort()
    return both & 0xFFFFFFFF


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of neighbouring suffixes in ``order``, by increasing value below ``length``; -1 where longer.

    ``text`` ends with the separator 0. Intervals of suffixes that start with a common string are
    extended to the left by breadth-first search; the first interval to end before a place names
    the place's value. Strings are not extended over separators.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.int64)
    front = np.empty(n, np.int64)
    front[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)  # where the suffix one to the left stands
    value = np.full(n + 1, -1, np.int64)
    value[0] = value[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        size = hi - lo
        one = size == 1
        at = lo[one]
        if level:
            at = at[bwt[at] > 0]
        left, right = [front[at]], [front[at] + 1]
        many = np.flatnonzero(~one)
        if len(many):
            s = size[many]
            ends = np.cumsum(s)
            place = np.repeat(lo[many] - (ends - s), s) + np.arange(ends[-1])
            key = np.repeat(np.arange(len(many)), s) * 512 + bwt[place]
            if level:
                ok = bwt[place] > 0
                place, key = place[ok], key[ok]
            by = stable_order(key)
            key, to = key[by], front[place[by]]
            if len(key):
                edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                left.append(to[edge])
                right.append(to[np.append(edge[1:], len(key)) - 1] + 1)
        lo, hi = np.concatenate(left), np.concatenate(right)
        fresh = value[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        value[hi] = level
        if not len(lo):
            break
    return value[:n]


def repeated_windows(bodies: list[bytes], places: np.ndarray, length: int) -> list[np.ndarray]:
    """Per body a flag for each window that also starts earlier; ``places`` orders the bodies' starts."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    text = np.zeros(int(sizes.sum()) + len(bodies), np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1
    body = np.repeat(np.arange(len(bodies)), sizes)
    within = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[start[body] + within] = raw
    order = suffix_order(text, length)
    group = np.cumsum(common_prefixes(text, order, length) >= 0)
    # the place of each full window in the corpus, -1 for others
    place = np.full(len(text), -1, np.int64)
    full = within + length <= sizes[body]
    place[(start[body] + within)[full]] = (places[body] + within)[full]
    p = place[order]
    valid = p >= 0
    g, p, at = group[valid], p[valid], order[valid]
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, g, p)
    late = np.zeros(len(text), bool)
    late[at[p > least[g]]] = True
    return [late[s:s + z - length + 1] for s, z in zip(start.tolist(), sizes.tolist())]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(start, stop) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


SPANS = "row long, start long, stop long"


def _spans(rows, starts, stops) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows, starts, stops)], ["row", "start", "stop"])


def pieces(rows: DataFrame, length: int, id_type: str) -> DataFrame:
    """bucket, hash, doc_id, row, start, windows of every piece of every text."""
    def run(batches):
        for b in batches:
            ids, docs = b.column("row"), b.column("doc_id")
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for first, part in _chunks(texts):
                text, bucket, start, n, hashed = pieces_of(part, length)
                at = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(hashed), docs.take(at), ids.take(at), pa.array(start.astype(np.int64)),
                     pa.array(n.astype(np.int32))], ["bucket", "hash", "doc_id", "row", "start", "windows"])

    return rows.select("doc_id", "row", "text").mapInArrow(
        run, f"bucket long, hash long, doc_id {id_type}, row long, start long, windows int")


def repeated_pieces(rows: DataFrame, length: int, id_type: str) -> DataFrame:
    """Pieces of buckets with two or more: ``same`` where all have one hash, and then without the first."""
    by = Window.partitionBy("bucket")
    at = F.struct("doc_id", "row", "start")
    return (pieces(rows, length, id_type).repartition("bucket").withColumn("lo", F.min("hash").over(by))
            .withColumn("hi", F.max("hash").over(by)).withColumn("first", F.min(at).over(by))
            .withColumn("last", F.max(at).over(by)).where("first <> last")
            .withColumn("same", F.col("lo") == F.col("hi")).where(~F.col("same") | (at > F.col("first")))
            .select("bucket", "row", "start", "windows", "same"))


def cut_bodies(joined: DataFrame, id_type: str, length: int) -> DataFrame:
    """The bytes of pieces. Of equal pieces in a batch only the earliest keeps its bytes."""
    def run(batches):
        for b in batches:
            first: dict[tuple, tuple] = {}
            late = []
            doc = b.column("doc_id").to_pylist()
            for i, r, t, found in zip(doc, b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("found").to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                for f in found:
                    key = (f["bucket"], data[f["start"]:f["start"] + f["windows"] + length - 1])
                    mine = ((i is not None, i if i is not None else 0, r, f["start"]), i, r, f["start"])
                    held = first.get(key)
                    if held is None or mine[0] < held[0]:
                        first[key] = mine
                        mine = held
                    if mine is not None and mine[0] != first[key][0]:
                        late.append((key[0], None, *mine[1:], len(key[1])))
            out = [(*k, *v[1:], len(k[1])) for k, v in first.items()] + late
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], b.column("doc_id").type),
                 *[pa.array(c, pa.int64()) for c in cols[3:]]], ["bucket", "body", "doc_id", "row", "start", "size"])

    return joined.mapInArrow(run, f"bucket long, body binary, doc_id {id_type}, row long, start long, size long")


def expand(bodies: DataFrame, length: int, id_type: str, crowd: int, batch: int = 1 << 20) -> DataFrame:
    """Removed spans (row, start, stop) of pieces sorted by bucket, body and place; whole buckets are in memory.

    The windows of a bucket of more than ``crowd`` distinct pieces come back one by one,
    with their hash in ``window``.
    """
    def run(batches):
        kept, where, size = [], [], 0              # of whole buckets waiting for an expansion
        bucket, fresh, last, many = None, [], None, False  # of the bucket being read

        def rows(spans, kind, windows=None):
            docs, r, s, z = list(zip(*spans)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, kind), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(z, pa.int64()),
                 pa.array(windows if windows is not None else [None] * len(r), pa.binary())],
                ["doc_id", "row", "start", "stop", "window"])

        def work(kind):
            docs = sorted({(i is not None, i if i is not None else 0, r) for i, r, _ in where})
            rank = {d: k for k, d in enumerate(docs)}
            places = np.array([(rank[i is not None, i if i is not None else 0, r] << 40) + s for i, r, s in where])
            return rows([(i, r, s + a, s + z + length - 1)
                         for flags, (i, r, s) in zip(repeated_windows(kept, places, length), where)
                         for a, z in runs_of(flags).tolist()], kind)

        def singly(some, kind):
            spans = [(i, r, s + k, s + k + length) for body, i, r, s in some for k in range(len(body) - length + 1)]
            return rows(spans, kind, [hashlib.blake2b(body[k:k + length], digest_size=16).digest()
                                      for body, _, _, _ in some for k in range(len(body) - length + 1)])

        for b in batches:
            late, kind = [], b.column("doc_id").type
            for k, body, i, r, s, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "body", "doc_id", "row", "start", "size"))):
                if body is None:
                    late.append((i, r, s, s + n))
                    continue
                if k != bucket:
                    if len(fresh) > 1 and not many:
                        kept += [f[0] for f in fresh]
                        where += [f[1:] for f in fresh]
                        size += sum(len(f[0]) for f in fresh)
                        if size >= batch:
                            yield work(kind)
                            kept, where, size = [], [], 0
                    elif fresh and many:
                        yield singly(fresh, kind)
                    bucket, fresh, last, many = k, [], None, False
                if body == last:  # sorted: an earlier copy of the piece has been seen
                    late.append((i, r, s, s + n))
                else:
                    fresh.append((body, i, r, s))
                    last = body
                    if len(fresh) > crowd:
                        yield singly(fresh, kind)
                        fresh, many = [], True
            yield rows(late, kind)
        if many and fresh:
            yield singly(fresh, kind)
        elif len(fresh) > 1:
            kept += [f[0] for f in fresh]
            where += [f[1:] for f in fresh]
        if kept:
            yield work(kind)

    return bodies.mapInArrow(run, f"doc_id {id_type}, row long, start long, stop long, window binary")


def removed_spans(rows: DataFrame, length: int, crowd: int) -> DataFrame:
    """row, start, stop of repeated strings (overlapping spans are possible)."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    repeated = materialize(repeated_pieces(rows, length, id_type), "repeated-pieces")
    told = repeated.where("same").select("row", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    found = repeated.where("not same").groupBy("row").agg(F.collect_set(F.struct("bucket", "start", "windows")).alias("found"))
    cut = cut_bodies(rows.join(found, "row").select("doc_id", "row", "text", "found"), id_type, length)
    dealt = cut.repartition("bucket").sortWithinPartitions("bucket", "body", "doc_id", "row", "start")
    out = materialize(expand(dealt, length, id_type, crowd), "removed-spans")
    # windows of crowded buckets are grouped over the cluster
    windows = out.where("window is not null")
    at = F.struct("doc_id", "row", "start")
    first = windows.groupBy("window").agg(F.min(at).alias("first"))
    crowded = windows.join(first, "window").where(at > F.col("first"))
    return (told.unionByName(out.where("window is null").select("row", "start", "stop"))
            .unionByName(crowded.select("row", "start", "stop")))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def dedup_bytes(docs: DataFrame, length: int = 100, crowd: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs), kept (remaining bytes) for every row of ``docs``."""
    d = documents(docs)
    rows = d.withColumn("row", F.xxhash64("doc_id", "text"))
    found = removed_spans(rows, length, crowd).groupBy("row").agg(
        F.collect_set(F.struct("start", "stop")).alias("found"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in batches:
            n, spans, kept = [], [], []
            for t, f in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                m = merge_spans([(x["start"], x["stop"]) for x in f or []])
                at = [0, *[z for _, z in m]]
                n.append(len(data))
                spans.append([{"start": a, "stop": z} for a, z in m])
                kept.append(b"".join(data[z:a] for z, a in zip(at, [*[a for a, _ in m], len(data)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, span),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return (rows.join(found, "row", "left").select("doc_id", "text", "found")
            .mapInArrow(run, f"doc_id {id_type}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"))
