"""Exact n-gram Jaccard components with adaptive multi-match prefixes.

A document is the set of its hashed word shingles. Equal sets are one vertex. All
sets are put in one global order (rare shingles first; shingles seen often stand
last). Two sets with Jaccard similarity t or more share at least l shingles within
their prefixes of n - ceil(t*n) + l. Each document lengthens its prefix (chooses
its l) by the estimated cost of its candidates, and a pair is verified only if it
shares as many prefix shingles as the smaller l of the two asks for.

Lists of a prefix shingle that are longer than ``short`` are not paired up. They
matter only to pairs that share no shorter list, so all shingles such a pair asks
for lie in long lists. A member stays in a long list only if it stands in as many
long lists as the l of some member of like size asks for, and that member does too.
The smallest set that stays is the hub: every member is compared with the hub alone. Members
linked to the hub are in one component. If x is not linked to hub p, any set y of
the list that is linked to x shares a shingle with x outside p (|y| >= |p|, so the
overlap of x and y exceeds that of x and p). So the members are listed again by
their shingles outside the hub, and only there pairs are formed, never those of
two members that links found before connect. Lists that are still long there have
a hub of their own, and so on. The members of what is long after ``ROUNDS`` are no
rows of pairs either: they are dealt into cells of bounded size, each of which holds
its sets once and gives the links that connect members not connected yet.

Defined results: null or empty text has an empty set, links with nothing and is its
own component; fewer words than a shingle make one shingle of all; rows of equal id
are rows of their own; a row without id takes part like any other, and its component
has the smallest id of the others, or none; an empty table gives no rows; extra
columns are ignored. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.common import (Counter64, count_cut, documents, gather, give_back, lower_ascii, materialize, mix64,
                                 row_key, unused, without_rows)
from riskline.llm.components import components

LEVELS = 24         # longest extension of a prefix
UNSEEN = 0.25       # other members expected in the list of a shingle outside the frequent ones
FLUSH = 1 << 20     # shingles after which a task reports its frequent ones
OFTEN = 6           # reported if seen so often among them
ROUNDS = 2          # times that members are listed again outside a hub, before members of long lists are compared in cells
BLOCK = 1 << 20     # shingles expected on each side of a cell


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts."""

    def __init__(self, width: int = 5, memory: int = 500_000):
        self.width, self.memory = width, memory
        self.rows, self.hashes = Counter64(), np.zeros(0, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        words = lower_ascii(text).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.rows) > self.memory:
            self.rows, self.hashes = Counter64(), np.zeros(0, np.uint64)
        known = len(self.rows)
        ids = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        if len(self.rows) > known:
            if len(self.rows) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(self.rows) + 1024, np.uint64)])
            fresh = words if not known else [w for w, k in zip(words, ids.tolist()) if k >= known]
            for w in fresh:
                self.hashes[self.rows[w]] = xxhash.xxh64_intdigest(w)
        h = self.hashes[ids]
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, np.uint64(len(words) if len(words) < self.width else 0))
        for k in range(width):
            out = mix64(out + h[k:len(words) - width + 1 + k])
        return np.unique(out)


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=7) - (1 << 63)


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def survey(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (doc_id, row, set, n) and rows (shingle, seen) of those frequent within a task."""
    d = documents(docs)
    d = d.select("doc_id", row_key(d).alias("row"), "text")

    def run(batches):
        make, held, size = Shingler(width), [], 0
        kinds = None

        def report():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            at, n = at[n >= OFTEN], n[n >= OFTEN]
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(at), kinds), none, none, none, pa.array(at.view(np.int64)), pa.array(n, pa.int64())], names)

        names = ["doc_id", "row", "set", "n", "shingle", "seen"]
        for b in batches:
            kinds, sets, sizes = b.column("doc_id").type, [], []
            for t in b.column("text").to_pylist():
                s = make(t)
                sets.append(fingerprint(s) if len(s) else None)
                sizes.append(len(s))
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield report()
                    held, size = [], 0
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(sets, pa.int64()),
                                              pa.array(sizes, pa.int64()), none, none], names)
        if held:
            yield report()

    id_type = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {id_type}, row long, set long, n long, shingle long, seen long")


class Order:
    """The global order: shingles outside the frequent list by hash, then the frequent ones by count."""

    def __init__(self, shingles: np.ndarray, seen: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.seen = shingles[by], seen[by]

    def arrange(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set in global order, estimated other members of each shingle's list)."""
        if not len(self.shingles):
            return s, np.full(len(s), UNSEEN)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        hot = self.shingles[at] == s
        n = self.seen[at[hot]]
        by = np.lexsort((s[hot], n))
        return np.concatenate([s[~hot], s[hot][by]]), np.concatenate([np.full(int((~hot).sum()), UNSEEN), n[by].astype(float)])

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """(prefix, l): l minimises list reads plus verification of the candidates that share l shingles."""
        ordered, cost = self.arrange(s)
        base = len(s) - least_overlap(len(s), percent)
        most = min(LEVELS, len(s) - base)
        reads = np.cumsum(cost)[base:base + most]  # other members of the lists
        level = np.arange(1, most + 1)
        total = reads + level + reads / level * (1 + len(s) / 16)
        k = int(level[np.argmin(total)])
        return ordered[:base + k], k


def postings(docs: DataFrame, width: int, percent: int, order) -> DataFrame:
    """shingle, set, n, l of all prefixes; a task lists equal sets once."""
    def run(batches):
        make, done = Shingler(width), set()
        for b in batches:
            cols = [[], [], [], []]
            for t in b.column("text").to_pylist():
                s = make(t)
                f = fingerprint(s)
                if len(s) and f not in done:
                    done.add(f)
                    p, level = order.value.prefix(s, percent)
                    for c, v in zip(cols, (p.view(np.int64), f, len(s), level)):
                        c.append(v if c is cols[0] else np.full(len(p), v, np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)).cast(k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                    ["shingle", "set", "n", "l"])

    return documents(docs).select("text").mapInArrow(run, "shingle long, set long, n int, l int")


def shared_postings(lists: DataFrame) -> DataFrame:
    """Postings of shingles with two or more sets, with the list's size."""
    w = Window.partitionBy("shingle")
    return (lists.repartition("shingle").withColumn("lo", F.min("set").over(w)).withColumn("hi", F.max("set").over(w))
            .where("lo <> hi").drop("lo", "hi").dropDuplicates(["shingle", "set"])
            .withColumn("size", F.count(F.lit(1)).over(w)))


def size_bin(percent: int) -> Column:
    """Bin of a set's size n: sizes that fit lie in the same or in neighbouring bins."""
    return F.floor(F.log("n") / max(1.001 * math.log(100 / percent), 0.01)).cast("int")


def long_members(long: DataFrame, percent: int) -> DataFrame:
    """set, n, hub of the postings in ``long`` lists that a pair may need which shares no other list.

    Such a pair shares l long lists, l being the smaller of its two: one set stands in as many as its own
    l asks for, the other in as many as that.
    """
    like = Window.partitionBy("shingle").orderBy("bin").rangeBetween(-1, 1)
    of = Window.partitionBy("shingle")
    return (long.join(long.groupBy("set").agg(F.count(F.lit(1)).alias("long")), "set")
            .withColumn("bin", size_bin(percent))
            .withColumn("least", F.min(F.when(F.col("long") >= F.col("l"), F.col("l"))).over(like))
            .where("long >= least").withColumn("hub", F.min(F.struct("n", "set")).over(of)["set"])
            .select("set", "n", "hub").distinct())


def _pairs(lists: DataFrame, key: list[str], extra: list[str]) -> DataFrame:
    """All pairs a < b within lists of bounded size, with the ``extra`` columns of both."""
    grouped = lists.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("set", *extra))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return grouped.select(F.explode(pairs).alias("p")).select(
        F.col("p.x.set").alias("a"), F.col("p.y.set").alias("b"),
        *[F.col(f"p.{s}.{c}").alias(f"{c}_{t}") for c in extra for s, t in (("x", "a"), ("y", "b"))])


def parities(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64-bit words, two bits a shingle or more: sets differ by at least as many."""
    words = 1 << min(10, max(0, (len(s) - 1).bit_length() - 5))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (s >> np.uint64(6)) & np.uint64(words - 1), np.uint64(1) << (s & np.uint64(63)))
    return out


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Lower bound on the symmetric difference of two sets, by their ``parities``."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def sets_of(docs: DataFrame, wanted: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """set, n, bits (``parities``), items (8-byte hashes in order) of the wanted sets, from one row of each (``firsts``: set, row)."""
    rows = wanted.join(firsts, "set").select("row", "set")
    d = documents(docs)
    d = d.select(row_key(d).alias("row"), "text")

    def run(batches):
        make = Shingler(width)
        for b in batches:
            sets = [make(t) for t in b.column("text").to_pylist()]
            # keys of unlike rows may be equal
            mine = [len(s) > 0 and fingerprint(s) == f for s, f in zip(sets, b.column("set").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("set"), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "n", "bits", "items"]).filter(pa.array(mine, pa.bool_()))

    return d.join(rows, "row").dropDuplicates(["row", "set"]).select("set", "text").mapInArrow(run, "set long, n long, bits binary, items binary")


def linked(n_a, n_b, both, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, hub) that may be linked by their sets' sizes and ``parities``: only these meet with all their items."""
    def run(batches):
        for batch in batches:
            may = [100 * (x + y) - 100 * d >= percent * (x + y + d) for x, y, d in zip(
                batch.column("na").to_pylist(), batch.column("nb").to_pylist(),
                (least_difference(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                 for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())))]
            yield batch.select(["a", "b", "hub"]).filter(pa.array(may, pa.bool_()))

    side = lambda c: sets.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "hub", "na", "nb", "xa", "xb")
            .mapInArrow(run, "a long, b long, hub boolean"))


def compare(pairs: DataFrame, sets: DataFrame, order, percent: int) -> DataFrame:
    """(a, b, hub, linked, rest) of pairs (a, b, hub), but for those without hub that are seen not to be linked by ``near_pairs``.

    Where b is the hub of a, ``rest`` are the shingles of a outside b by which to look further.
    """
    def run(batches, rows=256):
        for batch in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
            ok, rest = [], []
            for x, y, hub in zip(*(batch.column(c).to_pylist() for c in ("ia", "ib", "hub"))):
                s, p = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                out = np.setdiff1d(s, p, assume_unique=True)
                both = len(s) - len(out)
                ok.append(linked(len(s), len(p), both, percent))
                if hub:
                    out, _ = order.value.arrange(out)
                    if not ok[-1]:
                        # overlap needed with any set as large as the hub and with any that fits s, less what the hub can give
                        need = max(1, -(-percent * (len(s) + len(p)) // (100 + percent)) - both, least_overlap(len(s), percent) - both)
                        out = out[:max(0, len(out) - need + 1)]
                rest.append(out.view(np.int64) if hub else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("a", "b", "hub")), pa.array(ok, pa.bool_()),
                 pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "hub", "linked", "rest"])
        give_back()  # the worker goes on to other tasks

    pairs = near_pairs(pairs.where("not hub"), sets, percent).unionByName(pairs.where("hub").select("a", "b", "hub"))
    return (pairs.join(sets.select(F.col("set").alias("b"), F.col("items").alias("ib")), "b")
            .join(sets.select(F.col("set").alias("a"), F.col("items").alias("ia")), "a")
            .select("a", "b", "hub", "ia", "ib")
            .mapInArrow(run, "a long, b long, hub boolean, linked boolean, rest array<long>"))


def linked_pairs(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("a", "b")


def outside_hubs(hubs: DataFrame, sizes: DataFrame, links: DataFrame) -> DataFrame:
    """hub, z, set, n, group, degree, size: members by their shingles z outside the hub, where not all are connected yet.

    By the ``links`` (a, b) found so far, ``group`` is a member's component and ``degree`` its number of links.
    """
    w = Window.partitionBy("hub", "z")
    degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("degree"))
    of = (sizes.join(components(links).withColumnRenamed("node", "set"), "set", "left").join(degree, "set", "left")
          .select("set", "n", F.coalesce("component", "set").alias("group"), F.coalesce("degree", F.lit(0)).alias("degree")))
    listed = hubs.select(F.col("a").alias("set"), F.col("b").alias("hub"), "rest").join(of, "set")
    return (listed.select("hub", F.explode("rest").alias("z"), "set", "n", "group", "degree").repartition("hub", "z")
            .withColumn("size", F.count(F.lit(1)).over(w)).withColumn("low", F.min("group").over(w))
            .withColumn("high", F.max("group").over(w)).where("low <> high").drop("low", "high"))


def crowds(lists: DataFrame) -> DataFrame:
    """crowd, z, set, n, group: members to compare with each other, so that no pair of one of the ``lists`` is left out.

    A crowd is a list, all members of a hub, or all members of hubs that share members: lists of like members
    become one crowd where that makes fewer pairs than the lists do. Its z is 0 unless it is a list.
    """
    of_hub = lists.groupBy("hub", "set").agg(F.sum("size").alias("pairs"))
    near = components(of_hub.select(F.col("hub").alias("a"), F.col("set").alias("b"))).toDF("hub", "near")
    hubs = (of_hub.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("pairs").alias("pairs")).join(near, "hub")
            .select("hub", "near", (F.col("members") * F.col("members") <= F.col("pairs")).alias("by_hub"),
                    F.least(F.col("members") * F.col("members"), "pairs").alias("pairs")))
    members = of_hub.join(near, "hub").groupBy("near").agg(F.countDistinct("set").alias("members"))
    whole = (hubs.groupBy("near").agg(F.sum("pairs").alias("pairs")).join(members, "near")
             .select("near", (F.col("members") * F.col("members") <= F.col("pairs")).alias("by_near")))
    by = hubs.join(whole, "near").select("hub", "near", "by_hub", "by_near")
    return lists.join(by, "hub").select(
        F.when(F.col("by_near"), F.col("near")).otherwise(F.col("hub")).alias("crowd"),
        F.when(F.col("by_near") | F.col("by_hub"), F.lit(0)).otherwise(F.col("z")).alias("z"), "set", "n", "group").distinct()


def cells(members: DataFrame, percent: int, block: int) -> DataFrame:
    """crowd, z, cell, side, set, group: any two members of a crowd whose sizes fit meet in one cell.

    A crowd's members of like size are dealt into parts of about ``block`` shingles. A cell has one part (all
    of side 0) or two (sides 0 and 1, to be compared across). Cells of members connected already are left out.
    """
    of = members.withColumn("bin", size_bin(percent))
    beside = lambda k: F.sum("parts").over(Window.partitionBy("crowd", "z").orderBy("bin").rangeBetween(k, k))
    parts = (of.groupBy("crowd", "z", "bin").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
             .withColumn("before", F.coalesce(beside(-1), F.lit(0))).withColumn("after", F.coalesce(beside(1), F.lit(0))))
    dealt = of.join(parts, ["crowd", "z", "bin"]).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))
    every = """flatten(array(
        transform(sequence(0, parts - 1), k -> named_struct('bin', bin, 'i', least(part, k), 'above', 0, 'j', greatest(part, k), 'side', int(part > k))),
        transform(filter(sequence(0, after), k -> k < after), k -> named_struct('bin', bin, 'i', part, 'above', 1, 'j', bigint(k), 'side', 0)),
        transform(filter(sequence(0, before), k -> k < before), k -> named_struct('bin', bin - 1, 'i', bigint(k), 'above', 1, 'j', part, 'side', 1))))"""
    cell = Window.partitionBy("crowd", "z", "cell")
    return (dealt.select("crowd", "z", "set", "group", F.explode(F.expr(every)).alias("of"))
            .select("crowd", "z", F.struct("of.bin", "of.i", "of.above", "of.j").alias("cell"), "of.side", "set", "group")
            .withColumn("low", F.min("group").over(cell)).withColumn("high", F.max("group").over(cell))
            .where("low <> high").drop("low", "high"))


class Cell:
    """Sets of a cell, with bounds on how much any two of them differ.

    Shingles of one set only are counted, those of several are summed up by the parity of their number in each
    of ``64 * words`` bits: sets differ by at least as many shingles as bits.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), self.n)
        items, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = (seen > 1)[at]
        number = np.cumsum(seen > 1) - 1
        self.flat, row, bits = number[at[shared]], row[shared], items[at[shared]]
        self.size = np.bincount(row, minlength=len(sets))
        self.start = np.cumsum(self.size) - self.size
        self.own = self.n - self.size
        words = 1 << max(0, (int(self.size.max()) - 1).bit_length() - 5)  # two bits a shingle or more
        self.bits = np.zeros((len(sets), words), np.uint64)
        np.bitwise_xor.at(self.bits, (row, (bits >> np.uint64(6)) & np.uint64(words - 1)), np.uint64(1) << (bits & np.uint64(63)))
        self.mark = np.zeros(int((seen > 1).sum()), np.int64)

    def least_difference(self, x: int, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[y] ^ self.bits[x]).sum(axis=1, dtype=np.int64) + self.own[y] + self.own[x]

    def both(self, x: int, y: np.ndarray) -> np.ndarray:
        mine = self.flat[self.start[x]:self.start[x] + self.size[x]]
        self.mark[mine] = 1
        theirs, size = gather(self.start, self.size, self.flat, y)
        ends = np.cumsum(size)
        held = np.concatenate([[0], np.cumsum(self.mark[theirs])])
        self.mark[mine] = 0
        return held[ends] - held[ends - size]


def cell_links(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int, batch: int = 64) -> list[tuple[int, int]]:
    """Links (numbers of sets) that connect what links of the cell connect, beyond the groups known before."""
    cell, out = Cell(sets), []
    _, root = np.unique(group, return_inverse=True)
    other = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        y = other if len(other) else np.arange(x + 1, len(sets))
        y = y[root[y] != root[x]]
        if not len(y):
            continue
        differ = cell.least_difference(x, y)
        fit = (100 + percent) * differ <= (100 - percent) * (cell.n[x] + cell.n[y])
        y = y[fit][np.argsort(differ[fit], kind="stable")]
        while len(y):
            now, y = y[:batch], y[batch:]
            for k in now[linked(cell.n[x], cell.n[now], cell.both(x, now), percent)]:
                if root[k] != root[x]:
                    out.append((int(x), int(k)))
                    root[root == root[k]] = root[x]
            y = y[root[y] != root[x]]
    return out


def crowd_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in ``cells``."""
    def run(rows: pa.Table) -> pa.Table:
        name = rows.column("set").to_numpy()
        found = cell_links([np.frombuffer(x, np.uint64) for x in rows.column("items").to_pylist()],
                           rows.column("group").to_numpy(), rows.column("side").to_numpy(), percent)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        give_back()
        return pa.table({"a": name[a], "b": name[b]})

    return dealt.join(sets.select("set", "items"), "set").groupBy("crowd", "z", "cell").applyInArrow(run, "a long, b long")


def jaccard_links(docs: DataFrame, known: DataFrame, width: int = 5, percent: int = 80, short: int = 32,
                  frequent: int = 50_000, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different sets whose components are those of all links.

    ``known`` is the materialized ``survey``. At most ``frequent`` shingles are sent to the tasks as
    frequent; all others count as rare, which costs time and no results.
    """
    sc = docs.sparkSession.sparkContext
    often = known.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("n"))
    often = materialize(often, "frequent-shingles")
    top = often.where(F.col("n") >= count_cut(often, frequent)).toArrow()
    order = sc.broadcast(Order(top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()))
    lists = materialize(shared_postings(postings(docs, width, percent, order)), "shared-postings")
    firsts = known.where("set is not null").groupBy("set").agg(F.min("row").alias("row"))
    in_long = lists.where(F.col("size") > short).groupBy("set").agg(F.count(F.lit(1)).alias("long"))
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    found = (_pairs(lists.where(F.col("size") <= short), ["shingle"], ["n", "l"]).where(fits)
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.least(F.max("l_a"), F.max("l_b")).alias("l")))
    side = lambda c: in_long.select(F.col("set").alias(c), F.col("long").alias(f"long_{c}"))
    # shingles shared in long lists were not counted: at most as many as either has there
    close = (found.join(side("a"), "a", "left").join(side("b"), "b", "left")
             .where(F.col("k") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))) >= F.col("l"))
             .select("a", "b"))
    in_hubs = materialize(long_members(lists.where(F.col("size") > short), percent), "long-members")
    members = in_hubs.where(F.col("set") != F.col("hub")).select(F.col("set").alias("a"), F.col("hub").alias("b"))
    first = materialize(close.withColumn("hub", F.lit(False)).unionByName(members.withColumn("hub", F.lit(True))), "pairs")
    named = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    sets = materialize(sets_of(docs, named(first), firsts, width), "sets")  # sets outside any pair are not fetched
    compared = materialize(compare(first, sets, order, percent), "compared")
    n = in_hubs.select("set", "n").distinct()
    links, few, hubs = linked_pairs(compared), [], compared.where("hub")
    for left in reversed(range(ROUNDS)):
        again = materialize(outside_hubs(hubs, n, links), "outside-hubs")
        few.append(_pairs(again.where(F.col("size") <= short), ["hub", "z"], ["n", "group"])
                   .where(fits & (F.col("group_a") != F.col("group_b"))).select("a", "b"))
        rest = again.where(F.col("size") > short)
        if not left or rest.isEmpty():
            break
        # The smallest set of such a list is the hub of the next round. The set of most links is no hub, but may connect many.
        w = Window.partitionBy("hub", "z")
        led = rest.select("set", "group", F.min(F.struct("n", "set")).over(w)["set"].alias("next"),
                          F.max(F.struct("degree", "set", "group")).over(w).alias("best"))
        members = (led.where("set <> next").select(F.col("set").alias("a"), F.col("next").alias("b"), F.lit(True).alias("hub"))
                   .unionByName(led.where("group <> best.group")
                                .select(F.col("set").alias("a"), F.col("best.set").alias("b"), F.lit(False).alias("hub"))))
        found = materialize(compare(members.distinct(), sets, order, percent), "compared")
        hubs = found.where("hub")
        links = links.unionByName(linked_pairs(found))
    if not rest.isEmpty():  # longer lists after the last round
        dealt = materialize(cells(crowds(rest), percent, block), "cells")
        mine = sets.join(dealt.select("set").distinct(), "set", "left_semi")
        links = links.unionByName(materialize(crowd_links(dealt, mine, percent), "crowd-links"))
    second = materialize(reduce(DataFrame.unionByName, few).distinct().withColumn("hub", F.lit(False)), "outside-pairs")
    last = compare(second, sets.join(named(second), "set", "left_semi"), order, percent)
    return links.unionByName(linked_pairs(last))


def jaccard_rows(docs: DataFrame, width: int = 5, percent: int = 80, **rule) -> DataFrame:
    """doc_id, row, n_shingles, group (of the row's set; null for an empty one), component_id for every row of ``docs``.

    The component's id is the smallest doc_id reachable by links; without any, and for empty sets, the row's own.
    """
    known = materialize(survey(docs, width), "shingle-sets")
    rows = known.where("shingle is null")
    firsts = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("first"))
    group = components(jaccard_links(docs, known, width, percent, **rule))
    named = firsts.join(group.withColumnRenamed("node", "set"), "set", "left").withColumn("group", F.coalesce("component", "set"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    by_set = named.select("set", "group").join(least, "group").select("set", "group", "component_id")
    return (rows.join(by_set, "set", "left")
            .select("doc_id", "row", F.col("n").alias("n_shingles"), "group", F.coalesce("component_id", "doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, **rule) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``docs``."""
    return jaccard_rows(docs, width, percent, **rule).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, **rule) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id (rows without id last), then smallest row key.

    Rows are judged by themselves, whatever ids they share: another text of the same id that is linked with
    nothing stays. Rows of equal id and text count once. Rows without a shingle link with nothing and all stay.
    """
    rows = materialize(jaccard_rows(docs, **rule).where("group is not null"), "components")
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("kept"))
    told = rows.groupBy("row").agg(F.min("group").alias("group"), (F.count(F.lit(1)) > 1).alias("many")).join(best, "group")
    rest = without_rows(docs, told.where("row <> kept").select("row"))
    # kept rows that occur more than once: few keys, each with its copies
    many = materialize(told.where("row = kept and many").select("row"), "repeated")
    key = unused(docs, "row_key")
    repeated = many.toDF(key)
    twice = rest.join(repeated, row_key(rest) == repeated[key], "left_semi").dropDuplicates(["doc_id", "text"])
    return without_rows(rest, many).unionByName(twice)
