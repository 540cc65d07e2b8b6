"""Merkle manifest of a table, by checkpoint and recompute.

Every row is a leaf, every language a binary tree over its leaves in ascending
``doc_id``, and the languages' roots form one last tree. Only every ``LEVELS``-th
level is stored: the leaves, the roots of aligned subtrees of 2^LEVELS leaves,
the roots over 2^LEVELS of those, and so on. The levels between are never
written: building a stored level and extracting proofs both read the stored
descendants of one aligned subtree (at most 2^LEVELS digests, in the task that
holds them), regenerate its interior nodes, emit what is asked for and drop them.

Proofs run from the top down. A stored node's steps to the root are its steps
inside its own subtree, then those of that subtree's root. A subtree's root
travels with its descendants as one more row of the same shuffle, so each stored
level is dealt out once, by (language, subtree): a language that holds a third of
all rows is as many groups as it has subtrees.

Defined results: a null field hashes as ``-``; a null language is a language of
its own, before all others; rows with a null id come first in their language;
rows with equal ids are ordered by their leaf digest (rows that are equal in all
hashed fields may swap places); empty texts hash as ``0:``; an empty table has no
tree and no proofs; columns that are not hashed are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import materialize
from riskline.operators.ranking import key_rank

#: Levels between two stored ones; a subtree holds at most 2^LEVELS stored digests.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64

#: One step from a node to its parent: the sibling and its side; an only child has side '-'.
STEP = "struct<side:string, digest:string>"
NODES = "tree string, place long, digest string"


@dataclass
class Manifest:
    """Stored levels, lowest first, each (tree, place, digest); ``roots`` has one row per language, ``root`` at most one."""

    leaves: DataFrame           # tree, place, digest, doc_id and what the caller kept
    levels: list[DataFrame]     # stored levels above the leaves
    roots: DataFrame            # tree (one for all), place, digest, and the language's tree (of)
    tops: list[DataFrame]       # stored levels above the languages' roots
    root: DataFrame             # digest
    gap: int                    # distance of two stored levels


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields; ``changed`` replaces some of them."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree_key(lang: str = "lang") -> Column:
    """Key of a row's language; byte order of the keys is the order of the languages, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


# Work inside one aligned subtree ---------------------------------------------------

def grow(digests: np.ndarray, rounds: int) -> list[np.ndarray]:
    """All levels of a subtree from its lowest (S64 array) up, ``rounds`` above it."""
    out = [digests]
    for _ in range(rounds):
        below = out[-1].tolist()
        out.append(np.array([hashlib.sha256(b"".join(below[i:i + 2])).hexdigest().encode()
                             for i in range(0, len(below), 2)], dtype=f"S{HEX}"))
    return out


def rounds_of(n: int, gap: int) -> int:
    """Levels that a subtree spans when its tree has ``n`` nodes on the subtree's lowest level."""
    return min(gap, max(n - 1, 0).bit_length())


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive next to each other, many to a table where they are small."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        new = _starts(table, keys)
        if len(new) > 1:  # the last group may go on in the next batch
            yield table.slice(0, new[-1])
            held = table.slice(new[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        codes = table.column(k).combine_chunks()
        if pa.types.is_string(codes.type):
            codes = codes.dictionary_encode().indices
        v = codes.to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _ascii(column) -> np.ndarray:
    """Digests as an S64 array."""
    return np.array(column.to_pylist(), dtype=f"S{HEX}")


def _roots(gap, batches):
    """Root of every aligned subtree from its stored descendants."""
    for table in _groups(batches, ["tree", "subtree"]):
        starts = np.append(_starts(table, ["tree", "subtree"]), table.num_rows)
        digests = _ascii(table.column("digest"))
        nodes = table.column("nodes").to_numpy()
        tops = [grow(digests[a:b], rounds_of(int(nodes[a]), gap))[-1][0].decode() for a, b in zip(starts, starts[1:])]
        first = pa.array(starts[:-1])
        yield pa.RecordBatch.from_pydict({"tree": table.column("tree").take(first).combine_chunks(),
                                          "place": table.column("subtree").take(first).combine_chunks(),
                                          "digest": pa.array(tops, pa.string())})


def _siblings(levels: list[np.ndarray]) -> list[list[tuple[str, str | None]]]:
    """Steps of every lowest node up to the subtree's root."""
    n = len(levels[0])
    out = [[] for _ in range(n)]
    for depth, nodes in enumerate(levels[:-1]):
        text = [d.decode() for d in nodes.tolist()]
        steps = [("R", text[p + 1]) if p % 2 == 0 and p + 1 < len(text) else ("-", None) if p % 2 == 0
                 else ("L", text[p - 1]) for p in range(len(text))]
        for i in range(n):
            out[i].append(steps[i >> depth])
    return out


def _steps(gap, batches):
    """Steps to the root of every stored node; a subtree's own steps come as its first row (place -1)."""
    for table in _groups(batches, ["tree", "subtree"]):
        starts = np.append(_starts(table, ["tree", "subtree"]), table.num_rows)
        digests, nodes = _ascii(table.column("digest")), table.column("nodes").to_numpy()
        subroot, upper = table.column("subroot"), table.column("steps")
        rows, steps, roots = [], [], []
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            above = [(s["side"], s["digest"]) for s in upper[a].as_py() or []]
            inner = _siblings(grow(digests[a + 1:b], rounds_of(int(nodes[a + 1]), gap)))
            steps += [own + above for own in inner]
            roots += [subroot[a].as_py()] * len(inner)
            rows += range(a + 1, b)
            if len(rows) >= 4096:
                yield _step_batch(table, rows, steps, roots)
                rows, steps, roots = [], [], []
        if rows:
            yield _step_batch(table, rows, steps, roots)


def _step_batch(table, rows, steps, roots):
    ends = np.append(0, np.cumsum([len(p) for p in steps])).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array([s for path in steps for s, _ in path], pa.string()),
                                        pa.array([d for path in steps for _, d in path], pa.string())],
                                       ["side", "digest"])
    kept = table.select([c for c in table.column_names if c not in ("subtree", "nodes", "subroot", "steps")])
    kept = kept.take(pa.array(rows))
    columns = {c: kept.column(c).combine_chunks() for c in kept.column_names}
    columns["subroot"] = pa.array(roots, pa.string())
    columns["steps"] = pa.ListArray.from_arrays(pa.array(ends), items)
    return pa.RecordBatch.from_pydict(columns)


# Stored levels ----------------------------------------------------------------------

def _counted(nodes: DataFrame, gap: int) -> DataFrame:
    """Nodes with the size of their tree on this level and their subtree; sizes are one row per tree."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"))
    return _with_sizes(nodes, sizes).withColumn("subtree", F.shiftright("place", gap))


def _with_sizes(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Join the trees' sizes; trees with a thousandth of all nodes or more (at most 1000) by broadcast, so that no
    large tree is dealt to one task."""
    total = sizes.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    large = sizes.where(F.col("nodes") * 1000 >= total)
    first = nodes.join(F.broadcast(large), "tree", "left")
    rest = first.where("nodes is null").drop("nodes").join(sizes.where(F.col("nodes") * 1000 < total), "tree")
    return first.where("nodes is not null").unionByName(rest)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "subtree").sortWithinPartitions("tree", "subtree", "place")


def _store(nodes: DataFrame, name: str, gap: int) -> list[DataFrame]:
    """Stored levels above ``nodes`` up to the one that holds only roots."""
    out, level = [], nodes.select("tree", "place", "digest")
    while level.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0] > 0:
        # A tree of one node is its own root (no rounds) and passes through unchanged.
        up = _dealt(_counted(level, gap)).mapInArrow(partial(_roots, gap), NODES)
        level = materialize(up, name)
        out.append(level)
    return out


def build(df: DataFrame, *keep: Column, gap: int = LEVELS) -> Manifest:
    """Leaves and stored levels of ``df``; ``keep`` are further columns to carry
    with the leaves, ``gap`` is the distance of two stored levels."""
    rows = df.select(tree_key().alias("tree"), "doc_id", leaf().alias("digest"), *keep,
                     F.monotonically_increasing_id().alias("seen"))
    ranked = key_rank(rows, ["tree"], ["doc_id", "digest", "seen"], "place")
    leaves = materialize(ranked.withColumn("place", F.col("place") - 1).drop("seen"), "leaves")
    levels = _store(leaves, "level", gap)
    tips = levels[-1] if levels else leaves.select("tree", "place", "digest")
    ranked = key_rank(tips.select(F.lit("").alias("all"), F.col("tree"), "digest"), ["all"], ["tree"], "place")
    roots = materialize(ranked.select(F.col("all").alias("tree"), F.col("place") - 1, "digest", "tree")
                        .toDF("tree", "place", "digest", "of"), "roots")
    tops = _store(roots, "top", gap)
    root = (tops[-1] if tops else roots).select("digest")
    return Manifest(leaves, levels, roots, tops, root, gap)


# Proofs -----------------------------------------------------------------------------

def _descend(upper: DataFrame, lower: DataFrame, gap: int) -> DataFrame:
    """Steps to the root for the nodes of ``lower``, given those of the next stored level, ``upper``."""
    nodes = (_counted(lower, gap).withColumn("subroot", F.lit(None).cast("string"))
             .withColumn("steps", F.lit(None).cast(f"array<{STEP}>")))
    of_node = [c for c in lower.columns if c not in ("tree", "place")]
    heads = upper.select("tree", F.lit(-1).cast("long").alias("place"), "subroot", "steps",
                         F.lit(0).cast("long").alias("nodes"), F.col("place").alias("subtree"),
                         *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in of_node])
    out = nodes.drop("subtree", "nodes").schema
    return _dealt(nodes.unionByName(heads)).select(*out.names, "nodes", "subtree").mapInArrow(partial(_steps, gap), out)


def proofs(m: Manifest) -> DataFrame:
    """Every leaf with its steps to the root (``steps``, lowest first) and its language's root (``subroot``)."""
    nothing = F.array().cast(f"array<{STEP}>").alias("steps")
    no_root = F.lit(None).cast("string").alias("subroot")
    trees = [m.roots, *m.tops]
    path = trees[-1].select("*", no_root, nothing)
    for lower in reversed(trees[:-1]):
        path = _descend(path, lower, m.gap)
    path = path.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"),
                       F.col("digest").alias("subroot"), "steps")
    stored = [m.leaves, *m.levels]
    if len(stored) == 1:  # every language has one row
        return m.leaves.join(path.drop("place"), "tree")
    for lower in reversed(stored[:-1]):
        path = _descend(path, lower, m.gap)
    return path


def siblings(steps: str = "steps") -> Column:
    """Sibling digests from the leaf to the root, one text."""
    return F.array_join(F.transform(F.filter(steps, lambda s: s["digest"].isNotNull()), lambda s: s["digest"]), "")


def fold(start: Column, steps: str = "steps") -> Column:
    """Root that ``start`` leads to by the steps of a proof."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(
        F.when(s["side"] == "L", F.concat(s["digest"], acc)).when(s["side"] == "R", F.concat(acc, s["digest"]))
        .otherwise(acc), 256))


def tampered(every: int = 7) -> Column:
    """Leaf digest after 1 is added to n_chars where ``every`` divides the id's CRC-32; elsewhere the leaf itself."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(F.coalesce(hit, F.lit(False)), leaf(n_chars=F.col("n_chars") + 1)).otherwise(leaf())


def audit(df: DataFrame, gap: int = LEVELS) -> DataFrame:
    """Build the manifest of ``df``, tamper with some rows and check all against their proofs."""
    m = build(df, tampered().alias("changed"), gap=gap)
    root = m.root.first()  # one digest
    root = F.lit(root.digest if root else None).cast("string")
    p = proofs(m).withColumn("folded_root", fold(F.col("changed")))
    return p.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"),
                    F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == root).alias("verified"))
