"""Cells of the Jaccard join: members of long lists are compared without rows of pairs, and no link is lost."""

import random

import numpy as np
import pytest

from riskline.llm import common, jaccard_join


def edited(r, base, n):
    out = list(base)
    for i in r.sample(range(len(out)), n):
        out[i] = f"x{r.random()}"
    return " ".join(out)


def brute(texts):
    words = [t.split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    label = list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def joined(spark, texts, **rule):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs, frequent=0, **rule).collect()}
    return [got[i] for i in range(len(texts))]


def test_a_crowd_of_unlinked_texts_forms_few_pairs(spark, monkeypatch):
    r, seen = random.Random(2), {}

    def written(df, name):
        out = common.materialize(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", written)
    base = [f"b{i}" for i in range(200)]
    texts = [edited(r, base, r.choice((3, 9, 10, 11))) for _ in range(100)]
    assert joined(spark, texts, short=8) == brute(texts)
    assert seen["cells"] <= 3 * len(texts)
    assert seen["outside-pairs"] < 300  # before: 4,752


@pytest.mark.parametrize("block", [100, 1 << 20])
def test_cells_of_any_size_equal_all_pairs(spark, block):
    r = random.Random(block)
    texts = []
    for group in range(3):
        base = [f"g{group if r.random() < 0.8 else 9}_{i}" for i in range(70)]
        texts += [edited(r, base[:r.randrange(48, 71)], r.choice((0, 1, 2, 3, 4))) for _ in range(30)]
    assert joined(spark, texts, short=2, block=block) == brute(texts)


@pytest.mark.parametrize("percent", [50, 80, 100])
@pytest.mark.parametrize("two", [False, True])
def test_links_of_a_cell_connect_what_all_pairs_do(percent, two):
    g = np.random.default_rng(percent)
    base = g.integers(0, 1 << 63, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[g.random(90) > g.random() * 0.3], g.integers(0, 1 << 63, g.integers(0, 20)).astype(np.uint64)]))
            for _ in range(60)]
    sets += sets[:1] if percent == 100 else []
    group = np.array([0 if k < 6 else k for k in range(len(sets))])
    side = np.arange(len(sets)) % 2 if two else np.zeros(len(sets), int)
    root = group.copy()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (not two or side[a] != side[b]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[root == root[a]] = root[b]
    found = jaccard_join.cell_links(sets, group, side, percent, batch=4)
    mine = group.copy()
    for a, b in found:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert mine[a] != mine[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
        mine[mine == mine[a]] = mine[b]
    same = lambda x: x[:, None] == x
    assert (same(mine) == same(root)).all()


def test_parities_never_exceed_the_difference():
    g = np.random.default_rng(1)
    for n in (1, 2, 31, 33, 64, 400, 5_000, 40_000):
        x = np.unique(g.integers(0, 1 << 63, n).astype(np.uint64))
        for keep, new in ((1.0, 0), (0.95, n // 20), (0.6, n), (0.3, 0)):
            y = np.unique(np.concatenate([x[g.random(len(x)) < keep], g.integers(0, 1 << 63, new).astype(np.uint64)]))
            found = jaccard_join.least_difference(jaccard_join.parities(x), jaccard_join.parities(y))
            exact = len(np.setxor1d(x, y))
            assert found <= exact and (found >= exact / 4 or n > 5_000)
            assert found == jaccard_join.least_difference(jaccard_join.parities(y), jaccard_join.parities(x))


def test_pairs_that_cannot_be_linked_do_not_meet_with_their_items(spark):
    g = np.random.default_rng(4)
    x, far = (np.unique(g.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2))
    sets = {1: x, 2: x[10:], 3: np.unique(np.concatenate([x[:150], far[:150]]))}
    frame = spark.createDataFrame([(k, len(v), bytearray(jaccard_join.parities(v).tobytes()), bytearray(v.tobytes())) for k, v in sets.items()],
                                  "set long, n long, bits binary, items binary")
    pairs = spark.createDataFrame([(1, 2, False), (1, 3, False), (3, 2, False), (3, 1, True)], "a long, b long, hub boolean")
    order = spark.sparkContext.broadcast(jaccard_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = {(r.a, r.b, r.hub, r.linked) for r in jaccard_join.compare(pairs, frame, order, 80).collect()}
    assert got == {(1, 2, False, True), (3, 1, True, False)}  # before: a row of each pair
