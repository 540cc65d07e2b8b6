"""Long lists of the Jaccard join: which members are compared, and that no link between components is lost."""

import random

import pytest

from riskline.llm import common, jaccard_join


def watch(monkeypatch):
    """Rows of every table that the join writes, by name."""
    seen = {}

    def written(df, name):
        out = common.materialize(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", written)
    return seen


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


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


def test_one_common_passage_compares_no_members(spark, monkeypatch):
    r = random.Random(5)
    common_words = " ".join(f"common{i}" for i in range(14))
    texts = [" ".join(f"w{r.random()}" for _ in range(70)) + " " + common_words for _ in range(80)]
    seen = watch(monkeypatch)
    docs = frame(spark, texts)
    known = jaccard_join.materialize(jaccard_join.survey(docs, 5), "shingle-sets")
    assert jaccard_join.jaccard_links(docs, known, short=8, frequent=0).count() == 0
    assert seen["shared-postings"][0] > 8  # a long list
    assert seen["pairs"] == [0]  # before: every member with the hub


def test_pairs_connected_by_a_third_text_are_not_formed(spark, monkeypatch):
    r = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    small = [f"s{i}" for i in range(30)] + base[:40]

    def edit(words, n):
        out = list(words)
        for i in r.sample(range(len(out)), n):
            out[i] = f"x{r.random()}"
        return " ".join(out)

    texts = [" ".join(small), " ".join(base)] + [edit(base, 2) for _ in range(60)] + [edit(small, 1) for _ in range(10)]
    seen = watch(monkeypatch)
    docs = frame(spark, texts)
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs, short=4, frequent=0).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(seen["outside-pairs"]) < 600  # before: all pairs of the 61 texts near the base


@pytest.mark.parametrize("short", [1, 2, 6])
def test_crowds_of_edited_texts_equal_all_pairs(spark, short):
    r = random.Random(short)
    texts = []
    for group in range(4):
        base = [f"g{group if r.random() < 0.7 else 9}_{i}" for i in range(60)]
        for _ in range(25):
            t = [f"e{r.randrange(10 ** 9)}" if r.random() < r.choice((0.005, 0.02, 0.04)) else w for w in base]
            texts.append(" ".join(t[:r.randrange(45, 61)]))
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(frame(spark, texts), short=short, frequent=0).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
