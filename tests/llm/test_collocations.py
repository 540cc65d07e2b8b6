"""Phrase collocations against a count of all phrases held in memory."""
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riskline.llm import collocations as C


def plain(rows, support, top, longest=3):
    f, n = {}, Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        g = f.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, longest + 1):
                for i in range(len(w) - s + 1):
                    g[tuple(w[i:i + s])] += 1
    out = []
    for lang, g in f.items():
        c = {p: a for p, a in g.items() if len(p) > 1 and a >= support}
        inside = Counter()
        for p, a in c.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    inside[p[i:i + s]] = max(inside[p[i:i + s]], a)
        found = []
        for p, a in c.items():
            if 100 * inside[p] < 50 * a:
                cut = [(1000000 * a * a // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cut)
                found.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def test_equals_a_plain_count(spark, odd):
    r = random.Random(1)
    odd_texts = ["A\x0bB c\x85d \x1ce\x1d!f\tg", "É é. é É", "a " * 400, "!?\n\t ", "x-y x-y, x-y\r\nx-y"] * 6
    rows = [(i, t, [None, "en", "", "日本"][i % 4], None, 0, i, 0, 0) for i, t in enumerate(odd_texts)]
    rows += [(None, " ".join(r.choice("abcdef") + r.choice(".   ") for _ in range(300)), "fr", "", 1, 0, 0, 0) for _ in range(20)]
    df = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    for top, longest in ((2000, 3), (7, 4)):
        got = C.collocations(df, 10, longest, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain([x.asDict() for x in df.collect()], 10, top, longest)
    assert C.collocations(df.limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 4_000_000_000)], "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", "a", 5_000_000_001), ("en", "b", 4_000_000_003)], "lang string, phrase string, n long")
    total = spark.createDataFrame([("en", 90_000_000_000)], "lang string, n long")
    row = C.scored(phrases, words, total).first()
    assert row.score == 1_000_000 * 4_000_000_000 ** 2 // (5_000_000_001 * 4_000_000_003)


def test_rounds_of_the_ranking_keep_the_first(spark):
    df = spark.range(60_000).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("phrase"),
                                    (F.col("id") % 5).alias("a"), (F.col("id") % 1000).alias("score"))
    got = [x.phrase for x in C.best_of(df, 50).orderBy("rank").collect()]
    want = sorted(df.collect(), key=lambda x: (-x.score, -x.a, x.phrase))[:50]
    assert got == [x.phrase for x in want]


def test_bitmap_never_loses_an_entry(spark):
    keys = np.random.default_rng(0).integers(-2**63, 2**63, 3000)
    bits = C.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"), F.col("key")).value
    assert bits.has(keys.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(-2**63, 2**63, 3000).view(np.uint64)
    assert bits.has(other).mean() < 0.1


def test_mining_passes_make_no_text_of_words():
    block = C.Block()
    block.add(0, "en", "Some words, ï words.")
    block.close()
    assert "words" not in vars(block) and len(block.base) == 4
    assert block.words.to_pylist() == ["", "some", "words", "ï"]
