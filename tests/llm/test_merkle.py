"""The Merkle manifest against a plain one held in memory."""
import hashlib
import zlib

import pytest

from riskline.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    out = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        v = r[name] + add if name == "n_chars" and r[name] is not None else r[name]
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*out)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(None if j >= len(level) else (j < i, level[j]))
        i >>= 1
    return out


def plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r["lang"] == x),
                    key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in of[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs]) if langs else None
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            steps = path(trees[x], i) + path(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf(r, int(hit))
            for s in steps:
                folded = sha(*([folded] if s is None else [s[1], folded] if s[0] else [folded, s[1]]))
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], root, sha(*[s[1] for s in steps if s]), folded,
                        folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("gap", [1, 3, 8])
def test_audit_equals_a_plain_tree(odd, gap):
    assert sorted(map(tuple, merkle.audit(odd, gap).collect()), key=str) == plain([r.asDict() for r in odd.collect()])


def test_odd_rows_and_languages(spark):
    rows = [(None, "a", None, None, None, 1, "t"), (1, "x", "en", 3, "t", 1, ""), (1, "x", "en", 3, "t", 1, ""),
            (2, None, None, 0, "", 2, "t"), (5, "é", "日本", 7, "日", 2, "t"), (-4, "q", "", 7, "z" * 70_000, 1, "t")]
    rows += [(i, "s", "l%d" % (i % 13), i, "t%d" % i, 0, None) for i in range(100, 180)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, place int, tree string")
    got = merkle.audit(df, 2)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([r.asDict() for r in df.collect()])
    for few in (df.limit(0), df.limit(1), df.where("lang like 'l%'").dropDuplicates(["lang"])):
        assert sorted(map(tuple, merkle.audit(few, 2).collect()), key=str) == plain([r.asDict() for r in few.collect()])


def test_only_every_few_levels_are_stored(docs):
    m = merkle.build(docs, gap=3)
    n = m.leaves.count()
    assert [x.count() for x in m.levels] == [-(-n // 8), -(-n // 64), 1]
    assert merkle.proofs(m).where("size(steps) <> 7").count() == 0
