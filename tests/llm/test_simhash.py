"""SimHash components against fingerprints and distances taken one by one."""
import random
import re

import numpy as np
import xxhash

from riskline.llm import simhash as S


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode("utf-8", "surrogatepass"), 42)
              for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def forest(prints):
    """print -> label of its component, by all pairs."""
    u = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(u))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            if label[j] != label[i]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return dict(zip(u.tolist(), label.tolist()))


def plain(rows):
    prints = [fingerprint(t) for _, t in rows]
    of, low = forest(prints), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            low[of[p]] = min(low.get(of[p], i), i)
    return sorted(((i, "%016x" % p, low.get(of[p])) for (i, _), p in zip(rows, prints)), key=str)


def balls(seed, centres, members):
    """Fingerprints close around some centres."""
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(members):
            out.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    return np.array(sorted(out), np.uint64)


def test_near_duplicates_equal_all_pairs(odd):
    want = plain([(r.doc_id, r.text) for r in odd.collect()])
    for size in (4096, 2):  # every bucket at once; all cut again and compared in parts
        got = S.near_duplicates(odd, size)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_odd_rows(spark, empty):
    assert S.near_duplicates(empty).count() == 0
    rows = [(None, "lonely text without an id", 1), (None, None, 2), (7, " \n", 3), (7, "a b c d e", 4), (5, "A B C D E", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    assert sorted(map(tuple, S.near_duplicates(df).collect()), key=str) == plain([r[:2] for r in rows])


def test_bit_sliced_distances_for_every_radius():
    prints = balls(2, 4, 40)
    planes, starts, used = S.planes_of(prints, np.array([len(prints)]))
    n, words = len(prints), planes.shape[1]
    query, word = np.repeat(np.arange(n), words), np.tile(np.arange(words), n)
    for radius in range(8):
        cell, mask = S.near(planes, prints, query, word, used[word], radius)
        got = np.zeros((n, words * 64), bool)
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        for c, b in zip(cell, bits):
            got[query[c], word[c] * 64:word[c] * 64 + 64] = b
        assert (got[:, :n] == (np.bitwise_count(prints[:, None] ^ prints[None]) <= radius)).all()
        assert not got[:, n:].any()


def test_bucket_links_span_every_component():
    prints = balls(3, 30, 25)
    counts = np.array([len(prints) - 70, 1, 69])
    a, b = S.bucket_links(prints, np.full(len(prints), 2), counts)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    for start, n in zip(np.cumsum(counts) - counts, counts):
        inside = prints[start:start + n]
        labels = len(set(forest(inside.tolist()).values()))
        assert np.isin(a, inside).sum() == n - labels
    side = np.arange(len(prints)) % 2
    a, b = S.bucket_links(prints, side, np.array([len(prints)]))
    left, right = set(prints[side == 0].tolist()), set(prints[side == 1].tolist())
    assert all((x in left) != (y in left) and (x in right) != (y in right) for x, y in zip(a.tolist(), b.tolist()))
