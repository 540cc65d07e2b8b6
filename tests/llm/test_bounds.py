"""Memory and work of helpers inside tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from riskline.llm import registry
from riskline.llm.byte_bpe import Dictionary, encode
from riskline.llm.suffix_dedup import stable_order, suffix_order
from riskline.llm.wavelet import CachedEncoder


def test_dictionary_never_holds_all_words_as_python_strings():
    words = pa.array([f"word {i}" for i in range(200_000)])
    tracemalloc.start()
    d = Dictionary(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(words)  # over 100 bytes a word as strings and numbers in lists
    assert d.numbers(["word 7", "none", "word 199999"]).tolist() == [7, -1, 199_999]


def test_encoder_moves_its_ids_seldom_and_gives_those_of_single_words():
    with open(registry.WORD_TOKENIZER, encoding="utf-8") as f:
        encode = CachedEncoder(f.read())
    texts = [f"Word{i} é{i}, naïve... \t" + "x" * (i % 7) for i in range(300)] + ["", " \n"]
    moved, ids = 0, []
    for t in texts:
        before = encode.flat
        ids += encode([t])
        moved += encode.flat is not before
    assert moved < 30
    assert [x.tolist() for x in ids] == [[i for w in t.split() for i in encode.tok.encode(w, add_special_tokens=False).ids]
                                         for t in texts]
    assert [x.tolist() for x in encode(texts)] == [x.tolist() for x in ids]


def test_letters_are_encoded_once_whatever_marks_follow(monkeypatch):
    with open(registry.WORD_TOKENIZER, encoding="utf-8") as f:
        encode = CachedEncoder(f.read())
    asked, ids = [], encode._ids
    monkeypatch.setattr(encode, "_ids", lambda texts: asked.extend(w for t in texts for w in t.split()) or ids(texts))
    text = " ".join("grün" + m for m in ("", ".", ",", "$$$", ",***", "!!", "'", "<|", "1", "'s", "É", ".a")) + " ,*** $$$a ß."
    got = [x.tolist() for t in (text, text[::-1], text) for x in encode([t])]
    assert got == [encode.tok.encode(t, add_special_tokens=False).ids for t in (text, text[::-1], text)]
    assert [w for w in asked if w.startswith("grün")] == ["grün", "grün1", "grün's", "grünÉ", "grün.a"]


def test_suffixes_are_sorted_by_as_many_symbols_as_a_key_holds():
    r = np.random.default_rng(5)
    for symbols in (1, 2, 5, 70, 256):
        text = np.append(r.integers(0, symbols + 1, 2000), 0)
        got = [text[k:k + 40].tolist() + [0] * max(0, k + 40 - len(text)) for k in suffix_order(text, 40)]
        assert got == sorted(got)


def test_stable_order():
    r = np.random.default_rng(6)
    for top in (1, 3, 1 << 31, 1 << 40):
        key = r.integers(0, top, 5000)
        assert stable_order(key).tolist() == np.argsort(key, kind="stable").tolist()
    assert len(stable_order(np.zeros(0, np.int64))) == 0


def test_blocks_without_ids_and_words_outside_the_dictionary(spark):
    pattern = registry.public_tokenizers.PATTERN
    for rows in ([(1, ""), (2, None)], [(1, "an odd xqzvk"), (2, ""), (3, "xqzvk é an"), (4, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: (len(r.ids), bytes(r.decoded)) for r in encode(docs, registry.BYTE_RANKS, pattern, 2).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: (t or "").encode() for k, t in rows}
        assert all((n > 0) == bool(t) for (n, _), (_, t) in zip(map(got.get, range(1, 5)), rows))
