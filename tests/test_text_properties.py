"""Property tests: the Spark text expressions equal Python's str/re semantics."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskline.functions import text as T

# Python's str whitespace, plus pieces that matter to the masks and tokens.
WHITESPACE = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0",
              "\u1680", "\u2000", "\u2005", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
PIECES = ["http", "https://", "www", "@", ".", ",", "_", "-", "\u00e9", "\u00df", "\u00dc", "\u03a9",
          "\u0436", "\u4e2d\u6587", "\u0663", "a", "Z", "9", "ab", "x@y", "e\u0301", "!", "'", "\u200b"]
ALPHABET = st.sampled_from(WHITESPACE + PIECES)
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=60)


def py_basic(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


def py_mask(t):
    t = t.lower()
    t = re.sub(r"http\S+|www\S+", " URL ", t)
    t = re.sub(r"\S+@\S+", " EMAIL ", t)
    return re.sub(r"\s+", " ", t).strip()


TOK = re.compile(r"(?u)\b\w\w+\b")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_text_functions_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.clean_basic("t").alias("b"), T.clean_mask("t").alias("m"),
                     T.tokenize("t").alias("k"), T.strip_ws("t").alias("s"),
                     T.is_blank("t").alias("z")).orderBy("i").collect()
    for r, t in zip(rows, texts):
        assert r.b == py_basic(t), repr(t)
        assert r.m == py_mask(t), repr(t)
        assert r.k == TOK.findall(t.lower()), repr(t)
        assert r.s == t.strip(), repr(t)
        assert r.z == (t.strip() == ""), repr(t)
