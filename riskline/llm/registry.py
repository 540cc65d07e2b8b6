"""Registered queries of the corpus operators: thin wrappers that read whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.llm import (byte_bpe, collocations, decontaminate, html_cut, jaccard_join, maxent_lm, merkle,
                          quality_forest, secrets, simhash, suffix_dedup, toxicity_gru, wavelet)
from riskline.llm.common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_forest(spark: SparkSession, sf: str) -> DataFrame:
    out = quality_forest.quality_forest(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "anomaly")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_gru.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("row")


def op3_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


def op4_maxent_lm(spark: SparkSession, sf: str) -> DataFrame:
    return maxent_lm.score_lm(table(spark, sf, "documents"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_wavelet_shards(spark: SparkSession, sf: str) -> DataFrame:
    return wavelet.token_shards(table(spark, sf, "documents"), WORD_TOKENIZER)


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf, "documents")))


def op8_html_cut(spark: SparkSession, sf: str) -> DataFrame:
    return html_cut.extract_main_text(table(spark, sf, "pages"))


def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf, "documents"), BYTE_RANKS, public_tokenizers.PATTERN))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(table(spark, sf, "documents"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_forest, op2_toxicity, op3_jaccard_join, op4_maxent_lm, op5_decontaminate, op6_wavelet_shards,
        op7_secrets, op8_html_cut, op9_byte_bpe, op10_suffix_dedup,
        op11_simhash, op12_merkle_manifest, op13_collocations)}


#: Components by all pairs that share a shingle; the exact definition, without any filter.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
         ELSE list_distinct([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)]) END AS g FROM w),
g AS (SELECT doc_id, unnest(g) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * p.k >= 80 * (len(sa.g) + len(sb.g) - p.k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, a AS seen FROM edges UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(min(r.seen), s.doc_id) AS component_id
FROM s LEFT JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.g)
"""


#: All diagonals by plain equality of words, without any seed.
DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
           FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT * FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
           FROM benchmark) WHERE len(t) >= 4),
dw AS (SELECT doc_id, r, unnest(t) AS word, unnest(range(0, len(t))) AS p FROM d),
bw AS (SELECT item_id, len(t) AS n, unnest(t) AS word, unnest(range(0, len(t))) AS q FROM b),
lines AS (
  SELECT doc_id, r, item_id, n, p - q AS diagonal, list(q) AS places FROM dw JOIN bw USING (word)
  GROUP BY ALL HAVING count(*) >= CASE WHEN n >= 10 THEN 8 ELSE n END),
found AS (
  SELECT doc_id, item_id, n, len(list_distinct(flatten(list(places)))) AS n_match FROM lines GROUP BY doc_id, r, item_id, n)
SELECT doc_id, item_id, CAST(max(n_match) AS BIGINT) AS n_match, CAST(n AS BIGINT) AS item_words, round(max(n_match) / n, 6) AS share
FROM found WHERE n_match >= least(10, n) AND n_match >= 0.5 * n GROUP BY doc_id, item_id, n
"""


def _leaf_sql(n_chars: str) -> str:
    fields = [n_chars if name == "n_chars" else name for name in merkle.FIELDS]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


#: Every level of every tree, written out; CRC-32 bit by bit. Proofs look their siblings up by level and place.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
           string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END) AS crc
  FROM documents),
e AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS changed FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM e),
n AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS nodes FROM l
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(nodes) + 1) // 2
  FROM n WHERE nodes > 1 GROUP BY tree, level, place // 2),
s AS (SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS nodes
      FROM n WHERE nodes = 1),
t AS (
  SELECT 0 AS level, place, digest, nodes FROM s
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(nodes) + 1) // 2
  FROM t WHERE nodes > 1 GROUP BY level, place // 2),
steps AS (
  SELECT l.tree, l.place AS leaf_place, n.level, n.place < (l.place >> n.level) AS before, n.digest
  FROM l JOIN n ON n.tree = l.tree AND n.nodes > 1 AND n.place = xor(l.place >> n.level, 1)
  UNION ALL
  SELECT l.tree, l.place, s.height + t.level, t.place < (s.place >> t.level), t.digest
  FROM l JOIN s USING (tree) JOIN t ON t.nodes > 1 AND t.place = xor(s.place >> t.level, 1)),
f AS (
  SELECT l.tree, l.place, 0 AS level, l.changed AS digest, s.height + (SELECT max(level) FROM t) AS height FROM l JOIN s USING (tree)
  UNION ALL
  SELECT f.tree, f.place, f.level + 1, sha256(CASE WHEN p.before THEN p.digest || f.digest ELSE f.digest || coalesce(p.digest, '') END),
         f.height
  FROM f LEFT JOIN steps p ON p.tree = f.tree AND p.leaf_place = f.place AND p.level = f.level WHERE f.level < f.height),
proof AS (SELECT tree, leaf_place, string_agg(digest, '' ORDER BY level) AS digests FROM steps GROUP BY 1, 2)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.digests, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = r.digest AS verified
FROM l JOIN s USING (tree) JOIN f ON f.tree = l.tree AND f.place = l.place AND f.level = f.height
JOIN t r ON r.nodes = 1 LEFT JOIN proof p ON p.tree = l.tree AND p.leaf_place = l.place
"""


#: All phrases of one to three words, counted as they stand.
COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
t AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
  FROM t, (SELECT unnest([1, 2, 3]) AS size)),
f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.size, cuts.a, cuts.k, x.a AS l, y.a AS r,
         (1000000 * cuts.a * cuts.a) // (x.a * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[:k], ' ')
            JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * b.a)
SELECT r.lang, r.rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY 1) USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": JACCARD_SQL, "op5_decontaminate": DECONTAMINATE_SQL,
            "op12_merkle_manifest": MERKLE_SQL, "op13_collocations": COLLOCATIONS_SQL}
