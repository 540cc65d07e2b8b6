"""DuckDB SQL for every SQL-expressible query in ``riskline.plans.catalog``.

Views ``documents labels pages conversations events embeddings ...`` are
registered by the caller. Constants are written as doubles (``1.0e0``) so
DuckDB does not switch to DECIMAL arithmetic; regexes use the ``'g'`` flag.
"""

from __future__ import annotations

from riskline.functions import labels as _L
from riskline.functions.text import NON_WS, TOKEN, WS
from riskline.sources.mail import EXCLUDED_FILES
from riskline.sources.extract import HTML_COMMENT, HTML_SCRIPT, HTML_STYLE, HTML_TAG

K = 5000


def clean_basic_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '{WS}+', ' ', 'g'))"


def clean_mask_sql(expr: str) -> str:
    t = f"lower({expr})"
    t = f"regexp_replace({t}, 'http{NON_WS}+|www{NON_WS}+', ' URL ', 'g')"
    t = f"regexp_replace({t}, '{NON_WS}+@{NON_WS}+', ' EMAIL ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def blank_sql(expr: str) -> str:
    return f"(regexp_replace({expr}, '{WS}+', '', 'g') = '')"


def band_sql(expr: str) -> str:
    return (f"CASE WHEN {expr} >= 0.8e0 THEN 'HIGH' WHEN {expr} >= 0.5e0 THEN 'MEDIUM' "
            f"ELSE 'LOW' END")


def term_counts_cte(name: str, src: str, id_col: str, text_col: str) -> str:
    return (f"{name}_tok AS (SELECT {id_col}, unnest(regexp_extract_all(lower(coalesce({text_col}, '')), "
            f"'{TOKEN}')) AS term FROM {src}),\n"
            f"{name} AS (SELECT {id_col}, term, count(*)::BIGINT AS tf FROM {name}_tok GROUP BY ALL)")


def vocab_cte(name: str, counts: str, n_expr: str) -> str:
    """Top-k vocabulary with idf and the fixed hash weight."""
    return (f"{name}_top AS (SELECT term, sum(tf)::BIGINT AS total, count(*)::BIGINT AS df FROM {counts} "
            f"GROUP BY term ORDER BY total DESC, term ASC LIMIT {K}),\n"
            f"{name} AS (SELECT term, total, df, "
            f"(row_number() OVER (ORDER BY total DESC, term ASC) - 1)::INTEGER AS idx, "
            f"ln((1.0e0 + ({n_expr})) / (1.0e0 + df)) + 1.0e0 AS idf, "
            f"((('0x' || substr(md5(term), 1, 8))::BIGINT % 2001) - 1000) / 250.0e0 AS coef "
            f"FROM {name}_top)")


DOC_MODEL = (term_counts_cte("dtc", "documents", "doc_id", "text") + ",\n"
             + vocab_cte("dvoc", "dtc", "SELECT count(*) FROM documents"))


def score_sql(src: str, id_cols: list[str], text_col: str, model: str = "dvoc", prefix: str = "s",
              guard: bool = True) -> str:
    """CTEs computing ``{prefix}_score(ids..., risk_score)`` for every row of ``src``."""
    ids = ", ".join(id_cols)
    jn = " AND ".join(f"a.{c} = b.{c}" for c in id_cols)
    tok = (f"{prefix}_tok AS (SELECT {ids}, unnest(regexp_extract_all(lower(coalesce({text_col}, '')), "
           f"'{TOKEN}')) AS term FROM {src}),\n"
           f"{prefix}_tc AS (SELECT {ids}, term, count(*) AS tf FROM {prefix}_tok GROUP BY ALL),\n"
           f"{prefix}_agg AS (SELECT {ids}, sum(tf * idf * coef) AS dot, sum((tf * idf) * (tf * idf)) AS sq "
           f"FROM {prefix}_tc JOIN {model} USING (term) GROUP BY ALL),\n")
    sel = ", ".join(f"a.{c}" for c in id_cols)
    blank = f"coalesce({blank_sql('a.' + text_col)}, true)" if guard else "false"
    score = (f"{prefix}_score AS (SELECT {sel}, CASE WHEN {blank} "
             f"THEN 0.0e0 ELSE 1.0e0 / (1.0e0 + exp(-(CASE WHEN b.sq > 0 THEN b.dot / sqrt(b.sq) "
             f"ELSE 0.0e0 END))) END AS risk_score FROM {src} a LEFT JOIN {prefix}_agg b ON {jn})")
    return tok + score


SQL: dict[str, str] = {}

SQL["clean_basic"] = f"SELECT doc_id, {clean_basic_sql('text')} AS clean_text FROM documents"

SQL["clean_mask"] = f"""
SELECT kind, id, {clean_mask_sql('text')} AS masked FROM (
  SELECT 'document' AS kind, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'page_url' AS kind, page_id AS id, url AS text FROM pages)
"""

SQL["tokens"] = f"WITH {term_counts_cte('tc', 'documents', 'doc_id', 'text')} SELECT doc_id, term, tf FROM tc"

SQL["vocabulary"] = f"WITH {DOC_MODEL} SELECT term, total, df, idx FROM dvoc"

SQL["idf"] = f"WITH {DOC_MODEL} SELECT term, round(idf, 6) AS idf FROM dvoc"

SQL["tfidf"] = f"""
WITH {DOC_MODEL},
w AS (SELECT doc_id, term, tf * idf AS w FROM dtc JOIN dvoc USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
"""

SQL["score_linear"] = f"""
WITH {DOC_MODEL},
{score_sql('documents', ['doc_id'], 'text')}
SELECT doc_id, round(risk_score, 6) AS risk_score, {band_sql('risk_score')} AS risk_band FROM s_score
"""


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def word_label_sql(expr: str) -> str:
    s = f"lower({strip_sql(expr)})"
    return (f"(CASE WHEN {expr} IS NULL THEN NULL WHEN {s} IN {_in(_L.PHISHING_WORDS)} THEN 1 "
            f"WHEN {s} IN {_in(_L.SAFE_WORDS)} THEN 0 END)::INTEGER")


def page_text_sql(expr: str) -> str:
    t = expr
    for pat in (HTML_SCRIPT, HTML_STYLE, HTML_COMMENT, HTML_TAG):
        t = f"regexp_replace({t}, '{pat}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def display_sql(expr: str) -> str:
    return (f"CASE WHEN {expr} >= 0.8e0 THEN '🚨 HIGH RISK: Likely phishing' "
            f"WHEN {expr} >= 0.5e0 THEN '⚠️  MEDIUM RISK: Review recommended' "
            f"ELSE '✅ LOW RISK: Likely safe' END")


def severity_sql(band: str) -> str:
    return f"CASE WHEN {band} = 'HIGH' THEN 'danger' WHEN {band} = 'MEDIUM' THEN 'warning' ELSE 'success' END"


RAW_WORDS = _L.PHISHING_WORDS + _L.SAFE_WORDS + ["maybe", "2", "1.0", "Phishing Email", "SAFE EMAIL"]
PSEUDO_FILES = [*_L.SAFE_SOURCES, *_L.PHISHING_SOURCES, *EXCLUDED_FILES, "unknown.csv", "A b.csv"]

SQL["assemble_text"] = f"""
SELECT page_id, trim(concat_ws(' ', {clean_basic_sql('body')}, {clean_basic_sql('urls')})) AS text FROM (
  SELECT page_id, url AS urls, CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS body FROM pages)
"""

SQL["strict_label"] = """
SELECT doc_id, email_type,
       (CASE email_type WHEN 'Safe Email' THEN 0 WHEN 'Phishing Email' THEN 1 END)::INTEGER AS label
FROM (SELECT d.doc_id,
             CASE d.doc_id % 3
               WHEN 0 THEN CASE WHEN l.toxic = 1 THEN 'Phishing Email' ELSE 'Safe Email' END
               WHEN 1 THEN CASE WHEN l.toxic = 1 THEN 'phishing email' ELSE 'Safe Email ' END
               ELSE NULL END AS email_type
      FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)
"""

SQL["normalize_label"] = f"""
WITH w AS (
  SELECT doc_id, toxic, {_list(RAW_WORDS)}[doc_id % {len(RAW_WORDS)} + 1] AS w0,
         ((doc_id % 9) - 3) * 0.7e0 AS raw_num FROM labels),
r AS (
  SELECT doc_id, raw_num,
         CASE WHEN doc_id % 23 = 0 THEN NULL
              WHEN doc_id % 3 = 1 THEN upper(w0)
              WHEN doc_id % 3 = 2 THEN '  ' || w0 || ' '
              ELSE w0 END AS raw_word,
         CASE WHEN toxic = 1 THEN 'True' ELSE 'false' END AS raw_bool,
         TRY_CAST(trunc(raw_num) AS INTEGER) AS t
  FROM w)
SELECT doc_id, raw_word, {word_label_sql('raw_word')} AS word_label,
       round(raw_num, 6) AS raw_num, (CASE t WHEN 1 THEN 1 WHEN 0 THEN 0 END)::INTEGER AS num_label,
       raw_bool, (CASE WHEN raw_bool IN ('True', 'TRUE', 'true') THEN 1
                       WHEN raw_bool IN ('False', 'FALSE', 'false') THEN 0 END)::INTEGER AS bool_label
FROM r
"""

SQL["label_from_source"] = f"""
SELECT doc_id, source_file, label FROM (
  SELECT doc_id, source_file,
         (CASE WHEN source_file IN {_in(_L.SAFE_SOURCES)} THEN 0
               WHEN source_file IN {_in(_L.PHISHING_SOURCES)} THEN 1 END)::INTEGER AS label
  FROM (SELECT doc_id, {_list(PSEUDO_FILES)}[CAST(substr(source, 4) AS INTEGER) % {len(PSEUDO_FILES)} + 1]
               AS source_file FROM documents))
WHERE label IS NOT NULL
"""

SQL["label_precedence"] = """
SELECT doc_id,
       CASE doc_id % 4 WHEN 0 THEN 'CEAS_08.csv' WHEN 1 THEN 'Nazario.csv' ELSE 'Enron.csv' END AS source_file,
       (CASE doc_id % 4
          WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN NULL WHEN toxic = 1 THEN 1 ELSE 0 END
          WHEN 1 THEN CASE WHEN toxic = 1 THEN 1 ELSE 0 END
          ELSE 0 END)::INTEGER AS label
FROM documents JOIN labels USING (doc_id)
WHERE doc_id % 4 <> 3
"""

SQL["union_sources"] = f"""
SELECT 'documents' AS source_file, d.doc_id AS row_id, trim({clean_basic_sql('d.text')}) AS text, l.toxic AS label
FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL
SELECT 'pages', page_id, trim(concat_ws(' ', {clean_basic_sql('html')}, {clean_basic_sql('url')})), NULL::INTEGER
FROM pages
UNION ALL
SELECT 'conversations', conv_id * 100 + turn, trim({clean_basic_sql('text')}), NULL::INTEGER FROM conversations
"""

INJECTED = f"""
b AS (SELECT d.doc_id, l.toxic AS label,
             CASE d.doc_id % 10 WHEN 0 THEN regexp_replace(d.text, '{NON_WS}', '', 'g')
                                WHEN 1 THEN NULL ELSE d.text END AS text
      FROM documents d LEFT JOIN labels l USING (doc_id))
"""
USABLE = f"(label IS NOT NULL AND text IS NOT NULL AND NOT {blank_sql('text')})"

SQL["valid_rows"] = f"WITH {INJECTED} SELECT doc_id, label::INTEGER AS label FROM b WHERE {USABLE}"

SQL["row_counts"] = (f"WITH {INJECTED} SELECT count(*) AS rows_before, "
                     f"count(*) FILTER (WHERE {USABLE}) AS rows_after FROM b")

SQL["class_distribution"] = ("SELECT toxic AS label, count(*) AS n_rows FROM documents JOIN labels "
                             "USING (doc_id) GROUP BY toxic")

SQL["rows_by_source"] = ("SELECT source, count(*) AS n_rows FROM documents JOIN labels USING (doc_id) "
                         "GROUP BY source")

SPLIT = """
sb AS (SELECT d.doc_id, d.text, l.toxic AS label,
              ('0x' || substr(md5('42:' || d.doc_id::VARCHAR), 1, 8))::BIGINT AS h
       FROM documents d JOIN labels l USING (doc_id)),
sn AS (SELECT count(*) AS n, ceil(0.2e0 * count(*))::BIGINT AS k FROM sb),
sper AS (SELECT {strat} AS st, count(*) AS c FROM sb GROUP BY ALL),
salloc AS (SELECT st, (k * c) // n AS base_k, (k * c) % n AS rem, k FROM sper, sn),
sextra AS (SELECT any_value(k) - sum(base_k) AS e FROM salloc),
srank AS (SELECT st, base_k, row_number() OVER (ORDER BY rem DESC, st ASC) AS rr FROM salloc),
skk AS (SELECT st, base_k + CASE WHEN rr <= e THEN 1 ELSE 0 END AS kl FROM srank, sextra),
sr AS (SELECT sb.*, row_number() OVER (PARTITION BY {strat} ORDER BY h, doc_id) AS rn FROM sb),
split AS (SELECT sr.doc_id, sr.text, sr.label, CASE WHEN rn <= kl THEN 'test' ELSE 'train' END AS split
          FROM sr JOIN skk ON {strat_sr} = skk.st)
"""
SPLIT_RANDOM = SPLIT.format(strat="0", strat_sr="0")
SPLIT_STRAT = SPLIT.format(strat="label", strat_sr="sr.label")

SQL["split_random"] = f"WITH {SPLIT_RANDOM} SELECT doc_id, label, split FROM split"
SQL["split_stratified"] = f"WITH {SPLIT_STRAT} SELECT doc_id, label, split FROM split"
SQL["split_sizes"] = f"WITH {SPLIT_STRAT} SELECT split, label, count(*) AS n_rows FROM split GROUP BY ALL"

SQL["tfidf_holdout"] = f"""
WITH {SPLIT_STRAT},
train AS (SELECT doc_id, text FROM split WHERE split = 'train'),
test AS (SELECT doc_id, text FROM split WHERE split = 'test'),
{term_counts_cte('trc', 'train', 'doc_id', 'text')},
{vocab_cte('tvoc', 'trc', 'SELECT count(*) FROM train')},
{term_counts_cte('tec', 'test', 'doc_id', 'text')},
w AS (SELECT doc_id, term, tf * idf AS w FROM tec JOIN tvoc USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
"""

SQL["predict_struct"] = f"""
WITH {DOC_MODEL},
pc AS (SELECT doc_id, {clean_basic_sql('text')} AS clean FROM documents),
{score_sql('pc', ['doc_id'], 'clean', guard=False)}
SELECT doc_id, (risk_score > 0.5e0)::INTEGER AS label, round(risk_score, 6) AS phishing_probability FROM s_score
"""

SQL["risk_band"] = f"""
WITH {DOC_MODEL},
{score_sql('documents', ['doc_id'], 'text')}
SELECT doc_id, round_even(risk_score, 3) AS risk_score, printf('%.3f', risk_score) AS score_text,
       {band_sql('risk_score')} AS risk_band, {display_sql('risk_score')} AS display,
       {severity_sql(band_sql('risk_score'))} AS severity
FROM s_score
"""

SQL["risk_band_grid"] = f"""
SELECT doc_id, score, {band_sql('score')} AS risk_band, {display_sql('score')} AS display,
       {severity_sql(band_sql('score'))} AS severity, {band_sql('score')} IN ('MEDIUM', 'HIGH') AS alert,
       (score > 0.5e0)::INTEGER AS label
FROM (SELECT doc_id, (doc_id % 11) / 10.0e0 AS score FROM labels)
"""

SQL["preview"] = """
SELECT doc_id, substring(text, 1, 200) AS preview,
       CASE WHEN coalesce(text, '') = '' THEN '[No text detected]' ELSE text END AS shown
FROM documents
"""

CM = """
cm AS (SELECT count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn,
              count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fp,
              count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fn,
              count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp FROM labels)
"""

SQL["confusion_matrix"] = f"""
WITH {CM}
SELECT * FROM (
  SELECT 0 AS true_label, 0 AS predicted_label, tn AS n_rows FROM cm UNION ALL
  SELECT 0, 1, fp FROM cm UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm)
"""


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0e0 END)"


SQL["accuracy_f1"] = f"""
WITH {CM}
SELECT tn + fp + fn + tp AS n_rows, round({_div('tn + tp', 'tn + fp + fn + tp')}, 6) AS accuracy,
       round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM cm
"""

SQL["classification_report"] = f"""
WITH {CM},
m AS (SELECT tn + fp + fn + tp AS n, tn + fp AS s0, tp + fn AS s1,
             {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('2 * tn', '2 * tn + fn + fp')} AS f0,
             {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
             {_div('tn + tp', 'tn + fp + fn + tp')} AS acc FROM cm),
rows AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m UNION ALL
  SELECT '1', p1, r1, f1, s1 FROM m UNION ALL
  SELECT 'accuracy', NULL, NULL, acc, n FROM m UNION ALL
  SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m UNION ALL
  SELECT 'weighted avg', {_div('p0 * s0 + p1 * s1', 'n')}, {_div('r0 * s0 + r1 * s1', 'n')},
         {_div('f0 * s0 + f1 * s1', 'n')}, n FROM m)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
       support::BIGINT AS support FROM rows
"""

SQL["extract_page_text"] = f"SELECT page_id, {page_text_sql('html')} AS text FROM pages"

SQL["scan_report"] = f"""
WITH {DOC_MODEL},
files AS (SELECT 'page_' || page_id::VARCHAR || ['.png', '.JPG', '.jpeg', '.txt'][page_id % 4 + 1] AS filename,
                 html FROM pages),
imgs AS (SELECT filename, {page_text_sql('html')} AS text FROM files
         WHERE lower(filename) LIKE '%.png' OR lower(filename) LIKE '%.jpg' OR lower(filename) LIKE '%.jpeg'),
{score_sql('imgs', ['filename'], 'text')}
SELECT filename, round_even(risk_score, 3) AS risk_score, {band_sql('risk_score')} AS risk_band FROM s_score
"""

SQL["capture_names"] = """
SELECT 'capture_' || strftime(ts, '%Y%m%d_%H%M%S') || '.png' AS capture_name,
       arg_max(event_id, ts) AS event_id, count(*) AS n_writes
FROM events GROUP BY 1
"""

SQL["mean_pool"] = """
WITH r AS (SELECT label AS group_id, embedding,
                  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                  CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS mask FROM embeddings),
u AS (SELECT group_id, mask, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim
      FROM r WHERE pos < 128)
SELECT group_id, dim::INTEGER AS dim,
       round(sum(v::DOUBLE * mask) / greatest(sum(mask)::DOUBLE, 1.0e0), 6) AS value
FROM u GROUP BY group_id, dim
"""

SQL["frame_sample"] = """
SELECT user_id, event_id, frame_no FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no
  FROM events)
WHERE frame_no % 30 = 0
"""

CONV_SCORED = f"""
{DOC_MODEL},
{score_sql('conversations', ['conv_id', 'turn'], 'text', prefix='c')}
"""

SQL["alerts"] = f"""
WITH {CONV_SCORED}
SELECT conv_id, turn, round(risk_score, 6) AS risk_score, {band_sql('risk_score')} AS risk_band
FROM c_score WHERE {band_sql('risk_score')} IN ('MEDIUM', 'HIGH')
"""

SQL["latest_state"] = f"""
WITH {CONV_SCORED}
SELECT conv_id, max(turn) AS turn, round(arg_max(risk_score, turn), 6) AS risk_score,
       arg_max({band_sql('risk_score')}, turn) AS risk_band
FROM c_score GROUP BY conv_id
"""


SQL["feature_cache"] = """
SELECT vec_id, vec_id % 2 = 0 AS from_cache,
       round(list_reduce(list_prepend(0.0e0, list_transform(embedding, lambda x: x::DOUBLE)), lambda a, b: a + b), 6)
         AS dim_sum
FROM embeddings
"""

# Streams: the same answers as the batch queries over the whole tables.
SQL["stream_score"] = f"""
WITH {CONV_SCORED}
SELECT conv_id, turn, round(risk_score, 6) AS risk_score, {band_sql('risk_score')} AS risk_band FROM c_score
"""
SQL["stream_alerts"] = SQL["alerts"]
SQL["stream_latest_state"] = SQL["latest_state"]
SQL["stream_frame_sample"] = SQL["frame_sample"]
SQL["stream_capture_names"] = SQL["capture_names"]

SQL["mail_ingest"] = f"""
WITH d AS (SELECT doc_id, source, lang, toxic, {clean_basic_sql('text')} AS t FROM documents JOIN labels USING (doc_id))
SELECT trim({clean_basic_sql('source')} || ' ' || t) AS text, toxic::INTEGER AS label, 'a b+c%.csv' AS source_file
FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT trim(t), toxic::INTEGER, 'words.csv' FROM d WHERE doc_id % 5 = 1
UNION ALL SELECT trim({clean_basic_sql('lang')} || ' ' || t), 0, 'Enron.csv' FROM d WHERE doc_id % 5 = 2
"""

SQL["strict_label_drop"] = f"""
SELECT doc_id, label FROM ({SQL["strict_label"]}) WHERE label IS NOT NULL
"""

SQL["combined_dataset"] = f"""
SELECT source AS source_file, toxic::INTEGER AS label, md5(text) AS text_md5
FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND text IS NOT NULL AND NOT {blank_sql('text')}
"""

SQL["report_file"] = f"""
SELECT row_number() OVER (ORDER BY filename) AS place, * FROM ({SQL["scan_report"]})
"""

SQL["run_metrics"] = f"""
SELECT 'labels' AS dataset, unnest(['first', 'second']) AS model, round(accuracy, 3) AS accuracy, round(f1, 3) AS f1,
       true AS dated FROM ({SQL["accuracy_f1"]})
"""

SQL["unreadable_inputs"] = """
WITH s AS (SELECT page_id, length(html) AS n FROM pages),
r AS (SELECT page_id, CASE WHEN n % 11 = 0 THEN 'error' WHEN n % 7 = 0 THEN 'unreadable' ELSE 'ok' END AS status,
             CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN '' ELSE 'read ' || n END AS text FROM s)
SELECT policy, page_id, status, text FROM r, (SELECT unnest(['empty', 'skip']) AS policy)
WHERE policy = 'empty' OR status = 'ok'
"""

SQL["stream_dead_letter"] = f"""
WITH {DOC_MODEL},
x AS (SELECT conv_id, turn, (conv_id * 31 + turn) AS n, text AS raw FROM conversations),
t AS (SELECT conv_id, turn, n, CASE WHEN n % 10 = 0 OR n % 7 = 0 THEN '' ELSE raw END AS text FROM x),
{score_sql('t', ['conv_id', 'turn'], 'text')}
SELECT conv_id, turn, CASE WHEN n % 10 = 0 THEN 'open' ELSE 'scored' END AS came_to,
       (CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END)::INTEGER AS attempts,
       CASE WHEN n % 10 <> 0 THEN round(risk_score, 6) END AS risk_score,
       CASE WHEN n % 10 <> 0 THEN {band_sql('risk_score')} END AS risk_band
FROM t JOIN s_score USING (conv_id, turn)
"""

SQL["media_scan_report"] = SQL["scan_report"]

SQL["vector_scan_report"] = f"""
WITH files AS (SELECT 'page_' || page_id::VARCHAR || ['.png', '.JPG', '.jpeg', '.txt'][page_id % 4 + 1] AS filename,
                      {page_text_sql('html')} AS text FROM pages),
imgs AS (SELECT filename, text, {clean_mask_sql('text')} AS c FROM files
         WHERE lower(filename) LIKE '%.png' OR lower(filename) LIKE '%.jpg' OR lower(filename) LIKE '%.jpeg'),
v AS (SELECT filename, text, length(c) / 64.0e0 AS a, length(regexp_replace(c, '[^0-9]', '', 'g')) / 64.0e0 AS b,
             length(regexp_replace(c, '[^ ]', '', 'g')) / 64.0e0 AS s, length(regexp_replace(c, '[^e]', '', 'g')) / 64.0e0 AS e
      FROM imgs),
p AS (SELECT filename, CASE WHEN coalesce({blank_sql('text')}, true) THEN 0.0e0
             ELSE 1.0e0 / (1.0e0 + exp(-(-0.75e0 + a * 0.125e0 - b * 0.5e0 + s * 0.25e0 - e * 0.0625e0))) END AS risk_score FROM v)
SELECT filename, round_even(risk_score, 3) AS risk_score, {band_sql('risk_score')} AS risk_band FROM p
"""

SQL["score_linear_blanks"] = f"""
WITH {DOC_MODEL}, {INJECTED},
{score_sql('b', ['doc_id'], 'text')}
SELECT doc_id, round(risk_score, 6) AS risk_score, {band_sql('risk_score')} AS risk_band FROM s_score
"""

SQL["split_by_source"] = f"""
WITH {SPLIT.replace("l.toxic AS label", "d.source").replace(" JOIN labels l USING (doc_id)", "")
      .replace("sr.label", "sr.source").format(strat="source", strat_sr="sr.source")}
SELECT doc_id, source, split FROM split
"""

# At the optimum every gradient is small: the features are the vocabulary of the training rows, and the intercept.
SQL["lr_tfidf_optimal"] = f"""
WITH {SPLIT_STRAT},
train AS (SELECT doc_id, text FROM split WHERE split = 'train'),
{term_counts_cte('trc', 'train', 'doc_id', 'text')},
{vocab_cte('tvoc', 'trc', 'SELECT count(*) FROM train')}
SELECT term AS feature, true AS optimal FROM tvoc UNION ALL SELECT '(intercept)', true
"""
SQL["lr_vectors_optimal"] = """
SELECT 'v' || i AS feature, true AS optimal FROM (SELECT unnest(range(max(len(embedding)))) AS i FROM embeddings)
UNION ALL SELECT '(intercept)', true
"""
SQL["model_roundtrip"] = "SELECT doc_id, 'baseline' AS variant, true AS equal, true AS equal_band FROM documents"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
