"""The derived fixtures again, in DuckDB SQL (CTE bodies)."""

from __future__ import annotations

BENCH_OFFSET = 1_000_000_000_000

CORPUS = f"""corpus AS (
    SELECT doc_id AS text_id, text FROM documents
    UNION ALL SELECT item_id + {BENCH_OFFSET} AS text_id, text FROM benchmark
    UNION ALL SELECT -1::BIGINT AS text_id, '' AS text)"""

PAIRS = f"""pairs AS (
    SELECT concat_ws(':', kind, left_id, right_id) AS pair_id, kind, left_id, right_id FROM (
      SELECT 'adjacent' AS kind, a.doc_id AS left_id, b.doc_id AS right_id
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0
      UNION ALL SELECT 'self', doc_id, doc_id FROM documents
      UNION ALL SELECT 'benchmark', doc_id, doc_id % (SELECT max(item_id) + 1 FROM benchmark) + {BENCH_OFFSET} FROM documents
      UNION ALL SELECT 'empty', min(doc_id), -1::BIGINT FROM documents))"""


def _completions() -> str:
    from pagewise.sources.fixtures import CATEGORIES, OVERLONG_KEYWORDS, OVERLONG_SENTIMENT, SENT_LABELS
    from pagewise.plans.sqlfrag import sq
    labs = "[" + ", ".join(sq(x) for x in SENT_LABELS) + "]"
    cats = "[" + ", ".join(sq(x) for x in CATEGORIES) + "]"
    w = [f"coalesce(w[{i + 1}], 'none')" for i in range(3)]
    sent = (f"""CASE WHEN k <= 2 THEN '{{"sentiment": "' || {labs}[doc_id % 4 + 1] || '", "confidence": 0.' || (5 + doc_id % 5)
                || ', "scores": {{"positive": 0.6, "negative": 0.3, "neutral": 0.1}}, "key_phrases": ["'
                || {w[0]} || '", "' || {w[1]} || '", "' || {w[2]} || '"]}}'
             WHEN k = 3 THEN 'not json: ' || {w[0]} WHEN k = 4 THEN ''
             WHEN k = 5 THEN '{{"sentiment": "ecstatic", "confidence": 0.7, "key_phrases": []}}'
             WHEN k = 6 THEN CASE WHEN doc_id % 3 = 0 THEN '{{"sentiment": "positive", "confidence": 1.5}}'
                                  WHEN doc_id % 3 = 1 THEN '{{"sentiment": "positive", "confidence": "0.9"}}'
                                  ELSE '{{"sentiment": "negative", "confidence": -0.2}}' END
             ELSE {sq(OVERLONG_SENTIMENT)} END""")
    kw = (f"""CASE WHEN k <= 2 THEN '{{"keywords": ["' || {w[0]} || '", "' || {w[1]} || '"], "topics": ["' || {w[2]}
                || '"], "entities": [{{"name": "' || {w[0]} || '", "type": "ORG"}}], "category": "'
                || {cats}[doc_id % 10 + 1] || '", "tags": ["' || lower({w[0]}) || '"]}}'
             WHEN k = 3 THEN 'keywords: ' || {w[0]} WHEN k = 4 THEN ''
             WHEN k = 5 THEN '{{"keywords": ["x"], "category": "gardening"}}' WHEN k = 6 THEN '{{}}'
             ELSE {sq(OVERLONG_KEYWORDS)} END""")
    summ = (f"""CASE WHEN k <= 2 THEN '  ' || {w[0]} || ' ' || {w[1]} || ' ' || {w[2]} || '.  '
             WHEN k = 3 THEN 'Summary: ' || {w[0]} WHEN k = 4 THEN '' ELSE {w[0]} || ' and ' || {w[1]} END""")
    return f"""completions AS (
    SELECT doc_id, 'summary' AS task, {summ} AS raw FROM cw
    UNION ALL SELECT doc_id, 'sentiment', {sent} FROM cw
    UNION ALL SELECT doc_id, 'keywords', {kw} FROM cw)"""


COMPLETIONS = ("cw AS (SELECT doc_id, doc_id % 8 AS k, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents), "
               + _completions())
