"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.llm import align, chunks, decontaminate, langid, mixing, mixlm, pii, quality, rangejoin, rules, simhash, trie, warc
from pagewise.llm.common import is_held_out, read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.inspect(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
                        "n_generalised", "n_removed")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.contained(docs, items).drop("text_key")


def op3_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = is_held_out(F.col("doc_id"), 7, 2)
    scored = mixlm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score", "bits_per_byte")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = is_held_out(F.col("doc_id"), 5, 0)
    scored = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"),
                              read(spark, sf_dir, "labels").select("doc_id", "quality"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = is_held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_rangejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.savings(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        "ends_sha256")


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return rules.judge(docs, model).select("doc_id", *rules.COUNTS, "base_failed", "kept", "probability", "verdict")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixlm": op3_mixlm,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_chunks": op8_chunks,
    "op9_warc": op9_warc,
    "op10_rangejoin": op10_rangejoin,
    "op11_align": op11_align,
    "op12_trie": op12_trie,
    "op13_rules": op13_rules,
}

_LOWER_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')"

_DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM c JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                            1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1),
                     '' ORDER BY k) FROM range(32) AS r(k)) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN t USING (h)
"""

_RANGEJOIN_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

_TRIE_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, max(p) AS n FROM t GROUP BY c),
h AS (SELECT c, n, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
          lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h FROM i),
f AS (SELECT h.c, t.p AS d, r, x FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.p <= h.h
      UNION ALL
      SELECT h.c, t.p - h.h + least(h.h, coalesce(b.n, 0)) AS d, r, x
      FROM h JOIN t ON t.c = h.c AND t.p > h.h LEFT JOIN i AS b ON b.c = h.c - h.c % 20),
k AS (SELECT c, 0 AS d, '' AS k, 0 AS w FROM h
      UNION ALL
      SELECT c, d, sha256(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k,
        len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM f),
m AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, max(d) OVER (PARTITION BY c) AS l FROM k),
n AS (SELECT k, min(c) AS conv_id, any_value(d) AS depth, any_value(pk) AS pk, count(*) AS n_convs, any_value(w) AS w,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = l), '')) AS ends_sha256 FROM m GROUP BY k),
ch AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
s AS (SELECT k.k, sum((u.n_convs - 1) * u.w) AS saved, count(*) FILTER (u.n_children = 0) AS leaves
      FROM u JOIN k ON k.c = u.conv_id AND k.d <= u.depth GROUP BY k.k)
SELECT u.conv_id, u.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, u.ends_sha256
FROM u JOIN s USING (k) LEFT JOIN n AS p ON p.k = u.pk
"""

ORACLE_SQL: dict[str, str] = {
    "op9_warc": _WARC_SQL,
    "op10_rangejoin": _RANGEJOIN_SQL,
    "op2_decontaminate": _DECONTAMINATE_SQL,
    "op12_trie": _TRIE_SQL,
}
