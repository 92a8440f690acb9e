"""Model-task queries: prompts, truncation, request parameters, the scorer
hook, robust parsing of completions, gathering and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewise.functions.text import is_blank, round_half_even, ws_word_count
from pagewise.operators import scoring as SC
from pagewise.plans.registry import query
from pagewise.plans.sqlfix import COMPLETIONS
from pagewise.plans.sqlfrag import NONWS, r, sq, ws_count, ws_trim
from pagewise.session import spread
from pagewise.sources import fixtures as fx
from pagewise.sources import tables as src

_FORMATS = "[" + ", ".join(sq(f) for f in SC.SUMMARY_FORMATS) + "]"
_TEMPLATES = "(VALUES " + ", ".join(f"({sq(k)}, {sq(v)})" for k, v in SC.SUMMARY_TEMPLATES.items()) + ") AS t(format, template)"
_NOTE = sq(SC.LANGUAGE_NOTE)


def _docs_with_options(spark, sf):
    """Documents with per-row request options (format, max_length 20..1000,
    language = document language); blank texts are rejected before prompting."""
    d = spread(src.documents(spark, sf)).filter(~is_blank(F.col("text")))
    fmt = F.get(F.array(*[F.lit(f) for f in SC.SUMMARY_FORMATS]), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", "text", "lang", fmt.alias("format"),
                    (F.lit(20) + (F.col("doc_id") % 50) * 20).alias("max_length"))


_DOCOPT = f"""dopt AS (SELECT doc_id, text, lang, {_FORMATS}[doc_id % 4 + 1] AS format, 20 + (doc_id % 50) * 20 AS max_length
                FROM documents WHERE regexp_matches(text, {NONWS}))"""


@query("prompt_summary", group="scoring", oracle=f"""WITH {_DOCOPT}
SELECT d.doc_id, d.format, d.max_length,
       CASE WHEN d.lang <> 'en' THEN replace(t.template, '{{n}}', d.max_length::VARCHAR) || replace({_NOTE}, '{{lang}}', d.lang)
            ELSE replace(t.template, '{{n}}', d.max_length::VARCHAR) END AS system_prompt
FROM dopt d JOIN {_TEMPLATES} USING (format)""")
def q_prompt_summary(spark, sf):
    d = _docs_with_options(spark, sf).join(SC.templates(spark), "format")
    return d.select("doc_id", "format", "max_length",
                    SC.summary_prompt(F.col("template"), F.col("max_length"), F.col("lang")).alias("system_prompt"))


_TASKS_SQL = "(VALUES " + ", ".join(f"('{t}', {p[0]}, {p[1]}::DOUBLE, {p[2]}, {str(p[3]).lower()})"
                                    for t, p in SC.TASK_PARAMS.items()) + ") AS tk(task, lim, temperature, max_tokens, json_mode)"


@query("prompt_truncate", group="scoring", oracle=f"""WITH {_DOCOPT}
SELECT d.doc_id, tk.task, length(substr(d.text, 1, tk.lim))::BIGINT AS input_chars,
       length(d.text) > tk.lim AS truncated
FROM dopt d, {_TASKS_SQL}""")
def q_prompt_truncate(spark, sf):
    d = _docs_with_options(spark, sf).select("doc_id", F.length("text").alias("n"))
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(v[0]).alias("lim")) for t, v in SC.TASK_PARAMS.items()])
    d = d.select("doc_id", "n", F.explode(tasks).alias("t"))
    return d.select("doc_id", "t.task", F.least("n", "t.lim").cast("long").alias("input_chars"),
                    (F.col("n") > F.col("t.lim")).alias("truncated"))


@query("prompt_table", group="scoring", oracle=f"""WITH {_DOCOPT}
SELECT d.doc_id, tk.task, '{SC.MODEL}' AS model, tk.temperature, tk.max_tokens, tk.json_mode,
       md5(CASE WHEN tk.task = 'summary' THEN
             CASE WHEN d.lang <> 'en' THEN replace(t.template, '{{n}}', '200') || replace({_NOTE}, '{{lang}}', d.lang)
                  ELSE replace(t.template, '{{n}}', '200') END
           WHEN tk.task = 'sentiment' THEN {sq(SC.SENTIMENT_PROMPT)} ELSE {sq(SC.KEYWORDS_PROMPT)} END) AS prompt_md5
FROM dopt d JOIN {_TEMPLATES} ON t.format = 'tldr', {_TASKS_SQL}""")
def q_prompt_table(spark, sf):
    d = _docs_with_options(spark, sf).drop("format")
    p = SC.prompt_table(d, spark, fmt="tldr", max_length=200, language=F.col("lang"))
    return p.select("doc_id", "task", "model", "temperature", "max_tokens", "json_mode",
                    F.md5("system_prompt").alias("prompt_md5"))


def standin_sentiment(text: str) -> tuple[str, str]:
    """SQL for the stand-in model's label and confidence."""
    low = f"list_transform(regexp_extract_all(substr({text}, 1, 10000), '[a-zA-Z]+'), lambda w: lower(w))"

    def hits(ws: list[str]) -> str:
        return f"len(list_filter({low}, lambda w: w IN ({', '.join(sq(w) for w in ws)})))"
    p, n = hits(SC.POSITIVE_WORDS), hits(SC.NEGATIVE_WORDS)
    label = (f"CASE WHEN {p} + {n} = 0 THEN 'neutral' WHEN {p} = {n} THEN 'mixed' WHEN {p} > {n} THEN 'positive' "
             "ELSE 'negative' END")
    return label, f"CASE WHEN {p} + {n} = 0 THEN 0.5 ELSE {r(f'greatest({p}, {n}) / ({p} + {n})', 2)} END"


_LABEL_SQL, _CONF_SQL = standin_sentiment("text")


@query("score_local", group="scoring", oracle=f"""SELECT doc_id, {_LABEL_SQL} AS sentiment, {_CONF_SQL} AS confidence
FROM documents WHERE regexp_matches(text, {NONWS})""")
def q_score_local(spark, sf):
    """Prompt table -> stand-in scorer -> parsed sentiment."""
    s = SC.score(SC.prompt_table(_docs_with_options(spark, sf), spark).filter(F.col("task") == "sentiment"))
    f = SC.sentiment_fields(F.col("raw"))
    return s.select("doc_id", f["sentiment"].alias("sentiment"), f["confidence"].alias("confidence"))


def _completions(spark, sf):
    return fx.completions(spark, sf)


@query("summary_record", group="scoring", oracle=f"""WITH {COMPLETIONS}
SELECT c.doc_id, {ws_trim("coalesce(c.raw, '')")} AS summary, {ws_count(ws_trim("coalesce(c.raw, '')"))} AS word_count,
       {ws_count('d.text')} AS original_word_count, '{SC.MODEL}' AS model_used
FROM completions c JOIN documents d USING (doc_id) WHERE c.task = 'summary'""")
def q_summary_record(spark, sf):
    c = _completions(spark, sf).filter(F.col("task") == "summary")
    # the original's word count is taken before the join, so that no text is shuffled
    d = c.join(src.documents(spark, sf).select("doc_id", ws_word_count(F.col("text")).alias("original_word_count")), "doc_id")
    f = SC.summary_fields(F.col("raw"), F.lit(""))
    return d.select("doc_id", f["summary"].alias("summary"), f["word_count"].alias("word_count"),
                    "original_word_count", F.lit(SC.MODEL).alias("model_used"))


_LABELS = ", ".join(sq(x) for x in SC.SENTIMENT_LABELS)
_SENT = f"""{COMPLETIONS}, s0 AS (
    SELECT doc_id, CASE WHEN coalesce(raw, '') = '' THEN '{{}}' ELSE raw END AS t FROM completions WHERE task = 'sentiment'),
  s1v AS (SELECT doc_id, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t ELSE '{{}}' END AS t FROM s0),
  s1 AS (SELECT doc_id, t, ok, lower(coalesce(json_extract_string(t, '$.sentiment'), 'neutral')) AS lab,
                coalesce(TRY_CAST(json_extract_string(t, '$.confidence') AS DOUBLE), 0.5) AS conf FROM s1v),
  sent AS (SELECT doc_id, ok AS json_valid,
        CASE WHEN NOT ok THEN 'neutral' WHEN lab IN ({_LABELS}) THEN lab ELSE 'neutral' END AS sentiment,
        CASE WHEN NOT ok THEN 0.5 ELSE least(greatest(conf, 0.0), 1.0) END AS confidence,
        CASE WHEN NOT ok THEN 0.33 ELSE TRY_CAST(json_extract(t, '$.scores.positive') AS DOUBLE) END AS score_positive,
        CASE WHEN NOT ok THEN 0.33 ELSE TRY_CAST(json_extract(t, '$.scores.negative') AS DOUBLE) END AS score_negative,
        CASE WHEN NOT ok THEN 0.34 ELSE TRY_CAST(json_extract(t, '$.scores.neutral') AS DOUBLE) END AS score_neutral,
        CASE WHEN NOT ok THEN []::VARCHAR[] ELSE coalesce(json_extract_string(t, '$.key_phrases[*]'), []::VARCHAR[])[1:5] END AS phrases
      FROM s1)"""


def _sentiment(spark, sf):
    c = _completions(spark, sf).filter(F.col("task") == "sentiment")
    f = SC.sentiment_fields(F.col("raw"))
    return c.select("doc_id", *[v.alias(k) for k, v in f.items()])


@query("sentiment_record", group="scoring", oracle=f"""WITH {_SENT}
SELECT doc_id, json_valid, sentiment, confidence, score_positive, score_negative, score_neutral,
       array_to_string(phrases, '|') AS key_phrases, len(phrases)::BIGINT AS n_phrases FROM sent""")
def q_sentiment_record(spark, sf):
    s = _sentiment(spark, sf)
    return s.select("doc_id", "json_valid", "sentiment", "confidence",
                    *[F.try_element_at("scores", F.lit(k)).alias(f"score_{k}") for k in ("positive", "negative", "neutral")],
                    F.array_join("key_phrases", "|").alias("key_phrases"),
                    F.size("key_phrases").cast("long").alias("n_phrases"))


_KW_BODY = f"""k0 AS (
    SELECT doc_id, CASE WHEN coalesce(raw, '') = '' THEN '{{}}' ELSE raw END AS t FROM completions WHERE task = 'keywords'),
  kwr AS (SELECT doc_id, json_valid(t) AS ok,
        CASE WHEN json_valid(t) THEN coalesce(json_extract_string(t, '$.keywords[*]'), [])[1:10] ELSE [] END AS keywords,
        CASE WHEN json_valid(t) THEN coalesce(json_extract_string(t, '$.topics[*]'), [])[1:5] ELSE [] END AS topics,
        CASE WHEN json_valid(t) THEN coalesce(json_extract_string(t, '$.entities[*].name'), [])[1:10] ELSE [] END AS entities,
        CASE WHEN json_valid(t) THEN coalesce(json_extract_string(t, '$.category'), 'other') ELSE 'other' END AS category,
        CASE WHEN json_valid(t) THEN coalesce(json_extract_string(t, '$.tags[*]'), [])[1:7] ELSE [] END AS tags
      FROM k0)"""
_KW = f"{COMPLETIONS}, {_KW_BODY}"


def _keywords(spark, sf):
    c = _completions(spark, sf).filter(F.col("task") == "keywords")
    f = SC.keyword_fields(F.col("raw"))
    return c.select("doc_id", *[v.alias(k) for k, v in f.items()])


@query("keyword_record", group="scoring", oracle=f"""WITH {_KW}
SELECT doc_id, ok AS json_valid, array_to_string(keywords, '|') AS keywords, array_to_string(topics, '|') AS topics,
       array_to_string(entities, '|') AS entity_names, category, array_to_string(tags, '|') AS tags,
       len(keywords)::BIGINT AS n_keywords, len(entities)::BIGINT AS n_entities FROM kwr""")
def q_keyword_record(spark, sf):
    k = _keywords(spark, sf)
    names = F.transform("entities", lambda e: e["name"])
    return k.select("doc_id", "json_valid", F.array_join("keywords", "|").alias("keywords"),
                    F.array_join("topics", "|").alias("topics"), F.array_join(names, "|").alias("entity_names"),
                    "category", F.array_join("tags", "|").alias("tags"),
                    F.size("keywords").cast("long").alias("n_keywords"), F.size("entities").cast("long").alias("n_entities"))


@query("llm_gather", group="scoring", oracle=f"""WITH {_SENT}, {_KW_BODY}
SELECT s.doc_id, {ws_count(ws_trim("coalesce(c.raw, '')"))} AS summary_words, s.sentiment, s.confidence,
       k.category, len(k.keywords)::BIGINT AS n_keywords
FROM sent s JOIN kwr k USING (doc_id) JOIN (SELECT doc_id, raw FROM completions WHERE task = 'summary') c USING (doc_id)""")
def q_llm_gather(spark, sf):
    g = SC.gather(_completions(spark, sf))
    s = SC.sentiment_fields(F.col("sentiment_raw"))
    k = SC.keyword_fields(F.col("keywords_raw"))
    sm = SC.summary_fields(F.col("summary_raw"), F.lit(""))
    return g.select("doc_id", sm["word_count"].alias("summary_words"), s["sentiment"].alias("sentiment"),
                    s["confidence"].alias("confidence"), k["category"].alias("category"),
                    F.size(k["keywords"]).cast("long").alias("n_keywords"))


@query("sentiment_rollup", group="scoring", oracle=f"""WITH {_SENT}, j AS (
    SELECT d.lang, s.sentiment, s.confidence FROM sent s JOIN documents d USING (doc_id))
SELECT lang, sentiment, count(*)::BIGINT AS n_docs,
       {r('count(*) / sum(count(*)) OVER (PARTITION BY lang)', 4)} AS share,
       {r('avg(confidence)', 4)} AS avg_confidence
FROM j GROUP BY lang, sentiment""")
def q_sentiment_rollup(spark, sf):
    s = _sentiment(spark, sf).join(src.documents(spark, sf).select("doc_id", "lang"), "doc_id")
    by = s.groupBy("lang", "sentiment").agg(F.count(F.lit(1)).alias("n_docs"),
                                            round_half_even(F.avg("confidence"), 4).alias("avg_confidence"))
    tot = s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    return by.join(tot, "lang").select("lang", "sentiment", "n_docs",
                                       round_half_even(F.col("n_docs") / F.col("n_lang"), 4).alias("share"),
                                       "avg_confidence")


@query("entity_topk", group="scoring", oracle=f"""WITH {_KW}, e AS (SELECT unnest(entities) AS name FROM kwr),
  c AS (SELECT name, count(*)::BIGINT AS n_docs FROM e GROUP BY name)
SELECT name, n_docs, rk FROM (SELECT *, row_number() OVER (ORDER BY n_docs DESC, name) AS rk FROM c) WHERE rk <= 10""")
def q_entity_topk(spark, sf):
    """Top-10 entity names across documents (a top-k report). The count is a
    partial+final aggregation; only the 10 winners reach the final sort."""
    k = _keywords(spark, sf)
    e = k.select(F.explode(F.transform("entities", lambda x: x["name"])).alias("name"))
    c = e.groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"))
    top = c.orderBy(F.col("n_docs").desc(), F.col("name").asc()).limit(10)
    from pyspark.sql import Window
    return top.withColumn("rk", F.row_number().over(Window.orderBy(F.col("n_docs").desc(), F.col("name").asc()))
                          .cast("long"))


@query("category_rollup", group="scoring", oracle=f"""WITH {_KW}
SELECT category, count(*)::BIGINT AS n_docs, sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS n_invalid FROM kwr GROUP BY category""")
def q_category_rollup(spark, sf):
    k = _keywords(spark, sf)
    return k.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum(F.when(F.col("json_valid"), 0).otherwise(1)).cast("long").alias("n_invalid"))
