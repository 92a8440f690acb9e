"""Model-backed tasks as batch jobs: prompt table -> scorer -> parsed records.

* ``prompt_table``: one row per (document, task) with the system prompt, the
  truncated input and the request parameters (temperature, max tokens, JSON
  mode). Templates are a 4-row dimension joined by broadcast.
* ``score``: an injected scorer (a model client) runs in an Arrow-batched
  ``mapInPandas``, the only Python in the path; without one, the stand-in
  (first sentence, small lexicon sentiment, leading keywords) is a column
  expression. Alternatively join a ``completions(doc_id, task, raw)`` table.
* ``sentiment_record`` / ``keyword_record`` / ``summary_record``: robust
  parsing of the raw completions with native JSON functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.functions.text import is_blank, round_half_even, words, ws_trim, ws_word_count

MODEL = "local-standin-1"
TASKS = ["summary", "sentiment", "keywords"]
# Tasks, their parameters, formats, labels, categories, list caps and fallback scores.
# Per task: input character limit, temperature, max output tokens, JSON mode.
TASK_PARAMS = {
    "summary": (50_000, 0.3, 1000, False),
    "sentiment": (10_000, 0.1, 500, True),
    "keywords": (8_000, 0.1, 600, True),
}
SUMMARY_FORMATS = ["tldr", "bullets", "key_takeaways", "paragraph"]
SENTIMENT_LABELS = ["positive", "negative", "neutral", "mixed"]
KEYWORD_CATEGORIES = ["technology", "business", "health", "science", "politics", "entertainment",
                      "sports", "education", "lifestyle", "other"]
MAX_PHRASES, MAX_KEYWORDS, MAX_TOPICS, MAX_ENTITIES, MAX_TAGS = 5, 10, 5, 10, 7
FALLBACK_SCORES = {"positive": 0.33, "negative": 0.33, "neutral": 0.34}

# Our own prompt wording; {n} is the word budget.
SUMMARY_TEMPLATES = {
    "tldr": "Summarise the text below in at most {n} words. State only what the text says.",
    "bullets": "List the main points of the text below as 3 to 7 one-sentence bullets, {n} words in total at most.",
    "key_takeaways": "Give 3 to 7 numbered takeaways a reader should remember from the text below, "
                     "{n} words in total at most.",
    "paragraph": "Write one paragraph of at most {n} words that summarises the text below in its own tone.",
}
LANGUAGE_NOTE = "\n\nAnswer in the language whose ISO code is '{lang}'."
SENTIMENT_PROMPT = ("Classify the sentiment of the text below. Reply with one JSON object with keys "
                    "sentiment (positive, negative, neutral or mixed), confidence (0 to 1), scores "
                    "(positive, negative, neutral; summing to about 1) and key_phrases (3 to 5 short "
                    "phrases from the text). Reply with the JSON object only.")
KEYWORDS_PROMPT = ("Extract from the text below one JSON object with keys keywords (5 to 10), topics "
                   "(2 to 4), entities (up to 10 objects with name and type), category (one of "
                   + ", ".join(KEYWORD_CATEGORIES) + ") and tags (3 to 7 lower-case tags). "
                   "Reply with the JSON object only.")

SENTIMENT_SCHEMA = ("sentiment STRING, confidence STRING, scores MAP<STRING, STRING>, "
                    "key_phrases ARRAY<STRING>")
KEYWORD_SCHEMA = ("keywords ARRAY<STRING>, topics ARRAY<STRING>, "
                  "entities ARRAY<MAP<STRING, STRING>>, category STRING, tags ARRAY<STRING>")


def templates(spark: SparkSession) -> DataFrame:
    """The 4-row summary-format dimension (fixed size: safe to broadcast)."""
    return F.broadcast(spark.createDataFrame(list(SUMMARY_TEMPLATES.items()), "format STRING, template STRING"))


def summary_prompt(template: Column, max_length: Column, language: Column) -> Column:
    base = F.replace(template, F.lit("{n}"), max_length.cast("string"))
    note = F.replace(F.lit(LANGUAGE_NOTE), F.lit("{lang}"), language)
    return F.when(language != "en", F.concat(base, note)).otherwise(base)


def prompt_table(docs: DataFrame, spark: SparkSession, fmt: str = "tldr", max_length: int = 200,
                 language: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, task, system_prompt, input, model, temperature, max_tokens, json_mode):
    one row per (id, task) from a single pass over ``docs`` (explode over the
    tasks; per-task parameters are literal map lookups)."""
    lang = F.lit("en") if language is None else language
    # The format is a job parameter here, so its template is a literal (no
    # join); per-row formats join the template dimension (see templates()).
    base = docs.select(id_col, text_col, lang.alias("language"), F.lit(SUMMARY_TEMPLATES[fmt]).alias("template"))
    rows = base.select(id_col, text_col, "language", "template",
                       F.explode(F.array(*[F.lit(t) for t in TASKS])).alias("task"))

    def param(i: int) -> Column:
        return F.create_map(*[x for t in TASKS for x in (F.lit(t), F.lit(TASK_PARAMS[t][i]))])[F.col("task")]
    prompt = (F.when(F.col("task") == "summary",
                     summary_prompt(F.col("template"), F.lit(max_length), F.col("language")))
               .when(F.col("task") == "sentiment", F.lit(SENTIMENT_PROMPT))
               .otherwise(F.lit(KEYWORDS_PROMPT)))
    return rows.select(id_col, "task", prompt.alias("system_prompt"),
                       F.substring(F.col(text_col), F.lit(1), param(0)).alias("input"),
                       F.lit(MODEL).alias("model"), param(1).alias("temperature"),
                       param(2).alias("max_tokens"), param(3).alias("json_mode"))


# ------------------------------------------------------------------ scorer

Scorer = Callable[[pd.DataFrame], pd.Series]
MAX_BATCH_CHARS = 4_000_000  # input characters that a scorer call gets at most (one input may be longer)

# Words of the stand-in model.
POSITIVE_WORDS = ["good", "great", "excellent", "happy", "love", "best", "win", "success", "bright", "calm", "clear"]
NEGATIVE_WORDS = ["bad", "poor", "terrible", "sad", "hate", "worst", "loss", "fail", "dark", "broken", "angry"]
FIRST_SENTENCE_RE = r"^[^.!?]*[.!?]*"


def standin_raw(task: Column, text: Column) -> Column:
    """Deterministic stand-in completion as a column: the first sentence; the
    balance of a small lexicon; the first ten distinct words of over three
    letters. NULL (no model call) for a blank input."""
    found = words(text)
    low = F.transform(found, F.lower)
    pos = F.size(F.filter(low, lambda w: w.isin(POSITIVE_WORDS)))
    neg = F.size(F.filter(low, lambda w: w.isin(NEGATIVE_WORDS)))

    def sentiment(n: Column) -> Column:
        p, m = n["p"], n["n"]
        total = F.greatest(p + m, F.lit(1))
        label = (F.when(p + m == 0, F.lit("neutral")).when(p == m, F.lit("mixed"))
                  .when(p > m, F.lit("positive")).otherwise(F.lit("negative")))
        conf = F.when(p + m == 0, F.lit(0.5)).otherwise(round_half_even(F.greatest(p, m) / total, 2))
        share = [round_half_even(x / total, 2) for x in (p, m)]
        return F.to_json(F.struct(
            label.alias("sentiment"), conf.alias("confidence"),
            F.struct(share[0].alias("positive"), share[1].alias("negative"),
                     F.greatest(round_half_even(1 - share[0] - share[1], 2), F.lit(0.0)).alias("neutral")).alias("scores"),
            n["phrases"].alias("key_phrases")))
    counts = F.struct(pos.alias("p"), neg.alias("n"), F.slice(F.array_distinct(found), 1, 3).alias("phrases"))
    top = F.slice(F.array_distinct(F.filter(found, lambda w: F.length(w) > 3)), 1, MAX_KEYWORDS)

    def keywords(k: Column) -> Column:
        return F.to_json(F.struct(k.alias("keywords"), F.slice(k, 1, 2).alias("topics"), F.array().cast("array<string>").alias("entities"),
                                  F.lit("other").alias("category"), F.slice(F.transform(k, F.lower), 1, 5).alias("tags")))
    return (F.when(is_blank(text), F.lit(None).cast("string"))
             .when(task == "summary", F.regexp_extract(ws_trim(text), FIRST_SENTENCE_RE, 0))
             .when(task == "sentiment", F.get(F.transform(F.array(counts), sentiment), 0))
             .otherwise(F.get(F.transform(F.array(top), keywords), 0)))


def score(prompts: DataFrame, scorer: Scorer | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, task, raw). Without a ``scorer`` the stand-in, as a column. A
    ``scorer`` (a model client) gets Arrow batches cut to ``MAX_BATCH_CHARS``;
    filters and truncation are applied before this point because Catalyst
    cannot push them through ``mapInPandas``."""
    if scorer is None:
        return prompts.select(id_col, "task", standin_raw(F.col("task"), F.col("input")).alias("raw"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("task", T.StringType()),
                           T.StructField("raw", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["input"].fillna("").str.len()
            for _, part in b.groupby((size.cumsum() - size) // MAX_BATCH_CHARS):
                raw = pd.Series([None] * len(part), index=part.index, dtype="object")
                has_text = part["input"].fillna("").str.strip() != ""   # no model call for blank input
                if has_text.any():
                    raw[has_text] = scorer(part[has_text]).values
                yield pd.DataFrame({id_col: part[id_col], "task": part["task"], "raw": raw})
    return prompts.select(id_col, "task", "input").mapInPandas(run, schema)


# ------------------------------------------------------------------ parsers

def _valid_json(raw: Column) -> Column:
    return F.try_parse_json(raw).isNotNull()


def sentiment_fields(raw: Column) -> dict[str, Column]:
    """Robust parse: empty -> {}; invalid JSON -> neutral/0.5/fallback scores;
    label lower-cased, unknown -> neutral; confidence numeric or numeric
    string, default 0.5, clamped to [0, 1]; phrases cut to 5."""
    text = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("{}")).otherwise(raw)
    ok = _valid_json(text)
    p = F.from_json(text, SENTIMENT_SCHEMA)
    label = F.lower(F.coalesce(p["sentiment"], F.lit("neutral")))
    conf = F.coalesce(p["confidence"].try_cast("double"), F.lit(0.5))
    fallback = F.create_map(*[x for k, v in FALLBACK_SCORES.items() for x in (F.lit(k), F.lit(v))])
    return {
        "json_valid": ok,
        "sentiment": F.when(~ok, F.lit("neutral"))
                      .when(label.isin(*SENTIMENT_LABELS), label).otherwise(F.lit("neutral")),
        "confidence": F.when(~ok, F.lit(0.5)).otherwise(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))),
        # scores may be numbers or numeric strings; what is neither is left out
        "scores": F.when(~ok, fallback).otherwise(F.coalesce(
            F.map_filter(F.transform_values(p["scores"], lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull()),
            F.create_map().cast("map<string,double>"))),
        "key_phrases": F.when(~ok, F.array().cast("array<string>")).otherwise(
            F.slice(F.coalesce(p["key_phrases"], F.array().cast("array<string>")), 1, MAX_PHRASES)),
    }


def keyword_fields(raw: Column) -> dict[str, Column]:
    """Robust parse: invalid JSON -> empty lists and category 'other'; lists
    cut to 10 / 5 / 10 / 7; category defaults to 'other' (not validated)."""
    text = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("{}")).otherwise(raw)
    ok = _valid_json(text)
    p = F.from_json(text, KEYWORD_SCHEMA)
    empty_s = F.array().cast("array<string>")

    def lst(name: str, n: int, empty: Column = empty_s) -> Column:
        return F.when(~ok, empty).otherwise(F.slice(F.coalesce(p[name], empty), 1, n))
    return {
        "json_valid": ok,
        "keywords": lst("keywords", MAX_KEYWORDS),
        "topics": lst("topics", MAX_TOPICS),
        "entities": lst("entities", MAX_ENTITIES, F.array().cast("array<map<string,string>>")),
        "category": F.when(~ok, F.lit("other")).otherwise(F.coalesce(p["category"], F.lit("other"))),
        "tags": lst("tags", MAX_TAGS),
    }


def summary_fields(raw: Column, original_text: Column) -> dict[str, Column]:
    s = ws_trim(F.coalesce(raw, F.lit("")))
    return {"summary": s, "word_count": ws_word_count(s), "original_word_count": ws_word_count(original_text)}


def gather(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per id with the three raw completions (conditional aggregation
    on the id; at most three rows per group)."""
    return scored.groupBy(id_col).agg(*[F.max(F.when(F.col("task") == t, F.col("raw"))).alias(f"{t}_raw")
                                        for t in TASKS])
