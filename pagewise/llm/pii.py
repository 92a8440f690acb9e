"""Information-theoretic sanitisation of personal data.

Protected entities are the personal values themselves (e-mail addresses, IP
addresses, card and phone numbers), found by fixed patterns. Which other terms
give them away is learned from the corpus: for an entity e and a term t, the
documents that hold e, hold t, and hold t within ``WINDOW`` words of e are
counted over all documents, and

    disclosure(t, e) = PMI(t, e) / IC(e) = log(N df(t,e) / (df(t) df(e))) / log(N / df(e))

is the share of e's information that t reveals (1: t occurs only beside e). A
term at or above ``threshold``, seen beside e in at least ``min_docs``
documents, is generalised where it stands in e's window, to the class of terms
that share its first letters, if the class stays below the threshold; else it
is removed.

Most values are in one document only, so the same is estimated for the groups
that a value belongs to (any value, its kind, e-mail domain, network, leading
digits), and for values and groups alike also with all terms of the documents
that hold them; such a term goes wherever it stands in those documents.

One pass over the texts yields a table of document rows (spans, and terms near
mentions) and, pre-aggregated in each task, document frequencies of terms and
classes. The rest are counts and equi-joins on that table. The window keeps the
pairs of a text linear in its length. All offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.session import cut_lineage

# fixed values: the kinds in their order, and the patterns of the query contract
KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NON_DIGITS = re.compile(r"[^0-9]+")

WINDOW = 8
MIN_DOCS = 3
THRESHOLD = 0.8
CLASS_LETTERS = 3
FLUSH_TERMS = 300_000  # counts that a task holds before it passes them on
SLICE_ROWS = 500
EDGES = ".,;:!?\"'()[]{}<>|*#$%&/\\=+-_~`^@"

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address holds one @, so each @ is tried once: with the run of local
    characters before it (not reaching into the previous match)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four kinds, leftmost and non-overlapping within a kind, by
    kind and start; time is linear in the text."""
    if not text:
        return []
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NON_DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NON_DIGITS.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def terms(text: str | None) -> set[str]:
    """Distinct blank-separated words, lower-cased, without punctuation at the ends."""
    return {w.strip(EDGES) for w in set(text.lower().split())} - {""} if text else set()


def entity_of(text: str, span: Span) -> str:
    return f"{KINDS[span[0]]}:{text[span[1]:span[2]].lower()}"


def groups_of(entity: str) -> list[str]:
    """The groups of a value: all, its kind, and what it shares with values of one origin."""
    kind, value = entity.split(":", 1)
    if kind == "email":
        own = [f"domain:{value.rsplit('@', 1)[1]}"]
    elif kind == "ip":
        parts = [str(int(p)) for p in value.split(".")]
        own = [f"net:{'.'.join(parts[:n])}" for n in (2, 3)]
    else:
        digits = NON_DIGITS.sub("", value)
        own = [f"{kind}-prefix:{digits[:n]}" for n in (3, 6)]
    return ["any:", f"kind:{kind}", *own]


def outside(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words that touch no span."""
    merged = sorted((s, e) for _, s, e in spans)
    words, touch = [], 0
    reach = 0
    for m in re.finditer(r"\S+", text):
        while touch < len(merged) and merged[touch][0] < m.end():
            reach = max(reach, merged[touch][1])
            touch += 1
        if reach > m.start():
            continue
        raw = m.group()
        start = m.start() + len(raw) - len(raw.lstrip(EDGES))
        word = raw.strip(EDGES)
        if word:
            words.append((start, start + len(word), word.lower()))
    return words


def near_terms(text: str, spans: list[Span], window: int = WINDOW, words: list[tuple[int, int, str]] | None = None
               ) -> dict[tuple[str, str], set[tuple[int, int]]]:
    """(entity, term) -> places of the term within ``window`` words of a mention.
    Words that touch a span are no terms."""
    words = outside(text, spans) if words is None else words
    starts = [w[0] for w in words]
    out: dict[tuple[str, str], set[tuple[int, int]]] = {}
    for span in spans:
        entity, (_, s, e) = entity_of(text, span), span
        left, right = bisect_left(starts, s), bisect_right(starts, e - 1)
        for a, b, w in words[max(0, left - window):left] + words[right:right + window]:
            out.setdefault((entity, w), set()).add((a, b))
    return out


_SCAN = pa.schema([
    ("kind", pa.string()), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
    ("counts", pa.list_(pa.int64())), ("base", pa.string()), ("entities", pa.list_(pa.string())),
    ("pairs", pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()),
                                  ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))),
    ("classes", pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))),
    ("held", pa.list_(pa.string())),
    ("words", pa.list_(pa.struct([("term", pa.string()),
                                  ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))),
    ("term", pa.string()), ("n", pa.int64())])
_SCAN_DDL = ("kind string, row_key long, doc_id long, text_key long, counts array<long>, base string, "
             "entities array<string>, pairs array<struct<entity:string,term:string,places:array<struct<start:long,"
             "end:long>>>>, classes array<struct<entity:string,term:string>>, held array<string>, "
             "words array<struct<term:string,places:array<struct<start:long,end:long>>>>, term string, n long")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scan(window: int, class_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        seen: dict[str, Counter] = {"term": Counter(), "class": Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counter in seen.items():
                rows = list(counter.items())
                counter.clear()
                for at in range(0, len(rows), 50_000):
                    part = rows[at:at + 50_000]
                    yield pa.RecordBatch.from_pylist([{"kind": kind, "term": t, "n": n} for t, n in part], _SCAN)

        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part, rows = b.slice(at, SLICE_ROWS), []
                for doc_id, text_key, text in zip(*(c.to_pylist() for c in part.columns)):
                    spans = base_spans(text)
                    words = outside(text, spans) if spans else []
                    near = near_terms(text, spans, window, words) if spans else {}
                    entities = sorted({entity_of(text, s) for s in spans})
                    places: dict[str, list[dict]] = {}
                    for s, e, w in words:
                        places.setdefault(w, []).append({"start": s, "end": e})
                    found = terms(text)
                    seen["term"].update(found)
                    seen["class"].update({t[:class_letters] for t in found})
                    kinds = Counter(k for k, _, _ in spans)
                    rows.append({
                        "kind": "doc", "row_key": key, "doc_id": doc_id, "text_key": text_key,
                        "counts": [kinds[k] for k in range(len(KINDS))], "base": joined(spans),
                        "entities": entities,
                        "pairs": [{"entity": e, "term": t, "places": [{"start": x, "end": y} for x, y in sorted(p)]}
                                  for (e, t), p in near.items()],
                        "classes": [{"entity": e, "term": c} for e, c in
                                    sorted({(e, t[:class_letters]) for e, t in near})],
                        "held": sorted({*entities, *(g for e in entities for g in groups_of(e))}),
                        "words": [{"term": t, "places": p} for t, p in places.items()]})
                    key += 1
                yield pa.RecordBatch.from_pylist(rows, _SCAN)
                if len(seen["term"]) > FLUSH_TERMS:
                    yield from flush()
        yield from flush()
    return run


def disclosures(scan: DataFrame, min_docs: int = MIN_DOCS, threshold: float = THRESHOLD,
                class_letters: int = CLASS_LETTERS) -> DataFrame:
    """``(entity, term, disclosure, action)`` of the terms that reveal an entity."""
    docs = scan.where("kind = 'doc'")
    total = docs.count()
    entities = docs.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    entities = entities.where(F.col("df_e") >= min_docs)  # a pair cannot be in more documents than its entity

    def revealed(pairs: str, kind: str) -> DataFrame:
        both = (docs.select(F.explode(pairs).alias("p")).groupBy("p.entity", "p.term")
                .agg(F.count(F.lit(1)).alias("df_te")).where(F.col("df_te") >= min_docs))
        both = cut_lineage(both, f"{kind}_pairs")
        wanted = cut_lineage(both.select("term").distinct(), f"{kind}_names")
        known = (scan.where(F.col("kind") == kind).select("term", "n").join(wanted, "term", "left_semi")
                 .groupBy("term").agg(F.sum("n").alias("df_t")))
        both = both.join(known, "term").join(entities, "entity")
        content = F.log2(F.lit(float(max(total, 1))) / F.col("df_e"))
        pmi = F.log2(F.lit(float(total)) * F.col("df_te") / (F.col("df_t") * F.col("df_e")))
        return both.select("entity", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure"))

    classes = revealed("classes", "class").select(
        F.col("entity").alias("class_entity"), F.col("term").alias("class"), F.col("disclosure").alias("class_value"))
    found = revealed("pairs", "term").where(F.col("disclosure") >= threshold)
    found = found.join(classes, (F.col("entity") == F.col("class_entity"))
                       & (F.substring("term", 1, class_letters) == F.col("class")), "left")
    general = (F.col("class_value") < threshold) & (F.length("term") > class_letters)
    return found.select("entity", "term", "disclosure",
                        F.when(general, F.lit(GENERALISED)).otherwise(F.lit(REMOVED)).alias("action"))


def wide_disclosures(scan: DataFrame, min_docs: int = MIN_DOCS, threshold: float = THRESHOLD,
                     class_letters: int = CLASS_LETTERS) -> DataFrame:
    """As ``disclosures``, of values and their groups, from whole documents.

    A term meets entities only if it can reach the threshold at all: beside e it
    must be in at least df(t) (df(e) / N) ** (1 - threshold) documents, so in no
    fewer beside any value, with the least df(e) that counts."""
    docs = scan.where("kind = 'doc'")
    total = docs.count()
    docs = docs.where(F.size("held") > 0)
    entities = docs.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    entities = cut_lineage(entities.where((F.col("df_e") >= min_docs) & (F.col("df_e") < total)), "wide_entities")
    held = (docs.select("row_key", F.explode("held").alias("entity"))
            .join(entities.select("entity"), "entity", "left_semi"))
    words = docs.select("row_key", F.explode("words.term").alias("term"))

    def df(kind: str, wanted: DataFrame) -> DataFrame:
        return (scan.where(F.col("kind") == kind).select("term", "n").join(wanted.select("term"), "term", "left_semi")
                .groupBy("term").agg(F.sum("n").alias("df_t")))

    def value(both: DataFrame) -> DataFrame:
        n = F.lit(float(max(total, 1)))
        share = F.log2(n * F.col("df_te") / (F.col("df_t") * F.col("df_e"))) / F.log2(n / F.col("df_e"))
        return both.join(entities, "entity").select("entity", "term", share.alias("disclosure"))

    with_any = words.groupBy("term").agg(F.count(F.lit(1)).alias("df_any")).where(F.col("df_any") >= min_docs)
    least = (min_docs / max(total, min_docs, 1)) ** max(0.0, 1 - threshold) * (1 - 1e-9)
    with_any = cut_lineage(with_any, "wide_terms")
    terms_ = cut_lineage(with_any.join(df("term", with_any), "term").where(F.col("df_any") >= F.col("df_t") * least)
                         .select("term", "df_t"), "wide_candidates")
    both = (words.join(terms_.select("term"), "term", "left_semi").join(held, "row_key").groupBy("entity", "term")
            .agg(F.count(F.lit(1)).alias("df_te")).where(F.col("df_te") >= min_docs).join(terms_, "term"))
    found = cut_lineage(value(both).where(F.col("disclosure") >= threshold)
                        .withColumn("class", F.substring("term", 1, class_letters)), "wide_found")

    pairs = found.select("entity", F.col("class").alias("term")).distinct()
    wanted = cut_lineage(pairs, "wide_classes")
    names = wanted.select("term").distinct()
    near = words.select("row_key", F.substring("term", 1, class_letters).alias("term")).join(names, "term", "left_semi")
    both = (near.distinct().join(held, "row_key").join(wanted, ["entity", "term"], "left_semi").groupBy("entity", "term")
            .agg(F.count(F.lit(1)).alias("df_te")).join(df("class", names), "term"))
    classes = value(both).select("entity", F.col("term").alias("class"), F.col("disclosure").alias("class_value"))
    general = (F.col("class_value") < threshold) & (F.length("term") > class_letters)
    return found.join(classes, ["entity", "class"], "left").select(
        "entity", "term", "disclosure", F.when(general, F.lit(GENERALISED)).otherwise(F.lit(REMOVED)).alias("action"))


def inspect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            min_docs: int = MIN_DOCS, threshold: float = THRESHOLD, class_letters: int = CLASS_LETTERS) -> DataFrame:
    """One row per document: ``id_col``, ``text_key`` (the text's 64-bit hash),
    ``n_email, n_ip, n_card, n_phone``, ``base`` and ``spans`` (comma-joined
    ``kind:start:end``, by kind, then start), ``n_generalised, n_removed``.

    Defined results: a null text counts as empty; repeated rows are inspected
    and counted like any other documents and stay in the result; null ids stay
    null; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("k"),
                       F.col(text_col).cast("string").alias("text"))
    scan = cut_lineage(rows.mapInArrow(_scan(window, class_letters), _SCAN_DDL), "pii_scan")
    found = cut_lineage(disclosures(scan, min_docs, threshold, class_letters), "disclosures")
    held = scan.where("kind = 'doc'")
    placed = (held.select("row_key", F.explode("pairs").alias("p"))
              .select("row_key", "p.entity", "p.term", "p.places").join(found, ["entity", "term"])
              .select("row_key", "places", (F.col("action") == REMOVED).alias("gone")))
    wide = cut_lineage(wide_disclosures(scan, min_docs, threshold, class_letters), "wide_disclosures")
    everywhere = (held.select("row_key", F.explode("words").alias("w")).select("row_key", "w.term", "w.places")
                  .join(wide.select("term", "entity", "action"), "term")
                  .join(held.select("row_key", F.explode("held").alias("entity")), ["row_key", "entity"])
                  .groupBy("row_key", "term").agg(F.first("places").alias("places"),
                                                  F.max(F.col("action") == REMOVED).alias("gone")).drop("term"))
    placed = placed.unionByName(everywhere).select("row_key", F.explode("places").alias("place"), "gone")
    placed = placed.groupBy("row_key", "place").agg(F.max("gone").alias("gone"))
    more = placed.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("gone", "place.start", "place.end"))).alias("more"))
    out = held.select("row_key", "doc_id", "text_key", "counts", "base").join(more, "row_key", "left")
    extra = F.transform(F.coalesce("more", F.array().cast("array<struct<gone:boolean,start:bigint,end:bigint>>")),
                        lambda m: F.concat_ws(":", F.when(m["gone"], F.lit(REMOVED)).otherwise(F.lit(GENERALISED)),
                                              m["start"].cast("string"), m["end"].cast("string")))
    removed = F.coalesce(F.size(F.filter("more", lambda m: m["gone"])), F.lit(0))
    spans = F.array_join(F.concat(F.filter(F.array("base"), lambda s: s != ""), extra), ",")
    return out.select(
        F.col("doc_id").alias(id_col), "text_key",
        *[F.get("counts", k).alias(f"n_{name}") for k, name in enumerate(KINDS)], "base", spans.alias("spans"),
        (F.coalesce(F.size("more"), F.lit(0)) - removed).cast("long").alias("n_generalised"),
        removed.cast("long").alias("n_removed"))


def cleaned(text: str, spans: str, class_letters: int = CLASS_LETTERS) -> str:
    """The text with base values replaced by their kind, generalised terms by
    their class and removed terms by nothing; of overlapping spans the one that
    starts first (the longer one, if both start together) names the whole."""
    marks = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, done = [], 0
    for start, end, kind in marks:
        end = -end
        if start < done:
            if end > done:
                done = end
            continue
        out.append(text[done:start])
        if kind == GENERALISED:
            out.append(text[start:start + class_letters] + "*")
        elif kind != REMOVED:
            out.append(f"[{kind.upper()}]")
        done = end
    return "".join(out) + text[done:]


def cleaned_column(text: Column, spans: Column, class_letters: int = CLASS_LETTERS) -> Column:
    @F.arrow_udf("string")
    def clean(texts: pa.Array, marks: pa.Array) -> pa.Array:
        return pa.array((t if t is None or not m else cleaned(t, m, class_letters)
                         for t, m in ((a.as_py(), b.as_py()) for a, b in zip(texts, marks))), pa.string())
    return clean(text.cast("string"), spans)


# holds in every text that has a base span (and in some others)
MAYBE = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){12}"


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with sanitised texts, row for row; ``n_chars``, where there is
    such a column, follows the new text. Other columns are left as they are.

    Only a text with a base span can have any span, so rows whose text cannot
    have one stay where they are; the others meet their spans in a join."""
    found = inspect(docs, **options).where("spans <> ''")
    found = cut_lineage(found.groupBy("doc_id", "text_key").agg(F.min("spans").alias("spans")), "pii_spans")
    maybe = F.coalesce(F.col("text").cast("string").rlike(MAYBE), F.lit(False))
    held = docs.where(maybe)
    same = held["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (
        F.xxhash64(held["text"].cast("string")) == found["text_key"])
    rows = held.join(found, same, "left").select(*[held[c] for c in docs.columns], found["spans"].alias("_pii_spans"))
    rows = rows.withColumn("text", cleaned_column(F.col("text"), F.col("_pii_spans")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("_pii_spans").isNotNull(), F.length("text").cast(kind))
                               .otherwise(F.col("n_chars")))
    return docs.where(~maybe).unionByName(rows.drop("_pii_spans"))
