"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of the item's
distinct five-word shingles occur there, however long the document is.

Search. Shingles are put in MinHash order (by their 64-bit hash). An item of q
shingles needs ``ceil(threshold * q)`` of them, so it can miss at most
``q - need``; of its ``k = q - need + 1`` smallest hashes, its bottom-k
MinHash sketch, at least one must therefore be in the document. Joining
document shingles with sketches on the hash loses no true pair. Items are
partitioned by size (powers of two of q): every partition has the bound up to
which its sketches reach and the least size of a document that can hold one of
its items, so a document sends on only the shingles below the bound of the
partitions that it is large enough for.

Verification. A document's candidate items are checked on the shingle texts
themselves, by exact containment.

Everything is DataFrame functions; texts are normalised by lower-casing
and cut at ASCII blanks. A text of one to four words has one shingle, the
whole sequence; null and blank texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import BLANK_RE, BLANKS
from pagewise.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so that the
    optimiser cannot copy its expression into every place that uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    low = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(BLANKS))
    return let(low, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RE)))


def _starts(n: Column, size: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """One 64-bit hash for each shingle of the text, in order."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.transform(
        _starts(F.size(h), size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))


def shingles(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The distinct shingle texts."""
    return F.array_distinct(let(words(text), lambda w: F.transform(
        _starts(F.size(w), size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))))


def sketches(items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(item, n_item, need, size_class, hash)``: the bottom-k sketch of each item."""
    rows = items.select("item", F.size(shingles(F.col("text"), size)).alias("n_item"),
                        F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), size))).alias("low"))
    rows = rows.where("n_item > 0").withColumn("need", F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9).cast("int"))
    rows = rows.withColumn("low", F.slice("low", F.lit(1), F.col("n_item") - F.col("need") + 1))
    return rows.select("item", "n_item", "need", F.floor(F.log2("n_item")).cast("int").alias("size_class"),
                       F.explode("low").alias("hash"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
              text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(id_col, text_key, item_col, n_shared, n_item, containment)`` for every
    row of ``docs`` and item with containment of at least ``threshold``;
    ``text_key`` is the text's 64-bit hash.

    Defined results: null and blank texts contain nothing and are contained in
    nothing; a repeated document or item row gives repeated result rows; null
    ids are kept as null; other columns are ignored; empty tables give an empty
    result.
    """
    items = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"),
                         F.col(text_col).cast("string").alias("text"))
    items = cut_lineage(items, "items")
    low = cut_lineage(sketches(items, threshold, size), "sketches")
    classes = low.groupBy("size_class").agg(F.min("need").alias("least"), F.max("hash").alias("bound")).collect()

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    sized = rows.select("doc", "text_key", shingle_hashes(F.col("text"), size).alias("hashes"))
    n = F.size("hashes")
    bound = F.greatest(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"),
                       *[F.when(n >= c.least, F.lit(c.bound)) for c in classes])
    # explode_outer and coalesce keep the optimiser from testing the array, built anew, in a filter below
    sent = (sized.select("doc", "text_key", n.alias("n"), bound.alias("bound"), F.explode_outer("hashes").alias("hash"))
            .where(F.coalesce(F.col("hash") <= F.col("bound"), F.lit(False))))
    met = (sent.join(low.select("hash", "item", "need"), "hash").where(F.coalesce(F.col("n") >= F.col("need"), F.lit(False)))
           .select("doc", "text_key", "item").distinct())
    met = cut_lineage(met.groupBy("doc", "text_key").agg(F.collect_list("item").alias("items")), "candidates")

    same = rows["doc"].eqNullSafe(met["doc"]) & (rows["text_key"] == met["text_key"])
    held = rows.join(met, same).select(rows["doc"], rows["text_key"], "text", "items")
    held = held.select("doc", "text_key", shingles(F.col("text"), size).alias("shingles"), "items")
    held = held.select("doc", "text_key", "shingles", F.explode_outer("items").alias("item"))
    checked = items.select("item", "item_id", shingles(F.col("text"), size).alias("wanted"))
    pairs = held.join(checked, "item").select(
        "doc", "text_key", "item_id", F.size(F.array_intersect("wanted", "shingles")).cast("long").alias("n_shared"),
        F.size("wanted").cast("long").alias("n_item"))
    return (pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))
            .select(F.col("doc").alias(id_col), "text_key", F.col("item_id").alias(item_col), "n_shared", "n_item",
                    "containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                      size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without the rows that contain an item; all else is kept,
    repeated rows and rows without an id or a text included."""
    bad = cut_lineage(contained(docs, items, threshold=threshold, size=size)
                      .select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")
