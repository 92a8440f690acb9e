"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a bit string that lies
within half the radius of both. So every distinct fingerprint emits its whole
ball (all variants within ``radius // 2`` flips, itself included), variants
meet in a shuffle, and the fingerprints that meet on a variant are linked.

The ball crosses the network in folded form. A variant belongs to the cell of
its leading ``cell_bits`` bits, and a fingerprint is sent once to every cell
that holds some of its variants (1 + b + b(b-1)/2 rows instead of 2081); the
cell's task unfolds the variants that are its own. Each variant is unfolded in
exactly one cell, so nothing is found twice and nothing is missed. The number
of cells follows the number of fingerprints so that a cell unfolds about
``VARIANTS_PER_CELL`` variants; a cell that collects far more is re-cut by
further bits, and inside a task a large cell is unfolded in slices.

Linked fingerprints leave a cell as a spanning forest (at most one row per
member), never as all pairs, so a group of thousands of near copies stays
linear; components are closed on Spark afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import lower_words, text_bytes
from pagewise.llm.components import connected_components
from pagewise.session import cut_lineage

SHINGLE_WORDS = 4
RADIUS = 4
VARIANTS_PER_CELL = 1 << 17
CELL_ROWS_MAX = 200_000  # rows of a cell beyond which it is cut by further bits
RECUT_BITS = 6
SLICE_VARIANTS = 1 << 22  # variants unfolded at once inside a task


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text over its word shingles, repeats included."""
    words = lower_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[:n - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], 42) for i, j in zip(starts, ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k:k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The SimHash of a text column as a signed long; 0 for null or blank texts."""
    @F.arrow_udf("long")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in text_bytes(texts)], np.uint64).view(np.int64))
    return digest(text.cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(id_col, fp)`` per row."""
    return docs.select(F.col(id_col).cast("long").alias(id_col),
                       fingerprint_column(F.col(text_col), shingle).alias("fp"))


def flips(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` ones (most <= 2)."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def ball_size(bits: int, most: int) -> int:
    return sum(math.comb(bits, k) for k in range(most + 1))


def _span(fps: np.ndarray, bits: int, prefix: int, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) rows that span what the cell's fingerprints link."""
    rest = 64 - bits
    spent = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(prefix)) if bits else np.zeros(len(fps), int)
    fps, spent = fps[spent <= half], spent[spent <= half]
    total = sum(int((spent == k).sum()) * ball_size(rest, half - k) for k in range(half + 1))
    if total > SLICE_VARIANTS and rest > 4:
        parts = [_span(fps, bits + 2, (prefix << 2) | s, half, radius) for s in range(4)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    low = fps & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for k in range(half + 1):
        own = np.flatnonzero(spent == k)
        masks = flips(rest, half - k)
        variants.append((low[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    s = np.sort(v)
    shared = np.unique(s[1:][s[1:] == s[:-1]])
    none = np.zeros(0, np.uint64)
    if not len(shared):
        return none, none
    hit = np.searchsorted(shared, v)
    hit[hit == len(shared)] = 0
    met = shared[hit] == v
    run, o = hit[met], o[met]
    order = np.lexsort((o, run))
    run, o = run[order], o[order]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    centre = np.repeat(o[first], np.diff(np.r_[first, len(run)]))
    close = np.bitwise_count(fps[o] ^ fps[centre]) <= radius  # verification of each meeting
    o, centre = o[close], centre[close]
    label = np.arange(len(fps))
    while True:
        low_label = np.minimum(label[o], label[centre])
        new = label.copy()
        np.minimum.at(new, o, low_label)
        np.minimum.at(new, centre, low_label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def _cells(fps: DataFrame, bits: int, half: int) -> DataFrame:
    masks = F.array(*[F.lit(int(m)) for m in flips(bits, half)]).cast("array<bigint>")
    return (fps.select("fp", F.explode(masks).alias("mask"))
            .select("fp", F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("mask")).alias("cell")))


def links(fps: DataFrame, radius: int = RADIUS, cell_rows_max: int = CELL_ROWS_MAX,
          variants_per_cell: int = VARIANTS_PER_CELL) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints (column ``fp``)
    at most ``radius`` (even, up to 4) bits apart."""
    half = radius // 2
    n = fps.count()
    bits = min(28, max(6, math.ceil(math.log2(max(1, n) * ball_size(64, half) / variants_per_cell))))
    cells = _cells(fps, bits, half)

    def meet(key_bits: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own = rows["fp"].to_numpy(np.int64).view(np.uint64)
            a, b = _span(own, key_bits, int(key[0]), half, radius)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        return run

    crowded = cut_lineage(cells.groupBy("cell").count().where(F.col("count") > cell_rows_max).select("cell"), "crowded")
    if crowded.isEmpty():
        return cells.groupBy("cell").applyInPandas(meet(bits), "a long, b long")
    fine = _cells(fps, bits + RECUT_BITS, half).withColumn("wide", F.shiftrightunsigned("cell", RECUT_BITS))
    fine = fine.join(crowded.select(F.col("cell").alias("wide")), "wide", "left_semi").select("fp", "cell")
    return (cells.join(crowded, "cell", "left_anti").groupBy("cell").applyInPandas(meet(bits), "a long, b long")
            .union(fine.groupBy("cell").applyInPandas(meet(bits + RECUT_BITS), "a long, b long")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links of at most ``radius``
    differing bits, itself included).

    Defined results: null and blank texts have fingerprint zero and are linked
    like any other; equal texts share a fingerprint; a repeated row is repeated
    in the result; a null id takes part in links but is never a component's
    smallest id (its component_id is null only if its component has no other
    id); other columns of ``docs`` are not read; an empty table gives an empty
    result.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")), "balls")
    linked = connected_components(links(nodes.select("fp"), radius), "a", "b")
    rooted = cut_lineage(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    whole = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(whole, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of the
    smallest doc_id. Rows that repeat a doc_id count as copies of one document
    (their group keeps one row); rows with a null doc_id are kept only if their
    whole group has null ids, one row for each text fingerprint then."""
    rows = cut_lineage(near_duplicates(docs, shingle=shingle, radius=radius), "groups")
    dropped = rows.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    repeated = cut_lineage(rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
                           .where("count > 1").select("doc_id"), "repeated")
    kept = docs.where(F.col("doc_id").isNotNull()).join(dropped, "doc_id", "left_anti")
    if not repeated.isEmpty():
        kept = (kept.join(repeated, "doc_id", "left_anti")
                .unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    lone = rows.where(F.col("component_id").isNull()).select(F.col("fingerprint").alias("_fingerprint")).distinct()
    nulls = (docs.where(F.col("doc_id").isNull())
             .withColumn("_fingerprint", hex16(fingerprint_column(F.col("text"), shingle)))
             .join(lone, "_fingerprint", "left_semi").dropDuplicates(["_fingerprint"]))
    return kept.select(*docs.columns).unionByName(nulls.select(*docs.columns))
