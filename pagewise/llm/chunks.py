"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where the hash is
the least within ``REACH`` bytes on either side (of equal hashes the first, and
at most ``MAX_BYTES`` after the last cut). So a cut depends only on the bytes
around it: an insertion changes the chunks that it touches and no others.
Chunks are deduplicated by a 128-bit digest: the document with the smallest id
owns a chunk, and it is a repeat in every other document. Neighbouring chunks that are
shared with other documents form a span; spans of at least ``MIN_CHARS``
characters are reported, so that a few common words are not taken for a
passage.

A hot chunk is pre-aggregated before its shuffle (smallest and largest id), and
its occurrences meet the owner in an equi-join that AQE can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import text_bytes
from pagewise.session import cut_lineage

WINDOW_BYTES = 16  # the hash has as many bits
REACH = 28
MAX_BYTES = 512
MIN_CHARS = 72
SLICE_BYTES = 1 << 22  # hashed at once, with the bytes around them that matter

GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2).digest(), "little") for b in range(256)],
                np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-j]] << j over the window's bytes, modulo 2**16."""
    h = GEAR[data]
    for s in (1, 2, 4, 8):
        if len(h) > s:
            low = h[:-s] << np.uint16(s)
            h[s:] += low
    return h


def cuts(data: bytes) -> list[int]:
    """End offsets of the chunks of a UTF-8 text, at character boundaries."""
    size = len(data)
    if not size:
        return []
    raw = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, size, SLICE_BYTES):
        left = max(0, at - REACH - WINDOW_BYTES + 1)
        h = gear_hash(raw[left:at + SLICE_BYTES + REACH])
        first = at - left
        # hashes of [at - REACH, at + SLICE_BYTES + REACH), with the largest value beyond the text
        wide = np.full(min(SLICE_BYTES, size - at) + 2 * REACH, 0xFFFF, np.uint16)
        known = h[max(0, first - REACH):]
        offset = REACH - min(first, REACH)
        wide[offset:offset + len(known)] = known[:len(wide) - offset]
        low, width = wide, 1
        while 2 * width <= REACH:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        low = np.minimum(low[:len(low) - (REACH - width)], low[REACH - width:])  # least of REACH hashes from here
        own = wide[REACH:len(wide) - REACH]
        cut = (own < low[:len(own)]) & (own <= low[REACH + 1:REACH + 1 + len(own)])
        found.append(np.flatnonzero(cut) + at + 1)
    ends = np.concatenate(found)
    inner = (np.r_[raw, 0] & 0xC0) == 0x80  # a cut here would split a character
    for _ in range(3):
        ends = ends + inner[np.minimum(ends, size)]
    flags = inner.tobytes()
    out, last = [], 0
    for end in ends.tolist() + [size]:
        while end - last > MAX_BYTES:
            last += MAX_BYTES
            while flags[last]:
                last += 1
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            keys, ids, starts, ends, digests = [], [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text"))):
                text = text or b""
                cut = cuts(text)
                chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                last = chars[np.array(cut, np.int64) - 1] if cut else np.zeros(0, np.int64)
                keys.append(np.full(len(cut) + 1, key))
                ids += [doc_id] * (len(cut) + 1)
                # the first row of a document has no digest: its chunk count and length
                starts.append(np.r_[len(cut), 0, last[:-1]] if cut else np.zeros(1, np.int64))
                ends.append(np.r_[int(chars[-1]) if cut else 0, last])
                digests.append(bytes(16))
                digest = xxhash.xxh3_128_digest
                digests += [digest(text[s:e]) for s, e in zip([0, *cut], cut)]
                key += 1
            halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            keys_, starts_, ends_ = (np.concatenate(x).astype(np.int64) for x in (keys, starts, ends))
            first = np.r_[True, keys_[1:] != keys_[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys_), pa.array(ids, pa.int64()), pa.array(starts_), pa.array(ends_), pa.array(first),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["row_key", "doc_id", "start", "end", "head", "hi", "lo"])


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk and one (``head``) per document row; offsets in code points."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_chunk, "row_key long, doc_id long, start long, end long, head boolean, hi long, lo long")


def _spans(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row_key, marks in zip(b.column("row_key").to_pylist(), b.column("marks").to_pylist()):
                marks.sort(key=lambda m: m["start"])
                found: dict[bool, list[list[int]]] = {True: [], False: []}
                owners = set()
                for only_repeats, spans in found.items():
                    for m in marks:
                        if only_repeats and not m["repeat"]:
                            continue
                        if spans and spans[-1][1] == m["start"]:
                            spans[-1][1] = m["end"]
                        else:
                            spans.append([m["start"], m["end"]])
                    spans[:] = [s for s in spans if s[1] - s[0] >= min_chars]
                at = 0
                for m in marks:
                    while at < len(found[True]) and found[True][at][1] <= m["start"]:
                        at += 1
                    if m["repeat"] and at < len(found[True]) and found[True][at][0] <= m["start"]:
                        owners.add(m["owner"])
                rows.append((row_key, *(",".join(f"{s}:{e}" for s, e in found[k]) for k in (True, False)),
                             *(sum(e - s for s, e in found[k]) for k in (True, False)), sorted(owners)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                names=["row_key", "repeat_spans", "shared_spans", "repeat_chars", "shared_chars", "first_ids"])
    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: ``id_col, n_chunks, n_chars``; ``repeat_spans``,
    the comma-joined ``start:end`` (code points) of passages that a document
    with a smaller id holds, and ``repeat_chars``, their length; ``shared_spans``
    and ``shared_chars``, the same for passages that any other document holds;
    ``first_ids``, the documents that own the repeats.

    Defined results: a null text is empty and has no chunk; rows that repeat an
    id count as one document (what they share with each other only is no
    repeat) and each get a row; a null id counts as the largest id of all, and
    all rows with null ids as one document; other columns are not read; an
    empty table gives an empty result.
    """
    rows = cut_lineage(chunk_rows(docs, id_col, text_col), "chunks")
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    body = rows.where("NOT head")
    shared = (body.groupBy("hi", "lo").agg(F.min("place").alias("owner"), F.max("place").alias("last"))
              .where("owner < last").select("hi", "lo", "owner"))
    met = body.select("row_key", "place", "start", "end", "hi", "lo").join(shared, ["hi", "lo"])
    marks = met.select("row_key", F.struct("start", "end", (F.col("owner") < F.col("place")).alias("repeat"),
                                           "owner").alias("mark"))
    marks = marks.groupBy("row_key").agg(F.collect_list("mark").alias("marks"))
    spans = marks.mapInArrow(_spans(min_chars), "row_key long, repeat_spans string, shared_spans string, "
                             "repeat_chars long, shared_chars long, first_ids array<long>")
    heads = rows.where("head").select("row_key", "doc_id", F.col("start").alias("n_chunks"), F.col("end").alias("n_chars"))
    out = heads.join(spans, "row_key", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "n_chunks", "n_chars",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("repeat_spans", "shared_spans")],
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("repeat_chars", "shared_chars")],
        F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"))
