"""Alignment of two tokenizers' token streams over the same text.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file), B a piece model
(``sentencepiece``) that sets a space before the text; both are laid over the
UTF-8 bytes of space+text. Intervals are coalesced: all tokens of A and B are
lexsorted by their start, the running maximum of their ends is taken, and a new
group begins where a start reaches that maximum, so groups are cut at the byte
offsets where tokens of both end. Inside a group every A token is linked with
every B token.

Texts are tokenized once; the ids are kept as a table of small integers, from
which the groups are made anew where they are needed (array work over slices of
many texts, no loop over tokens). Pairs of ids are counted per document, summed
per task and then by a shuffle. The most frequent ``COMMON_PAIRS`` pairs, a
bounded number, are sent to the tasks; links of all other pairs, which are rare
ones by then, meet their counts in a join.

The tokenizer files must lie under the same path on every executor.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.session import cut_lineage, shared_path

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20  # of text, tokenized together
SLICE_TOKENS = 1 << 19  # aligned together
BIG_GROUP = 4096  # links; the tokens of larger groups are counted by id before they are paired
PAIRS_AT_ONCE = 1 << 21
HELD_PAIRS = 1 << 22  # different pairs that a task holds before it passes their counts on
COMMON_PAIRS = 1 << 20
_ID = np.dtype("<u2")
_FAR = re.compile("[^\x00-ɏ]")
_LONG = 10_000  # characters without a blank from which the slow encoder is taken


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the
    others, in order, as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, file_a: str, file_b: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(file_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of_char()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *[t["id"] for t in spec.get("added_tokens", [])]])
        self.bytes_a = [b""] * size
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        self.slow = Tokenizer.from_file(file_a)
        self.slow.encode_special_tokens = True
        ranks = {self.bytes_a[i]: i for t, i in vocab.items() if t not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.fast = None
        if [vocab[m] for m in merged] == list(range(256, 256 + len(merged))):  # ids are merge ranks
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value
            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=file_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.pieces.id_to_piece(list(range(self.pieces.get_piece_size()))))]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 entries need a wider id column")
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])

    def encode_a(self, text: str) -> list[int]:
        """Both encoders give the same ids; the fast one is left to characters
        whose classes no version of Unicode has changed."""
        if self.fast is None or _FAR.search(text) or (len(text) > _LONG and max(map(len, text.split())) > _LONG):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of A and B of each text as little-endian numbers; empty for an
        empty text and where the joined bytes of A or B are not space+text."""
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            if not text:
                yield b"", b""
                continue
            a, whole = self.encode_a(" " + text), b" " + text.encode()
            if b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b]):
                yield np.array(a, _ID).tobytes(), np.array(b, _ID).tobytes()
            else:
                yield b"", b""


@lru_cache(maxsize=2)
def load(folder: str, file_a: str, file_b: str) -> Tokenizers:
    return Tokenizers(f"{folder}/{file_a}", f"{folder}/{file_b}")


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in sum; a larger item is a range of its own."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item k, ``counts[k]`` times (k, 0), (k, 1) and so on."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligned:
    """The groups of a slice of texts, given as lists of id bytes."""

    def __init__(self, a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray) -> None:
        self.n = len(a)
        self.n_a = np.array([len(x) for x in a]) // _ID.itemsize
        self.n_b = np.array([len(x) for x in b]) // _ID.itemsize
        self.a = np.frombuffer(b"".join(a), _ID).astype(np.int64)
        self.b = np.frombuffer(b"".join(b), _ID).astype(np.int64)
        # A and B of a text have equally many bytes, so the texts can be laid end to end
        end = np.concatenate([np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b])])
        start = end - np.concatenate([len_a[self.a], len_b[self.b]])
        self.side = np.repeat(np.array([0, 1], np.int8), [len(self.a), len(self.b)])
        order = np.lexsort((self.side, start))
        reach = np.maximum.accumulate(end[order])
        cut = np.zeros(len(order), bool)
        cut[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(cut)
        self.group_a, self.group_b = group[:len(self.a)], group[len(self.a):]
        groups = int(group.max()) + 1 if len(group) else 0
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        doc = np.zeros(groups, np.int64)
        doc[self.group_a] = np.repeat(np.arange(self.n), self.n_a)
        self.doc = doc
        self.links = self.in_a * self.in_b

    def per_text(self, of_groups: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_groups)])
        bounds = np.searchsorted(self.doc, np.arange(self.n + 1))
        return total[bounds[1:]] - total[bounds[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Different linked pairs as ``text << 32 | a << 16 | b``, ascending, and their links."""
        big = self.links > BIG_GROUP

        def entries(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not big.any():
                return group, ids, np.ones(len(ids), np.int64)
            own = big[group]
            keys, times = np.unique(group[own] << 16 | ids[own], return_counts=True)
            g, i = np.append(group[~own], keys >> 16), np.append(ids[~own], keys & 0xFFFF)
            order = np.argsort(g, kind="stable")
            return g[order], i[order], np.append(np.ones(int((~own).sum()), np.int64), times)[order]

        (ga, a, times_a), (gb, b, times_b) = entries(self.a, self.group_a), entries(self.b, self.group_b)
        count = np.bincount(gb, minlength=len(self.links))
        first = np.cumsum(count) - count
        fan = count[ga]
        keys, links = [], []
        for x, y in _bounded(fan, PAIRS_AT_ONCE):
            item, k = _expand(fan[x:y])
            item += x
            other = first[ga[item]] + k
            pair = self.doc[ga[item]] << 32 | a[item] << 16 | b[other]
            if big.any():
                key, place = np.unique(pair, return_inverse=True)
                links.append(np.bincount(place, times_a[item] * times_b[other], len(key)).astype(np.int64))
            else:
                key, n = np.unique(pair, return_counts=True)
                links.append(n)
            keys.append(key)
        return _summed(keys, links)

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text, '' without tokens."""
        group = np.concatenate([self.group_a, self.group_b])
        order = np.lexsort((self.side, group))
        ids = np.concatenate([self.a, self.b])[order]
        side, group = self.side[order], group[order]
        kind = np.full(len(ids), 2, np.int64)  # what follows a token: , | ; or nothing
        kind[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        ends = np.cumsum(self.n_a + self.n_b)
        kind[ends[ends > 0] - 1] = 3
        written = list(map(_written().__getitem__, (kind << 16 | ids).tolist()))
        return ["".join(written[x:y]) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _bounded(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their values."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], values[0]
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, total = key[order], np.cumsum(value[order])
    last = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1) if len(key) else np.zeros(0, np.int64)
    return key[last], np.diff(total[last], prepend=0)


@lru_cache(maxsize=1)
def _written() -> list[str]:
    numbers = [str(i) for i in range(1 << 16)]
    return [n + mark for mark in (",", "|", ";", "") for n in numbers]


def encoded(docs: DataFrame, id_col: str, text_col: str, folder: str, file_a: str, file_b: str) -> DataFrame:
    """``row`` (a number of its own for each row), the id and the ids ``a`` and
    ``b``, as a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(folder, file_a, file_b)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for x, y in _runs([len(t) for t in texts], SLICE_BYTES):
                ids = list(both.encode(texts[x:y]))
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(x, y - x), batch["id"].slice(x, y - x), pa.array([a for a, _ in ids], pa.binary()),
                     pa.array([b for _, b in ids], pa.binary())], ["row", "id", "a", "b"])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row long, id {kind}, a binary, b binary")
    path = shared_path(docs.sparkSession, "tokens")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _aligned(batches: Iterator[pa.RecordBatch], both: Tokenizers) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for batch in batches:
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        for x, y in _runs([(len(p) + len(q)) // _ID.itemsize for p, q in zip(a, b, strict=True)], SLICE_TOKENS):
            yield batch.slice(x, y - x), Aligned(a[x:y], b[x:y], both.len_a, both.len_b)


def pair_counts(tokens: DataFrame, folder: str, file_a: str, file_b: str) -> DataFrame:
    """``pair`` (a << 16 | b), ``n`` (documents that hold it linked) and
    ``best`` (no pair of the same A id has more), as a stored table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["pair", "n"])

        for _, s in _aligned(batches, load(folder, file_a, file_b)):
            pair, n = np.unique(s.pairs()[0] & 0xFFFFFFFF, return_counts=True)
            keys.append(pair)
            counts.append(n)
            if sum(map(len, keys)) > 2 * len(keys[0]):
                key, value = _summed(keys, counts)
                keys, counts = [key], [value]
                if len(key) > HELD_PAIRS:
                    yield out()
                    keys, counts = [], []
        if keys:
            key, value = _summed(keys, counts)
            keys, counts = [key], [value]
            yield out()

    pairs = tokens.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = cut_lineage(pairs, "pairs")
    best = pairs.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))  # a row per entry of A
    return cut_lineage(pairs.withColumn("a", F.shiftright("pair", 16)).join(best, "a")
                       .select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def most_frequent(pairs: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """All pairs, or those above a frequency that at most ``most`` have, and whether these are all."""
    if pairs.count() <= most:
        return pairs, True
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for r in pairs.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # at most 16 * 63 rows
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["s"]
    return pairs.where(F.lit(False) if least is None else step >= least), False


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS,
          file_a: str = FILE_A, file_b: str = FILE_B, digest: bool = False,
          common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_a`` and ``n_b`` tokens,
    ``n_groups``, ``n_links`` (pairs of token occurrences in one group),
    ``n_best`` (links whose pair of ids is in as many documents as any pair of
    its A id), ``count_sum`` (documents of the pair, summed over the links) and
    ``groups``, written ``a1,a2|b1;a3|b2,b3``; with ``digest`` the lower-case
    hex SHA-256 of that.

    Defined results: a null or empty text, and one whose tokens of A or B do not
    join to space+text (a text with U+2581, or one that a tokenizer normalises),
    has no tokens: zeros and ``groups`` of '' (not hashed). Rows are documents:
    repeated rows, equal ids and null ids each count. Special tokens of either
    file are plain text. Other columns are not read; an empty table gives an
    empty result. Groups of any size are whole.
    """
    spark = docs.sparkSession
    tokens = encoded(docs, id_col, text_col, folder, file_a, file_b)
    pairs = pair_counts(tokens, folder, file_a, file_b)
    common, complete = most_frequent(pairs, common_pairs)
    table = common.toArrow()  # at most common_pairs rows of 17 bytes
    order = np.argsort(table["pair"].to_numpy())
    held = spark.sparkContext.broadcast(tuple(
        table[c].to_numpy()[order].astype(t) for c, t in (("pair", np.uint32), ("n", np.int64), ("best", bool))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = held.value
        for batch, s in _aligned(batches, load(folder, file_a, file_b)):
            keys, links = s.pairs()
            different, place = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
            at = np.searchsorted(known, different.astype(np.uint32))
            at[at == len(known)] = 0
            found = known[at] == different if len(known) else np.zeros(len(different), bool)
            count = np.where(found, n[at], 0) if len(known) else np.zeros(len(different), np.int64)
            top = found & best[at] if len(known) else found
            bounds = np.searchsorted(keys >> 32, np.arange(s.n + 1))

            def per_text(values: np.ndarray, bounds=bounds) -> pa.Array:
                total = np.concatenate([[0], np.cumsum(values)])
                return pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64))

            rest = ~found[place]
            ends = np.concatenate([[0], np.cumsum(rest)])[bounds].astype(np.int32)
            groups = s.texts()
            if digest:
                groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], pa.array(s.n_a), pa.array(s.n_b),
                 pa.array(s.per_text(np.ones(len(s.links), np.int64))), pa.array(s.per_text(s.links)),
                 per_text(links * top[place]), per_text(links * count[place]), pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[rest] & 0xFFFFFFFF)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(links[rest]))],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "pairs", "links"])

    kind = tokens.schema["id"].dataType.simpleString()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rows = tokens.mapInArrow(run, f"row long, id {kind}, {', '.join(c + ' long' for c in columns)}, groups string, "
                                  "pairs array<long>, links array<long>")
    if not complete:
        rows = cut_lineage(rows, "aligned")
        rare = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x"))
        rare = rare.select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links")).join(pairs, "pair")
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
                                       F.sum(F.col("links") * F.col("n")).alias("more_sum"))
        rows = rows.drop("pairs", "links").join(rare, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return rows.select(F.col("id").alias(id_col), *columns, "groups")
