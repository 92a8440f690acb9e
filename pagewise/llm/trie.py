"""Prefix trie of conversations, as balanced parentheses per shard.

A node is a distinct sequence of first turns. Texts do not travel: a turn is two
64-bit hashes of role and text with the depth, and the key of a node is the
exclusive or of those on its path (two 64-bit numbers). Paths are sorted, so
that those below a node are neighbours, and dealt out by range; a task encodes
its run of paths, in pieces of bounded size, as balanced parentheses:

* ``find_close`` over blocks with their least excess delimits every subtree;
* the rank of ``()`` pairs counts the leaves of a subtree;
* differences of cumulative arrays give its members and savings.

A piece knows all about its inner nodes. Nodes on its first and last path (its
two spines) may go on in other pieces: they leave with what their inner
children amount to, and the spines of all pieces are merged as a trie of their
own, by the same code, until one piece holds them all.

Paths longer than ``BLOCK_TURNS`` are cut into blocks, each with the node that
it starts from as root. Blocks are encoded from the deepest up; what lies below
the end of a block is handed to it as a path that no conversation takes. So no
task holds more than a bounded piece of a trie, nor a conversation whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewise.llm.common import WORD_RE
from pagewise.session import cut_lineage

SHARE_GROUP = 20  # conversations that start with turns of the same one
SHARE_TURNS = 4  # 0 to SHARE_TURNS - 1 of them
BLOCK_TURNS = 512
SHARD_PLACES = 1 << 18  # places on the paths that are encoded together
LEAST_PATHS = 8  # in a piece, however long they are: a piece leaves two spines, so rounds shrink
PAREN_BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max
_STEP = "struct<x1:bigint,x2:bigint>"


# --- one shard -------------------------------------------------------------

@dataclass
class Paths:
    """Sorted paths. ``length`` counts places, the root included; the flat
    arrays have one entry a place: node key, words of the turn and what is known
    of the node besides (members, their smallest id, children, leaves, savings)."""
    length: np.ndarray
    key: np.ndarray  # places x 2
    words: np.ndarray
    n: np.ndarray
    least: np.ndarray
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray


def find_close(excess: np.ndarray, opens: np.ndarray, block: int = PAREN_BLOCK) -> np.ndarray:
    """Place of the parenthesis that closes each of ``opens``: the next place
    whose excess is one less. A block whose least excess stays above is skipped,
    and so are runs of blocks, by a tree of the blocks' least excess."""
    n = len(excess)
    blocks = -(-n // block)
    levels = [np.append(excess, np.full(blocks * block - n, n)).reshape(blocks, block).min(axis=1)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.append(low, np.full(len(low) % 2, n))
        levels.append(np.minimum(low[::2], low[1::2]))
    target, at = excess[opens] - 1, opens + 1
    out = np.full(len(opens), -1)

    def scan(todo: np.ndarray) -> np.ndarray:
        """Go on to the end of the block; what has not been found."""
        while len(todo):
            hit = excess[at[todo]] == target[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            done = at[todo] % block == 0
            if done.any():
                rest.append(todo[done])
                todo = todo[~done]
        return np.concatenate(rest) if rest else todo

    rest: list[np.ndarray] = []
    fresh = np.arange(len(opens))
    edge = at % block == 0
    rest = [fresh[edge]]
    todo = scan(fresh[~edge])
    # up the tree to the first run of blocks that holds the target, and down into it
    node, level = at[todo] // block, np.zeros(len(todo), np.int64)
    climbing = np.arange(len(todo))
    while len(climbing):
        still = []
        for k in np.unique(level[climbing]):
            c = climbing[level[climbing] == k]
            found = levels[k][node[c]] <= target[todo[c]]
            c = c[~found]
            up = node[c] % 2 == 1
            node[c] += 1
            node[c[up]] //= 2
            level[c[up]] += 1
            still.append(c)
        climbing = np.concatenate(still)
    while (level > 0).any():
        down = np.flatnonzero(level > 0)
        for k in np.unique(level[down]):
            d = down[level[down] == k]
            left = levels[k - 1][2 * node[d]] <= target[todo[d]]
            node[d] = 2 * node[d] + ~left
            level[d] -= 1
    at[todo] = node * block
    rest = []
    scan(todo)
    return out


class Shard:
    """The trie of some paths; nodes are numbered in depth-first order."""

    def __init__(self, p: Paths, whole: bool) -> None:
        m, places = len(p.length), int(p.length.sum())
        first = np.cumsum(p.length) - p.length
        path = np.repeat(np.arange(m), p.length)
        index = np.arange(places) - first[path]
        before = np.where(path > 0, first[path - 1] + index, 0)
        shared = (path > 0) & (index < p.length[path - 1])
        shared &= (p.key == p.key[before]).all(axis=1)
        new = ~shared
        self.size = int(new.sum())
        number = np.cumsum(new) - 1
        order = np.lexsort((path, index))
        source = np.maximum.accumulate(np.where(new[order], np.arange(places), 0))
        self.node = np.empty(places, np.int64)  # of each place
        self.node[order] = number[order[source]]
        at = np.flatnonzero(new)
        self.at, self.first, self.length = at, first, p.length
        self.index, self.key, self.words = index[at], p.key[at], p.words[at]
        self.parent = np.where(self.index > 0, self.node[np.maximum(at - 1, 0)], -1)

        def of_nodes(values: np.ndarray) -> np.ndarray:
            out = np.zeros(self.size, np.int64)
            np.add.at(out, self.node, values)
            return out

        n, children, leaves, saved = map(of_nodes, (p.n, p.children, p.leaves, p.saved))
        self.least = np.full(self.size, _NONE)
        np.minimum.at(self.least, self.node, p.least)
        by_depth = np.argsort(self.index, kind="stable")
        cuts = np.searchsorted(self.index[by_depth], np.arange(1, int(self.index.max(initial=0)) + 2))
        for a, b in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):
            of = by_depth[a:b]
            np.minimum.at(self.least, self.parent[of], self.least[of])

        # parentheses: before a path's new nodes open, those of its predecessor that it does not share close
        kept = np.bincount(path[shared], minlength=m)
        closing = np.cumsum(np.concatenate([[0], (p.length[:-1] - kept[1:])]))
        opens = np.arange(self.size) + closing[path[at]]
        bits = np.full(2 * self.size, -1, np.int64)
        bits[opens] = 1
        closes = find_close(np.cumsum(bits), opens)
        end = np.arange(self.size) + (closes - opens + 1) // 2  # one past the last node below

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[:-1]

        inner = self.parent >= 0
        self.children = children + np.bincount(self.parent[inner], minlength=self.size)
        self.left = self.node[:p.length[0]] if not whole else np.zeros(0, np.int64)
        self.right = self.node[places - p.length[-1]:] if not whole else np.zeros(0, np.int64)
        self.spine = np.zeros(self.size, bool)
        self.spine[self.left] = self.spine[self.right] = True
        self.n = below(n)
        gain = np.where(self.spine | ~inner & ~whole, 0, (self.n - 1) * self.words)
        pairs = np.zeros(2 * self.size + 1, np.int64)  # rank of "()" that are leaves of the whole trie
        pairs[opens + 1] = (closes == opens + 1) & (children == 0) & ~self.spine
        pairs = np.cumsum(pairs)
        self.leaves = below(leaves) + pairs[closes + 1] - pairs[opens]
        self.saved = below(saved + gain)

    def carried(self) -> dict[str, np.ndarray]:
        """What the nodes of the spines amount to without their children on the spines."""
        own = {k: getattr(self, k).copy() for k in ("n", "children", "leaves", "saved")}
        below = np.flatnonzero(self.spine & (self.parent >= 0))
        for k in ("n", "leaves", "saved"):
            np.subtract.at(own[k], self.parent[below], getattr(self, k)[below])
        np.subtract.at(own["children"], self.parent[below], 1)
        return own


# --- rows ------------------------------------------------------------------

_NODE = [("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()),
         ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
         ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_SPINE_VALUES = ("n", "least", "children", "leaves", "saved")
_STEPS = pa.list_(pa.struct([("x1", pa.int64()), ("x2", pa.int64())]))
_SPINE = [("r1", pa.int64()), ("r2", pa.int64()), ("path", _STEPS), ("words", pa.list_(pa.int32())),
          *[(f"s_{c}", pa.list_(pa.int64())) for c in _SPINE_VALUES]]
_PIECE = [("first_id", pa.int64()), ("piece", pa.string())]
_SCHEMA = pa.schema([("kind", pa.string()), *_NODE, *_SPINE, *_PIECE])
_DDL = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string' if f.type == pa.string() else ''}"
                 for f in _SCHEMA if f.type in (pa.int64(), pa.string()))
_DDL = (_DDL.replace("r1 bigint, r2 bigint, ", f"r1 bigint, r2 bigint, path array<{_STEP}>, words array<int>, "
        + "".join(f"s_{c} array<bigint>, " for c in _SPINE_VALUES)))


def _batch(kind: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n) if f.name == "kind" else columns[f.name].cast(f.type) if f.name in columns
         else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _prefix_keys(r: np.ndarray, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys of all places: the root's, then the exclusive or of the steps so far."""
    places = np.cumsum(length) - length
    flat = np.zeros((int(length.sum()), 2), np.int64)
    inner = np.ones(len(flat), bool)
    inner[places] = False
    flat[inner] = x
    total = np.bitwise_xor.accumulate(flat, axis=0)
    start = np.where((places > 0)[:, None], total[places - 1], 0)
    return total ^ np.repeat(start ^ r, length, axis=0)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _paths(t: pa.Table) -> Paths:
    """From rows with scalar values (of the end of the path) or spines with one value a place."""
    t = t.combine_chunks()
    col = {c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type) for c in t.column_names}
    steps, flat = _lists(col["path"])
    length = steps + 1
    x = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).reshape(-1, 2)
    r = np.stack([col["r1"].to_numpy(), col["r2"].to_numpy()], axis=1)
    key = _prefix_keys(r, x, length)
    places = len(key)
    last = np.cumsum(length) - 1
    inner = np.ones(places, bool)
    inner[last - steps] = False
    words = np.zeros(places, np.int64)
    words[inner] = _lists(col["words"])[1].to_numpy()
    own = {}
    for c in _SPINE_VALUES:
        if f"s_{c}" in col:
            own[c] = _lists(col[f"s_{c}"])[1].to_numpy()
        else:
            own[c] = np.full(places, _NONE if c == "least" else 0)
            own[c][last] = col[c].to_numpy()
    return Paths(length, key, words, *[own[c] for c in _SPINE_VALUES])


def _emit(t: pa.Table, base: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Nodes that are finished, the spines of the others and the ids that end on them."""
    p = _paths(t)
    s = Shard(p, whole)
    ends: dict[int, list[int]] = {}
    if "ends" in t.column_names:
        last = s.node[s.first + s.length - 1]
        here = np.flatnonzero(t["ends"].to_numpy(zero_copy_only=False).astype(bool))
        ids = t["conv_id"].to_numpy()
        for v, i in zip(last[here].tolist(), ids[here].tolist(), strict=True):
            ends.setdefault(v, []).append(i)
    written = {v: ",".join(map(str, sorted(i))) for v, i in ends.items()}
    done = np.flatnonzero(~s.spine & ((s.index > 0) | (base == 0)))
    above = s.parent[done]
    # the parent's smallest member is known unless it is on a spine or the root of a block
    known = (above >= 0) & ~s.spine[above] & ((s.index[above] > 0) | (base == 0))
    if len(done):
        sha = [hashlib.sha256(written[v].encode()).hexdigest() if v in written else NO_ENDS for v in done.tolist()]
        up = s.key[above]
        yield _batch("node", {
            "k1": pa.array(s.key[done, 0]), "k2": pa.array(s.key[done, 1]), "p1": pa.array(up[:, 0], mask=above < 0),
            "p2": pa.array(up[:, 1], mask=above < 0), "depth": pa.array(s.index[done] + base),
            "conv_id": pa.array(s.least[done]), "parent_conv_id": pa.array(s.least[above], mask=~known),
            "n_convs": pa.array(s.n[done]), "n_children": pa.array(s.children[done]),
            "n_leaves": pa.array(s.leaves[done]), "saved_tokens": pa.array(s.saved[done]),
            "ends_sha256": pa.array(sha, pa.string()) if "ends" in t.column_names else pa.nulls(len(done), pa.string())})
    roots = np.flatnonzero(~s.spine & (s.index == 0)) if base else np.zeros(0, np.int64)
    if len(roots):
        yield _batch("root", {
            "k1": pa.array(s.key[roots, 0]), "k2": pa.array(s.key[roots, 1]), "conv_id": pa.array(s.least[roots]),
            "n_children": pa.array(s.children[roots]), "n_leaves": pa.array(s.leaves[roots]),
            "saved_tokens": pa.array(s.saved[roots])})
    if whole:
        return
    own = s.carried()
    own["least"] = s.least
    paths = [0] if len(s.length) == 1 else [0, len(s.length) - 1]
    seen = np.zeros(s.size, bool)
    rows: dict[str, list] = {c: [] for c, _ in _SPINE}
    for j in paths:
        on = s.node[s.first[j]:s.first[j] + s.length[j]]
        fresh = ~seen[on]
        seen[on] = True
        for c in _SPINE_VALUES:
            rows[f"s_{c}"].append(np.where(fresh, own[c][on], _NONE if c == "least" else 0))
        rows["words"].append(s.words[on[1:]].astype(np.int32))
    picked = t.select(["r1", "r2", "path"]).take(paths).combine_chunks()
    yield _batch("spine", {c: picked[c].chunk(0) if c in picked.column_names else pa.array(rows[c], kind)
                           for c, kind in _SPINE})
    open_ends = [v for v in written if s.spine[v]]
    if open_ends:
        yield _batch("piece", {
            "k1": pa.array(s.key[open_ends, 0]), "k2": pa.array(s.key[open_ends, 1]),
            "first_id": pa.array([min(ends[v]) for v in open_ends], pa.int64()),
            "piece": pa.array([written[v] for v in open_ends], pa.string())})


def _encode(rows: DataFrame, base: int, whole: bool, shard_places: int) -> DataFrame:
    """Sorted rows -> ``_SCHEMA``; ``whole``: all rows are in one partition and of one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places, paths = [], 0, 0
        for b in batches:
            total = np.cumsum(np.diff(b["path"].offsets.to_numpy()) + 1)
            a = 0
            while a < len(b):
                room = shard_places - places if not whole else int(total[-1]) + 1
                z = int(np.searchsorted(total, (total[a - 1] if a else 0) + room, "right"))
                z = min(len(b), max(z, a + LEAST_PATHS - paths))
                if z > a:
                    held.append(b.slice(a, z - a))
                    places += int(total[z - 1] - (total[a - 1] if a else 0))
                    paths += z - a
                    a = z
                if a < len(b):
                    yield from _emit(pa.Table.from_batches(held), base, whole)
                    held, places, paths = [], 0, 0
        if held:
            yield from _emit(pa.Table.from_batches(held), base, whole)
    return rows.mapInArrow(run, _DDL)


def _layer(paths: DataFrame, base: int, shard_places: int) -> list[DataFrame]:
    """Stored tables of the rounds that finish all nodes of one layer of blocks."""
    order = ["r1", "r2", "path"]
    rows = paths.repartitionByRange(*order, "ends", "conv_id").sortWithinPartitions(*order, "ends", "conv_id")
    out = []
    while True:
        table = cut_lineage(_encode(rows, base, False, shard_places), "trie", partition_by=("kind",))
        out.append(table)
        spines = table.where("kind = 'spine'").select(*[c for c, _ in _SPINE])
        paths, places = spines.agg(F.count("path"), F.sum(F.size("path") + 1)).first()
        parts = min((places or 0) // shard_places, paths // (2 * LEAST_PATHS))
        if parts <= 1:
            rows = spines.repartition(1).sortWithinPartitions(*order)
            out.append(cut_lineage(_encode(rows, base, True, shard_places), "trie", partition_by=("kind",)))
            return out
        rows = spines.repartitionByRange(parts, *order).sortWithinPartitions(*order)


# --- conversations ---------------------------------------------------------

def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos`` (from 1, by turn), two hashes and the words of each turn,
    and ``conv_id, length``. A conversation may span many partitions of the
    sort: places are counted per partition, then moved by what lies before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.regexp_count(text, F.lit(WORD_RE)).alias("words"), F.monotonically_increasing_id().alias("tie"))
    order: list[Column] = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("h1"), F.col("h2"), F.col("tie")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, place = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b["conv_id"].to_numpy()
            start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            pos = np.arange(len(ids)) + 1
            pos -= np.repeat(start, np.diff(np.append(start, len(ids))))
            if len(ids):
                if ids[0] == held:
                    pos[:start[1] if len(start) > 1 else len(ids)] += place
                held, place = ids[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array(np.full(len(ids), part, np.int32)), pa.array(pos),
                                              b["h1"], b["h2"], b["words"]],
                                             ["conv_id", "part", "pos", "h1", "h2", "words"])

    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.mapInArrow(count, "conv_id long, part int, pos long, h1 long, h2 long, words int"), "turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.max("pos").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part")
    sizes = sizes.select("conv_id", "part", F.sum("n").over(w).alias("upto"), "n")
    lengths = sizes.groupBy("conv_id").agg(F.max("upto").alias("length"))
    # a partition begins in at most one conversation that an earlier one holds, so these are no more rows than partitions
    moved = sizes.where("upto > n").select("conv_id", "part", (F.col("upto") - F.col("n")).alias("moved"))
    rows = rows.join(F.broadcast(moved), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("pos") + F.coalesce("moved", F.lit(0))).alias("pos"), "h1", "h2", "words"), lengths


def rebuilt(turns: DataFrame, lengths: DataFrame, group: int = SHARE_GROUP,
            share: int = SHARE_TURNS) -> tuple[DataFrame, DataFrame]:
    """Conversation c becomes the first h turns of conversation ``c - c % group``
    and its own turns after its first h, h being the unsigned crc32 of its number
    modulo ``share``: ``conv_id, depth, h1, h2, words`` and ``conv_id, total``."""
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < share)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head"))  # at most share - 1 turns
    heads = heads.select(F.col("conv_id").alias("base"), "head")
    about = lengths.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % share)
    about = about.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    none = F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,words:int>>")
    about = about.withColumn("head", F.slice(F.coalesce("head", none), 1, F.col("h").cast("int")))
    about = about.select("conv_id", "h", "head", F.size("head").alias("kept"),
                         (F.size("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("total"))
    own = turns.join(about.select("conv_id", "h", "kept"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept")).alias("depth"), "h1", "h2", "words")
    first = about.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), F.col("t.words").alias("words"))
    return own.unionByName(first), about.select("conv_id", "total")


def blocks(turns: DataFrame, totals: DataFrame, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, int]:
    """A stored table of ``block, conv_id, r1, r2`` (key of the node that the
    block starts from), ``path``, ``words`` and ``ends`` (the conversation does),
    and the number of layers."""
    steps = turns.select("conv_id", "depth", F.expr(f"(depth - 1) div {block_turns}").alias("block"), "words",
                         F.xxhash64(F.lit(3), "depth", "h1", "h2").alias("x1"),
                         F.xxhash64(F.lit(4), "h2", "depth", "h1").alias("x2"))
    cut = steps.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("depth", "x1", "x2", "words"))).alias("steps"),  # at most block_turns
        F.bit_xor("x1").alias("f1"), F.bit_xor("x2").alias("f2"))
    empty = totals.where("total = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"),
        F.array().cast("array<struct<depth:bigint,x1:bigint,x2:bigint,words:int>>").alias("steps"),
        F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"))
    longest = totals.agg(F.max("total")).first()[0] or 0
    layers = max(1, -(-longest // block_turns))
    cut = cut.unionByName(empty)
    if layers > 1:
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        after = F.lead("block").over(Window.partitionBy("conv_id").orderBy("block"))
        cut = cut.withColumns({"r1": F.coalesce(F.bit_xor("f1").over(before), F.lit(0)),
                               "r2": F.coalesce(F.bit_xor("f2").over(before), F.lit(0)), "ends": after.isNull()})
    else:
        cut = cut.withColumns({"r1": F.lit(0).cast("long"), "r2": F.lit(0).cast("long"), "ends": F.lit(True)})
    path = F.transform("steps", lambda s: F.struct(s["x1"].alias("x1"), s["x2"].alias("x2")))
    cut = cut.select("conv_id", "r1", "r2", path.alias("path"), F.transform("steps", lambda s: s["words"]).alias("words"),
                     "ends", "block")
    return cut_lineage(cut, "blocks", partition_by=("block",)), layers


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the pieces of each node, in order: the hash reads them one by
    one, so a node where very many conversations end is a stream of few long rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for k1, k2, piece in zip(*[b[c].to_pylist() for c in ("k1", "k2", "piece")], strict=True):
                if (k1, k2) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256()
                state.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), ["e1", "e2", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_pydict({"e1": [node[0]], "e2": [node[1]], "sha": [state.hexdigest()]})
    rows = pieces.select("k1", "k2", "first_id", "piece").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_id")
    return rows.mapInArrow(run, "e1 long, e2 long, sha string")


def prefix_trie(paths: DataFrame, layers: int, block_turns: int = BLOCK_TURNS,
                shard_places: int = SHARD_PLACES) -> DataFrame:
    """The nodes of the table that ``blocks`` returns."""
    deeper, first, later, pieces = None, [], [], []
    for k in reversed(range(layers)):
        rows = paths.where(F.col("block") == k)
        value = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
        here = rows.select("r1", "r2", "path", "words", "conv_id", "ends", F.lit(1).cast("long").alias("n"),
                           F.col("conv_id").alias("least"), *value)
        if deeper is not None:  # one path that no conversation takes to each node with turns in the next block
            under = deeper.select("conv_id", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"),
                                  F.col("saved_tokens").alias("saved"))
            via = rows.join(under, "conv_id").select(
                "r1", "r2", "path", "words", "conv_id", F.lit(False).alias("ends"), F.lit(0).cast("long").alias("n"),
                F.lit(int(_NONE)).cast("long").alias("least"), "children", "leaves", "saved")
            here = here.unionByName(via)
        tables = _layer(here, k * block_turns, shard_places)
        deeper = None
        for t in tables:
            roots = t.where("kind = 'root'")
            deeper = roots if deeper is None else deeper.unionByName(roots)
        first.append(tables[0].where("kind = 'node'"))
        later += [t.where("kind = 'node'") for t in tables[1:]]
        pieces.append(tables[0].where("kind = 'piece'"))

    def all_of(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    columns = [c for c, _ in _NODE]
    merged = all_of(later).join(_digests(all_of(pieces)), (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    merged = merged.withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).select(*columns)
    merged = cut_lineage(merged, "merged")
    nodes = all_of(first).select(*columns)
    # parents outside of a piece: nodes that were on a spine, and those that blocks start from
    joints = merged.unionByName(nodes.where(F.col("depth") % block_turns == 0)) if layers > 1 else merged
    joints = joints.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("conv_id").alias("joint"))
    nodes = nodes.unionByName(merged)
    closed = nodes.where("parent_conv_id IS NOT NULL OR depth = 0")
    loose = nodes.where("parent_conv_id IS NULL AND depth > 0")
    loose = loose.join(joints, (F.col("p1") == F.col("j1")) & (F.col("p2") == F.col("j2")))
    loose = loose.withColumn("parent_conv_id", F.col("joint")).select(*columns)
    return closed.unionByName(loose)


def savings(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", group: int = SHARE_GROUP, share: int = SHARE_TURNS,
            block_turns: int = BLOCK_TURNS, shard_places: int = SHARD_PLACES) -> DataFrame:
    """The trie of the rebuilt conversations, one row a node: its key (``k1``,
    ``k2``), that of its parent (``p1``, ``p2``), ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (words that need no second computing when members share the
    node's last turn, summed over its subtree) and ``ends_sha256``. ``share=1``
    gives the trie of the conversations as they are.

    Defined results: turns go by ``turn``, null first; rows of one conversation
    and turn number in the order of their hashes, repeated rows each; null role
    or text is empty; rows with a null conversation number belong to none and
    are left out; a conversation whose rebuilt form has no turn is a member of
    the root; other columns are not read; an empty table gives an empty result.
    """
    turns, lengths = numbered(conversations, conv_col, turn_col, role_col, text_col)
    table, layers = blocks(*rebuilt(turns, lengths, group, share), block_turns)
    return prefix_trie(table, layers, block_turns, shard_places)
