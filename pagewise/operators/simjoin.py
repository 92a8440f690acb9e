"""Cosine similarity join over term-frequency vectors.

``similarity_classes`` links all texts whose cosine is at least a threshold t.
Texts with the same term frequencies are folded into one class row first, so a
group of copies is one vector and never pairs. For the others:

1. Blocks. The vectors are packed into blocks of at most about ``GROUP_ROWS``
   vectors and ``GROUP_TERMS`` terms, one row each, and written once. Every pair of
   blocks is a cell of its own, so each pair of vectors meets in exactly one cell,
   whatever terms it shares. The cells are a Cartesian product of the block table
   with itself: its tasks read the blocks where they lie, and no vector is
   shuffled, or kept on disk, once for each cell. A cell holds two blocks, however
   large the table is.
2. Bounds. Some frequent terms have a dimension each, the others share dimensions,
   in which the length of their part counts. By the Cauchy-Schwarz inequality no
   product of two such short vectors is below the cosine, so a pair whose product
   is below t is no link. A cell takes these products as matrix products, of few
   dimensions first (``COARSE``), of more for the rows and columns that have pairs
   left, of ``OWN_TERMS`` and ``SHARED`` ones last. The product over the own terms
   alone is never above the cosine, so a pair that reaches t by it is a link.
3. Exact check. The integer dot product of every pair that is left decides.

All pairs are compared, so the arithmetic is quadratic in the classes; no row is
made for a pair that is no link, and ``similarity_join`` makes none for links
either: a cell returns the sum of each vector's links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.session import cut_lineage

THRESHOLD = 0.95
COARSE = ((128, 32), (512, 128))
OWN_TERMS = 2_048
SHARED = 2_048
GROUP_ROWS = 4_000
GROUP_TERMS = 4_000_000
STRIP = 1_000  # vectors of one side whose products are held at once
CHECKED_TERMS = 1_000_000  # terms of candidates that are looked up at once
ROUNDING = 2.0 ** -23  # of each dimension in the products of non-negative single-precision vectors of length 1
BATCH_BYTES = 4 << 20  # of rows that go to Python at once; a row has two blocks


class Vectors:
    """The vectors of a block: ``codes[at[i]:at[i + 1]]`` are the terms of vector i, by
    number in ``words``, with their counts ``tfs``."""

    def __init__(self, block: bytes):
        row = pa.ipc.open_stream(block).read_next_batch()
        self.ids, self.n, size, self.codes, self.tfs, self.dim, self.sums = (row.column(k).flatten().to_numpy() for k in range(7))
        self.words = row.column(7).flatten()
        self.at = np.r_[0, np.cumsum(size)].astype(np.int64)
        self.sum_sq = np.add.reduceat(self.tfs * self.tfs, self.at[:-1]) if len(self.ids) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.ids), dtype=np.int32), size)
        self.share = (self.tfs / np.sqrt(self.sum_sq).take(self.row)).astype(np.float32)
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def short(self, rows: np.ndarray, own: int, shared: int) -> np.ndarray:
        """Of these vectors (by rising number): a column for each of the first ``own`` named
        terms, and the lengths of the parts of all others that share each of ``shared`` columns."""
        every = len(rows) == len(self.ids)
        if every and (own, shared) in self.made:
            return self.made[own, shared]
        if every:
            row, codes, share = self.row, self.codes, self.share
        else:
            to = np.full(len(self.ids), -1, np.int32)
            to[rows] = np.arange(len(rows))
            row = to.take(self.row)
            some = row >= 0
            row, codes, share = row[some], self.codes[some], self.share[some]
        place = np.where(self.dim < own, self.dim, -1).take(codes)
        out = np.zeros((len(rows), own + shared), np.float32)
        named = place >= 0
        out[row[named], place[named]] = share[named]
        others = ~named
        cell = row[others] * np.int64(shared) + (self.sums % shared).take(codes[others])
        square = np.bincount(cell, share[others] ** 2, len(rows) * shared).astype(np.float32)
        out[:, own:] = np.sqrt(square, square).reshape(len(rows), shared)
        if every and own + shared <= 1_000:
            self.made[own, shared] = out
        return out


def near_pairs(x: Vectors, y: Vectors, threshold: float, levels: tuple[tuple[int, int], ...]
               ) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs ``(i, j)`` of vector i of ``x`` and j of ``y``, by rising i, with True if they
    are links for sure; of one block with itself, each pair once. All others are no links."""
    rows, columns = np.arange(len(x.ids)), np.arange(len(y.ids))
    near = np.triu(np.ones((len(rows), len(columns)), bool), 1) if x is y else np.ones((len(rows), len(columns)), bool)
    for own, shared in levels:
        some, others = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(some):
            return
        rows, columns, near = rows[some], columns[others], near[np.ix_(some, others)]
        a, b = x.short(rows, own, shared), y.short(columns, own, shared)
        error = ROUNDING * (own + shared + 16)
        for at in range(0, len(rows), STRIP):
            part = slice(at, at + STRIP)
            if (own, shared) != levels[-1]:
                near[part] &= a[part] @ b.T >= threshold - error
                continue
            least = a[part, :own] @ b[:, :own].T
            most = a[part, own:] @ b[:, own:].T
            most += least
            near[part] &= most >= threshold - error
            sure = near[part] & (least >= threshold + error)
            for pairs, known in ((sure, True), (near[part] & ~sure, False)):
                i, j = np.nonzero(pairs)
                if len(i):
                    yield rows[part][i], columns[j], known


class Checker:
    """Exact dot products of vectors of two blocks."""

    def __init__(self, x: Vectors, y: Vectors):
        self.x, self.y = x, y
        # terms of y by their number in x; what x lacks comes last, where no count is
        self.codes = y.codes if x is y else (
            pc.index_in(y.words, value_set=x.words).fill_null(len(x.words)).to_numpy().astype(np.int32).take(y.codes))
        self.size, self.dense = np.diff(y.at), np.zeros(len(x.words) + 1, np.int64)

    def links(self, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(i, j, dot)`` of the pairs (by rising i) that are links."""
        x, y = self.x, self.y
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for one, js in zip(i[starts].tolist(), np.split(j, starts[1:])):
            own = slice(x.at[one], x.at[one + 1])
            self.dense[x.codes[own]] = x.tfs[own]
            cuts = np.flatnonzero(np.diff(np.cumsum(self.size[js]) // CHECKED_TERMS, prepend=0))
            for part in np.split(js, cuts):
                if not len(part):
                    continue
                spans = [slice(*s) for s in zip(y.at[part].tolist(), y.at[part + 1].tolist())]
                counts = self.dense.take(np.concatenate([self.codes[s] for s in spans]))
                counts *= np.concatenate([y.tfs[s] for s in spans])
                dot = np.add.reduceat(counts, np.cumsum(self.size[part]) - self.size[part])
                # the smaller id comes first, as in the pair
                a, b = np.sqrt(float(x.sum_sq[one])), np.sqrt(y.sum_sq[part].astype(float))
                linked = dot >= np.where(y.ids[part] < x.ids[one], threshold * b * a, threshold * a * b)
                if linked.any():
                    yield np.full(linked.sum(), one), part[linked], dot[linked]
            self.dense[x.codes[own]] = 0


def _pieces(rows: pa.Table, most: tuple[int, int]) -> Iterator[pa.Table]:
    """``rows`` (with the lists ``terms``) cut into parts of at most about so many rows and terms."""
    ends = np.cumsum(pc.list_value_length(rows.column("terms")).to_numpy())
    at = 0
    while at < len(ends):
        until = min(at + most[0], max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most[1], side="right"))))
        yield rows.slice(at, until - at)
        at = until


def _grouped(tables: Iterator[pa.Table], most: tuple[int, int]) -> Iterator[pa.Table]:
    """The same rows in tables of at most about so many rows and terms."""
    held, rows, terms = [], 0, 0
    for table in tables:
        for piece in _pieces(table, most):
            n = pc.sum(pc.list_value_length(piece.column("terms"))).as_py() or 0
            if held and (rows + len(piece) > most[0] or terms + n > most[1]):
                yield pa.concat_tables(held)
                held, rows, terms = [], 0, 0
            held, rows, terms = [*held, piece], rows + len(piece), terms + n
    if held:
        yield pa.concat_tables(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The sizes of the lists and their values in one array."""
    values = [c.flatten() for c in column.chunks]
    return (pc.list_value_length(column).to_numpy().astype(np.int32),
            pa.concat_arrays(values) if values else pa.array([], column.type.value_type))


def _stream(columns: dict[str, pa.Array]) -> bytes:
    """One compressed Arrow row that has each of ``columns`` as a list."""
    row = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for c in columns.values()],
                                     names=list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(row)
    return out.getvalue().to_pybytes()


def _packed(tf: DataFrame, threshold: float, id_col: str) -> DataFrame:
    """The vectors of ``tf`` in order of its partitions, written once: ``(block, ids,
    prints, sizes, frequent, data)``; equal prints are equal term frequencies, ``frequent``
    has the terms in most of the block's vectors."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    tf.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # the list is bounded by the different words of one text
    listed = tf.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf")))).alias("v"))
    vectors = listed.select(F.col(id_col).alias("id"), F.sha2(F.to_json("v").cast("binary"), 256).alias("print"),
                            F.col("v.term").alias("terms"), F.col("v.tf").alias("tfs"))
    most, named = (GROUP_ROWS, GROUP_TERMS), 2 * OWN_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for rows in _grouped((pa.Table.from_batches([b]) for b in batches), most):
            sizes, terms = _lists(rows.column("terms"))
            terms = terms.cast(pa.large_string()).dictionary_encode()
            words, codes = terms.dictionary, terms.indices
            data = _stream({"size": pa.array(sizes), "codes": codes, "tfs": _lists(rows.column("tfs"))[1], "words": words})
            df = np.bincount(codes.to_numpy(), minlength=len(words))
            top = np.argsort(-df, kind="stable")[:named]
            frequent = pa.StructArray.from_arrays([words.take(pa.array(top)).cast(pa.string()), pa.array(df[top])], names=["term", "df"])
            row = [pa.array([key]), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (
                rows.column("id").combine_chunks(), rows.column("print").combine_chunks(), pa.array(sizes), frequent))]
            yield pa.RecordBatch.from_arrays([*row, pa.array([data], pa.binary())],
                                             names=["block", "ids", "prints", "sizes", "frequent", "data"])
            key += 1
    kind = vectors.schema["id"].dataType.simpleString()
    return cut_lineage(vectors.mapInArrow(run, f"block long, ids array<{kind}>, prints array<string>, sizes array<int>, "
                                               "frequent array<struct<term:string,df:long>>, data binary"), "packed")


def _members(packed: DataFrame) -> DataFrame:
    """``(block, pos, size, id, class_id, class_size)`` of each vector; ``class_id`` is the
    smallest id with the same term frequencies."""
    rows = (packed.select("block", F.posexplode(F.arrays_zip("ids", "prints", "sizes")))
            .select("block", "pos", F.col("col.ids").alias("id"), F.col("col.prints").alias("print"), F.col("col.sizes").alias("size")))
    least = rows.groupBy("print").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return cut_lineage(rows.join(least, "print").select("block", "pos", "size", "id", "class_id", "class_size"), "classes")


def _blocks(packed: DataFrame, kept: DataFrame) -> DataFrame:
    """``(block, data)``: the vectors at ``(block, pos)`` in ``kept`` with their ``n``, in full blocks."""
    top = (packed.select(F.explode("frequent").alias("w")).groupBy("w.term").agg(F.sum("w.df").alias("df"))
           .orderBy(F.desc("df"), "term").limit(OWN_TERMS).collect())  # which terms have their own dimension changes no result
    own = [r["term"] for r in top]
    total = kept.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("terms")).first()
    groups = max(-(-total["rows"] // GROUP_ROWS), -(-(total["terms"] or 0) // GROUP_TERMS), 1)
    listed = kept.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("kept"))
    met = packed.select("block", "ids", "data").join(listed.select("block", "kept.pos", "kept.n"), "block")
    most = (GROUP_ROWS, GROUP_TERMS)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            for k in range(b.num_rows):
                ids, pos, n = (b.column(c)[k].values for c in ("ids", "pos", "n"))
                row = pa.ipc.open_stream(b.column("data")[k].as_buffer()).read_next_batch()
                size, codes, tfs, words = (row.column(c).flatten() for c in range(4))
                at = pa.array(np.r_[0, np.cumsum(size.to_numpy())].astype(np.int64))
                terms = pa.LargeListArray.from_arrays(at, words.take(codes))
                yield pa.table([c.take(pos) for c in (ids, terms, pa.LargeListArray.from_arrays(at, tfs))],
                               names=["id", "terms", "tfs"]).append_column("n", n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        named = pa.array(own, pa.large_string())
        for rows in _grouped(unpacked(batches), most):
            sizes, terms = _lists(rows.column("terms"))
            terms = terms.dictionary_encode()
            words, codes = terms.dictionary, terms.indices
            dim = pc.index_in(words, value_set=named).fill_null(-1)
            sums = pa.array([zlib.crc32(w) for w in words.view(pa.large_binary()).to_pylist()], pa.int64())
            data = _stream({"id": rows.column("id").combine_chunks(), "n": rows.column("n").combine_chunks(), "size": pa.array(sizes),
                            "codes": codes, "tfs": _lists(rows.column("tfs"))[1], "dim": dim, "sum": sums, "words": words})
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([data], pa.binary())], names=["block", "data"])
            key += 1
    tasks = max(packed.sparkSession.sparkContext.defaultParallelism, groups // 4)
    return cut_lineage(met.coalesce(tasks).mapInArrow(run, "block long, data binary"), "blocks")


def _cells(blocks: DataFrame) -> DataFrame:
    """``(a, x, b, y)``: every two blocks once and each block with itself, about as many in each task."""
    left = blocks.select(F.col("block").alias("a"), F.col("data").alias("x")).hint("shuffle_replicate_nl")
    right = blocks.select(F.col("block").alias("b"), F.col("data").alias("y"))
    side = F.xxhash64(F.least("a", "b"), F.greatest("a", "b")) % 2 == 0
    return left.join(right, (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == side) & (F.col("a") != F.col("b")))


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Vectors, Vectors]]:
    held, x = None, None
    for batch in batches:
        for a, left, b, right in zip(*batch.columns):
            if a.as_py() != held:
                held, x = a.as_py(), Vectors(left.as_buffer())
            yield x, x if b.as_py() == held else Vectors(right.as_buffer())


def _levels() -> tuple[tuple[int, int], ...]:
    return (*COARSE, (OWN_TERMS, SHARED))


def _links(blocks: DataFrame, threshold: float) -> DataFrame:
    levels = _levels()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _sides(batches):
            checker = Checker(x, y)
            for some, others, _ in near_pairs(x, y, threshold, levels):
                for i, j, dot in checker.links(some, others, threshold):
                    turned = y.ids[j] < x.ids[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in (np.where(turned, y.ids[j], x.ids[i]), np.where(turned, x.ids[i], y.ids[j]), dot,
                                               np.where(turned, y.sum_sq[j], x.sum_sq[i]), np.where(turned, x.sum_sq[i], y.sum_sq[j]))],
                        names=["a", "b", "dot", "sum_sq_a", "sum_sq_b"])
    return _cells(blocks).mapInArrow(run, "a long, b long, dot long, sum_sq_a long, sum_sq_b long")


def _linked_sizes(blocks: DataFrame, threshold: float) -> DataFrame:
    """``(id, beside)``: the sum of ``n`` over the vectors linked with a vector, for those that have one."""
    levels = _levels()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _sides(batches):
            checker, sums = None, [np.zeros(len(v.ids), np.int64) for v in (x, y)]
            for i, j, sure in near_pairs(x, y, threshold, levels):
                if not sure:
                    checker = checker or Checker(x, y)
                    found = list(checker.links(i, j, threshold))
                    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                np.add.at(sums[0], i, y.n[j])
                np.add.at(sums[1], j, x.n[i])
            ids, beside = np.concatenate([x.ids, y.ids]), np.concatenate(sums)
            x = y = checker = None  # two blocks are held at once, not three
            yield pa.RecordBatch.from_arrays([pa.array(ids[beside > 0]), pa.array(beside[beside > 0])], names=["id", "beside"])
    return (_cells(blocks).mapInArrow(run, "id long, beside long")
            .groupBy("id").agg(F.sum("beside").alias("beside")))


def _representatives(members: DataFrame) -> DataFrame:
    return members.where(F.col("id") == F.col("class_id")).select("block", "pos", "size", F.col("class_size").alias("n"))


def links(tf: DataFrame, threshold: float = THRESHOLD, id_col: str = "text_id") -> DataFrame:
    """``(a, b, dot, sum_sq_a, sum_sq_b)``, a < b, for all pairs of different
    vectors with ``dot / (|a| |b|) >= threshold``. ``tf`` has one row for each
    (id, term) with its count ``tf``; it is read once."""
    packed = _packed(tf, threshold, id_col)
    every = packed.select("block", F.posexplode(F.arrays_zip("ids", "sizes"))).select(
        "block", "pos", F.col("col.ids").alias("id"), F.col("col.sizes").alias("size"), F.lit(1).cast("long").alias("n"))
    return _links(_blocks(packed, every.where(F.col("id").isNotNull())), threshold)


def similarity_classes(tf: DataFrame, threshold: float = THRESHOLD, id_col: str = "text_id") -> tuple[DataFrame, DataFrame]:
    """Membership ``(id_col, class_id)`` of every text that has a word, and the
    links ``(a, b, dot, sum_sq_a, sum_sq_b)`` between class representatives: two
    texts have a cosine of at least ``threshold`` if and only if they are of one
    class or their classes are linked."""
    packed = _packed(tf, threshold, id_col)
    members = _members(packed)
    return (members.select(F.col("id").alias(id_col), "class_id"),
            _links(_blocks(packed, _representatives(members)), threshold))


def similarity_join(tf: DataFrame, threshold: float = THRESHOLD, id_col: str = "text_id") -> DataFrame:
    """One row for each text that has a word: ``class_id``, ``class_size`` and
    ``n_links`` (other texts with a cosine of at least ``threshold``: those of
    its class and of the classes that are linked with it)."""
    packed = _packed(tf, threshold, id_col)
    members = _members(packed)
    beside = cut_lineage(_linked_sizes(_blocks(packed, _representatives(members)), threshold), "linked_sizes")
    found = members.where(F.col("class_id").isNotNull()).join(beside.withColumnRenamed("id", "class_id"), "class_id", "left")
    return found.select(F.col("id").alias(id_col), "class_id", "class_size",
                        (F.col("class_size") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
