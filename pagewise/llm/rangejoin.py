"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other, and
Euclidean distance is a metric. Pivots drawn from the data partition the
vectors: each belongs to the cell of its nearest pivot. If x of cell p and y of
cell q are within r, the triangle inequality gives

    d(x, q) <= d(x, p) + 2r    and    d(x, q) <= radius(q) + r,

so x also visits every cell q that passes both bounds, q before p in pivot
order, which finds each pair of cells from one side only. Cells join
independently: home vectors against home vectors and visitors.

Equal vectors are joined once and counted by their number. A cell is cut into
blocks of bounded size, so no task holds a whole cell, and leaves only what is
linear in its vectors: link counts, and a spanning forest of its links for the
components. Candidates are found in single precision with slack and decided in
double precision.

How much the bounds prune depends on the data: vectors in clusters visit few
cells, vectors without structure in many dimensions (all about equally far
apart) visit most of them, and the join then costs the square of the number of
distinct vectors. No exact metric partition avoids that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.components import connected_components
from pagewise.session import cut_lineage

COSINE = 0.95
CELL_VECTORS = 4096  # distinct vectors to a pivot
MAX_PIVOTS = 1024  # pivots are sent to every task
BLOCK_VECTORS = 4096  # vectors on either side of one block of a cell
SLACK = 1e-4  # of the single-precision candidate test


def unit_rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as float64, usable) of a list column whose lists have one length."""
    width = len(values[0]) if len(values) else 0
    x = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), width)
    top = np.abs(x).max(axis=1, initial=0.0)
    usable = np.isfinite(top) & (top > 0)
    x = x / np.where(usable, top, 1.0)[:, None]  # no overflow in the squares
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(usable, norm, 1.0)[:, None], usable


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of one vector length."""
    for b in batches:
        size = np.array([len(v) for v in b.column("v")]) if b.num_rows else np.zeros(0, int)
        for s in np.unique(size):
            yield b.filter(pa.array(size == s))


def _assign(pivots: dict[int, np.ndarray], reach: float, radii: dict[int, np.ndarray] | None):
    """Home cell and its distance (``radii`` None), or home and visited cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            x, _ = unit_rows(b.column("v"))
            size = x.shape[1]
            p = pivots[size]
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))
            home = gap.argmin(axis=1)
            near = gap[np.arange(len(x)), home]
            if radii is None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), size, np.int32)), pa.array(home.astype(np.int32)), pa.array(near)],
                    names=["size", "cell", "gap"])
                continue
            visit = (gap <= near[:, None] + 2 * reach + 1e-9) & (gap <= radii[size][None, :] + reach + 1e-9)
            visit &= np.arange(len(p))[None, :] < home[:, None]
            visit[np.arange(len(x)), home] = True
            row, cell = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), size, np.int32)), pa.array(cell.astype(np.int32)),
                 pa.array(home[row] == cell), b.column("rep").take(pa.array(row)),
                 b.column("n").take(pa.array(row)), b.column("v").take(pa.array(row))],
                names=["size", "cell", "home", "rep", "n", "v"])
    return run


def _find(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    root = parent[nodes]
    while True:
        up = parent[root]
        if (up == root).all():
            parent[nodes] = root
            return root
        root = up


def _join(cosine: float):
    """Links of one block: home vectors (side 0) against probes (side 1)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64),
                              "root": np.zeros(0, np.int64)})
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(a) or not len(b):
            return empty
        xa, _ = unit_rows(pa.array(a["v"].tolist()))
        xb, _ = unit_rows(pa.array(b["v"].tolist()))
        ra, rb = a["rep"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)
        na, nb = a["n"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
        guest = ~b["home"].to_numpy(bool)
        fa, fb = xa.astype(np.float32), xb.astype(np.float32)
        names, place = np.unique(np.r_[ra, rb], return_inverse=True)
        pa_, pb = place[:len(ra)], place[len(ra):]
        links, parent = np.zeros(len(names), np.int64), np.arange(len(names))
        for at in range(0, len(xa), 512):
            i, j = np.nonzero(fa[at:at + 512] @ fb.T >= cosine - SLACK)
            i += at
            other = ra[i] != rb[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            true = np.einsum("ij,ij->i", xa[i], xb[j]) >= cosine
            i, j = i[true], j[true]
            np.add.at(links, pa_[i], nb[j])
            away = guest[j]  # a pair of home vectors is met from its other side too
            np.add.at(links, pb[j[away]], na[i[away]])
            cut = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
            for s, e in zip(cut, np.r_[cut[1:], len(i)]):
                roots = np.unique(_find(parent, np.r_[pa_[i[s]], pb[j[s:e]]]))
                parent[roots] = roots[0]
        root = _find(parent, np.arange(len(names)))
        kept = (links > 0) | (root != np.arange(len(names)))
        return pd.DataFrame({"rep": names[kept], "links": links[kept], "root": names[root[kept]]})
    return run


def _numbers(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    cell_vectors: int = CELL_VECTORS, block_vectors: int = BLOCK_VECTORS, seed: int = 5) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links`` (other rows with cosine of at
    least ``cosine``), ``component_id`` (smallest id reachable over links,
    itself included), ``kept`` (id = component_id).

    Defined results: vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, not even equal ones; vectors of
    different lengths do not link; a repeated row counts as another vector; a
    null id takes part in links and is null in the result, its component_id
    being null only if its component has no other id and ``kept`` being false;
    other columns are not read; an empty table gives an empty result.
    """
    cosine = float(cosine)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable &= F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(usable, F.lit(False)))
    good = rows.where("good").select("id", F.transform("v", lambda x: x + 0.0).alias("v"))

    # equal vectors once: rep numbers them, n counts their rows
    reps = (good.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"))
            .withColumn("rep", F.monotonically_increasing_id()))
    reps = cut_lineage(reps, "vectors")
    sizes = {r["s"]: r["count"] for r in reps.groupBy(F.size("v").alias("s")).count().collect()}
    pivots: dict[int, np.ndarray] = {}
    for s, n in sizes.items():
        k = min(MAX_PIVOTS, max(1, -(-n // cell_vectors)))
        drawn = reps.where(F.size("v") == s).orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(k).collect()
        pivots[s] = unit_rows(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())))[0]

    homes = (reps.select("rep", "n", "v").mapInArrow(_assign(pivots, reach, None), "size int, cell int, gap double")
             .groupBy("size", "cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("home")).collect())
    radii = {s: np.full(len(p), -np.inf) for s, p in pivots.items()}
    for r in homes:
        radii[r["size"]][r["cell"]] = r["radius"]
    placed = reps.select("rep", "n", "v").mapInArrow(
        _assign(pivots, reach, radii), "size int, cell int, home boolean, rep long, n long, v array<double>")
    placed = cut_lineage(placed.withColumn("v", F.col("v").cast("array<double>")), "cells")
    counted = placed.groupBy("size", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / block_vectors).cast("int").alias("home_blocks"),
        F.ceil(F.count(F.lit(1)) / block_vectors).cast("int").alias("probe_blocks"))
    placed = placed.join(F.broadcast(counted), ["size", "cell"])  # at most MAX_PIVOTS rows for each length
    mix = F.xxhash64("rep")
    as_home = placed.where("home").select(
        "size", "cell", F.pmod(mix, "home_blocks").alias("i"),
        _numbers("probe_blocks").alias("j"),
        F.lit(0).alias("side"), "home", "rep", "n", "v")
    as_probe = placed.select(
        "size", "cell", _numbers("home_blocks").alias("i"),
        F.pmod(mix, "probe_blocks").alias("j"), F.lit(1).alias("side"), "home", "rep", "n", "v")
    found = as_home.unionByName(as_probe).groupBy("size", "cell", "i", "j").applyInPandas(
        _join(cosine), "rep long, links long, root long")
    found = cut_lineage(found, "links")

    roots = connected_components(found.where("rep <> root"), "rep", "root").select(F.col("node").alias("rep"), "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    summed = cut_lineage(reps.select("rep", "n", "least_id").join(links, "rep", "left").join(roots, "rep", "left")
                         .select("rep", "least_id", F.coalesce("root", "rep").alias("root"),
                                 (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector_links")
    whole = summed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = summed.join(whole, "root").select("rep", "n_links", "component_id")
    named = reps.select("rep", "v").join(named, "rep").select("v", "n_links", "component_id")
    linked = good.join(named, "v").select("id", "n_links", "component_id")
    lone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(lone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
