"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are put in a seeded random order and cut into blocks of
``block_rows``. A source with ``a`` of the ``W`` weight units of all sources
must have its j-th block (from 0) in the window from release ``floor(j*W/a)``
to deadline ``ceil((j+1)*W/a)``; one slot takes one block, and in every slot
the released block of earliest deadline goes first. For weights that sum to
one this keeps every window, so after any number of slots a source is less
than one block away from its weight.

The schedule repeats after W slots, so the earliest-deadline-first simulation
runs once over W slots on the driver (W is bounded by the number of sources
times ``MAX_UNITS``) and block numbers are mapped to slots by arithmetic on the
executors. No row is dropped or repeated: when a source runs out, a new phase
starts at the next slot, in which the other sources keep their relative
weights.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
MAX_UNITS = 100
MAX_SOURCES = 256  # the schedule is sent to every task; its size is bounded by this
GROUP_ROWS = 1000  # rows that one task ranks together
SEED = 17


def earliest_deadline_first(units: list[int]) -> list[list[int]]:
    """Slots of one period: ``out[s][j]`` is the slot of source s's j-th block."""
    total = sum(units)
    out: list[list[int]] = [[] for _ in units]
    pending = [(0, s) for s in range(len(units))]
    ready: list[tuple[int, int]] = []
    heapq.heapify(pending)
    for slot in range(total):
        while pending and pending[0][0] <= slot:
            s = heapq.heappop(pending)[1]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * total // units[s]), s))
        s = heapq.heappop(ready)[1]
        out[s].append(slot)
        j = len(out[s])
        if j < units[s]:
            heapq.heappush(pending, (j * total // units[s], s))
    return out


@dataclass
class Phase:
    first_block: int  # of the source, in this phase
    start: int  # slot at which the phase starts
    units: int
    total: int
    slots: list[int]


def schedule(blocks: dict[str, int], units: dict[str, int]) -> dict[str, list[Phase]]:
    """The phases of every source until all its blocks have a slot."""
    out: dict[str, list[Phase]] = {s: [] for s in blocks}
    done = {s: 0 for s in blocks}
    start = 0
    while active := sorted(s for s in blocks if done[s] < blocks[s]):
        own = [units[s] for s in active]
        total = sum(own)
        period = earliest_deadline_first(own)

        def slot(k: int, j: int, own=own, total=total, period=period) -> int:
            return j // own[k] * total + period[k][j % own[k]]

        length = min(slot(k, blocks[s] - done[s] - 1) + 1 for k, s in enumerate(active))
        for k, s in enumerate(active):
            out[s].append(Phase(done[s], start, own[k], total, period[k]))
            rounds, rest = divmod(length, total)
            done[s] += rounds * own[k] + sum(x < rest for x in period[k])
        start += length
    return out


def tempered_units(counts: dict[str, int]) -> dict[str, int]:
    """Target weights in proportion to the square root of the source's rows, in
    whole units from 1 to ``MAX_UNITS``."""
    most = max(counts.values(), default=1)
    return {s: max(1, math.isqrt(MAX_UNITS * MAX_UNITS * n // most)) for s, n in counts.items()}


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, source_col: str = "source",
        id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, seed: int = SEED,
        group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with ``mix_block`` (number of the row's block in its source),
    ``mix_release`` and ``mix_deadline`` (the block's window, in slots),
    ``mix_slot`` (the slot it got) and ``mix_pos`` (place in the block).
    Reading by ``mix_slot, mix_pos`` gives the mixture.

    ``weights`` maps sources to whole units; None means ``tempered_units``, and
    a source without an entry has one unit.

    Defined results: a null source is a source of its own; every row appears
    exactly once, repeated rows and rows with null ids included (their order
    among themselves is arbitrary); columns of ``docs`` with the names of the
    five new ones are replaced; an empty table gives an empty result. More than
    ``MAX_SOURCES`` sources raise ValueError.
    """
    new = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_pos"]
    docs = docs.drop(*new)
    counted = docs.groupBy(_key(F.col(source_col)).alias("key")).count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer groups first")
    counts = {r["key"]: r["count"] for r in counted}
    if weights is None:
        units = tempered_units(counts)
    else:
        named = {"null" if s is None else f"={s}": u for s, u in weights.items()}
        units = {s: named.get(s, 1) for s in counts}
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, units)
    phase = "array<struct<first_block:bigint,start:bigint,units:bigint,total:bigint,slots:array<bigint>>>"
    table = docs.sparkSession.createDataFrame(
        [(s, -(-counts[s] // group_rows), [(p.first_block, p.start, p.units, p.total, p.slots) for p in plan[s]])
         for s in counts], f"_key string, _groups bigint, _phases {phase}")

    rows = docs.withColumn("_key", _key(F.col(source_col))).withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_col)))
    rows = rows.join(F.broadcast(table.select("_key", "_groups")), "_key")
    rows = rows.withColumn("_group", F.pmod("_hash", "_groups")).drop("_groups")
    # rank within the source: groups of about group_rows rows, then prefix sums of their sizes in two levels
    sizes = rows.groupBy("_key", "_group").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_wide", F.expr(f"_group div {group_rows}"))
    wide = sizes.groupBy("_key", "_wide").agg(F.sum("_n").alias("_m"))
    wide = wide.select("_key", "_wide", F.coalesce(
        F.sum("_m").over(Window.partitionBy("_key").orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    sizes = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_key", "_wide").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = sizes.join(wide, ["_key", "_wide"]).select("_key", "_group", (F.col("_a") + F.col("_b")).alias("_offset"))
    order = Window.partitionBy("_key", "_group").orderBy("_hash", id_col)
    rows = rows.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, ["_key", "_group"])
    rows = rows.withColumn("_rank", F.col("_rank") + F.col("_offset")).drop("_offset")

    rows = rows.withColumn("mix_block", F.expr(f"_rank div {block_rows}"))
    rows = rows.join(F.broadcast(table.select("_key", "_phases")), "_key")
    rows = rows.withColumn("_phase", F.element_at(F.filter("_phases", lambda p: p["first_block"] <= F.col("mix_block")), -1))
    rows = rows.drop("_phases").withColumn("_j", F.expr("mix_block - _phase.first_block"))
    rows = rows.withColumns({
        "mix_release": F.expr("_phase.start + (_j * _phase.total) div _phase.units"),
        "mix_deadline": F.expr("_phase.start + ((_j + 1) * _phase.total + _phase.units - 1) div _phase.units"),
        "mix_slot": F.expr("_phase.start + (_j div _phase.units) * _phase.total"
                           " + get(_phase.slots, cast(_j % _phase.units as int))"),
        "mix_pos": F.expr(f"cast(_rank % {block_rows} as int)"),
    })
    return rows.select(*docs.columns, *new)


def interleaved(docs: DataFrame, **options) -> DataFrame:
    """``mix`` laid out in mixture order: range-partitioned by slot and sorted,
    so that files read in order give the interleaved stream."""
    return (mix(docs, **options).repartitionByRange("mix_slot", "mix_pos").sortWithinPartitions("mix_slot", "mix_pos"))
