"""Greedy interval de-duplication over rows (any table of intervals).

Sorted intervals are cut into blocks. What a block does to the end that reaches into it, coming from the last interval
kept before it, is a small step function: up to some start one last end comes out, up to a later start another, and
beyond the block's last start the end that came in. These functions are composed in groups, groups of groups and so on,
and the ends are handed down again, so each block gets its own without a loop over blocks and without the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.sources.workspace import save_table

#: Rows of a block are this many at most, as a power of two.
BLOCK_BITS = 16
#: Blocks, or groups, that are composed to one.
FAN = 64


def dedup_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    best_first: Sequence[Column] = (),
) -> DataFrame:
    """Leftmost interval wins within ``keys``; touching counts as overlapping.

    Of all intervals with one start at most the best can survive, so a map-side aggregate
    leaves one row per start. These are sorted over all tasks and cut into blocks of bounded
    size, so neither a hot key nor a long run of overlaps gathers in one task. An interval without a
    start or an end overlaps nothing and ends nothing. Repeated rows share a start, and one is kept.
    Starts and ends are of types that compare, such as numbers, times or strings.
    """
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(*best_first, F.col(end), *[F.col(c) for c in payload if c not in (start, end)])
    best = df.groupBy(*keys, start).agg(
        F.min_by(F.struct(*[F.col(c) for c in payload]), order).alias("_hit")
    )
    rows = best.select(*[F.col(c) if c in keys else F.col("_hit")[c].alias(c) for c in df.columns])
    ranged = rows.repartitionByRange(*keys, start).sortWithinPartitions(*keys, start)
    row = F.monotonically_increasing_id()
    stored = save_table(
        ranged.select("*", row.alias("_row"), F.shiftright(row, BLOCK_BITS).alias("_block")), "intervals"
    )
    at = [stored.schema[c].dataType.simpleString() for c in (start, end)]
    steps = f"edges array<{at[0]}>, ends array<{at[1]}>, fixed boolean"
    columns = [*keys, start, end]
    functions = stored.select(*columns, "_row", "_block").groupBy("_block").applyInArrow(_function(columns), f"_block bigint, {steps}")
    functions = save_table(_numbered(stored, functions, keys), "steps")

    levels = [functions]
    for _ in range(_height(functions)):
        grouped = levels[-1].groupBy(F.floor(F.col("number") / FAN).alias("up"))
        levels.append(save_table(grouped.applyInArrow(_composed, f"number bigint, {steps}"), "steps"))
    reached = levels[-1].select("number", F.lit(None).cast(at[1]).alias("reach"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("up", F.floor(F.col("number") / FAN)).groupBy("up")
        reached = own.cogroup(reached.groupBy("number")).applyInArrow(_handed_down, f"number bigint, reach {at[1]}")
    # What the block before hands on ends with its key.
    given = functions.join(reached, "number").select("_block", F.when(F.col("follows"), F.col("reach")).alias("reach"))
    kept = stored.groupBy("_block").cogroup(given.groupBy("_block")).applyInArrow(_kept(columns), stored.schema)
    return kept.select(*df.columns)


def _numbered(stored: DataFrame, functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Functions of blocks with dense numbers in order; a block that begins a key gets nothing from the one before."""
    edges = stored.groupBy("_block").agg(
        F.min_by(F.struct(*keys), "_row").alias("low"), F.max_by(F.struct(*keys), "_row").alias("high")
    )
    # A block's number holds its partition: rows of a partition are numbered from a multiple of 2^33 on.
    task = F.shiftright("_block", 33 - BLOCK_BITS)
    place = F.col("_block") - F.shiftleft(task, 33 - BLOCK_BITS)
    sizes = edges.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    # One row per task of the sort.
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("task", F.coalesce(before, F.lit(0)).alias("offset"))
    dense = edges.withColumn("task", task).join(offsets, "task").select("_block", "low", "high", (F.col("offset") + place).alias("number"))
    previous = dense.select((F.col("number") + 1).alias("number"), F.col("high").alias("previous"))
    dense = dense.join(previous, "number", "left").select("_block", "number", F.col("previous").eqNullSafe(F.col("low")).alias("follows"))
    begins = ~F.col("follows")
    nothing = F.slice("ends", 1, 1)
    return functions.join(dense, "_block").select(
        "_block", "number", "follows",
        F.when(begins, F.slice("edges", 1, 0)).otherwise(F.col("edges")).alias("edges"),
        F.when(begins, nothing).otherwise(F.col("ends")).alias("ends"),
        (begins | F.col("fixed")).alias("fixed"),
    )


def _height(functions: DataFrame) -> int:
    """Levels above the blocks; one number comes to the driver."""
    n, height = functions.count(), 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def _values(table: pa.Table, column: str | int) -> tuple[np.ndarray, np.ndarray]:
    """Values (any where null) and where they are null."""
    own = table.column(column).combine_chunks()
    if isinstance(own, pa.ChunkedArray):
        own = own.chunk(0) if own.num_chunks else pa.array([], own.type)
    null = own.is_null().to_numpy(zero_copy_only=False)
    filled = own.drop_null()
    values = filled.to_numpy(zero_copy_only=False)
    out = np.zeros(len(null), dtype=values.dtype) if values.dtype != object else np.full(len(null), values[0] if len(values) else None, dtype=object)
    out[~null] = values
    return out, null


class _Block:
    """Rows of a block, by key and start: what follows each interval, and the last of each chain."""

    def __init__(self, table: pa.Table, columns: list[str]):
        *keys, start, end = columns
        n = table.num_rows
        other = np.zeros(n, dtype=bool)
        for c in keys:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            codes = codes.indices.to_numpy(zero_copy_only=False)
            other[1:] |= codes[1:] != codes[:-1]
        self.key = np.cumsum(other)
        (starts, no_start), (ends, no_end) = _values(table, start), _values(table, end)
        #: Intervals that overlap nothing and end nothing; the others are linked.
        self.no_start, self.no_end = no_start, no_end
        self.at = np.flatnonzero(~no_start & ~no_end)
        self.starts, self.ends, self.all_starts = starts[self.at], ends[self.at], starts
        m = len(self.at)
        distinct = np.unique(self.starts)
        width = len(distinct) + 1
        key = self.key[self.at]
        place = key * width + np.searchsorted(distinct, self.starts)
        behind = key * width + np.searchsorted(distinct, self.ends, side="right") - 1
        following = np.maximum(np.searchsorted(place, behind, side="right"), np.arange(1, m + 1))
        last = np.searchsorted(key, key, side="right")
        #: The first later interval of the key that starts behind the end; m without one.
        self.following = np.append(np.where(following < last, following, m), m)
        self.first = np.flatnonzero(np.diff(key, prepend=-1))
        self.of_first_key = int(np.searchsorted(key, 0, side="right"))

    def last(self) -> np.ndarray:
        """The last interval kept, if the chain begins at this one."""
        own = np.arange(len(self.at))
        jump = np.where(self.following[:-1] < len(own), self.following[:-1], own)
        while (jump[jump] != jump).any():
            jump = jump[jump]
        return jump

    def kept(self, reach) -> np.ndarray:
        """Which rows of the table stay."""
        m = len(self.at)
        roots = self.first[self.key[self.at[self.first]] > 0] if m else self.first
        if self.of_first_key:
            i = 0 if reach is None else int(np.searchsorted(self.starts[: self.of_first_key], reach, side="right"))
            if i < self.of_first_key:
                roots = np.append(roots, i)
        marked = np.zeros(m + 1, dtype=bool)
        marked[roots] = True
        step = self.following
        while (step < m).any():
            marked[step[marked]] = True
            step = step[step]
        marked = marked[:m]
        keep = np.zeros(len(self.key), dtype=bool)
        keep[self.at[marked]] = True
        keep[self.no_start] = True
        alone = np.flatnonzero(self.no_end & ~self.no_start)
        if len(alone):
            chosen = self.at[marked]
            before = np.searchsorted(chosen, alone) - 1
            own = self.all_starts[alone]
            keep[alone] = (self.key[alone] > 0) | (True if reach is None else own > reach)
            within = np.flatnonzero(before >= 0)
            within = within[self.key[chosen[before[within]]] == self.key[alone[within]]]
            keep[alone[within]] = own[within] > self.ends[marked][before[within]]
        return keep


def _steps(edges: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without steps between equal ends."""
    if not len(ends):
        return edges, ends
    kept = np.append(ends[1:] != ends[:-1], True)
    return edges[kept], ends[kept]


def _after(function, reach):
    """What comes out when ``reach`` comes in; None stands for nothing."""
    edges, ends, fixed = function
    if fixed:
        return ends[0] if len(ends) else None
    if reach is None:
        return ends[0] if len(ends) else None
    i = int(np.searchsorted(edges, reach, side="right"))
    return ends[i] if i < len(ends) else reach


def _function(columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        block = _Block(table, columns)
        kinds = [table.schema.field(c).type for c in columns[-2:]]
        last_key = int(block.key[-1])
        if last_key > 0:  # the last key begins here: what came in is gone
            own = np.flatnonzero(block.key[block.at] == last_key)
            edges, ends = block.starts[:0], block.ends[block.last()[own[:1]]]
        else:
            edges, ends = _steps(block.starts, block.ends[block.last()])
        columns_out = [table.column("_block").slice(0, 1), pa.array([edges], pa.list_(kinds[0])), pa.array([ends], pa.list_(kinds[1])), pa.array([last_key > 0])]
        return pa.table(dict(zip(("_block", "edges", "ends", "fixed"), columns_out, strict=True)))

    return run


def _read(table: pa.Table) -> list[tuple]:
    """Functions in order, with their numbers."""
    table = table.sort_by("number")
    out = []
    for i in range(table.num_rows):
        edges, ends = (_values(pa.table({"v": table.column(c)[i].values}), "v")[0] for c in ("edges", "ends"))
        out.append((table.column("number")[i].as_py(), (edges, ends, table.column("fixed")[i].as_py())))
    return out


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as they come from numpy, None for null."""
    null = np.array([v is None for v in values])
    if null.all() or not isinstance(values[int(null.argmin())], np.datetime64):
        return pa.array(values, kind)
    some = values[int(null.argmin())]
    return pa.array(np.array([some if v is None else v for v in values]), mask=null).cast(kind)


def _composed(key: tuple, table: pa.Table) -> pa.Table:
    """One function for those of a group, the first applied first."""
    total = None
    for _, own in _read(table):
        if total is None or own[2]:
            total = own
            continue
        edges, ends, fixed = total
        through = [_after(own, e) for e in ends] or ([_after(own, None)] if fixed else [])
        through = np.array([x for x in through if x is not None], dtype=own[1].dtype if len(own[1]) else ends.dtype)
        if fixed:
            total = (edges, through[:1], True)
            continue
        later = np.searchsorted(own[0], edges[-1], side="right") if len(edges) else 0
        total = (*_steps(np.concatenate([edges, own[0][later:]]), np.concatenate([through, own[1][later:]])), False)
    kinds = [table.schema.field(c).type for c in ("edges", "ends")]
    return pa.table({"number": pa.array([key[0].as_py()], pa.int64()), "edges": pa.array([total[0]], kinds[0]), "ends": pa.array([total[1]], kinds[1]), "fixed": pa.array([total[2]])})


def _handed_down(key: tuple, functions: pa.Table, reached: pa.Table) -> pa.Table:
    """What reaches each member of a group, from what reaches the group."""
    reach = _values(reached, "reach")
    reach = None if reach[1][0] else reach[0][0]
    numbers, out = [], []
    for number, own in _read(functions):
        numbers.append(number)
        out.append(reach)
        reach = _after(own, reach)
    return pa.table({"number": pa.array(numbers, pa.int64()), "reach": _column(out, reached.schema.field("reach").type)})


def _kept(columns: list[str]):
    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        reach, null = _values(given, "reach")
        return table.filter(pa.array(_Block(table, columns).kept(None if null[0] else reach[0])))

    return run
