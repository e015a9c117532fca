"""Training rows as blocks of arrays.

Rows go to Python once. Spark deals the blocks, keeps them between passes and adds up what tasks find in them;
within a block NumPy works on whole columns, so a pass makes no row for each input of a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.session import cut_lineage

BLOCK_ROWS = 32_768
#: So few rows one task keeps and makes all passes over, without a job for each.
HELD_ROWS = 3 * BLOCK_ROWS
#: What all tasks together may send to the driver at once; more is added up by a shuffle first.
GATHERED_BYTES = 64 << 20
#: Lots are whole numbers below this.
LOTS = 1 << 30

Block = dict[str, np.ndarray]


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """Missing numbers are NaN."""
    return column.to_numpy()


def to_blocks(rows: DataFrame, make: Callable[[Block], Block], first: str | None = None) -> RDD:
    """``make`` of some ten thousand rows at a time. ``first`` names a boolean column, true at the first row of a group:
    groups then stay whole, so rows must come dealt and sorted by group. Blocks are checkpointed, and with them row numbers."""

    def cut(batches: list[pa.RecordBatch], at: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        block = make({name: _array(table.column(name).slice(0, at)) for name in table.column_names})
        batches[:] = table.slice(at).to_batches()
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = batch.num_rows
            if first:
                starts = np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False))
                at = int(starts[-1]) if len(starts) else -1
            held.append(batch)
            if at >= 0 and size + at >= BLOCK_ROWS:
                yield cut(held, size + at)
                size = -at
            size += batch.num_rows
        if size:
            yield cut(held, size)

    stored = cut_lineage(rows.mapInArrow(run, "block binary"))
    return stored.rdd.map(lambda row: pickle.loads(row[0]))


class Held:
    """Blocks that one task holds, with what a pass needs of an RDD. They are put together to one block by ``join``."""

    def __init__(self, blocks: Sequence[Block], join: Callable[[Sequence[Block]], Block] | None = None):
        self.blocks = [join(blocks)] if join and len(blocks) > 1 else list(blocks)

    def map(self, f: Callable[[Block], Block]) -> Held:
        return Held([f(b) for b in self.blocks])

    def mapPartitions(self, f: Callable[[Iterator], Iterator]) -> Held:
        return Held(list(f(iter(self.blocks))))

    def persist(self, *_) -> Held:
        return self

    def unpersist(self) -> None:
        pass

    def getNumPartitions(self) -> int:
        return 1

    def reduceByKey(self, merge: Callable, tasks: int) -> Held:
        return self  # of one partition, which has merged already

    def collect(self) -> list:
        return self.blocks


def joined(blocks: Sequence[Block]) -> Block:
    """One block of all rows. ``starts`` are places of rows, sums of a block are left out."""
    sizes = np.cumsum([0, *[len(b["y"]) for b in blocks[:-1]]])
    out = {k: np.concatenate([b[k] for b in blocks], axis=-1) for k in blocks[0] if k not in ("starts", "measured")}
    if "starts" in blocks[0]:
        out["starts"] = np.concatenate([b["starts"] + n for b, n in zip(blocks, sizes, strict=True)])
    return out


def row_count(blocks: RDD) -> int:
    return blocks.map(lambda b: len(b["y"])).sum()


def combined(
    blocks: RDD | Held, work: Callable[[Block], dict[Hashable, np.ndarray]], size: int, merge: Callable = np.add
) -> dict[Hashable, np.ndarray]:
    """What ``work`` finds in the blocks, merged by key; ``size`` is the most bytes that it finds."""

    def task(part: Iterator[Block]) -> Iterator[tuple[Hashable, np.ndarray]]:
        total: dict[Hashable, np.ndarray] = {}
        for block in part:
            for key, value in work(block).items():
                total[key] = merge(total[key], value) if key in total else value
        return iter(total.items())

    found, tasks = blocks.mapPartitions(task), blocks.getNumPartitions()
    if size * tasks > GATHERED_BYTES:
        found = found.reduceByKey(merge, tasks)
    out: dict[Hashable, np.ndarray] = {}
    for key, value in found.collect():
        out[key] = merge(out[key], value) if key in out else value
    return out


def lots(row: str, seed: int) -> list[Column]:
    """Two whole numbers of a row, which ``drawn`` turns into one for each tree: any two trees' are independent."""
    return [F.pmod(F.xxhash64(row, F.lit(seed), F.lit(k)), F.lit(LOTS)).alias(name) for k, name in enumerate(("_lot", "_step"))]


def drawn(lot, step, number):
    """For columns and arrays alike."""
    return (lot + step * number) % LOTS
