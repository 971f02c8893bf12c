"""Comparing the rows of large groups block by block, in numpy, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: str, size: str, node: str, block: int) -> DataFrame:
    """Deals groups out to pairs of blocks: adds ``i`` and ``j`` (i <= j), and ``b``, the block of a row.

    A group of ``size`` rows is cut into ceil(size / block) blocks by the hash of ``node``; each two blocks, and each block
    with itself, meet under one (group, i, j), so no task holds over two blocks and each pair of rows meets at least once.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    dealt = rows.withColumn("b", F.pmod(F.xxhash64(node), n).cast("int"))
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    return dealt.withColumn("p", F.explode(others)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p", size)


def map_groups(rows: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work(batch, starts)`` over batches of whole groups: rows are dealt by ``keys`` and come sorted, groups begin at ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            starts = _starts(held, keys)
            if len(starts) > 1:
                done = held.slice(0, int(starts[-1]))
                if (out := work(done, starts[:-1])) is not None:
                    yield out
                held = held.slice(int(starts[-1]))
        if held is not None and (out := work(held, np.zeros(1, np.int64))) is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        x = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def fixed_binary(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """Binary values of ``width`` bytes each as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width // np.dtype(dtype).itemsize)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def spread_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For links between the indices u and v of n, the smallest index that each index is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new
