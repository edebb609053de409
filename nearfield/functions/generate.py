"""Seeded vectors, the same for any partitioning: each row jumps to its own place in the sequence of random numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import l2_normalize

_A, _C, _M = 1664525, 1013904223, 1 << 32


def state_after(seed: int, steps: int) -> int:
    """The state after a number of steps of state * A + C modulo 2**32, by squaring."""
    a, c, whole_a, whole_c = _A, _C, 1, 0
    while steps:
        if steps & 1:
            whole_a, whole_c = whole_a * a % _M, (whole_c * a + c) % _M
        a, c = a * a % _M, (c * a + c) % _M
        steps >>= 1
    return (whole_a * (seed % _M or 1) + whole_c) % _M


def random_vectors(spark: SparkSession, rows: int, dimension: int, seed: int = 1, unit: bool = False) -> DataFrame:
    """row_index, id (vec-N), vector: row N holds numbers N * dimension and on of the sequence, in [-1, 1); unit: over their norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column("id").to_pylist()
            state = np.array([state_after(seed, i * dimension) for i in index], np.uint64)
            out = np.empty((len(index), dimension), np.float32)
            for k in range(dimension):
                state = (state * np.uint64(_A) + np.uint64(_C)) % np.uint64(_M)
                out[:, k] = state / _M * 2 - 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.tolist(), pa.list_(pa.float32()))], names=["row_index", "vector"])

    made = spark.range(rows).mapInArrow(run, "row_index bigint, vector array<float>")
    return made.select("row_index", F.concat(F.lit("vec-"), F.col("row_index").cast("string")).alias("id"), (l2_normalize(F.col("vector")) if unit else F.col("vector")).alias("vector"))
