"""Records from other tables: embedders that the caller supplies, and vectors stored as bytes by other writers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import unpack_floats


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """id, vector of texts, batch by batch in Arrow batches of the tasks. embedder runs in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                yield pd.DataFrame({"id": rows["id"], "vector": embedder(rows["text"].tolist())})

    return df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, "id string, vector array<float>")


def from_bytes(df: DataFrame, id_col: str, bytes_col: str, dimension: int) -> DataFrame:
    """id, vector of a table that stores little-endian float32 bytes; bytes of another length raise."""
    checked = F.when(F.length(bytes_col) == 4 * dimension, F.col(bytes_col)).otherwise(F.raise_error(F.concat(F.lit("vector bytes of id "), F.col(id_col).cast("string"))).cast("binary"))
    return df.select(F.col(id_col).cast("string").alias("id"), unpack_floats(checked, dimension).alias("vector"))


def from_numbers(df: DataFrame, id_col: str, *columns: str | Column) -> DataFrame:
    """id, vector of numeric columns."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.array(*[F.col(c).cast("float") if isinstance(c, str) else c for c in columns]).alias("vector"))
