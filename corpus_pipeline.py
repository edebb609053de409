"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Stages keep all columns of documents (the last returns token digests), and no stage looks at what an earlier one dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontamination, mixing, near_duplicates, token_files, toxicity
from nearfield.llm.common import stored, table, text_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF does not predict to be toxic. The model is learned from the labels of the input documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words a shingle, similarity 0.8): the one with the least id."""
    return near_duplicates.keep_one(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Each row is judged by its own text, told apart by its 64-bit hash: rows without
    an id go like others, and of rows that share an id those go that hold an item."""
    own, leaked = F.xxhash64(text_of()), f"leaked_{uuid.uuid4().hex}"
    found = decontamination.contaminated(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select(F.col("doc_id").alias(leaked)).distinct(), "leaks")
    return docs.join(leaks.hint("merge"), own == leaks[leaked], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their share of the source mix: one row for each begun pass of the schedule over a document."""
    return mixing.repeat_by_share(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and checksum of the packed token files."""
    return token_files.read_digests(token_files.write_tokens(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mix", mix_sources),
    ("token_files", tokenize),
]

#: Model training, MinHash, BM25 retrieval and tokenizing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
