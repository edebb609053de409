"""The thin queries over the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import collocations, decontamination, fill_middle, fingerprints, html_text, line_dedup, mixing, near_duplicates, oracles, secrets, suffix_dedup, token_files, toxicity, transport
from nearfield.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write_tokens(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_features(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(fill_middle.restored(F.col("text"), F.col("form"))).alias("restored_sha256"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited(table(spark, sf_dir, "documents"))
    written = lambda c: F.array_join(c, "")
    near = lambda c: fingerprints.resemblance(F.col("sketch"), F.col(c))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"),
        near("edited_sketch").alias("near_edited"), near("next_sketch").alias("near_next"), fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"), fingerprints.distinct_shingles(F.col("sketch")).alias("shingles"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_token_files, op3_toxicity, op4_html_text, op5_decontamination, op6_suffix_dedup, op7_line_dedup, op8_source_mix, op9_near_duplicates, op10_transport_stream, op11_fill_in_middle, op12_fingerprints, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
