"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs WARM times before it is timed, then the best of RUNS counts. The scale_* entries search tables in files, of
$BENCH_ROWS independent random unit vectors of $BENCH_DIM numbers: exact, by codes with a rerank, and by clusters; build_* write
them, once, and count in the sum. `mb_read` is what a search of each way reads.
`recall10` compares these searches with the exact one, `ratio` their times, `build` gives seconds, vectors a second and bytes.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.operators.search import search, search_batch
from nearfield.plans.evaluate import search_reads
from nearfield.queries import queries
from nearfield.sources.inspect import inspect
from nearfield.sources.scratch import scratch
from nearfield.sources.table import VectorTable, write_stream, write_vectors

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS, SCALE_DIM = int(os.environ.get("BENCH_ROWS", "100000")), int(os.environ.get("BENCH_DIM", "384"))
WARM, RUNS, K, ASKED = 1, 2, 10, 3
HEADLINE = ("fn_cosine", "fn_hamming", "knn_exact_cosine", "knn_exact_euclidean", "knn_rerank", "knn_batch", "knn_multi_source", "kmeans_full", "knn_clustered", "recall_micro", "latency_percentiles")


def best(run) -> float:
    spent = []
    for i in range(WARM + RUNS):
        start = time.perf_counter()
        run()
        if i >= WARM:
            spent.append(time.perf_counter() - start)
    return round(min(spent), 4)


def made(spark: SparkSession) -> DataFrame:
    """ROWS unit vectors, each from its own seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy()
            v = np.random.default_rng(int(at[0])).standard_normal((len(at), SCALE_DIM), np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * SCALE_DIM), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype(str)), vectors], names=["row", "id", "vector"])

    return spark.range(0, ROWS, 1, 4 * int(CPUS)).mapInArrow(run, "row bigint, id string, vector array<float>")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    seconds = {name: best(lambda f=known[name]: f(spark, SF_DIR).collect()) for name in HEADLINE}

    rows = made(spark)
    tables: dict[str, VectorTable] = {}
    build: dict[str, dict] = {}
    for name, write in (
        ("rerank", lambda path: write_stream(rows, path, SCALE_DIM, normalize=False, binary=True)),
        ("clustered", lambda path: write_vectors(rows, path, SCALE_DIM, order_by=("row",), normalize=False)),
    ):
        path, start = scratch(spark, f"bench-{name}"), time.perf_counter()
        tables[name] = write(path)
        spent = time.perf_counter() - start
        size = int(inspect(spark, path).where("property = 'bytes'").first()["value"])
        seconds[f"build_{name}"] = round(spent, 4)
        build[name] = {"seconds": round(spent, 2), "vectors_a_second": round(ROWS / spent), "bytes": size}
    asked = [list(r["vector"]) for r in rows.where(f"row < {ASKED}").select("vector").collect()]
    seconds["scale_exact"] = best(lambda: search(tables["rerank"], asked[0], K, algorithm="exact").collect())
    seconds["scale_rerank"] = best(lambda: search(tables["rerank"], asked[0], K).collect())
    seconds["scale_exact_clustered"] = best(lambda: search(tables["clustered"], asked[0], K, algorithm="exact").collect())
    seconds["scale_clustered"] = best(lambda: search(tables["clustered"], asked[0], K).collect())
    mb_read = {r["way"]: round(r["bytes"] / 1e6, 2) for r in search_reads(tables["clustered"], asked[0], K).collect()}
    given = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "query_id string, query array<double>")
    truth: dict[str, set] = {}
    for r in search_batch(tables["rerank"], given, K).collect():
        truth.setdefault(r["query_id"], set()).add(r["id"])
    recall = {}
    for name, t in tables.items():
        hits = sum(len({r["id"] for r in search(t, q, K).collect()} & truth[str(i)]) for i, q in enumerate(asked))
        recall[name] = round(hits / (K * len(asked)), 3)
    ratio = {"exact_to_rerank": round(seconds["scale_exact"] / seconds["scale_rerank"], 2), "exact_to_clustered": round(seconds["scale_exact_clustered"] / seconds["scale_clustered"], 2)}
    print(json.dumps({"metric": "sum of the best times of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR, "scale_rows": ROWS, "scale_dim": SCALE_DIM, "build": build, "mb_read": mb_read, "recall10": recall, "ratio": ratio}))


if __name__ == "__main__":
    main()
