"""Appending to an index from a stream: each micro-batch becomes one more table, and searches go over all live tables.

A search pays for each table, so `compact` merges runs of FAN_IN neighbouring tables of one tier into a table of the next. Codes, clusters and
row numbers of a merged table are built anew. A row is rewritten once a tier, so log(batches) times, and at most FAN_IN - 1
tables of each tier stay live.

What is live stands in a manifest, path/manifest/NUMBER.json, which names the merged tables and the range of batches that each
replaces. A new manifest is complete before it appears under its number, and a number is taken once, so of two compactions
at the same time one fails and changes nothing. Batches behind the manifest are live by themselves: appending needs no
manifest, and a batch that the stream runs again after it was merged is not read twice. A table counts from when its last file
is written. Searches that opened replaced tables still find their files until `vacuum`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources.scratch import remove
from nearfield.sources.table import OWN, VectorTable, build, open_table, save, write_stream, write_vectors

FAN_IN = 10
_BATCH = re.compile(r"batch-(\d{8,})$")


@dataclass(frozen=True)
class Live:
    """A live table: its folder, its tier (0: a batch) and the batches first..last that it holds."""

    name: str
    tier: int
    first: int
    last: int


def append_batch(batch: DataFrame, path: str, number: int, dimension: int, *, narrow: bool = False, **options) -> None:
    """Write one batch of records as a table. narrow: in the order it comes, without a shuffle or clusters; options: see write_vectors, write_stream."""
    at, write = f"{path}/batch-{number:08d}", write_stream if narrow else write_vectors
    remove(batch.sparkSession, f"{at}/clusters")  # a table that is written again does not count until it is whole
    write(batch, at, dimension, mode="overwrite", **options)


def append_batches(stream: DataFrame, path: str, dimension: int, checkpoint: str, *, fan_in: int | None = None, **options) -> StreamingQuery:
    """Write each micro-batch of records to path/batch-N. A batch that is run again replaces what it wrote before. fan_in: compact after each batch."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            append_batch(batch, path, number, dimension, **options)
            if fan_in:
                compact(batch.sparkSession, path, fan_in=fan_in)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[Live]]:
    """The number of the newest manifest, 0 if there is none, and its merged tables."""
    number = max((int(n[:-5]) for n in _names(spark, f"{path}/manifest") if re.fullmatch(r"\d+\.json", n)), default=0)
    if not number:
        return 0, []
    at, fs = _path(spark, f"{path}/manifest/{number:08d}.json")
    opened = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()
    return number, [Live(**t) for t in json.loads(text)["tables"]]


def _commit(spark: SparkSession, path: str, number: int, tables: list[Live]) -> None:
    """Write the manifest under a name of its own, then give it its number, which fails if that is taken."""
    written, fs = _path(spark, f"{path}/manifest/.{uuid.uuid4().hex}.tmp")
    out = fs.create(written, False)
    try:
        out.write(bytearray(json.dumps({"tables": [asdict(t) for t in tables]}).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(fs.makeQualified(written), fs.makeQualified(_path(spark, f"{path}/manifest/{number:08d}.json")[0]), none)


def _written(spark: SparkSession, path: str, name: str) -> bool:
    at, fs = _path(spark, f"{path}/{name}/clusters/_SUCCESS")  # what a table writes last
    return fs.exists(at)


def live_tables(spark: SparkSession, path: str) -> list[Live]:
    """The live tables in order of their batches."""
    merged = _manifest(spark, path)[1]
    found = ((n, int(m[1])) for n in _names(spark, path) if (m := _BATCH.match(n)))
    alone = [Live(n, 0, b, b) for n, b in found if not any(t.first <= b <= t.last for t in merged) and _written(spark, path, n)]
    return sorted(merged + alone, key=lambda t: t.first)


def open_batches(spark: SparkSession, path: str) -> list[VectorTable]:
    """All live tables that a stream has written, in order."""
    return [open_table(spark, f"{path}/{t.name}") for t in live_tables(spark, path)]


def _runs(live: list[Live], fan_in: int) -> Iterator[list[Live]]:
    """Runs of fan_in neighbours of one tier, which share no table."""
    run: list[Live] = []
    for t in live:
        run = [*run, t] if run and run[-1].tier == t.tier else [t]
        if len(run) == fan_in:
            yield run
            run = []


def _merge(spark: SparkSession, path: str, run: list[Live], options: dict) -> Live:
    """One table of all rows of the run, in the order of its tables and their row numbers."""
    tables = [open_table(spark, f"{path}/{t.name}") for t in run]
    metas = {(t.meta.dimension, t.meta.metric, t.meta.normalized) for t in tables}
    if len(metas) > 1:
        raise ValueError(f"tables of {path} differ in dimension, metric or normalization")
    meta = tables[0].meta
    source, place = f"source_{uuid.uuid4().hex}", f"place_{uuid.uuid4().hex}"
    keep = tuple(dict.fromkeys(c for t in tables for c in t.rows.columns if c not in OWN))
    parts = [t.rows.select("id", "vector", F.lit(i).alias(source), F.col("row_index").alias(place), *[c for c in keep if c in t.rows.columns]) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if any(t.meta.binary for t in tables):
        options = {"binary": True, **options}
    if any(t.meta.clusters for t in tables) and "clusters" not in options:
        options = {k: v for k, v in options.items() if k != "binary"}  # clusters by the number of rows
    built = build(rows, meta.dimension, order_by=(source, place), metric=meta.metric, normalize=False, keep=keep, **options)
    built.meta = replace(built.meta, normalized=meta.normalized)
    out = Live(f"tier{run[0].tier + 1}-{run[0].first:08d}-{run[-1].last:08d}-{uuid.uuid4().hex[:8]}", run[0].tier + 1, run[0].first, run[-1].last)
    save(built, f"{path}/{out.name}")
    return out


def compact(spark: SparkSession, path: str, *, fan_in: int = FAN_IN, **options) -> list[Live]:
    """Merge until fewer than fan_in neighbours of any tier are left; returns what is live then. One manifest a round of merges.

    options: binary, clusters and the k-means options of write_vectors; left open, codes are kept, and both go by the number of rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    while runs := list(_runs(live := live_tables(spark, path), fan_in)):
        number, merged = _manifest(spark, path)
        made = [_merge(spark, path, run, options) for run in runs]
        gone = {t.name for run in runs for t in run}
        _commit(spark, path, number + 1, sorted([t for t in merged if t.name not in gone] + made, key=lambda t: t.first))
    return live


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete tables that the newest manifest replaced, once no search reads them and no compaction is on its way; returns their names."""
    live, merged = {t.name for t in live_tables(spark, path)}, _manifest(spark, path)[1]
    dead = []
    for name in _names(spark, path):
        b = _BATCH.match(name)
        replaced = any(t.first <= int(b[1]) <= t.last for t in merged) if b else name.startswith("tier")
        if replaced and name not in live:
            remove(spark, f"{path}/{name}")
            dead.append(name)
    return dead
