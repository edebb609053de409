"""Statistics of a written table, also as a command: python -m nearfield inspect PATH."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from nearfield.sources.table import open_table


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """property, value: what the table says of itself, and its size against that of the bare floats."""
    table = open_table(spark, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    size = fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(f"{path}/rows")).getLength()
    n, meta = table.rows.count(), table.meta
    raw = n * meta.dimension * 4
    rows = [("path", path), ("bytes", size), ("vectors", n), ("dimension", meta.dimension), ("metric", meta.metric), ("normalized", meta.normalized), ("codes", meta.binary), ("clusters", meta.clusters)]
    rows += [("files", len(table.rows.inputFiles())), ("raw_bytes", raw), ("percent_of_raw", f"{100 * size / raw if raw else 0:.1f}")]
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in rows], "property string, value string")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nearfield")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("inspect", help="print statistics of a vector table").add_argument("path")
    try:
        given = parser.parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    try:
        for r in inspect(spark, given.path).collect():
            print(f"{r['property']}: {r['value']}")
    except Exception as e:
        print(f"cannot read {given.path}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0
