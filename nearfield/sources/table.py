"""Vector tables: a Parquet directory that describes itself.

path/rows holds row_index, id, vector, and if there are codes vector_bin, if there are clusters cluster_id, and the
columns that were kept. Scalars of the index are metadata of the field `vector`, which Spark writes to Parquet and reads
back. path/clusters holds a row per cluster: cluster_id, centroid, row_count, row_start.

Row numbers come from the places of rows in their partitions and the counts of the partitions before, not from a window over all
rows. Rows are written once with (partition, place) to a folder of the session, and counts and numbers both come from these files: an
input that ends in a shuffle, whose partitions may differ from one evaluation to the next, loses no row. A write fails if it
ends with another number of rows than it read. With clusters, rows are numbered a second time, in ranges of (cluster, number): a cluster
of any size is split among tasks.
Rows are written in order of their number, by cluster as directories up to DIRECTORIES of them, else as sorted files,
so a search that names its clusters reads nothing else.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import check_metric, id_string, l2_normalize, with_codes
from nearfield.operators.kmeans import ITERATIONS, SEED, binary_kmeans, code_literal, reorder, two_level_kmeans
from nearfield.sources.scratch import remove, scratch

VERSION = 1
AUTO_CODES_ROWS = 10_000
CODE_PAGE_BYTES = 32 * 1024
ROW_GROUP_BYTES = 16 << 20
DIRECTORIES = 1000
#: Columns of a written table; kept columns need other names.
OWN = ("row_index", "id", "vector", "vector_bin", "cluster_id")


@dataclass(frozen=True)
class Meta:
    dimension: int
    metric: str = "cosine"
    normalized: bool = False
    binary: bool = False
    clusters: int = 0
    version: int = VERSION


@dataclass
class VectorTable:
    """An open table: rows(row_index, id, vector, ...), its metadata, and its clusters."""

    rows: DataFrame
    meta: Meta
    centroids: list[list[int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    path: str | None = None
    #: Codes that were read into memory: row_index, vector_bin[, cluster_id].
    prefetched: DataFrame | None = None
    #: What was persisted to build the rows.
    held: list[DataFrame] = field(default_factory=list)
    #: The folder of the numbered input that the rows are read from, and its number of rows.
    numbered_in: str | None = None
    expected: int | None = None

    def release(self) -> None:
        """Free what the executors hold for this table. A table that was built but not written is then computed anew when read."""
        for df in self.held + ([self.prefetched] if self.prefetched is not None else []):
            df.unpersist()
        self.held, self.prefetched = [], None

    @property
    def codes(self) -> DataFrame:
        if self.prefetched is not None:
            return self.prefetched
        if not self.meta.binary:
            raise ValueError("the table has no codes")
        return self.rows.select("row_index", "vector_bin", *(["cluster_id"] if self.meta.clusters else []))


def auto_codes(n: int, binary: bool | None, clusters: int | None) -> tuple[bool, int]:
    """(codes, clusters) for n rows: both by the number of rows if left open; clusters alone force codes."""
    codes = n >= AUTO_CODES_ROWS if binary is None else binary
    k = clusters if clusters is not None else (max(1, round(math.sqrt(n) / 2)) if binary is None and codes else 0)
    return codes or k > 0, k


def check_options(dimension: int, metric: str, binary: bool | None, clusters: int | None) -> None:
    if not isinstance(dimension, int) or dimension < 1:
        raise ValueError(f"invalid dimension: {dimension}")
    check_metric(metric)
    if clusters and binary is False:
        raise ValueError("clusters need codes: binary must not be False")


def checked_vector(vector: Column, id_col: Column, dimension: int, normalize: bool) -> Column:
    """The vector as floats; an error that names the id if it is null, of another length, or has a null or NaN."""
    bad = F.size(vector) != dimension
    missing = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    name = F.coalesce(id_col.cast("string"), F.lit("null"))
    value = l2_normalize(vector) if normalize else vector.cast("array<float>")
    return (
        F.when(F.coalesce(missing, F.lit(True)), F.raise_error(F.concat(F.lit("vector of id "), name, F.lit(" has a null or NaN"))).cast("array<float>"))
        .when(bad, F.raise_error(F.concat(F.lit("vector of id "), name, F.lit(f" has not {dimension} elements but "), F.size(vector).cast("string"))).cast("array<float>"))
        .otherwise(value)
    )


def _fresh(stem: str) -> str:
    """A column name that no caller's column has."""
    return f"{stem}_{uuid.uuid4().hex}"


def _check_kept(keep: tuple[str, ...]) -> None:
    if clash := [c for c in keep if c in OWN]:
        raise ValueError(f"kept columns must not be named {', '.join(clash)}")


def numbered(df: DataFrame, number: str) -> tuple[DataFrame, str, int]:
    """df with `number`, 0..N-1 in the order of its partitions; the folder that holds its rows; and N.

    df is evaluated once: its rows go to files with their partition and place, and the counts are read from these files.
    """
    spark = df.sparkSession
    part, place = _fresh("part"), _fresh("place")
    placed = df.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place))
    folder = scratch(spark, "numbered")
    placed.write.parquet(folder)
    held = spark.read.schema(placed.schema).parquet(folder)
    sizes = {r[part]: (r["n"], r["places"]) for r in held.groupBy(part).agg(F.count(F.lit(1)).alias("n"), (F.max(place) + 1).alias("places")).collect()}  # a row per task of the write
    if any(n != places for n, places in sizes.values()):
        raise RuntimeError("a partition was written in part")
    counts = [sizes.get(p, (0, 0))[0] for p in range(max(sizes, default=-1) + 1)]
    # One literal for the starts of all partitions.
    start = F.get(F.split(F.lit(",".join(map(str, running(counts)))), ","), F.col(part)).cast("bigint")
    known = F.coalesce(start, F.raise_error(F.lit("a partition without a start")).cast("bigint"))
    return held.withColumn(number, known + F.col(place)).drop(part, place), folder, sum(counts)


def build(
    df: DataFrame, dimension: int, *, id_col: str = "id", vector_col: str = "vector", order_by: tuple[str, ...] | None = None, metric: str = "cosine", normalize: bool = True,
    binary: bool | None = None, clusters: int | None = None, cluster_iterations: int = ITERATIONS, cluster_seed: int = SEED, cluster_levels: int = 1, keep: tuple[str, ...] = (), cache: bool = True,
) -> VectorTable:
    """The table of df's records, not yet written. keep: other columns to carry along. cluster_levels: 2 for two_level_kmeans."""
    check_options(dimension, metric, binary, clusters)
    if cluster_levels not in (1, 2):
        raise ValueError(f"invalid cluster_levels: {cluster_levels}")
    _check_kept(keep)
    vector = checked_vector(F.col(vector_col), F.col(id_col), dimension, normalize)
    kinds, order = dict(df.dtypes), order_by or (id_col,)
    kept = {c: _fresh("kept") for c in keep}
    used = df.select(*dict.fromkeys((*order, id_col, vector_col, *keep)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = _fresh("ordinal")
    base, folder, n = numbered(used.repartitionByRange(parts, *order).sortWithinPartitions(*order), at)
    base = base.select(F.col(at).alias("ordinal"), id_string(F.col(id_col), kinds[id_col]).alias("id"), vector.alias("vector"), *[F.col(c).alias(f) for c, f in kept.items()])
    codes, k = auto_codes(n, binary, clusters)
    if codes:
        base = with_codes(base, dimension)
    back = [F.col(f).alias(c) for c, f in kept.items()]
    meta, source = Meta(dimension, metric, normalize, codes, 0), {"numbered_in": folder, "expected": n}
    if not k:
        rows = base.select(F.col("ordinal").alias("row_index"), "id", "vector", *back, *(["vector_bin"] if codes else []))
        return VectorTable(rows, meta, **source)
    held = []
    if cache:
        base = base.persist()  # read once for each iteration
        held.append(base)
    fit = binary_kmeans if cluster_levels == 1 else two_level_kmeans
    found = fit(base.withColumnRenamed("vector_bin", "code"), dimension, k, cluster_iterations, cluster_seed)
    renumber = reorder(found.centroids)
    if not renumber:
        rows = base.select(F.col("ordinal").alias("row_index"), "id", "vector", *back, "vector_bin", F.lit(0).alias("cluster_id"))
        return VectorTable(rows, meta, held=held, **source)
    mapping = F.array(*map(F.lit, renumber))
    rows = found.assigned.withColumnRenamed("code", "vector_bin").withColumn("cluster_id", F.get(mapping, F.col("cluster"))).drop("cluster")
    place = ("cluster_id", "ordinal")
    rows, sorted_in, written = numbered(rows.repartitionByRange(parts, *place).sortWithinPartitions(*place), "row_index")
    for cached in held:
        cached.unpersist()
    remove(df.sparkSession, folder)
    if written != n:
        raise RuntimeError(f"{written} rows of {n} were clustered")
    seen = {r["cluster_id"]: r["count"] for r in rows.groupBy("cluster_id").count().collect()}  # a row per cluster
    counts = [seen.get(c, 0) for c in range(len(renumber))]
    centroids = [c for _, c in sorted(zip(renumber, found.centroids, strict=True))]
    rows = rows.select("row_index", "id", "vector", "vector_bin", "cluster_id", *back)
    return VectorTable(rows, Meta(dimension, metric, normalize, True, len(counts)), centroids, counts, numbered_in=sorted_in, expected=n)


def running(counts: list[int]) -> list[int]:
    """The sum of the counts before each."""
    return [0, *accumulate(counts)][: len(counts)]


def write_stream(df: DataFrame, path: str, dimension: int, *, id_col: str = "id", vector_col: str = "vector", metric: str = "cosine", normalize: bool = True, binary: bool = False, keep: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> VectorTable:
    """Write records in the order of their partitions: no shuffle, no cache and no clusters.

    df is evaluated once; its records pass through a folder of the session, from which they are numbered (see `numbered`).
    """
    check_options(dimension, metric, binary, None)
    _check_kept(keep)
    kinds, kept = dict(df.dtypes), {c: _fresh("kept") for c in keep}
    vector = checked_vector(F.col(vector_col), F.col(id_col), dimension, normalize)
    records = df.select(id_string(F.col(id_col), kinds[id_col]).alias("id"), vector.alias("vector"), *[F.col(c).alias(f) for c, f in kept.items()])
    rows, folder, n = numbered(records, "row_index")
    if binary:
        rows = with_codes(rows, dimension)
    rows = rows.select("row_index", "id", "vector", *[F.col(f).alias(c) for c, f in kept.items()], *(["vector_bin"] if binary else []))
    return save(VectorTable(rows.sortWithinPartitions("row_index"), Meta(dimension, metric, normalize, binary, 0), numbered_in=folder, expected=n), path, mode=mode, **options)


def write_vectors(df: DataFrame, path: str, dimension: int, *, codec: str = "uncompressed", page_size: int | None = None, row_group_bytes: int | None = None, encodings: dict[str, bool] | None = None, mode: str = "errorifexists", **options) -> VectorTable:
    """Build a table (see build) and write it; returns it opened from its files."""
    return save(build(df, dimension, **options), path, codec=codec, page_size=page_size, row_group_bytes=row_group_bytes, encodings=encodings, mode=mode)


def save(table: VectorTable, path: str, *, codec: str = "uncompressed", page_size: int | None = None, row_group_bytes: int | None = None, encodings: dict[str, bool] | None = None, mode: str = "errorifexists") -> VectorTable:
    """Write a built table; returns it opened from its files.

    encodings: for a column, if it may be written with a dictionary; vectors and codes are not, unless asked for.
    """
    spark = table.rows.sparkSession
    rows = table.rows.withColumn("vector", F.col("vector").alias("vector", metadata=dict(table.meta.__dict__)))
    leaves = {"vector": "vector.list.element", "vector_bin": "vector_bin.list.element"}
    writer_options = {"compression": codec, "parquet.block.size": str(row_group_bytes or ROW_GROUP_BYTES)}
    for column, on in {"vector": False, "vector_bin": False, **(encodings or {})}.items():
        writer_options[f"parquet.enable.dictionary#{leaves.get(column, column)}"] = str(on).lower()
    if page_size or table.meta.binary:
        writer_options["parquet.page.size"] = str(page_size or CODE_PAGE_BYTES)
    by_directory = 0 < table.meta.clusters <= DIRECTORIES
    if table.meta.clusters:  # by ranges, also for directories: a large cluster is written by several tasks
        rows = rows.repartitionByRange("cluster_id", "row_index").sortWithinPartitions("cluster_id", "row_index")
    writer = rows.write.mode(mode).options(**writer_options)
    (writer.partitionBy("cluster_id") if by_directory else writer).parquet(f"{path}/rows")
    clusters_frame(spark, table).coalesce(1).write.mode(mode).parquet(f"{path}/clusters")
    table.release()
    written = open_table(spark, path)
    if table.expected is not None and (n := written.rows.count()) != table.expected:
        raise RuntimeError(f"{path} holds {n} rows of {table.expected}")
    if table.numbered_in:
        remove(spark, table.numbered_in)
    return written


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def open_table(spark: SparkSession, path: str) -> VectorTable:
    """A written table; an error if the directory does not describe itself."""
    rows = spark.read.parquet(f"{path}/rows")
    found = rows.schema["vector"].metadata if "vector" in rows.columns else {}
    if "dimension" not in found:
        raise ValueError(f"{path} is no vector table: its metadata has no dimension")
    meta = Meta(found["dimension"], found.get("metric", "cosine"), found.get("normalized", False), found.get("binary", False), found.get("clusters", 0), found.get("version", 0))
    clusters = spark.read.parquet(f"{path}/clusters").orderBy("cluster_id").collect() if meta.clusters else []
    for r in clusters:
        if len(r["centroid"]) != -(-meta.dimension // 64):
            raise ValueError(f"centroid {r['cluster_id']} of {path} has a wrong length")
    return VectorTable(rows, meta, [list(r["centroid"]) for r in clusters], [r["row_count"] for r in clusters], path)


def from_rows(rows: DataFrame, dimension: int, metric: str = "cosine", normalized: bool = False) -> VectorTable:
    """A table over an existing DataFrame of row_index, id, vector[, vector_bin]."""
    return VectorTable(rows, Meta(dimension, metric, normalized, "vector_bin" in rows.columns))


def read_vectors(table: VectorTable, row_start: int | None = None, row_end: int | None = None, include_metadata: bool = True) -> DataFrame:
    """Records of rows [row_start, row_end): id, vector, and all other columns as the struct `metadata`. Vectors of a wrong length raise."""
    rows = table.rows
    if row_start is not None:
        rows = rows.where(F.col("row_index") >= row_start)
    if row_end is not None:
        rows = rows.where(F.col("row_index") < row_end)
    out = ["row_index", "id", checked_vector(F.col("vector"), F.col("id"), table.meta.dimension, False).alias("vector")]
    other = [c for c in rows.columns if c not in ("row_index", "id", "vector")]
    return rows.select(*out, *([F.struct(*other).alias("metadata")] if other and include_metadata else []))


def prefetch_codes(table: VectorTable) -> VectorTable:
    """The table with its codes held in memory by the executors."""
    codes = table.codes.persist()
    codes.count()
    return VectorTable(table.rows, table.meta, table.centroids, table.counts, table.path, codes)


def clusters_frame(spark: SparkSession, table: VectorTable) -> DataFrame:
    """cluster_id, centroid, row_count, row_start of a table."""
    data = [(c, [_signed(w % (1 << 64)) for w in code], n, start) for c, (code, n, start) in enumerate(zip(table.centroids, table.counts, running(table.counts), strict=True))]
    return spark.createDataFrame(data, "cluster_id int, centroid array<bigint>, row_count bigint, row_start bigint")


def union_tables(tables: list[VectorTable]) -> DataFrame:
    """Rows of several tables with source_index."""
    return reduce(DataFrame.unionByName, [t.rows.select("row_index", "id", "vector").withColumn("source_index", F.lit(i)) for i, t in enumerate(tables)])


__all__ = ["Meta", "VectorTable", "auto_codes", "build", "check_options", "checked_vector", "clusters_frame", "code_literal", "from_rows", "numbered", "open_table", "prefetch_codes", "read_vectors", "save", "union_tables", "write_stream", "write_vectors"]
