"""Which clusters and rows a search reads."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.kmeans import distance
from nearfield.sources.scratch import scratch

DEFAULT_PROBE, PROBE_CAP, GAP = 0.25, 48, 64
#: Row numbers of a block of a range join, and blocks in which a large pool of rows is looked for.
BLOCK_ROWS, BLOCKS = 1 << 15, 4096


def probe_count(clusters: int, probe: float | None = None) -> int:
    """Clusters to read: above 1 a number, otherwise a share, at least one. Only the default share is capped."""
    share = DEFAULT_PROBE if probe is None else probe
    n = min(math.ceil(share), clusters) if share > 1 else max(1, math.ceil(clusters * share))
    return min(n, PROBE_CAP) if probe is None else n


def select_clusters(centroids: list[list[int]], query: list[int], probe: float | None = None) -> list[int]:
    """Numbers of the clusters nearest to the query's code, ascending; of equals the lower number is nearer."""
    ranked = sorted(range(len(centroids)), key=lambda c: (distance(centroids[c], query), c))
    return sorted(ranked[: probe_count(len(centroids), probe)])


def merge_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """Half-open [row_start, row_end) that touch or overlap become one. keys: ranges of different keys stay apart.

    Rows are dealt by range of (keys, row_start, row_end), so a key with very many of them is spread. Windows stay within
    a part; the parts before come in as one reach and one number of islands for each (keys, part).
    """
    dealt = ranges.select(*keys, "row_start", "row_end").repartitionByRange(*keys, "row_start", "row_end").withColumn("part", F.spark_partition_id())
    path = scratch(ranges.sparkSession, "ranges")
    dealt.write.parquet(path)
    dealt = ranges.sparkSession.read.schema(dealt.schema).parquet(path)
    inside = Window.partitionBy(*keys, "part").orderBy("row_start", "row_end")
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def before(parts: DataFrame, value: Column, name: str) -> DataFrame:
        return parts.select(*keys, "part", value.over(earlier).alias(name))

    def joined(rows: DataFrame, parts: DataFrame) -> DataFrame:
        same = [rows[c].eqNullSafe(parts[c]) for c in (*keys, "part")]
        return rows.join(parts, same, "left").select(rows["*"], *[parts[c] for c in parts.columns if c not in (*keys, "part")])

    carried = before(dealt.groupBy(*keys, "part").agg(F.max("row_end").alias("end")), F.max("end"), "carried")
    reach = F.greatest(F.max("row_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    marked = joined(dealt, carried).withColumn("reach", reach).withColumn("new", F.when(F.col("row_start") <= F.col("reach"), 0).otherwise(1)).drop("carried", "reach")
    numbers = before(marked.groupBy(*keys, "part").agg(F.sum("new").alias("islands")), F.sum("islands"), "first")
    island = F.coalesce("first", F.lit(0)) + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = joined(marked, numbers).withColumn("island", island)
    return placed.groupBy(*keys, "island").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end")).drop("island")


def coalesce_runs(rows: DataFrame, gap: int = GAP, *keys: str) -> DataFrame:
    """Rows (row_index) as half-open runs; runs with at most gap rows between them become one."""
    reaching = rows.select(*keys, F.col("row_index").alias("row_start"), (F.col("row_index") + 1 + gap).alias("row_end"))
    return merge_ranges(reaching, *keys).withColumn("row_end", F.col("row_end") - gap)


def range_join(rows: DataFrame, ranges: DataFrame, *keys: str, row: str = "row_index", width: int = BLOCK_ROWS) -> DataFrame:
    """Each row with each half-open [row_start, row_end) that holds it, and all columns of both but the ranges' keys. keys: only ranges of equal keys.

    Both sides meet by an equi-join on blocks of `width` row numbers, never all ranges with all rows: a range stands in each block that it touches,
    so at most two copies more than its rows fill whole blocks, and a pair meets in one block alone. Empty ranges and nulls hold no row.
    """
    if width < 1:
        raise ValueError(f"invalid width: {width}")
    own, block, number = [f"{c}_{uuid.uuid4().hex}" for c in keys], f"block_{uuid.uuid4().hex}", f"number_{uuid.uuid4().hex}"
    at = lambda c: F.floor(c / F.lit(width)).cast("bigint") if width & (width - 1) else F.call_function("shiftright", c, F.lit(width.bit_length() - 1))
    others = [c for c in ranges.columns if c not in keys]
    whole = ranges.where(F.col("row_start") < F.col("row_end"))
    first, last = at(F.col("row_start").cast("bigint")), at(F.col("row_end").cast("bigint") - 1)
    dealt = whole.select(*[F.col(c).alias(n) for c, n in zip(keys, own, strict=True)], *others, F.explode(F.sequence(first, last)).alias(block))
    numbered = rows.withColumn(number, at(F.col(row).cast("bigint")))
    meet = [numbered[number] == dealt[block], *[numbered[c] == dealt[n] for c, n in zip(keys, own, strict=True)]]
    held = (numbered[row] >= dealt["row_start"]) & (numbered[row] < dealt["row_end"])
    return numbered.join(dealt, reduce(lambda a, b: a & b, [*meet, held])).drop(block, number, *own)


def block_ranges(chosen: DataFrame, low: int, high: int, most: int, gap: int = 0) -> list[tuple[int, int]]:
    """At most `most` half-open ranges that hold all row_index of chosen, which lie in low..high. BLOCKS numbers at most come to the driver,
    however many rows are chosen."""
    width = -(-(high - low + 1) // BLOCKS)
    hit = [r["block"] for r in chosen.select(F.floor((F.col("row_index") - low) / width).cast("bigint").alias("block")).distinct().collect()]
    while len(runs := runs_of(hit, gap)) > most:
        gap = max(1, 2 * gap)
    return [(low + a * width, min(high + 1, low + b * width)) for a, b in runs]


def runs_of(rows: list[int], gap: int = GAP) -> list[tuple[int, int]]:
    """The same for the few rows of one search, on the driver."""
    out: list[tuple[int, int]] = []
    for r in sorted(set(rows)):
        if out and r - out[-1][1] <= gap:
            out[-1] = (out[-1][0], r + 1)
        else:
            out.append((r, r + 1))
    return out
