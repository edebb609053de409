"""Document fingerprints: bottom-k sketches of word shingles. DataFrame operations only.

A text's sketch is the SIZE smallest hashes of its set of shingles (WIDTH words; A-Z in lower case; words are runs of bytes other than 32 and
9 to 13; a text with fewer words is one shingle, a text without words has none). A hash is the first 16 hex digits of the MD5 of the words
joined by a space, so order and equality of strings are those of 64-bit numbers. Sketches merge: the sketch of a union is the
bottom k of the sketches' union. Texts are sketched by parts of PART shingles and merged part by part; `merge_sketches` does the same over rows.

Estimates: resemblance is the share of the union's bottom k that both hold; containment the share of a's hashes, below the reach
of b's sketch, that b holds; the number of distinct shingles is (k - 1) over the k-th hash as a fraction, and exact below k.

`edited` pairs every document with the next one by id. The bounds of the parts come from ids, hashes and lengths alone: range
partitions of (id, hash of the text) of PART_BYTES, their least keys in one sorted array. Texts are then shuffled once, to their part; the first
documents of a part also go to the part before, where they only serve as the next of its last document. Next texts are read by a window inside the part.

Edge cases: null text is the empty text; two empty sketches resemble with 1, an empty and another with 0; null ids come first; rows of one
id follow by the text's hash; the last document is followed by the first, a single one by itself; equal rows follow each other, and rows equal in
id and text lie in one part, whose sort spills to disk; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import SPACE, stored, text_of

WIDTH, SIZE = 5, 128
DIGITS = 16
#: Shingles that are sorted at once.
PART = 4096
#: Bytes of text of a part; parts at most.
PART_BYTES, MOST_PARTS = 32 << 20, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bottom(hashes: Column, k: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of the union of the sets of two sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def sketch(text: Column, k: int = SIZE, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text: ascending strings of 16 hex digits."""
    empty = F.array().cast("array<string>")

    def of_words(words: Column) -> Column:
        shingles = F.greatest(F.size(words) - (width - 1), F.lit(1))
        hashed = lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, width), " ")), 1, DIGITS)
        part = lambda p: bottom(F.transform(F.sequence(p, F.least(p + (PART - 1), shingles)), hashed), k)
        parts = F.aggregate(F.sequence(F.lit(1), shingles, F.lit(PART)), empty, lambda acc, p: merged(acc, part(p), k))
        return F.when(F.size(words) > 0, parts).otherwise(empty)

    return let(F.filter(F.split(F.translate(text, UPPER, LOWER), SPACE), lambda w: w != ""), of_words)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated intersection over union of the two sets."""
    share = lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return let(merged(a, b, k), share)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's set that lies in b's."""
    near = F.size(F.filter(a, lambda x: (F.size(b) < k) | (x <= F.element_at(b, -1))))
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).when(near == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / near)


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated size of the set; exact below k."""
    last = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / last)


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """docs with `sketch` and `shingles` (estimated number of distinct shingles)."""
    return docs.withColumn("sketch", sketch(text_of(text_col), k, width)).withColumn("shingles", distinct_shingles(F.col("sketch"), k))


def merge_sketches(sketches: DataFrame, *keys: str, k: int = SIZE) -> DataFrame:
    """keys, sketch: the sketch of the union of all rows of each key (null is a key). No group is gathered: hashes are made distinct by
    partial aggregates, cut to k in each of 16 salts, and then to k."""
    hashes = sketches.select(*keys, F.explode("sketch").alias("hash")).distinct()
    first = Window.partitionBy(*keys, F.substring("hash", -1, 1)).orderBy("hash")
    cut = hashes.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    cut = cut.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("place") <= k)
    found = cut.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    if not keys:
        return found
    every = sketches.select(*keys).distinct()
    same = [every[c].eqNullSafe(found[c]) for c in keys]
    return every.join(found, same, "left").select(*[every[c] for c in keys], F.coalesce("sketch", F.array().cast("array<string>")).alias("sketch"))


def _bounds(rows: DataFrame) -> list[Column]:
    """The least (id, hash) of each range partition of rows(doc_id, hash, size), ascending, at most MOST_PARTS, and every step-th of them, as constants."""
    spark = rows.sparkSession
    light = stored(rows, "ids")
    size = light.agg(F.sum("size")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))
    least = light.repartitionByRange(parts, "doc_id", "hash").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "hash")).alias("low"))
    every = F.array_sort(F.array_distinct(F.collect_list("low")))
    row = least.agg(F.to_json(every).alias("every"), F.size(every).alias("n")).first()
    step = max(1, math.isqrt(row["n"]))
    known = F.from_json(F.lit(row["every"]), f"array<struct<doc_id:{dict(light.dtypes)['doc_id']},hash:bigint>>")
    return [known, F.filter(known, lambda x, i: i % step == 0), F.lit(step)]


def edited(docs: DataFrame, text_col: str = "text", k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, text, edited, sketch, edited_sketch, next_sketch for each row: `edited` has the last floor(n_chars / 2) code points replaced
    by the first as many (or all) of the next document by id."""
    rows = docs.select("doc_id", text_of(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    every, coarse, step = _bounds(rows.select("doc_id", "hash", F.octet_length("text").cast("bigint").alias("size")))
    own = F.struct("doc_id", "hash")
    reached = lambda among: F.size(F.filter(among, lambda x: x <= own))
    # The part: bounds at or below the row's key, found among every step-th bound first.
    rows = rows.withColumn("far", (F.greatest(reached(coarse), F.lit(1)) - 1) * step)
    rows = rows.withColumn("part", F.greatest(F.col("far") + reached(F.slice(every, F.col("far") + 1, step)), F.lit(1)))
    before = F.when(F.col("part") > 1, F.col("part") - 1).otherwise(F.size(every))
    place = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    places = F.when(F.element_at(every, F.col("part")) == own, F.array(place(F.col("part"), False), place(before, True))).otherwise(F.array(place(F.col("part"), False)))
    dealt = rows.select("doc_id", "hash", "text", F.explode(places).alias("at")).select("doc_id", "hash", "text", "at.part", "at.guest").repartition("part")
    # Sketches are made behind the shuffle, so they do not travel.
    held = dealt.withColumn("held", F.struct("text", sketch(F.col("text"), k, width).alias("sketch")))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "hash")
    pairs = held.withColumn("next", F.lead("held").over(order)).where(~F.col("guest"))
    n_chars = F.length("held.text")
    half = F.expr("cast(length(held.text) div 2 as int)")
    out = pairs.select("doc_id", n_chars.cast("bigint").alias("n_chars"), "held", "next.sketch", F.concat(F.substring("held.text", F.lit(1), n_chars - half), F.substring("next.text", F.lit(1), half)).alias("edited"))
    out = out.withColumnRenamed("sketch", "next_sketch")
    return out.select("doc_id", "n_chars", F.col("held.text").alias("text"), "edited", F.col("held.sketch").alias("sketch"), sketch(F.col("edited"), k, width).alias("edited_sketch"), "next_sketch")
