"""MinHash near-duplicates with odd sketches.

A document is its set of distinct word shingles. MinHash samples give band keys for the candidate search, and
are folded into a parity bitmap, the odd sketch (Mitzenmacher, Pagh and Pham, 2014): the population count of the
XOR of two sketches estimates high similarities closely, and candidates far below the threshold go. A second, longer
sketch folds the whole set: its count never exceeds the number of shingles in which two sets differ, so more than
the threshold allows means no link, and in texts of usual length few other pairs pass. What is left is confirmed on
the full sets, made anew from the texts.

Documents with equal sets are one class, represented by its least id. Classes in a bucket are not paired with
each other; links are sought in steps, of which each asks only for classes that are not yet connected:

1. stars: each class is compared with the best by sketch of the centres of its buckets. The centre of a bucket
   is first the class that meets most others in all its buckets (the original among its copies), then another one;
2. rest: in buckets that still hold several components, every class outside the largest of them is compared with
   all classes of other components whose sketches are near;
3. hot buckets: a bucket in which step 2 would form more than MOST_PAIRS pairs (many texts around one passage, similar to
   none) is not paired. Its classes are joined by the rarest shingles of their full sets instead, which loses no link:
   if sets of n <= m shingles are similar by t, the first n - ceil(2tn / (1 + t)) + 1 of the one and m - ceil(tm) + 1 of the
   other share a shingle, in any common order of shingles (prefix filter). From rare to common, the passage of
   all comes last; a set in whose short prefix it stands consists of it so far that it is similar to its like.

So two classes that share a bucket and are similar end up in one component, whatever the size of the bucket,
and a group of copies costs about one comparison per class. Bands are chosen so that a pair at the threshold
shares no bucket with a probability of at most MISS; pairs above it do so even less.

Edge cases: null texts, empty texts and texts without words have an empty set and are linked with nothing;
equal rows are one class; a class whose rows have no id is linked with nothing and has no component; rows that share an id with different texts are one node, linked if any of the texts is;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored, text_of
from nearfield.llm.components import connected_components
from nearfield.llm.shingles import common, mix, shingle_sets, stream

MISS, MOST_SAMPLES = 1e-5, 112
SKETCH_WORDS, SET_WORDS = 8, 32
_ROWS = 64  # texts that numpy takes at once
MOST_PAIRS = 10_000  # of a bucket in the last step; larger ones go by rare shingles


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which MISS holds at the threshold within MOST_SAMPLES samples."""
    best = (MOST_SAMPLES, 1)
    for rows in range(1, 13):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(math.log(MISS) / math.log(1 - share))
        if bands * rows <= MOST_SAMPLES:
            best = (bands, rows)
    return best


def sketch_limit(percent: int, samples: int) -> int:
    """Most differing bits of a pair at the threshold: each sample that differs flips two, six deviations allowed."""
    p = 1 - percent / 100
    return 2 * math.ceil(samples * p + 6 * math.sqrt(samples * p * (1 - p)) + 1)


def minhashes(s: np.ndarray, samples: int) -> np.ndarray:
    xor, odd = stream(3, samples), stream(4, samples) | np.uint64(1)
    out = np.full(samples, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        out = np.minimum(out, ((s[at : at + 2048, None] ^ xor) * odd).min(0))
    return out


def odd_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The parity bitmap of hashes, as 64-bit words."""
    place = mix(hashes + np.uint64(words)) % np.uint64(64 * words)
    bits = (np.bincount(place.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8")


def _signer(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, turn, number = stream(6, bands), stream(7, rows) | np.uint64(1), stream(5, bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                sets = shingle_sets([t.encode() for t in part.column("text").to_pylist()], width)
                keys, sketches, classes = [], [], ([], [])
                for s in sets:
                    m = minhashes(s, bands * rows)
                    keys.append(mix((m.reshape(bands, rows) * turn).sum(1) + salt).view(np.int64) if len(s) else [])
                    # a sample counts with its number: equal values of different samples must not cancel
                    sketches.append(np.concatenate([odd_sketch(m ^ number, SKETCH_WORDS), odd_sketch(s, SET_WORDS)]))
                    classes[0].append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                    classes[1].append(int(mix(s ^ salt[0]).sum().view(np.int64)) if len(s) else 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.int64()) for c in classes), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "c1", "c2", "bands", "sketch"])

    return run


def _confirmer(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                sides = [[t.encode() for t in part.column(c).to_pylist()] for c in ("text_a", "text_b")]
                sets = shingle_sets(sides[0] + sides[1], width)
                for i, (x, y) in enumerate(zip(sets[: part.num_rows], sets[part.num_rows :], strict=True)):
                    n = common(x, y)
                    if n and 100 * n >= percent * (len(x) + len(y) - n):
                        a.append(part.column("a")[i].as_py())
                        b.append(part.column("b")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _hot_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                sets = shingle_sets([t.encode() for t in part.column("text").to_pylist()], width)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("comp"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "comp", "shingles"])

    return run


def _by_rare_shingles(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b of texts (rep, comp, text) of different components whose prefixes of rare shingles share one."""
    sets = stored(texts.distinct().mapInArrow(_hot_sets(width), "rep bigint, comp bigint, shingles array<bigint>"), "hot-sets")
    sets = sets.where(F.size("shingles") > 0).withColumn("size", F.size("shingles").cast("long"))
    flat = sets.select("rep", "comp", "size", F.xxhash64("shingles").alias("set"), F.explode("shingles").alias("shingle"))
    # A shingle of one set only comes first in the order and meets nothing: its place is counted, it does not travel.
    shared = stored(flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hot-shingles")
    ordered = flat.join(shared, "shingle").groupBy("rep", "comp", "size", "set").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("common"))
    alone = F.col("size") - F.size("common")
    short = F.expr(f"size - (2 * {percent} * size + {99 + percent}) div {100 + percent} + 1")
    long = F.expr(f"size - ({percent} * size + 99) div 100 + 1")
    ordered = ordered.select("rep", "comp", "size", alone.alias("alone"), short.alias("short"), F.slice("common", F.lit(1), F.greatest(F.lit(0), long - alone).cast("int")).alias("common"))
    # left: how many shingles of the set come no earlier than this one
    placed = ordered.select("rep", "comp", "size", "short", "alone", F.posexplode("common").alias("at", "top")).withColumn("place", F.col("alone") + F.col("at"))
    prefixes = stored(placed.select("rep", "comp", "size", F.col("top.shingle").alias("shingle"), (F.col("size") - F.col("place")).alias("left"), (F.col("place") < F.col("short")).alias("short")), "hot-prefixes")
    first, second = (prefixes.select("shingle", F.col("rep").alias(s), F.col("comp").alias(f"comp_{s}"), F.col("size").alias(f"size_{s}"), F.col("left").alias(f"left_{s}"), F.col("short").alias(f"short_{s}")) for s in ("a", "b"))
    # The first shingle that two sets share has all others of both behind it: too few left means no link by this one.
    enough = f"least(left_a, left_b) * {100 + percent} >= {percent} * (size_a + size_b)"
    pairs = first.where("short_a").join(second, "shingle").where(f"comp_a <> comp_b and size_a <= size_b and 100 * size_a >= {percent} * size_b and {enough}")
    return pairs.select("a", "b").distinct()


def _distance(a: str, b: str, low: int = 0, high: int = SKETCH_WORDS) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(low, high)))


def _near(percent: int, limit: int) -> Column:
    """If the sketches of sides a and b allow a link."""
    differ = _distance("sketch_a", "sketch_b", SKETCH_WORDS, SKETCH_WORDS + SET_WORDS)
    return (_distance("sketch_a", "sketch_b") <= limit) & (differ * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; links have similarity of percent / 100 or more."""
    bands, rows = banding(percent)
    limit = sketch_limit(percent, bands * rows)
    texts = docs.select("doc_id", text_of(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signer(width, bands, rows), "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, bands array<bigint>, sketch array<bigint>"), "signatures")
    classes = stored(signed.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    member = classes.where("rep is not null").select(F.col("rep"), F.explode("bands").alias("bucket"))
    # Small tables are stored before a join, so that the join may split a large bucket.
    shared = stored(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    member = stored(member.join(shared, "bucket"), "members")
    central = member.groupBy("rep").agg(F.sum("n").alias("central"))
    sketches = classes.select("rep", "size", "sketch")
    kept_texts = stored(texts.join(member.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "candidate-texts")
    side = lambda s: kept_texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))

    def near(pairs: DataFrame) -> DataFrame:
        """a, b, distance of the pairs whose sketches are near."""
        for s in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("rep").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}")), s)
        return pairs.where(_near(percent, limit)).select("a", "b", _distance("sketch_a", "sketch_b").alias("distance"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(width, percent), "a bigint, b bigint")

    # Joins with a row per document are merge joins at any size, as a broadcast costs the driver memory and a thread.
    comps = None
    for step in range(3):
        if comps is None:
            placed = member.join(central.hint("merge"), "rep").select("bucket", "rep", F.col("rep").alias("comp"), F.col("central").alias("order"))
        else:
            placed = member.join(comps.hint("merge"), member["rep"] == comps["node"], "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"), F.xxhash64("rep", "bucket").alias("order"))
            mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
            placed = stored(placed.join(stored(mixed, f"mixed-{step}"), "bucket"), f"placed-{step}")
            if placed.isEmpty():
                break
        if step < 2:
            centre = placed.groupBy("bucket").agg(F.max(F.struct("order", (-F.col("rep")).alias("rep"), "comp")).alias("top")).select("bucket", (-F.col("top.rep")).alias("b"), F.col("top.comp").alias("comp_b"))
            pairs = placed.join(stored(centre, f"centres-{step}"), "bucket").where("comp <> comp_b").select(F.col("rep").alias("a"), "b").distinct()
            pairs = near(pairs).groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
        else:
            counts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n"))
            counts = stored(counts.select("bucket", "major", ((F.col("n") - F.col("most")) * F.col("n") > MOST_PAIRS).alias("hot")), "majors")
            held, major = placed.join(sketches, "rep"), counts.where("not hot").select("bucket", "major")
            left = held.join(major, "bucket").where("comp <> major").select("bucket", F.col("rep").alias("a"), F.col("comp").alias("comp_a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
            right = held.join(major, "bucket").select("bucket", F.col("rep").alias("b"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"), (F.col("comp") == F.col("major")).alias("in_major"))
            far = (left["bucket"] == right["bucket"]) & (F.col("comp_a") != F.col("comp_b")) & (F.col("in_major") | (F.col("a") < F.col("b")))
            pairs = left.join(right, far & _near(percent, limit)).select("a", "b")
            hot = stored(placed.join(counts.where("hot").select("bucket"), "bucket").select("rep", "comp").distinct(), "hot")
            if not hot.isEmpty():
                hot_texts = kept_texts.join(hot.hint("merge"), kept_texts["doc_id"] == hot["rep"]).select("rep", "comp", "text")
                pairs = pairs.unionByName(near(_by_rare_shingles(hot_texts, width, percent)).select("a", "b"))
            pairs = pairs.distinct()
        links = confirmed(pairs)
        if comps is not None:
            links = stored(links, f"links-{step}")
            if links.isEmpty():  # the components stay as they are
                continue
            links = links.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        comps = connected_components(links)
    named = classes.select("c1", "c2", "rep").join(comps.hint("merge"), F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("comp", "rep").alias("comp"))
    filled = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that represent their group: those with its least id, and of rows that share
    this id one. Rows without an id are all kept."""
    kept = near_duplicates(docs, width, percent, text_col).where("kept").select("doc_id").distinct()
    place = Window.partitionBy("doc_id").orderBy(text_of(text_col))
    # A merge join at any size: the ids grow with the documents.
    first = f"place_{uuid.uuid4().hex}"
    one = docs.join(stored(kept, "kept").hint("merge"), "doc_id", "left_semi").withColumn(first, F.row_number().over(place)).where(F.col(first) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
