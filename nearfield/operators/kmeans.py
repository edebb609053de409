"""Binary k-means over sign codes: Hamming assignment, bit-majority update.

Codes stay distributed. An iteration sends the centroids (k codes, k about sqrt(N) / 2) to the tasks as one packed
matrix, which numpy compares with blocks of rows; each task passes on one row of bit counts for each cluster that it has
seen, these are summed by cluster, and one row a cluster comes back. The random numbers are drawn on the driver in a fixed order, so
results do not depend on partitioning.

The flat way compares N codes with k centroids. two_level_kmeans compares each with about sqrt(k) coarse centroids, and then with the
centroids below the nearest of these, about sqrt(k) again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from nearfield.functions.vectors import WORD_BITS

ITERATIONS, SEED = 6, 1
_WORD = 1 << 64
#: Distances that a task holds at once.
PAIRS = 1 << 20
#: Rows drawn for each cluster to begin two levels with.
FIRST = 4


class Lcg:
    """state = state * 1664525 + 1013904223 modulo 2**32; a seed of 0 counts as 1."""

    def __init__(self, seed: int = SEED) -> None:
        self.state = seed % (1 << 32) or 1

    def below(self, n: int) -> int:
        self.state = (self.state * 1664525 + 1013904223) % (1 << 32)
        return self.state % n

    def distinct(self, n: int, k: int) -> list[int]:
        """k different numbers below n, in the order of their drawing."""
        found: dict[int, None] = {}
        while len(found) < k:
            found[self.below(n)] = None
        return list(found)

    def uniform(self) -> float:
        self.state = (self.state * 1664525 + 1013904223) % (1 << 32)
        return self.state / (1 << 32) * 2 - 1


def signed(word: int) -> int:
    return word - _WORD if word >= _WORD >> 1 else word


def code_literal(code: list[int]) -> Column:
    return F.array(*[F.lit(signed(w % _WORD)).cast("bigint") for w in code])


def distance(a: list[int], b: list[int]) -> int:
    return sum(((x ^ y) % _WORD).bit_count() for x, y in zip(a, b, strict=True))


def matrix(codes: list[list[int]], words: int = 1) -> np.ndarray:
    """Codes as rows of unsigned 64-bit words."""
    return np.array([[w % _WORD for w in c] for c in codes], np.uint64).reshape(len(codes), len(codes[0]) if codes else words)


def nearest(codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each code the number of the centroid of least Hamming distance, the first of equals."""
    out = np.empty(len(codes), np.int32)
    step = max(1, PAIRS // max(1, len(centroids)))
    for at in range(0, len(codes), step):
        part = codes[at : at + step]
        far = np.zeros((len(part), len(centroids)), np.uint16)
        for w in range(codes.shape[1]):
            far += np.bitwise_count(part[:, w, None] ^ centroids[None, :, w])
        out[at : at + step] = far.argmin(1)
    return out


@dataclass
class TwoLevel:
    """Centroids below coarse centroids: those of coarse centroid p are fine[heads[p]:heads[p + 1]]."""

    coarse: np.ndarray
    fine: np.ndarray
    heads: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return self.fine.shape

    def nearest(self, codes: np.ndarray) -> np.ndarray:
        """The nearest centroid below the nearest coarse one, the first of equals."""
        parent, out = nearest(codes, self.coarse), np.empty(len(codes), np.int32)
        order = np.argsort(parent, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1):
            if len(rows):
                at, end = self.heads[parent[rows[0]]], self.heads[parent[rows[0]] + 1]
                out[rows] = at + nearest(codes[rows], self.fine[at:end])
        return out


def _sendable(centroids: list[list[int]] | TwoLevel) -> np.ndarray | TwoLevel:
    return centroids if isinstance(centroids, TwoLevel) else matrix(centroids)


def _find(codes: np.ndarray, sent: np.ndarray | TwoLevel) -> np.ndarray:
    return sent.nearest(codes) if isinstance(sent, TwoLevel) else nearest(codes, sent)


def _codes_of(batch: pa.RecordBatch, words: int) -> np.ndarray:
    return batch.column("code").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, words)


def _assign(rows: DataFrame, centroids: list[list[int]] | TwoLevel) -> DataFrame:
    """rows(code, ...) with `cluster`."""
    sent = rows.sparkSession.sparkContext.broadcast(_sendable(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _find(_codes_of(batch, sent.value.shape[1]), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "cluster"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cluster", IntegerType())]))


def cluster_counts(rows: DataFrame, dimension: int, centroids: list[list[int]] | TwoLevel) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, rows that have each bit set) of an assignment to centroids."""
    sent = rows.sparkSession.sparkContext.broadcast(_sendable(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, words = sent.value.shape
        n, ones = np.zeros(k, np.int64), np.zeros((k, words * WORD_BITS), np.int64)
        for batch in batches:
            codes = _codes_of(batch, words)
            found = _find(codes, sent.value)
            n += np.bincount(found, minlength=k)
            order = np.argsort(found, kind="stable")
            heads = np.flatnonzero(np.diff(found[order], prepend=-1))
            for at in range(0, words):  # one word at a time bounds the bits held
                bits = np.unpackbits(codes[order, at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if len(heads):
                    ones[found[order][heads], at * WORD_BITS : (at + 1) * WORD_BITS] += np.add.reduceat(bits.astype(np.int64), heads, axis=0)
        seen = np.flatnonzero(n)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64()), pa.array(list(ones[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "ones"])

    counted = rows.select("code").mapInArrow(run, "cluster int, n bigint, ones array<bigint>")
    sums = counted.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("ones", F.lit(i))).alias(f"b{i}") for i in range(dimension)])
    found = {r["cluster"]: (r["n"], [r[f"b{i}"] for i in range(dimension)]) for r in sums.collect()}  # a row per centroid
    sent.unpersist()
    return found


@dataclass
class Clustering:
    centroids: list[list[int]]
    #: The rows given, with `cluster`.
    assigned: DataFrame


def _codes_at(rows: DataFrame, places: list[int]) -> list[list[int]]:
    found = {r["ordinal"]: list(r["code"]) for r in rows.where(F.col("ordinal").isin(sorted(set(places)))).select("ordinal", "code").collect()}
    return [found[p] for p in places]


def bit_counts(assigned: DataFrame, dimension: int) -> DataFrame:
    """cluster, n, ones: rows of each cluster and, for each bit, how many have it set."""
    bit = lambda i: F.expr(f"cast(shiftright(code[{i // WORD_BITS}], {i % WORD_BITS}) & 1 as bigint)")
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(dimension)]).select("cluster", "n", F.array(*[f"b{i}" for i in range(dimension)]).alias("ones"))


def binary_kmeans(rows: DataFrame, dimension: int, k: int, iterations: int = ITERATIONS, seed: int = SEED) -> Clustering:
    """Cluster rows(ordinal 0..N-1, code, ...). The last iteration assigns without an update; an empty cluster is drawn anew."""
    n = rows.count()
    if n == 0:
        return Clustering([], rows.withColumn("cluster", F.lit(0)))
    k, rng = min(k, n), Lcg(seed)
    centroids = _codes_at(rows, rng.distinct(n, k))
    if iterations < 1:
        return Clustering(centroids, rows.withColumn("cluster", F.lit(0)))
    for _ in range(iterations - 1):
        counts = cluster_counts(rows, dimension, centroids)
        for c in range(k):
            if c not in counts:
                centroids[c] = _codes_at(rows, [rng.below(n)])[0]
                continue
            centroids[c] = _majority(*counts[c], len(centroids[c]))
    return Clustering(centroids, _assign(rows, centroids))


def _majority(size: int, ones: list[int], words: int) -> list[int]:
    """The code of the bits that more than half of the rows have set."""
    out = [0] * words
    for i in np.flatnonzero(np.array(ones) > size // 2).tolist():
        out[i // WORD_BITS] |= 1 << i % WORD_BITS
    return out


def two_level_kmeans(rows: DataFrame, dimension: int, k: int, iterations: int = ITERATIONS, seed: int = SEED) -> Clustering:
    """Cluster rows(ordinal 0..N-1, code, ...) into at most k clusters by 2 sqrt(k) comparisons a row instead of k.

    About sqrt(k) coarse centroids are fitted to all rows. FIRST * k rows, drawn like those of the flat way, give each of them a share of the k
    centroids by the rows nearest to it, and the first different codes of these to begin with. All rows then fit the centroids below their
    coarse one; a centroid without rows stays as it is. There are fewer than k if too few different codes were drawn.
    """
    n = rows.count()
    k = min(k, n)
    if k < 4 or iterations < 1:
        return binary_kmeans(rows, dimension, k, iterations, seed)
    coarse = matrix(binary_kmeans(rows, dimension, round(k**0.5), iterations, seed).centroids)
    places = Lcg(seed + 1).distinct(n, min(n, FIRST * k))
    drawn = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(places)], "ordinal bigint, turn int")
    first = rows.join(F.broadcast(drawn), "ordinal").select("turn", "code").collect()  # FIRST * k codes
    codes = matrix([list(r["code"]) for r in sorted(first, key=lambda r: r["turn"])])
    parent, below, heads = nearest(codes, coarse), [], [0]
    own = np.bincount(parent, minlength=len(coarse))
    exact = own * (k - len(coarse)) / len(codes)
    shares = 1 + np.floor(exact).astype(int)
    shares[np.argsort(-(exact % 1), kind="stable")[: k - int(shares.sum())]] += 1
    for p, share in enumerate(shares.tolist()):
        mine = list(dict.fromkeys(map(tuple, codes[parent == p].tolist())))[:share] or [tuple(coarse[p].tolist())]
        below += mine
        heads.append(len(below))
    fine = matrix([list(c) for c in below])
    for _ in range(iterations - 1):
        found = cluster_counts(rows, dimension, TwoLevel(coarse, fine, np.array(heads)))
        fine = matrix([_majority(*found[c], fine.shape[1]) if c in found else fine[c].tolist() for c in range(len(fine))])
    levels = TwoLevel(coarse, fine, np.array(heads))
    return Clustering([[signed(w) for w in c] for c in fine.tolist()], _assign(rows, levels))


def reorder(centroids: list[list[int]]) -> list[int]:
    """New number of each centroid: a walk from the one nearest to all zeros, each time to the nearest not yet seen."""
    if not centroids:
        return []
    codes = matrix(centroids)
    here, seen, out = np.zeros(codes.shape[1], np.uint64), np.zeros(len(codes), np.int64), [0] * len(codes)
    for place in range(len(codes)):
        c = int((np.bitwise_count(codes ^ here).sum(1, dtype=np.int64) + seen).argmin())
        out[c], here = place, codes[c]
        seen[c] = 1 << 40
    return out
