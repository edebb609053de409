"""Seeded vectors and a plain search to compare with."""

import numpy as np

from nearfield.operators.kmeans import Lcg


def make_vectors(n, dim, seed=1):
    rng = Lcg(seed)
    return [(i, f"vec-{i}", [float(np.float32(rng.uniform())) for _ in range(dim)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "n bigint, id string, vector array<float>")


def scores(rows, q, metric):
    a, q = np.array([r[2] for r in rows], float), np.array(q, float)
    if metric == "euclidean":
        return np.sqrt(((a - q) ** 2).sum(1))
    d = (a * q).sum(1)
    if metric == "dot":
        return d
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(q)
    return np.where(norms == 0, 0, d / np.where(norms == 0, 1, norms))


def nearest(rows, q, k, metric="cosine"):
    s = scores(rows, q, metric)
    sign = 1 if metric == "euclidean" else -1
    return [rows[i][1] for i in sorted(range(len(rows)), key=lambda i: (sign * s[i], i))[:k]]


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]
