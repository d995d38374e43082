"""Nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shards_for
from .vectors import dimension, distances, k_means, prepared, sample, unit

BLOCK_ROWS = 16_384  # candidates a task compares at a time
QUERY_ROWS = 4_096  # queries a task compares at a time
SAMPLE_ROWS = 4_096  # rows that fit the centroids
CENTROIDS = 16
#: Half width of the error bound in standard deviations: a wider bound reranks more and misses less.
EPSILON = 3.0


class Codes:
    """The rotation and centroids; both are fitted once and travel with the tasks."""

    def __init__(self, vectors: np.ndarray, dim: int, seed: int = 11) -> None:
        self.dim, self.bits = dim, -(-dim // 8) * 8
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))
        self.rotation = (q * np.sign(np.diag(r)))[:dim]
        self.centroids = k_means(unit(vectors), CENTROIDS)

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """Packed bits, cell, length of the residual, its product with its code and with its centroid."""
        cell = distances(u, self.centroids).argmin(axis=1)
        c = self.centroids[cell]
        residual = u - c
        length = np.sqrt((residual * residual).sum(axis=1))
        z = residual @ self.rotation / np.maximum(length, 1e-300)[:, None]
        with_code = np.abs(z).sum(axis=1) / np.sqrt(self.bits)
        return np.packbits(z > 0, axis=1), cell, length, with_code, (residual * c).sum(axis=1)

    def bounds(self, q: np.ndarray, packed: np.ndarray, cell: np.ndarray, length: np.ndarray, with_code: np.ndarray, with_centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, half width) of the cosine of every query with every code."""
        signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
        estimate = np.empty((len(q), len(packed)), np.float32)
        width = np.empty_like(estimate)
        exact = with_code < 1e-9  # the vector is its centroid
        safe = np.where(exact, 1.0, with_code)
        spread = np.where(exact, 0, length * EPSILON * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / np.sqrt(max(1, self.bits - 1)))
        for k in np.unique(cell):
            at = np.flatnonzero(cell == k)
            rest = q - self.centroids[k]
            product = (rest @ self.rotation).astype(np.float32) @ signs[at].T / np.sqrt(self.bits)
            scale = np.where(exact[at], 0, length[at] / safe[at])
            estimate[:, at] = product * scale + with_centroid[at] + (q @ self.centroids[k])[:, None]
            width[:, at] = np.sqrt((rest * rest).sum(axis=1))[:, None] * spread[at] + 1e-5
        return estimate, width


def search_block(codes: Codes, k: int, queries: tuple[np.ndarray, np.ndarray], rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(query id, id, score) of the ``k`` nearest rows of one block for each query."""
    ids = rows["id"].to_numpy()
    x = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(rows), codes.dim)
    packed = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    scalars = [rows[c].to_numpy() for c in ("cell", "length", "with_code", "with_centroid")]
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = []
    for at in range(0, len(queries[0]), 64):
        qid, qv = queries[0][at : at + 64], queries[1][at : at + 64]
        estimate, width = codes.bounds(unit(qv), packed, *scalars)
        qn = np.sqrt(np.einsum("ij,ij->i", qv, qv))

        def score(i: np.ndarray, j: np.ndarray, qv=qv, qn=qn) -> np.ndarray:
            got = np.empty(len(i))
            for a in range(0, len(i), 65_536):
                s = slice(a, a + 65_536)
                got[s] = np.einsum("ij,ij->i", qv[i[s]], x[j[s]]) / (qn[i[s]] * norms[j[s]])
            return got

        own = qid[:, None] == ids[None, :]
        estimate[own] = -np.inf
        first = min(len(ids), 4 * k + 2)
        best = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
        i = np.repeat(np.arange(len(qid)), first)
        exact = np.where(own[i, best.ravel()], -np.inf, score(i, best.ravel())).reshape(len(qid), first)
        least = -np.sort(-exact, axis=1)[:, min(k, first) - 1]  # at least k rows reach this
        i, j = np.nonzero((estimate + width >= least[:, None] - 1e-9) & ~own)
        s = score(i, j)
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((qid[i[rank < k]], ids[j[rank < k]], s[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine of each query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on
    vec_id. Every row gets a code of one bit a component: a random rotation of
    its residual to the nearest of 16 centroids (fitted on 4,096 rows), with
    its length and its products with code and centroid. Queries and rows meet
    in blocks by hash of their ids, so equal vectors are spread. In a block the
    estimates choose a few rows whose exact scores give the k-th best so far;
    every row whose upper bound reaches that is reranked exactly. The bound
    is three standard deviations wide, so a true neighbour is missed about once
    in a thousand. The k best of all blocks remain, ties to the smaller id.

    Null ids and vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part. A row that repeats the
    query's id counts as the query's own (of several vectors, the least bytes
    are the query); other repeated rows count each. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.lit(None).cast("long").alias("label"), "embedding")
    dim = dimension(rows, "embedding")
    base = checkpoint(prepared(rows, dim))
    n = base.count()
    queries = checkpoint(base.where(F.expr(is_query.replace("vec_id", "id"))).groupBy("id").agg(F.min("vec").alias("vec")))
    n_queries = queries.count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = Codes(sample(base, SAMPLE_ROWS), dim)
    blocks, groups = shards_for(n, BLOCK_ROWS), shards_for(n_queries, QUERY_ROWS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float64).reshape(b.num_rows, dim)
                packed, cell, *scalars = codes.encode(unit(x))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("vec"), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(cell, pa.int32()), *map(pa.array, scalars)],
                    ["id", "vec", "code", "cell", "length", "with_code", "with_centroid"],
                )

    def both(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q = np.frombuffer(b"".join(right["vec"]), np.float64).reshape(len(right), dim)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), search_block(codes, k, (right["id"].to_numpy(), q), left))))

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    left = base.mapInArrow(encoded, "id long, vec binary, code binary, cell int, length double, with_code double, with_centroid double")
    left = left.withColumn("block", part(blocks, 1)).withColumn("group", every(groups))
    right = queries.withColumn("group", part(groups, 2)).withColumn("block", every(blocks))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(both, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
