"""Reading embedding columns in tasks, and a small k-means for bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the usable rows: ``dim`` finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.list_(pa.float64()))
    width = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1))
    at = np.flatnonzero(width == dim)
    taken = lists.take(pa.array(at))
    flat = np.asarray(pa.compute.fill_null(taken.flatten(), float("nan")), np.float64).reshape(-1, dim)
    fine = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return at[fine], np.ascontiguousarray(flat[fine])


def dimension(df: DataFrame, column: str) -> int:
    """The most frequent length of a vector column (the smaller of equals; 0 for none)."""
    got = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return got["d"] if got else 0


def prepared(df: DataFrame, dim: int, dtype: type = np.float64) -> DataFrame:
    """(id, label, vec) with the usable vectors as little-endian doubles, or ``dtype``; ``df`` has id, label, embedding.

    Rows with a null id, or a vector that is null, zero, of another length, or
    holds null or non-finite components are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = matrix(b.column("embedding"), dim)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(keep), b.column("label").take(keep), pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())], ["id", "label", "vec"]
            )

    return df.where("id IS NOT NULL").mapInArrow(rows, "id long, label long, vec binary")


def sample(vectors: DataFrame, rows: int, dtype: type = np.float64) -> np.ndarray:
    """At most ``rows`` vectors of (id, vec), those with the smallest hash of id, on the driver."""
    got = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    return np.stack([np.frombuffer(r["vec"], dtype) for r in got]).astype(np.float64) if got else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the square
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample; fewer than ``k`` if it has fewer distinct rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))
