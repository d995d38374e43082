"""Exact top-k inner products, term at a time, over integer vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shards_for

SCALE = 1024
BLOCK_ROWS = 32_768  # rows of a block: the length of a dense score array
QUERY_ROWS = 8_192  # queries of a group; rows are read once a group
LONG_MAX = 2**63 - 1
#: Products and sums below this stay exact in 64-bit integers.
SAFE = 1 << 62


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where they fit, else as Python integers. ``scale`` is a power of two."""
    if not len(x) or np.abs(x).max() < 2.0**40:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(np.floor(v * scale)) if abs(v) < 2.0**60 else int(v) * scale for v in x.tolist()], object)


def flattened(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, integer weight) of all components that are not zero after quantising."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    flat = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if sizes.sum() else np.zeros(0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = quantised(flat)
    keep = np.flatnonzero(weight != 0)
    return row[keep], term[keep], weight[keep]


class Postings:
    """The posting lists of a block: for each term the rows that hold it and their weights."""

    def __init__(self, vectors: pd.Series) -> None:
        self.rows = len(vectors)
        row, term, weight = flattened(vectors)
        self.exact = weight.dtype != object
        self.largest = int(np.abs(weight).max()) if len(weight) else 0
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order]
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, np.int64)
        self.lists = {}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            # A list of all rows needs no positions: the whole array is added.
            self.lists[int(term[a])] = (None if b - a == self.rows else row[a:b], weight[a:b])

    def scores(self, terms: list[int], weights: list[int]) -> np.ndarray:
        """The inner products of one sparse query with all rows; rows that share no term score 0."""
        largest = max(map(abs, weights), default=0)
        small = self.exact and self.largest * largest * max(1, len(terms)) < SAFE
        score = np.zeros(self.rows, np.int64 if small else object)
        for t, w in zip(terms, weights):
            if t in self.lists:
                at, own = self.lists[t]
                add = own * w if small else own.astype(object) * w
                if at is None:
                    score += add
                else:
                    score[at] += add
        if small:
            return score
        return np.array([min(max(s, -LONG_MAX), LONG_MAX) for s in score], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller id; ``ids`` ascend."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        at = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))]


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score) of the ``k`` best rows of a block for each query; rows of the query's id are its own."""
    rows = rows.sort_values("id", kind="stable")
    ids = rows["id"].to_numpy()
    postings = Postings(rows["embedding"])
    qrow, term, weight = flattened(queries["embedding"])
    edges = np.searchsorted(qrow, np.arange(len(queries) + 1))
    term, weight = term.tolist(), weight.tolist()
    found = []
    for q, (qid, a, b) in enumerate(zip(queries["id"].tolist(), edges[:-1].tolist(), edges[1:].tolist())):
        score = postings.scores(term[a:b], weight[a:b])
        lo, hi = np.searchsorted(ids, [qid, qid + 1]) if qid < LONG_MAX else (np.searchsorted(ids, qid), len(ids))
        others = np.delete(np.arange(len(ids)), slice(lo, hi)) if hi > lo else None
        at = best(score, ids, k) if others is None else others[best(score[others], ids[others], k)]
        found.append((np.full(len(at), qid), ids[at], score[at]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*found)))))


def top_products(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest integer inner product of each query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on
    vec_id. Components become floor(1024 x). Queries and rows meet in blocks:
    rows are dealt by a hash, and a block's posting lists
    (component number to rows and weights) are read term at a time, each query
    scattering its weighted postings into a dense array of the block's scores.
    A partition selects the block's ``k`` best, and the best of all blocks are
    merged, ties to the smaller vec_id. Nothing is skipped: every row is scored.

    Null ids, null vectors and vectors that hold null or non-finite components
    take no part; zero and empty vectors do and score 0; of vectors of unequal
    length the shared components count. Rows that repeat a query's id
    count as the query's own (of several vectors the least is the query);
    other repeated rows count each. Scores beyond +-(2^63 - 1) stop there. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = checkpoint(rows.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~bad))
    queries = checkpoint(rows.where(F.expr(is_query.replace("vec_id", "id"))).groupBy("id").agg(F.min("embedding").alias("embedding")))
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, groups = shards_for(rows.count(), BLOCK_ROWS), shards_for(n_queries, QUERY_ROWS)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Where a row lies in the written table is part of its hash, so copies spread and a lost task deals alike.
    place = F.pmod(F.xxhash64("id", "embedding", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    left = rows.withColumn("block", place).withColumn("group", every(groups))
    right = queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(left, right, k)

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(both, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
