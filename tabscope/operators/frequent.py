"""Exact most frequent values without shuffling values that occur rarely.

Counting every value sends each distinct one through the shuffle. Here a pass
keeps Misra-Gries counters of value hashes in every task and merges them;
only the candidates that remain are then counted, by their values. The pass
knows how often a value it dropped can occur at most. Where the k-th best
candidate occurs more often than that, the result is proven exact. Columns
without that proof are counted by 64-bit hashes; if no hash repeats, all values
are different and the k smallest are the answer; else the values are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

COUNTERS = 4_096  # values a column that a task keeps at least
FAN_IN = 64  # states merged at a time
STATE = "c int, part int, dropped long, hashes binary, counts binary"


def trimmed(hashes: np.ndarray, counts: np.ndarray, dropped: int, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``keep`` counters: all are lowered by the next largest count, which adds to what a value can have lost."""
    if len(hashes) <= keep:
        return hashes, counts, dropped
    cut = int(np.partition(counts, len(counts) - keep - 1)[len(counts) - keep - 1])
    left = counts > cut
    return hashes[left], counts[left] - cut, dropped + cut


def added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes with the sums of their counts."""
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.zeros(len(known), np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return known, sums


def _states(long: DataFrame, counters: int) -> DataFrame:
    """One state a column: its counters, and the most that a value without one can occur."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            code, h = np.asarray(b.column("c")), np.asarray(b.column("h"))
            for c in np.unique(code).tolist():
                found, n = np.unique(h[code == c], return_counts=True)
                old = held.get(c, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
                hashes, counts = added([old[0], found], [old[1], n.astype(np.int64)])
                held[c] = trimmed(hashes, counts, old[2], counters) if len(hashes) > 2 * counters else (hashes, counts, old[2])
        part, rows = TaskContext.get().partitionId(), []
        for c, s in held.items():
            hashes, counts, dropped = trimmed(*s, counters)
            rows.append((c, part, dropped, hashes.tobytes(), counts.tobytes()))
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["c", "part", "dropped", "hashes", "counts"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.frombuffer(x, np.int64) for x in group[f]] for f in ("hashes", "counts")]
        hashes, counts, dropped = trimmed(*added(*parts), int(group["dropped"].sum()), counters)
        return pd.DataFrame({"c": [group["c"].iloc[0]], "part": [group["part"].min()], "dropped": [dropped], "hashes": [hashes.tobytes()], "counts": [counts.tobytes()]})

    some = long.select("c", "h").mapInArrow(fold, STATE).groupBy("c", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, STATE)
    return some.groupBy("c").applyInPandas(merge, STATE)


def _candidates(states: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, h in zip(b.column("c").to_pylist(), b.column("hashes").to_pylist()):
                own = np.frombuffer(h, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(own)], ["c", "h"])

    return states.mapInArrow(rows, "c int, h long")


def _best(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("c").orderBy(F.desc("cnt"), F.asc("d"), F.asc("s"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("c", "rank", "s", "d", "cnt")


def frequent_values(long: DataFrame, k: int, counters: int = COUNTERS) -> DataFrame:
    """(c, rank, s, d, cnt): the ``k`` most frequent values of each column; ties by ``d``, then ``s``, nulls first.

    ``long`` holds a row a value: the column's number ``c`` (int) and the value
    as ``s`` (text) or ``d`` (double), rows without a value left out. ``counters`` changes the cost, not the
    result. Written to the checkpoint folder. No rows give an empty result.
    """
    ensure_checkpoint_dir(long.sparkSession)
    long = long.select(F.col("c").cast("int").alias("c"), "s", "d", F.xxhash64("s", "d").alias("h"))
    if k > counters:  # more values are asked for than a task may hold
        return _best(long.groupBy("c", "s", "d").agg(F.count(F.lit(1)).alias("cnt")), k).checkpoint()
    states = _states(long, counters).checkpoint()
    few = F.broadcast(_candidates(states))  # at most ``counters`` rows a column
    counted = long.join(few, ["c", "h"]).groupBy("c", "s", "d").agg(F.count(F.lit(1)).alias("cnt"))
    best = _best(counted, k).checkpoint()
    proof = states.select("c", "dropped").join(best.groupBy("c").agg(F.max("rank").alias("n"), F.min("cnt").alias("least")), "c", "left")
    open_columns = [r["c"] for r in proof.where("dropped > 0 AND (n IS NULL OR n < %d OR least <= dropped)" % k).select("c").collect()]  # a number a column
    if not open_columns:
        return best
    rest = long.where(F.col("c").isin(open_columns))
    hashes = rest.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max("n").alias("most"))
    different = [r["c"] for r in hashes.where("most = 1").collect()]
    out = best.where(~F.col("c").isin(open_columns))
    if different:
        smallest = Window.partitionBy("c").orderBy(F.asc("d"), F.asc("s"))
        own = rest.where(F.col("c").isin(different)).withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= k)
        out = out.unionAll(own.select("c", "rank", "s", "d", F.lit(1).cast("long")))
    others = sorted(set(open_columns) - set(different))
    if others:
        counted = rest.where(F.col("c").isin(others)).groupBy("c", "s", "d").agg(F.count(F.lit(1)).alias("cnt"))
        out = out.unionAll(_best(counted, k))
    return out.checkpoint()
