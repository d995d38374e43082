"""Pairwise-complete correlation from mergeable centred moments, one scan and no pass for the means.

Every task folds its rows into a state for each pair of columns: the number of
rows that hold both, the two means, the two centred sums of squares and the
centred sum of products. Two states are merged by Chan's update, so no fixed
shift has to suit all the data. The states of 64 partitions are merged at a
time, then the rest: a task sees at most 64 states of one column, or one in 64
of all partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64
FIELDS = ("n", "mean", "other", "square", "product", "low", "high")


def pair_moments(base: DataFrame, names: list[str]):
    """Matrices by field for the columns ``names``: [i, j] describes column i over the rows that hold i and j.

    ``mean``, ``square``, ``low`` and ``high`` are of column i, ``other`` is the mean of
    column j, ``product`` the centred sum of products. Values that are not finite count as missing.
    """
    import numpy as np

    width = len(names)
    columns = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)]

    def merged(a: dict, b: dict) -> dict:
        n = a["n"] + b["n"]
        share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
        # An empty side has no mean of its own.
        dx = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
        dy = np.where((a["n"] > 0) & (b["n"] > 0), b["other"] - a["other"], 0.0)
        return {
            "n": n,
            "mean": np.where(a["n"] > 0, a["mean"], b["mean"]) + dx * share,
            "other": np.where(a["n"] > 0, a["other"], b["other"]) + dy * share,
            "square": a["square"] + b["square"] + dx * dx * a["n"] * share,
            "product": a["product"] + b["product"] + dx * dy * a["n"] * share,
            "low": np.minimum(a["low"], b["low"]),
            "high": np.maximum(a["high"], b["high"]),
        }

    def state(x) -> dict:
        """The state of some rows; the first value of a column is taken off first, so constants stay exact."""
        there = np.isfinite(x)
        first = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(width)], 0.0)
        y = np.where(there, x - first, 0.0)
        centre = y.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        y = np.where(there, y - centre, 0.0)
        m = there.astype(float)
        n, sums = m.T @ m, y.T @ m
        some = np.maximum(n, 1.0)
        least = np.where(there, x, np.inf)
        most = np.where(there, x, -np.inf)
        low, high = (np.repeat(v[:, None], width, axis=1) for v in (least.min(axis=0), most.max(axis=0)))
        alike: dict[bytes, int] = {}  # columns that miss the same rows share their bounds
        for j in np.flatnonzero(~there.all(axis=0)).tolist():
            k = alike.setdefault(there[:, j].tobytes(), j)
            if k == j:
                own = there[:, j]
                low[:, j], high[:, j] = least[own].min(axis=0, initial=np.inf), most[own].max(axis=0, initial=-np.inf)
            else:
                low[:, j], high[:, j] = low[:, k], high[:, k]
        shift = (first + centre)[:, None]
        return {
            "n": n, "mean": shift + sums / some, "other": (shift + sums / some).T, "low": low, "high": high,
            "square": np.maximum((y * y).T @ m - sums * sums / some, 0.0), "product": y.T @ y - sums * sums.T / some,
        }

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = state(b.to_numpy(dtype=float, na_value=np.nan))
                total = own if total is None else merged(total, own)
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"i": range(width), "part": [part] * width, **{f: list(total[f]) for f in FIELDS}})

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        rows = [{f: np.asarray(r[f], float) for f in FIELDS} for r in group.to_dict("records")]
        total = rows[0]
        for r in rows[1:]:
            total = merged(total, r)
        return pd.DataFrame({"i": group["i"].iloc[:1].to_list(), "part": group["part"].iloc[:1].to_list(), **{f: [total[f]] for f in FIELDS}})

    schema = "i int, part int, " + ", ".join(f"{f} array<double>" for f in FIELDS)
    parts = base.select(*columns).mapInPandas(fold, schema)
    some = parts.groupBy("i", F.floor(F.col("part") / FAN_IN)).applyInPandas(combine, schema)
    out = {f: np.zeros((width, width)) for f in FIELDS}
    for r in some.groupBy("i").applyInPandas(combine, schema).collect():  # a row a column
        for f in FIELDS:
            out[f][r["i"]] = r[f]
    return out


def pearson(state: dict, i: int, j: int) -> float | None:
    """The correlation of columns i and j; null below two common rows or where one of the two does not vary there."""
    varies = state["low"][i, j] < state["high"][i, j] and state["low"][j, i] < state["high"][j, i]
    spread = float(state["square"][i, j]) * float(state["square"][j, i])
    if state["n"][i, j] < 2 or not varies or not 0 < spread < math.inf:
        return None
    return float(state["product"][i, j]) / math.sqrt(spread)
