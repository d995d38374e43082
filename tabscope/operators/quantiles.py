"""Exact, linearly interpolated quantiles per group without funnelling a group into one task.

``percentile`` keeps a value map per group in one task, which does not hold
when a single column (or a single day) carries billions of distinct values.
Here ranks are found by histograms, at every size; no value is sorted or written:

1. every value falls into an order-preserving cell of the whole range of
   doubles: its sign and its logarithm in steps of 1/22 (under 65,000 cells a
   group, so partial aggregation collapses them map-side);
2. running sums over a group's cells find the cell of each target rank. Every
   cell keeps its smallest and largest value; where they agree the rank is found;
3. only the values inside the cells that are left are counted again, in 65,536
   equal cells between that smallest and largest value, until all ranks are
   found. A round divides the range by 65,535, so doubles take at most four or
   five rounds; the smallest and the largest value always part, so it ends.

What stays between rounds is a row a target rank (two a group and quantile),
checkpointed, as it is all that the next round needs.

Interpolation follows pandas/numpy ``linear`` and DuckDB ``quantile_cont``:
position ``p * (n - 1)`` over the sorted non-null values.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

# Values of one range partition (about 50 MB).
PARTITION_ROWS = 2_000_000
# Cells of a logarithmic unit in the first round, and equal cells in the later ones.
LOG_CELLS, CELLS = 22, 65_536
# Below this many intervals (some 10 MB) the rows are matched with them where they lie.
BROADCAST_INTERVALS = 100_000


def scratch_path(spark, tag: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def log_cell(v: Column) -> Column:
    """A whole number that never falls as the double ``v`` grows: 0 for zero, the ends for the infinities."""
    size = F.abs(v)
    # The logarithm of a double lies between -744.5 and 709.8.
    cell = F.when(size == float("inf"), 33_000).otherwise(F.floor((F.log(size) + 745) * LOG_CELLS).cast("int") + 1)
    return F.when(v == 0, 0).when(v > 0, cell).otherwise(-cell)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    names: list[str] | None = None,
    weight: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Return ``keys + names`` with one row per group that has a non-null value.

    Nulls and NaN take no part, a null key is a group like any other. ``weight``
    counts repeated values; rows without a positive weight take no part.
    ``partitions`` sets how many partitions the histograms are ranked in (by
    default Spark decides).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    w_col = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    d = df.select(*[F.col(k) for k in keys], (F.col(value).cast("double") + F.lit(0.0)).alias("_v"), w_col.alias("_w")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0)
    ).withColumn("_cell", log_cell(F.col("_v")))
    facts = [F.sum("_w").alias("_cells_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    def ranked(hist: DataFrame, interval: list[str], cell: str) -> DataFrame:
        """Adds the ranks before each cell within its interval."""
        if partitions:
            hist = hist.repartition(partitions, *interval)
        upto = Window.partitionBy(*interval).orderBy(cell)
        return hist.withColumn("_before", F.sum("_cells_w").over(upto) - F.col("_cells_w"))

    def inside(cells: DataFrame) -> DataFrame:
        """The targets whose rank lies in a cell, with their rank in it."""
        return cells.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_cells_w"))).select(
            *keys, "_cell", "_lo", "_hi", "_slot", "_n", (F.col("_rank") - F.col("_before")).alias("_rank")
        )

    # Two targets a quantile: floor and ceil of p * (n - 1).
    position = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    targets = F.array(*[F.struct(F.lit(2 * i + j).alias("slot"), at(pos).cast("long").alias("rank")) for i, pos in enumerate(position) for j, at in enumerate((F.floor, F.ceil))])
    first = ranked(d.groupBy(*keys, "_cell").agg(*facts), keys, "_cell").withColumn("_n", F.sum("_cells_w").over(Window.partitionBy(*keys)))
    step = inside(first.withColumn("_t", F.explode(targets)).select("*", F.col("_t.slot").alias("_slot"), F.col("_t.rank").alias("_rank"))).checkpoint()
    found = [step.where("_lo = _hi")]
    while True:
        left = step.where("_lo < _hi")
        intervals = left.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_at"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct()
        n = intervals.count()
        if not n:
            break
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
        within = reduce(Column.__and__, [*same, F.col("_cell") == F.col("_at"), F.col("_v") >= F.col("_from"), F.col("_v") <= F.col("_to")])
        rows = d.join(F.broadcast(intervals) if n <= BROADCAST_INTERVALS else intervals, within)
        part = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * (CELLS - 1)).cast("int")
        named = [*keys, "_cell", "_from", "_to"]
        hist = ranked(rows.withColumn("_part", part).groupBy(*named, "_part").agg(*facts), named, "_part")
        open_ = left.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_at"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), "_slot", "_n", "_rank")
        own = reduce(Column.__and__, [*same, F.col("_cell") == F.col("_at"), F.col("_from") == F.col("_a"), F.col("_to") == F.col("_b")])
        step = inside(hist.join(F.broadcast(open_) if n <= BROADCAST_INTERVALS else open_, own)).checkpoint()
        found.append(step.where("_lo = _hi"))
    done = reduce(DataFrame.union, found)
    slot = lambda i: F.max(F.when(F.col("_slot") == i, F.col("_lo")))
    ends = done.groupBy(*keys).agg(F.max("_n").alias("_n"), *[slot(i).alias(f"_s{i}") for i in range(2 * len(probs))])

    def between(i: int) -> Column:
        lo, hi = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (position[i] - F.floor(position[i])))

    return ends.select(*keys, *[between(i).alias(nm) for i, nm in enumerate(names)])
