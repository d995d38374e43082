"""Window functions over an ordered key that split a hot key.

Spark sorts a whole ``partitionBy(key)`` window in one task. Here the rows are
range-partitioned on (key, order), ties by a hash of the row, so a key with a
third of the rows spreads over many partitions, and are written once with
their partition number: the rows of one key in one partition are a segment. A
small table, one row a segment, carries over what a segment needs of those
before it:

* ``ranked``: rows, different values and the start of a tie that runs across
  segments;
* ``windowed``: any function of a frame of a fixed number of rows (moving
  sums, lag, lead), by halo rows copied from the neighbouring segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabscope.operators.quantiles import PARTITION_ROWS, scratch_path


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _segmented(df: DataFrame, by: list[str], order: list[str], partitions: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``_k*`` (keys), ``_o`` (order values), ``_tie`` and ``_pid``, written; and the names of the keys."""
    spark = df.sparkSession
    keys = [f"_k{i}" for i in range(len(by))]
    taken = {c.lower() for c in df.columns} & {*keys, "_o", "_tie", "_pid", "_halo", "_n0", "_place", "_low", "_high", "_b", "_rn", "_r", "_d"}
    if taken:
        raise ValueError(f"column names used by the operator: {sorted(taken)}")
    rows = df.select("*", *[_q(c).alias(k) for c, k in zip(by, keys)], F.struct(*[_q(c) for c in order]).alias("_o"), F.xxhash64(*[_q(c) for c in df.columns]).alias("_tie"))
    p = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PARTITION_ROWS))
    path = scratch_path(spark, "segments")
    rows.repartitionByRange(p, *keys, "_o", "_tie").withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path), keys


def _same(keys: list[str], left: str, right: str) -> Column:
    """Equal keys, nulls included, between two aliased tables."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def ranked(df: DataFrame, by: list[str] | str, order: list[str] | str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_number``, ``rank`` and ``dense_rank`` of its rows within ``by``, in ascending ``order``.

    Nulls in ``by`` are one key; nulls in ``order`` come first, as in a window
    of Spark. Rows of equal order are numbered by a hash of the row; wholly equal
    rows in any order. A key, and a tie within it, may fill many partitions.
    """
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    data, keys = _segmented(df, by, order, partitions)
    # One row a segment: its rows, different values, first and last value, and rows of the last value.
    values = data.groupBy("_pid", *keys, "_o").agg(F.count(F.lit(1)).alias("c"))
    segs = values.groupBy("_pid", *keys).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.min("_o").alias("first"),
        F.max(F.struct("_o", "c")).alias("tail"),
    )
    w = Window.partitionBy(*keys).orderBy("_pid")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", F.col("tail._o"))
    # The rank at which each segment's last value starts: in the first segment that ends with it.
    starts = F.min(F.col("n0") + F.col("n") - F.col("tail.c") + 1).over(Window.partitionBy(*keys, "last"))
    segs = segs.withColumn("start", starts)
    joins = F.lag("last").over(w).eqNullSafe(F.col("first")) & F.lag("n").over(w).isNotNull()
    segs = segs.withColumn("tied", F.when(joins, F.lag("start").over(w)))
    distinct = F.sum(F.col("d")).over(before)
    overlap = F.sum(F.col("tied").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    segs = segs.withColumn("d0", F.coalesce(distinct, F.lit(0)) - overlap)
    carry = segs.select("_pid", *keys, "n0", "d0", "tied", F.col("first").alias("f"))

    own = Window.partitionBy("_pid", *keys).orderBy("_o")
    local = data.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy("_o", "_tie")))
    local = local.withColumn("_r", F.rank().over(own)).withColumn("_d", F.dense_rank().over(own))
    out = local.alias("x").join(carry.alias("c"), (F.col("x._pid") == F.col("c._pid")) & _same(keys, "x", "c"))
    rank = F.when(F.col("c.tied").isNotNull() & (F.col("x._r") == 1), F.col("c.tied")).otherwise(F.col("c.n0") + F.col("x._r"))
    return out.select(
        *[F.col(f"x.`{c}`") for c in df.columns], (F.col("c.n0") + F.col("x._rn")).alias("row_number"), rank.alias("rank"), (F.col("c.d0") + F.col("x._d")).alias("dense_rank"),
    )


def windowed(df: DataFrame, by: list[str] | str, order: list[str] | str, columns: dict[str, Callable[[WindowSpec], Column]],
             preceding: int = 0, following: int = 0, partitions: int | None = None) -> DataFrame:
    """``df`` with ``columns``, each a function of a window that looks at most ``preceding`` rows back and ``following`` ahead.

    A function gets the window by key and order, to which it adds its frame:
    ``{"s": lambda w: F.sum("v").over(w.rowsBetween(-3, 0)), "p": lambda w: F.lag("v").over(w)}``
    needs ``preceding=3``. Nulls in ``by`` are one key; rows of equal order stand
    in the order of a hash of the row. Each segment gets copies of the rows
    around it, from as many segments as the reach needs; they are left out again.
    """
    by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
    clash = sorted(set(columns) & set(df.columns))
    if clash:
        raise ValueError(f"new columns clash with columns of the table: {clash}")
    data, keys = _segmented(df, by, order, partitions)
    segs = data.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("_pid")
    segs = segs.withColumn("n0", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = [data.withColumn("_halo", F.lit(False))]
    for reach, end in ((preceding, True), (following, False)):
        if reach:
            parts.append(_halo(data, segs, keys, reach, end))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    own = Window.partitionBy("_pid", *keys).orderBy("_o", "_tie")
    found = rows.select("*", *[f(own).alias(name) for name, f in columns.items()])
    return found.where(~F.col("_halo")).select(*[_q(c) for c in df.columns], *[_q(c) for c in columns])


def _halo(data: DataFrame, segs: DataFrame, keys: list[str], reach: int, end: bool) -> DataFrame:
    """The last (``end``) or first ``reach`` rows of each segment, once for every later or earlier segment that they reach.

    The places that a row reaches are cut into stretches of ``reach``, so that
    rows and segments of one hot key meet a stretch at a time.
    """
    inward = [F.desc(c) if end else F.asc(c) for c in ("_o", "_tie")]
    number = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*inward))
    edge = data.withColumn("_n0", number).where(F.col("_n0") <= reach)
    edge = edge.alias("e").join(segs.alias("s"), (F.col("e._pid") == F.col("s._pid")) & _same(keys, "e", "s"))
    # The row's place in its key, from 0; a segment covers the places n0 to n0 + n - 1.
    place = F.col("s.n0") + F.col("s.n") - F.col("e._n0") if end else F.col("s.n0") + F.col("e._n0") - 1
    rows = edge.select("e.*", place.alias("_place"))
    # It serves segments whose first place is at most ``reach`` after it, or whose last is at most ``reach`` before.
    low, high = (F.col("_place") + 1, F.col("_place") + reach) if end else (F.col("_place") - reach, F.col("_place") - 1)
    stretch = lambda c: F.floor(c / F.lit(reach))
    rows = rows.withColumn("_low", low).withColumn("_high", high).withColumn("_b", F.explode(F.sequence(stretch(low), stretch(high))))
    at = F.col("n0") if end else F.col("n0") + F.col("n") - 1
    to = segs.select(F.col("_pid").alias("_to"), *[F.col(k).alias(f"_t{k}") for k in keys], at.alias("_at")).withColumn("_b", stretch(F.col("_at")))
    same = F.col("r._b") == F.col("t._b")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t._t{k}"))
    met = rows.alias("r").join(to.alias("t"), same & (F.col("t._at") >= F.col("r._low")) & (F.col("t._at") <= F.col("r._high")))
    own = [c for c in data.columns if c != "_pid"]
    return met.select(*[F.col(f"r.`{c}`") for c in own], F.col("t._to").alias("_pid"), F.lit(True).alias("_halo"))
