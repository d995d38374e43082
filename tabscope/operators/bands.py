"""Joins and running totals on an ordered value that split a hot key.

Spark plans ``key = key AND b.v BETWEEN a.v + low AND a.v + high`` as a join on
the key alone, which brings all rows of one key together in one task. Here the
value axis is cut into buckets as wide as the band, so a key is split over as
many buckets as its values span. A running window over a key is split into
range-partitioned segments, as in ``asof``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.operators.quantiles import PARTITION_ROWS, scratch_path


def _axis(df: DataFrame, column: str) -> Column:
    """A number, or a time as microseconds of its wall clock."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        t = c.cast("timestamp_ntz")
        days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
        seconds = days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
        return seconds * 1000000 + (F.extract(F.lit("SECOND"), t) * 1000000).cast("long")
    return c


def band_join(left: DataFrame, right: DataFrame, by: list[str] | str, left_value: str, right_value: str | None = None,
              low: float = 0.0, high: float = 0.0, include_low: bool = True, include_high: bool = True,
              right_prefix: str = "r_") -> DataFrame:
    """Pairs of rows with equal ``by`` and ``right - left`` between ``low`` and ``high``.

    Times differ in seconds. Returns the left columns and the right columns
    with ``right_prefix``. Null keys or values match nothing. Each left row is
    looked up in the buckets that its band touches, two or three of them.
    """
    by = [by] if isinstance(by, str) else list(by)
    right_value = right_value or left_value
    if high < low:
        raise ValueError("the band is empty")
    times = isinstance(left.schema[left_value].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    scale = 1_000_000 if times else 1
    lo, hi = (x * scale for x in (low, high))
    width = float((hi - lo) or 1)
    bucket = lambda c: F.floor(c / F.lit(width))
    keys = [f"_k{i}" for i in range(len(by))]
    l = left.select(  # noqa: E741
        *[F.col(f"`{k}`").alias(a) for k, a in zip(by, keys)], _axis(left, left_value).alias("_lv"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"),
    ).where(F.col("_lv").isNotNull())
    l = l.withColumn("_b", F.explode(F.sequence(bucket(F.col("_lv") + F.lit(lo)), bucket(F.col("_lv") + F.lit(hi)))))  # noqa: E741
    r = right.select(
        *[F.col(f"`{k}`").alias(a) for k, a in zip(by, keys)], _axis(right, right_value).alias("_rv"), F.struct(*[F.col(f"`{c}`").alias(f"{right_prefix}{c}") for c in right.columns]).alias("_r"),
    ).where(F.col("_rv").isNotNull()).withColumn("_b", bucket(F.col("_rv")))
    gap = F.col("_rv") - F.col("_lv")
    above = gap >= F.lit(lo) if include_low else gap > F.lit(lo)
    below = gap <= F.lit(hi) if include_high else gap < F.lit(hi)
    return l.join(r, [*keys, "_b"]).where(above & below).select("_l.*", "_r.*")


def running_totals(df: DataFrame, by: list[str] | str, order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``running_n`` and ``running_sum`` of ``value`` within ``by``, in ``order``, this row included.

    ``order`` must make the rows of a key distinct. Rows are range-partitioned
    on (by, order) and written once with their partition number; a small table of
    segment totals carries the counts and sums of earlier partitions, and each
    segment is summed on its own. Nulls in ``by`` are one key; null values count
    as rows and add nothing.
    """
    by = [by] if isinstance(by, str) else list(by)
    spark = df.sparkSession
    p = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PARTITION_ROWS))
    keys = [f"_k{i}" for i in range(len(by))]
    order_by = [F.col(f"`{c}`") for c in order]
    named = df.select("*", *[F.col(f"`{k}`").alias(a) for k, a in zip(by, keys)])
    path = scratch_path(spark, "running")
    named.repartitionByRange(p, *keys, *order_by).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    data = spark.read.parquet(path)
    add = F.coalesce(F.col(f"`{value}`").cast("double"), F.lit(0.0))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = data.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(add).alias("_s")).select(
        F.col("_pid").alias("_cp"), *[F.col(k).alias(f"_c{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"))
    same = F.col("_pid") == F.col("_cp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    seg = Window.partitionBy("_pid", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = data.withColumn("_n", F.count(F.lit(1)).over(seg)).withColumn("_s", F.sum(add).over(seg)).join(carry, same)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_n") + F.col("_n0")).alias("running_n"), (F.col("_s") + F.col("_s0")).alias("running_sum"))
