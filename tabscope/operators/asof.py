"""As-of join: for every left row, the latest right row with the same key and
``right_ts <= left_ts`` (DuckDB ``ASOF LEFT JOIN ... ON l.k = r.k AND l.ts >= r.ts``).

Spark SQL has no ASOF syntax. A plain ``partitionBy(key)`` window would put a
hot key (a third of the rows) into one task, so the union of both sides is
range-partitioned on ``(key, ts)`` instead, which splits a hot key across
many partitions:

1. union both sides, tag them, write range-partitioned to the checkpoint
   folder with the partition id frozen in a column;
2. per ``(pid, key)`` the last right row (a small table: partitions + keys);
   an exclusive running "last non-null" over pids gives each segment the
   right row carried in from earlier partitions;
3. inside a segment (bounded by partition size) a running ``last(ignorenulls)``
   window finds the latest right row; the carried-in row fills the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.operators.quantiles import PARTITION_ROWS, scratch_path


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str] | str,
    left_ts: str,
    right_ts: str | None = None,
    right_prefix: str = "",
    how: str = "left",
    partitions: int | None = None,
) -> DataFrame:
    """Return left columns + right non-key columns (prefixed) of the matching row.

    ``how="left"`` keeps unmatched left rows with nulls, ``"inner"`` drops them.
    A null in a key or a time never matches. Right rows with equal key and time are ordered by their full value hash, so
    the pick is deterministic.
    """
    by = [by] if isinstance(by, str) else list(by)
    right_ts = right_ts or left_ts
    spark = left.sparkSession
    r_cols = [c for c in right.columns if c not in by]
    r_named = {c: f"{right_prefix}{c}" for c in r_cols}
    clash = set(r_named.values()) & set(left.columns)
    if clash:
        raise ValueError(f"right columns clash with left columns: {sorted(clash)}; pass right_prefix")

    l_part = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.col(left_ts).cast("timestamp_ntz").alias("_ts"),
        F.lit(1).alias("_side"),
        F.xxhash64(*[F.col(c) for c in left.columns]).alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
        F.lit(None).cast(right.select(F.struct(*[F.col(c).alias(r_named[c]) for c in r_cols])).schema[0].dataType).alias("_r"),
    )
    r_part = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.col(right_ts).cast("timestamp_ntz").alias("_ts"),
        F.lit(0).alias("_side"),
        F.xxhash64(*[F.col(c) for c in right.columns]).alias("_tie"),
        F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in left.columns])).schema[0].dataType).alias("_l"),
        F.struct(*[F.col(c).alias(r_named[c]) for c in r_cols]).alias("_r"),
    ).where(F.col("_ts").isNotNull())
    known = F.lit(True)
    for i in range(len(by)):
        known = known & F.col(f"_k{i}").isNotNull()
    alone = l_part.where(~(known & F.col("_ts").isNotNull())).select("_l", F.col("_r").alias("_m"))
    l_part, r_part = l_part.where(known & F.col("_ts").isNotNull()), r_part.where(known)
    keys = [f"_k{i}" for i in range(len(by))]
    order = [*keys, "_ts", "_side", "_tie"]
    p = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(left.count() + right.count()) // PARTITION_ROWS))
    path = scratch_path(spark, "asof")
    l_part.unionByName(r_part).repartitionByRange(p, *order).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    data = spark.read.parquet(path)

    # Last right row per (pid, key), then carried forward across pids (small table).
    seg_last = data.where(F.col("_side") == 0).groupBy("_pid", *keys).agg(
        F.max_by("_r", F.struct("_ts", "_tie")).alias("_seg_r")
    )
    segs = data.select("_pid", *keys).distinct().join(seg_last, ["_pid", *keys], "left")
    carry_w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("_carry", F.last("_seg_r", ignorenulls=True).over(carry_w)).select("_pid", *keys, "_carry")

    in_seg = Window.partitionBy("_pid", *keys).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    scanned = data.withColumn("_match", F.last("_r", ignorenulls=True).over(in_seg)).where(F.col("_side") == 1)
    joined = scanned.join(segs, ["_pid", *keys], "left")
    match = F.coalesce(F.col("_match"), F.col("_carry"))
    out = joined.select("_l", match.alias("_m")).union(alone).select(F.col("_l.*"), "_m")
    if how == "inner":
        out = out.where(F.col("_m").isNotNull())
    return out.select(
        *[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_m.`{r_named[c]}`").alias(r_named[c]) for c in r_cols]
    )
