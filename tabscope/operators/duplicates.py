"""Row duplicates (T4-T6) with a hash-first pass.

The first pass counts an 8-byte row hash (partial aggregation collapses
repeated hashes map-side, so one huge group costs one row per task) and is
written to the checkpoint folder, repeated hashes only. The second groups the
rows with a repeated hash by their full values, which makes the result exact
whatever the hash collisions. Spark chooses the join by the size of the
written hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.expressions import PCT_PLACES, rnd, safe_ratio
from tabscope.functions.local import local_frame
from tabscope.plans.spine import _has_map, _row_hash, clean, q
from tabscope.session import ensure_checkpoint_dir


# Copies of a row that one task writes in a row.
CHUNK_COPIES = 1_000


def _hashed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Cleaned rows (NaN to null; map-bearing values as JSON text) plus ``_h``."""
    base = clean(df)
    names = [f.name for f in base.schema.fields]
    cols: list[Column] = [F.to_json(q(f.name)).alias(f.name) if _has_map(f.dataType) else q(f.name)
                          for f in base.schema.fields]
    return base.select(*cols, F.hex(_row_hash(base)).alias("_h")), names


def repeated_hashes(df: DataFrame) -> DataFrame:
    """Hashes seen more than once (``_h``), written once."""
    h, _ = _hashed(df)
    ensure_checkpoint_dir(df.sparkSession)
    return h.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select("_h").checkpoint()


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Exact groups of equal rows that occur more than once: ``_h, cols..., _copies``.

    Nulls compare equal, like pandas ``duplicated``.
    """
    hashed, names = _hashed(df)
    cand = hashed.join(repeated_hashes(df), "_h", "left_semi")
    return (
        cand.groupBy("_h", *[q(n) for n in names])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
    )


def duplicate_rows(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """T4/T5: one row ``duplicate_rows, duplicate_percentage, rows_in_duplicate_groups,
    duplicate_groups, duplicate_groups_ref``.

    ``duplicate_groups`` is the exact number of groups; ``duplicate_groups_ref``
    is half the rows in groups, rounded down, which equals it only for pairs.
    """
    n = df.count() if n_rows is None else n_rows
    spark = df.sparkSession
    r = duplicate_groups(df).agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("d"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("r"),
        F.count(F.lit(1)).alias("g"),
    ).collect()[0]
    dup, rows_in, groups = int(r["d"]), int(r["r"]), int(r["g"])
    out = local_frame(spark, [(dup, rows_in, groups)], "d long, r long, g long")
    return out.select(
        F.col("d").alias("duplicate_rows"),
        rnd(safe_ratio(F.col("d"), F.lit(n)) * 100, PCT_PLACES).alias("duplicate_percentage"),
        F.col("r").alias("rows_in_duplicate_groups"),
        F.col("g").alias("duplicate_groups"),
        F.floor(F.col("r") / 2).cast("long").alias("duplicate_groups_ref"),
    )


def duplicate_row_list(df: DataFrame) -> DataFrame:
    """Every row that has an equal copy (all copies kept), with its group size.

    The copies of a group are equal, so each group is repeated as often as it
    was counted; no join with the table is needed. A group is first split into
    chunks of ``CHUNK_COPIES`` copies, which are dealt out by (group, chunk), so
    a group of any size is written by many tasks. Map-bearing values come back
    as their JSON text (the form they were compared in).
    """
    names = [f.name for f in df.schema.fields]
    last = F.ceil(F.col("_copies") / CHUNK_COPIES) - 1
    chunks = duplicate_groups(df).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    own = F.least(F.lit(CHUNK_COPIES).cast("long"), F.col("_copies") - F.col("_chunk") * CHUNK_COPIES)
    # A given number of partitions: Spark would merge small ones by the bytes of the chunks, which grow a thousandfold here.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, "_h", "_chunk").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), own)))
    return dealt.select(*[q(n) for n in names], F.col("_copies").alias("group_size"))
