"""Profile drift (E4): two column reports side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["missing_percentage", "unique_ratio", "entropy", "mean", "std", "median", "quality_score"]


def profile_diff(before: DataFrame, after: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Join two ``profile_columns`` outputs on ``column``: ``<m>_before, <m>_after, <m>_delta``
    per metric, plus ``type_changed``. Columns present in one side only are kept."""
    ms = metrics or METRICS
    b = before.select("column", F.col("type").alias("type_before"), *[F.col(m).alias(f"{m}_before") for m in ms])
    a = after.select("column", F.col("type").alias("type_after"), *[F.col(m).alias(f"{m}_after") for m in ms])
    j = b.join(a, "column", "full_outer")
    out = [F.col("column"), "type_before", "type_after",
           (F.col("type_before") != F.col("type_after")).alias("type_changed")]
    for m in ms:
        out += [f"{m}_before", f"{m}_after", (F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta")]
    return j.select(*out)
