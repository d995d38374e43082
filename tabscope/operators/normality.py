"""Normality of numeric columns (P8, E2): Jarque-Bera over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.expressions import STAT_PLACES, rnd
from tabscope.plans.profile import TableProfile, profiled

# Fixed value: significance level of the verdict.
ALPHA = 0.05


def normality_jb(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Jarque-Bera from population skewness and excess kurtosis over all finite values:
    ``JB = n/6 (S^2 + K^2/4)``, p = exp(-JB/2) (chi-square with 2 degrees of freedom)."""
    with profiled(df, profile) as p:
        m = p.numeric.where((F.col("n") >= 3) & F.col("_skew_raw").isNotNull())
    jb = F.col("n") / 6.0 * (F.pow(F.col("_skew_raw"), 2) + F.pow(F.col("_kurt_raw"), 2) / 4.0)
    return m.select(
        "column", "n",
        rnd(jb, STAT_PLACES).alias("jarque_bera"),
        rnd(F.exp(-jb / 2.0), 6).alias("p_value"),
        (F.exp(-jb / 2.0) > ALPHA).alias("is_normal"),
    )
