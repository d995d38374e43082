"""Column profile operators (P1-P12). Each is a view of ``TableProfile``; pass
``profile=`` to share its scans across several calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.expressions import TOP_VALUES
from tabscope.plans.profile import TableProfile, profiled


def column_types(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """``column, ordinal, type`` (empty, binary, categorical, numeric, boolean, datetime, text, nested)."""
    with profiled(df, profile) as p:
        return p.stats.select("column", "ordinal", "type")


def column_uniqueness(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Distinct non-null values and their ratio to all rows."""
    with profiled(df, profile) as p:
        return p.stats.select("column", "ordinal", "unique_count", "unique_ratio")


def column_entropy(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Shannon entropy (bits) with null as its own category."""
    with profiled(df, profile) as p:
        return p.stats.select("column", "ordinal", "entropy")


def numeric_stats(df: DataFrame, limit: int | None = None, profile: TableProfile | None = None) -> DataFrame:
    """P5 (and V9 with ``limit``): mean, median, std, min, max, q25, q75 of numeric columns."""
    with profiled(df, profile) as p:
        out = p.numeric.select("column", "ordinal", "mean", "median", "std", "min", "max", "q25", "q75")
    return out.orderBy("ordinal").limit(limit) if limit else out


def outliers_iqr(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """IQR x 1.5 fences (strict) and the share of non-null values outside them."""
    from tabscope.functions.expressions import STAT_PLACES, rnd

    with profiled(df, profile) as p:
        o = p.outliers
    return o.select(
        "column",
        F.col("outlier_count").cast("long").alias("outlier_count"),
        "outlier_percentage",
        rnd(F.col("lower_bound"), STAT_PLACES).alias("lower_bound"),
        rnd(F.col("upper_bound"), STAT_PLACES).alias("upper_bound"),
    )


def skew_kurtosis(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Population skewness and excess kurtosis (null below 3 values or for constants)."""
    with profiled(df, profile) as p:
        return p.numeric.select("column", "skewness", "kurtosis")


def top_values(df: DataFrame, k: int = TOP_VALUES, columns: list[str] | None = None,
               profile: TableProfile | None = None) -> DataFrame:
    """The k most frequent non-null values per column (categorical, text and
    boolean columns unless ``columns`` is given); ties ordered by value."""
    with profiled(df, profile) as p:
        return p.top_values(k=k, columns=columns)


def quality_score(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """P10: 0-100 column score."""
    with profiled(df, profile) as p:
        return p.columns.select("column", "ordinal", "quality_score")


def quality_status(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Score band per column."""
    with profiled(df, profile) as p:
        return p.columns.select("column", "ordinal", "quality_score", "status")


def profile_columns(df: DataFrame, columns: list[str] | None = None, profile: TableProfile | None = None) -> DataFrame:
    """One flat report row per column (type, missing, uniqueness, entropy,
    statistics, outliers, shape, score, status)."""
    with profiled(df, profile, columns) as p:
        return p.columns
