"""Table profile operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators import duplicates as _dups
from tabscope.plans.profile import TableProfile, profiled


def table_completeness(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Rows, columns, cells, missing cells, missing % and completeness %."""
    with profiled(df, profile) as p:
        return p.completeness()


def overall_quality(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Mean column score and verdict."""
    with profiled(df, profile) as p:
        return p.overall_quality()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """T4/T5: duplicate rows, %, rows in duplicate groups, groups (exact and reference rule)."""
    return _dups.duplicate_rows(df)


def duplicate_row_list(df: DataFrame) -> DataFrame:
    """All rows that have an equal copy, with the size of their group."""
    return _dups.duplicate_row_list(df)


def column_duplicates(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Rows whose value repeats in the column (null counts as a value); columns with > 0 only."""
    with profiled(df, profile) as p:
        return p.stats.where(F.col("duplicate_count") > 0).select("column", "ordinal", "duplicate_count")


def missing_patterns(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Fully empty rows and rows with any missing value."""
    with profiled(df, profile) as p:
        return p.missing_patterns()


def missing_correlation(df: DataFrame, threshold: float = 0.5, profile: TableProfile | None = None) -> DataFrame:
    """Column pairs whose missingness correlates (|phi| > threshold)."""
    with profiled(df, profile) as p:
        return p.missing_correlation(threshold)


def correlation_matrix(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix of numeric columns, long form."""
    with profiled(df, profile) as p:
        return p.correlation_matrix()


def strong_correlations(df: DataFrame, hide_ids: bool = False, threshold: float = 0.7,
                        profile: TableProfile | None = None) -> DataFrame:
    """|r| > threshold pairs, optionally without id-like columns."""
    with profiled(df, profile) as p:
        return p.strong_correlations(hide_ids=hide_ids, threshold=threshold)


def constant_columns(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """T13."""
    with profiled(df, profile) as p:
        return p.constant_columns()


def high_cardinality(df: DataFrame, threshold: float = 0.9, profile: TableProfile | None = None) -> DataFrame:
    """T14."""
    with profiled(df, profile) as p:
        return p.high_cardinality(threshold)


def data_size(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """T15 (re-aimed): logical bytes per column."""
    with profiled(df, profile) as p:
        return p.data_size()


def type_distribution(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Storage type -> column count."""
    with profiled(df, profile) as p:
        return p.type_distribution()


def semantic_type_distribution(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Semantic type -> column count."""
    with profiled(df, profile) as p:
        return p.semantic_type_distribution()


def table_summary(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Short summary row."""
    with profiled(df, profile) as p:
        return p.summary()


def table_warnings(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """Constant and high-cardinality columns."""
    with profiled(df, profile) as p:
        return p.warnings()


def profile_table(df: DataFrame) -> dict[str, DataFrame]:
    """The full report as a dict of small DataFrames sharing one set of scans."""
    with profiled(df) as p:
        return p.report()
