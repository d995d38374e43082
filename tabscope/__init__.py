"""tabscope: data-quality profiling and chart analytics on Spark.

Lazy imports keep ``import tabscope`` cheap; the names below are the public API.
"""

from __future__ import annotations

_API = {
    # sources
    "read_csv": "tabscope.sources.readers", "read_json": "tabscope.sources.readers",
    "read_any": "tabscope.sources.readers", "source_metadata": "tabscope.sources.readers",
    "jdbc_options": "tabscope.sources.readers",
    "Catalog": "tabscope.sources.catalog", "load_catalog": "tabscope.sources.catalog",
    "load_jdbc_catalog": "tabscope.sources.catalog", "catalog_tables": "tabscope.sources.catalog",
    "catalog_columns": "tabscope.sources.catalog", "catalog_keys": "tabscope.sources.catalog",
    "catalog_status": "tabscope.sources.catalog", "describe_tables": "tabscope.sources.catalog",
    "sample_rows": "tabscope.sources.catalog",
    "json_safe": "tabscope.sources.sinks", "write_report": "tabscope.sources.sinks",
    # profile
    "TableProfile": "tabscope.plans.profile",
    "column_types": "tabscope.operators.columns", "column_uniqueness": "tabscope.operators.columns",
    "column_entropy": "tabscope.operators.columns", "numeric_stats": "tabscope.operators.columns",
    "outliers_iqr": "tabscope.operators.columns", "skew_kurtosis": "tabscope.operators.columns",
    "top_values": "tabscope.operators.columns", "quality_score": "tabscope.operators.columns",
    "quality_status": "tabscope.operators.columns", "profile_columns": "tabscope.operators.columns",
    "table_completeness": "tabscope.operators.table", "overall_quality": "tabscope.operators.table",
    "duplicate_rows": "tabscope.operators.table", "duplicate_row_list": "tabscope.operators.table",
    "column_duplicates": "tabscope.operators.table", "missing_patterns": "tabscope.operators.table",
    "missing_correlation": "tabscope.operators.table", "correlation_matrix": "tabscope.operators.table",
    "strong_correlations": "tabscope.operators.table", "constant_columns": "tabscope.operators.table",
    "high_cardinality": "tabscope.operators.table", "data_size": "tabscope.operators.table",
    "type_distribution": "tabscope.operators.table", "semantic_type_distribution": "tabscope.operators.table",
    "table_summary": "tabscope.operators.table", "table_warnings": "tabscope.operators.table",
    "profile_table": "tabscope.operators.table",
    "approx_profile": "tabscope.operators.approx", "approx_top_values": "tabscope.operators.approx",
    "ranked": "tabscope.operators.segments", "windowed": "tabscope.operators.segments",
    "normality_jb": "tabscope.operators.normality",
    "exact_quantiles": "tabscope.operators.quantiles",
    # charts
    "histogram": "tabscope.operators.charts", "category_frequency": "tabscope.operators.charts",
    "dynamics": "tabscope.operators.charts", "column_missing": "tabscope.operators.charts",
    "outlier_split": "tabscope.operators.charts", "date_candidates": "tabscope.operators.charts",
    "top_missing_columns": "tabscope.operators.charts", "columns_with_outliers": "tabscope.operators.charts",
    # query surface, joins, keys, logs
    "guarded_sql": "tabscope.operators.sql", "read_only_sql": "tabscope.operators.sql",
    "preview": "tabscope.operators.sql", "RefusedQuery": "tabscope.operators.sql",
    "apply_transform": "tabscope.operators.transform", "asof_join": "tabscope.operators.asof",
    "band_join": "tabscope.operators.bands", "running_totals": "tabscope.operators.bands",
    "check_primary_key": "tabscope.operators.keys", "check_foreign_key": "tabscope.operators.keys",
    "find_keys": "tabscope.operators.keys",
    "chat_summaries": "tabscope.operators.logs", "chat_transcript": "tabscope.operators.logs",
    "clean_feedback": "tabscope.operators.logs", "clean_tickets": "tabscope.operators.logs",
    "append_log": "tabscope.operators.logs", "profile_diff": "tabscope.operators.diff",
    "run_dynamics_stream": "tabscope.streaming.dynamics", "dynamics_stream_query": "tabscope.streaming.dynamics",
}

__all__ = sorted(_API)


def __getattr__(name: str):
    if name in _API:
        import importlib

        return getattr(importlib.import_module(_API[name]), name)
    raise AttributeError(name)
