"""User transforms over a catalog (Q6 re-aimed): a Python function instead of
``exec`` of pandas source text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabscope.sources.catalog import Catalog


def apply_transform(cat: Catalog, fn: Callable[..., DataFrame], current_table: str | None = None) -> DataFrame:
    """Call ``fn(df, tables)`` with the current table and a dict of all tables.

    Pandas-style code runs through ``df.pandas_api()`` and per-group pandas
    code through ``groupBy(...).applyInPandas``; both keep the work on executors.
    The result must be a DataFrame.
    """
    tables = {n: cat.loaders[n](cat.spark) for n in cat.names}
    out = fn(cat.table(current_table), tables)
    if hasattr(out, "to_spark"):
        out = out.to_spark()
    if not isinstance(out, DataFrame):
        raise TypeError("the transform must return a DataFrame")
    return out
