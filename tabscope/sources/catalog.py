"""Catalog: named tables as lazy loaders.

A loader is ``f(session) -> DataFrame``; nothing is read until a query runs.
A Parquet directory (one ``*.parquet`` file or folder per table) or a JDBC
source can act as the "database". Failure isolation (S7): a table whose
schema cannot be resolved is kept with its error and skipped by queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.local import local_frame
from tabscope.sources.files import list_path, status

Loader = Callable[[SparkSession], DataFrame]


@dataclass
class Catalog:
    spark: SparkSession
    loaders: dict[str, Loader] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    current: str | None = None
    source_id: str = "none"
    keys: dict[str, dict] = field(default_factory=dict)

    # ---------------------------------------------------------------- building
    def register(self, name: str, table: DataFrame | Loader, primary_key: list[str] | None = None,
                 foreign_keys: list[dict] | None = None) -> "Catalog":
        """Add a table. A DataFrame is pinned to its own session; a loader can run in any."""
        if isinstance(table, DataFrame):
            df = table
            self.loaders[name] = lambda _s, _df=df: _df
        else:
            self.loaders[name] = table
        if primary_key or foreign_keys:
            self.keys[name] = {"primary_key": list(primary_key or []), "foreign_keys": list(foreign_keys or [])}
        if self.current is None:
            self.current = name
        return self

    @property
    def names(self) -> list[str]:
        return list(self.loaders)

    def table(self, name: str | None = None) -> DataFrame:
        """The named table, else the current one, else the first; unknown is an error."""
        if name:
            if name not in self.loaders:
                raise KeyError(f"table not found: {name}")
            self.current = name
            return self.loaders[name](self.spark)
        if self.current and self.current in self.loaders:
            return self.loaders[self.current](self.spark)
        if not self.loaders:
            raise KeyError("catalog has no tables")
        first = next(iter(self.loaders))
        self.current = first
        return self.loaders[first](self.spark)

    def pinned(self) -> bool:
        """True when some entry is an in-memory DataFrame (must run in its session)."""
        return any(getattr(fn, "__defaults__", None) and isinstance(fn.__defaults__[0], DataFrame)
                   for fn in self.loaders.values())


_SCHEMAS: dict[tuple, object] = {}


def parquet_loader(spark: SparkSession, path: str) -> Loader:
    """A loader that reads ``path`` with its schema resolved once per process.

    Resolving a Parquet schema runs a small job; with the schema given, every
    later read (in any session) plans without one. Keyed on path, size and
    modification time, so a rewritten table is resolved again.
    """
    key = (path, status(spark, path))
    schema = _SCHEMAS.get(key)
    if schema is None:
        schema = spark.read.parquet(path).schema
        _SCHEMAS[key] = schema
    return lambda s, p=path, sc=schema: s.read.schema(sc).parquet(p)


def load_catalog(spark: SparkSession, path: str, source_id: str | None = None) -> Catalog:
    """Every ``*.parquet`` file, and every folder, under ``path`` becomes a lazy table.

    The path may lie in any store that Spark reads. Each table's schema is resolved once (metadata only); a table that cannot be
    read is recorded in ``errors`` and left out. No readable table is an error.
    """
    cat = Catalog(spark, source_id=source_id or f"parquet:{path}")
    for entry, full, is_dir, _, _ in list_path(spark, path):
        name = entry.removesuffix(".parquet")
        if name == entry and not (is_dir and not entry.startswith((".", "_"))):
            continue
        try:
            loader = parquet_loader(spark, full)  # resolves the footer only
        except Exception as e:  # S7: keep going, remember why
            cat.errors[name] = str(e).splitlines()[0][:500]
            continue
        cat.loaders[name] = loader
    if not cat.loaders:
        raise ValueError(f"no readable tables under {path}")
    cat.current = next(iter(cat.loaders))
    return cat


def load_jdbc_catalog(spark: SparkSession, url: str, tables: list[str], properties: dict,
                      partitioning: dict[str, dict] | None = None, source_id: str | None = None) -> Catalog:
    """S6 over JDBC: one lazy loader per table, optionally partitioned on a numeric key
    (``{"column", "lowerBound", "upperBound", "numPartitions"}``) so executors read
    slices in parallel and filters are pushed to the database."""
    cat = Catalog(spark, source_id=source_id or url.split("?")[0])
    partitioning = partitioning or {}
    for t in tables:
        part = partitioning.get(t)

        def loader(s, t=t, part=part):
            r = s.read.format("jdbc").option("url", url).option("dbtable", t)
            for k, v in properties.items():
                r = r.option(k, v)
            if part:
                r = r.option("partitionColumn", part["column"]).option("lowerBound", part["lowerBound"]) \
                    .option("upperBound", part["upperBound"]).option("numPartitions", part["numPartitions"])
            return r.load()

        try:
            loader(spark).schema  # noqa: B018
        except Exception as e:
            cat.errors[t] = str(e).splitlines()[0][:500]
            continue
        cat.loaders[t] = loader
    if not cat.loaders:
        raise ValueError("no readable tables")
    cat.current = next(iter(cat.loaders))
    return cat


def catalog_tables(cat: Catalog) -> DataFrame:
    """``table, rows, columns, primary_key, foreign_keys`` per table (rows counted in parallel stages).

    Declared keys as text: columns joined by commas, foreign keys as
    ``columns -> table(columns)`` joined by semicolons; null without keys.
    """
    parts = []
    for name in cat.names:
        df = cat.loaders[name](cat.spark)
        keys = cat.keys.get(name, {})
        primary = ",".join(keys.get("primary_key") or []) or None
        foreign = ";".join(f"{','.join(k['constrained_columns'])} -> {k['referred_table']}({','.join(k['referred_columns'])})"
                           for k in keys.get("foreign_keys") or []) or None
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.col("rows"), F.lit(len(df.columns)).alias("columns"),
            F.lit(primary).cast("string").alias("primary_key"), F.lit(foreign).cast("string").alias("foreign_keys"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_columns(cat: Catalog) -> DataFrame:
    """``table, column, ordinal, type, nullable, non_null``: the schemas, with each column's non-null values (one scan a table)."""
    rows = []
    for name in cat.names:
        df = cat.loaders[name](cat.spark)
        counts = df.agg(*[F.count(F.col(f"`{f.name}`")) for f in df.schema.fields]).first()
        for i, f in enumerate(df.schema.fields):
            rows.append((name, f.name, i, f.dataType.simpleString(), f.nullable, counts[i]))
    return local_frame(cat.spark, rows, "table string, column string, ordinal int, type string, nullable boolean, non_null long")


def catalog_keys(cat: Catalog, discover: bool = False) -> DataFrame:
    """``table, kind, columns, referred_table, referred_columns`` of declared keys (``primary``, ``foreign``).

    Keys of lake tables are declared through ``register``. With ``discover`` the tables
    without declared keys are searched too (``find_keys``): ``unique`` columns or pairs, and
    ``inclusion`` of a column's values in a unique column of any table.
    """
    rows = []
    for t, k in cat.keys.items():
        if k.get("primary_key"):
            rows.append((t, "primary", k["primary_key"], None, None))
        for fk in k.get("foreign_keys", []):
            rows.append((t, "foreign", fk["constrained_columns"], fk["referred_table"], fk["referred_columns"]))
    out = local_frame(cat.spark,
        rows, "table string, kind string, columns array<string>, referred_table string, referred_columns array<string>"
    )
    if discover:
        from tabscope.operators.keys import find_keys

        found = find_keys(cat).where(~F.col("table").isin(list(cat.keys)))
        out = out.unionByName(found.select(*out.columns))
    return out


def describe_tables(cat: Catalog) -> DataFrame:
    """``table, rows, columns, dtypes`` (dtype list as text), the data context of a catalog."""
    counts = catalog_tables(cat).select("table", "rows", "columns")
    rows = []
    for name in cat.names:
        df = cat.loaders[name](cat.spark)
        rows.append((name, ", ".join(f"{n}: {t}" for n, t in df.dtypes)))
    meta = local_frame(cat.spark, rows, "table string, dtypes string")
    return counts.join(meta, "table")


def sample_rows(cat: Catalog, table: str | None = None, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of a table, ordered by ``order_by`` (default: first column).

    Files have no inherent row order on a cluster, so "first" needs a key.
    """
    df = cat.table(table)
    keys = order_by or [df.columns[0]]
    return df.orderBy(*keys).limit(n)


def catalog_status(cat: Catalog) -> DataFrame:
    """One row per table found: ``table, status, error, rows`` (``ok`` or ``error``).

    Every table is read to count its rows, so one whose schema resolves but
    whose files cannot be read shows as an error too.
    """
    rows = [(n, "error", e, None) for n, e in cat.errors.items()]
    for name in cat.names:
        try:
            df = cat.loaders[name](cat.spark)
            rows.append((name, "ok", None, df.count()))
        except Exception as e:
            rows.append((name, "error", str(e).splitlines()[0][:500], None))
    return local_frame(cat.spark, rows, "table string, status string, error string, rows long")
