"""Derived inputs used by the registered checks: each is one SQL text that Spark
and DuckDB both run over the generated tables (the tables carry no nulls,
outliers or mixed types by themselves)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.sources.catalog import parquet_loader
from tabscope.sources.files import status

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Nulls in three columns; l_tax missing exactly when l_discount is (correlated missingness).
LI_NULLS = """SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_tax END AS l_tax,
  l_returnflag, l_linestatus, l_shipdate
FROM lineitem"""

# Every 97th order's prices blown up 50x: IQR outliers.
LI_OUTLIERS = """SELECT l_orderkey, l_quantity,
  CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_returnflag
FROM lineitem"""

# One column per semantic type rule.
LI_KINDS = """SELECT l_orderkey, l_linenumber, l_returnflag,
  l_discount > 0.05 AS is_discounted,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship_day,
  l_shipdate,
  1 AS one,
  CAST(NULL AS DOUBLE) AS nothing,
  CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS line_code
FROM lineitem"""

# Exact duplicates in groups larger than two.
LI_DUPS = "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem"

# Order dates as text, every 13th replaced by a bad value.
ORDERS_TEXT_DATES = """SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'n/a'
  ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_day,
  o_totalprice, o_orderstatus
FROM orders"""

# Mixed date formats (no single format fits), one format that is not ISO,
# a constant column (min == max) and NaN next to null.
ORDERS_MIXED = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
       ELSE replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/') END AS mixed_day,
  replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/') AS slash_day,
  CAST(5.0 AS DOUBLE) AS five,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE o_totalprice END AS price_nan
FROM orders"""

# Whole numbers beyond 2^53, a wide decimal, a single-precision column and few large values.
ORDERS_EXACT = """SELECT o_orderkey + 1152921504606846976 AS big_key,
  CAST(o_orderkey AS DECIMAL(30,0)) * 1000003 + CAST('0' AS DECIMAL(30,0)) AS wide_key,
  CASE WHEN o_orderkey % 2 = 0 THEN 1152921504606846976 ELSE 1152921504606846977 END AS two_big,
  o_totalprice
FROM orders"""

# Times as text with a zone, with milliseconds and without seconds.
ORDERS_ZONED = """SELECT concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T21:30:00.250Z') AS zoned_day,
  concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 21:30') AS minute_day, o_totalprice
FROM orders"""

# Columns that rise together, one of them named like an id.
LI_LINEAR = """SELECT l_orderkey AS order_id, l_orderkey * 2.0 + l_linenumber AS line_place, l_orderkey * 1.5 + 10 * l_linenumber AS shelf,
  l_quantity, l_quantity * 3 + l_linenumber AS units
FROM lineitem"""

# A third of the events on one user.
EVENTS_HOT = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, ts, value, event_type FROM events"""

DERIVED = {
    "orders_exact": ORDERS_EXACT,
    "orders_zoned": ORDERS_ZONED,
    "li_linear": LI_LINEAR,
    "events_hot": EVENTS_HOT,
    "li_nulls": LI_NULLS,
    "li_outliers": LI_OUTLIERS,
    "li_kinds": LI_KINDS,
    "li_dups": LI_DUPS,
    "orders_text_dates": ORDERS_TEXT_DATES,
    "orders_mixed": ORDERS_MIXED,
}


_FRAMES: dict[tuple[int, str], dict[str, DataFrame]] = {}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views for the generated tables and the derived inputs above.

    Resolved DataFrames are kept per (session, folder): resolving a Parquet
    schema runs a small job, and views are re-pointed at every call because
    another folder may have been registered in between.
    """
    key = (id(spark), sf_dir.rstrip("/"))
    frames = _FRAMES.get(key)
    if frames is None:
        frames = {}
        for t in TABLES:
            p = f"{key[1]}/{t}.parquet"
            if status(spark, p):
                frames[t] = parquet_loader(spark, p)(spark)
        _FRAMES[key] = frames
    for t, df in frames.items():
        df.createOrReplaceTempView(t)
    for name, sql in DERIVED.items():
        spark.sql(sql).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.table(name)
