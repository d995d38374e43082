"""File readers (S1-S5): CSV and JSON with pandas-like missing-value and type
rules, Parquet, format dispatch, load receipt and JDBC options."""

from __future__ import annotations

import re
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.local import local_frame

from tabscope.sources.csv_records import csv_records
from tabscope.sources.files import list_path
from tabscope.functions.expressions import DATE_FORMATS, parse_date

# Text read as missing by pandas' CSV reader (its default NA tokens).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Column names pandas' JSON reader parses as dates.
JSON_DATE_NAME = r"(?i)(_at$|_time$|^date$|^modified$|^timestamp)"


def _na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns
    ])


# What pandas reads as a whole number and as a number.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def infer_types(df: DataFrame) -> DataFrame:
    """Type inference for all-string columns in one aggregate pass: a column becomes
    bigint, double or boolean when every non-null value casts; otherwise it stays text."""
    checks = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        checks += [
            F.count(col).alias(f"n::{c}"),
            F.count(F.when(col.rlike(WHOLE), col.try_cast("bigint"))).alias(f"i::{c}"),
            F.count(F.when(col.rlike(NUMBER), col.try_cast("double"))).alias(f"d::{c}"),
            F.count(F.when(F.lower(col).isin("true", "false"), F.lit(1))).alias(f"b::{c}"),
        ]
    if not checks:
        return df
    r = df.agg(*checks).collect()[0]
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        n = r[f"n::{c}"]
        if n and r[f"i::{c}"] == n:
            out.append(col.cast("bigint").alias(c))
        elif n and r[f"d::{c}"] == n:
            out.append(col.cast("double").alias(c))
        elif n and r[f"b::{c}"] == n:
            out.append((F.lower(col) == "true").alias(c))
        else:
            out.append(col.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """Header row, pandas NA tokens to null, blank lines skipped, then type inference.

    A quote inside a quoted cell is doubled. Cells may hold line breaks, and a
    large file is still read by many tasks (``csv_records``); ``multi_line=False``
    saves the search for broken records where no cell has a break. Files whose only line
    end is a carriage return are read by one task each. Short rows are filled
    with nulls, rows of empty cells stay; a row with more cells than the header
    raises when it is read.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = reader.csv(path).columns
    if not names:
        return reader.csv(path)
    surplus = "_surplus_cell"
    if multi_line and not _bare_returns(spark, path):
        names[-1] = names[-1].removesuffix("\r")
        cells = [f"c{i}" for i in range(len(names))]
        schema = ", ".join(f"{c} string" for c in [*cells, surplus])
        df = csv_records(spark, path).select(F.from_csv("record", F.lit(schema), {"escape": '"'}).alias("r")).select("r.*")
    else:
        cells = names
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, surplus]])
        df = reader.schema(schema).csv(path)
    fits = F.when(F.col(surplus).isNotNull(), F.raise_error(F.lit("a row has more cells than the header")).cast("string"))
    df = _na_to_null(df.select(*[fits.otherwise(F.col(f"`{c}`")).alias(n) for c, n in zip(cells, names)]))
    df = infer_types(df) if infer else df
    df.source_path = path
    return df


def _bare_returns(spark: SparkSession, path: str) -> bool:
    """Whether the first line, as ``\\n`` ends it, holds a carriage return outside quotes."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    return first is not None and "\r" in re.sub(r'"[^"]*"', "", first["value"].removesuffix("\r"))


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Arrays of records (multi-line) or JSON Lines, in files or folders of any store;
    date-named text columns parsed."""
    if multi_line is None:
        first = spark.read.text(path).where(F.trim("value") != "").select(F.ltrim("value").alias("v")).first()
        multi_line = first is not None and first["v"].startswith("[")
    df = spark.read.option("multiLine", multi_line).json(path)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and _date_named(f.name):
            parsed = [parse_date(c, fmt) for fmt in DATE_FORMATS] + [F.try_to_timestamp(c)]
            c = F.coalesce(*parsed)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _date_named(name: str) -> bool:
    return re.search(JSON_DATE_NAME, name) is not None


READERS = {
    "csv": read_csv,
    "json": read_json,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """S3: dispatch on the file extension; unsupported types raise ``ValueError``.

    Excel files are not decoded (no splittable reader): convert them to CSV or Parquet.
    """
    name = path.rstrip("/").rpartition("/")[2]
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if not ext and any(n.endswith(".parquet") for n, *_ in list_path(spark, path)):
        ext = "parquet"
    if ext not in READERS:
        raise ValueError(f"unsupported file type: {ext or '(none)'}; use csv, json or parquet")
    return READERS[ext](spark, path)


def source_metadata(df: DataFrame, filename: str | None = None, path: str | None = None) -> DataFrame:
    """Load receipt: ``filename, rows, columns, size_bytes, uploaded_at``.

    ``path`` is where the table was read from; ``read_csv`` leaves it on its result,
    and sizes are then listed without reading the files. Without one, rows and file sizes
    come from one distributed pass over the hidden ``_metadata`` column of file
    sources (no data columns are read). The file name is the given one or the
    first input file's base name.
    """
    path = path or getattr(df, "source_path", None)
    if path:
        files = df.sparkSession.read.format("binaryFile").load(path).select(F.col("path").alias("p"), F.col("length").alias("s"))
        per_file = files.withColumn("rows", F.lit(0).cast("long"))
    else:
        if df.inputFiles():
            meta = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
        else:  # not a file source: rows only
            meta = df.select(F.lit(None).cast("string").alias("p"), F.lit(0).cast("long").alias("s"))
        per_file = meta.groupBy("p").agg(F.count(F.lit(1)).alias("rows"), F.max("s").alias("s"))
    r = per_file.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("s"), F.lit(0)).alias("size"),
                     F.min("p").alias("first")).collect()[0]
    rows = df.count() if path else int(r["rows"])
    name = filename or (r["first"].rstrip("/").rpartition("/")[2] if r["first"] else None)
    return local_frame(df.sparkSession, [(name, rows, len(df.columns), int(r["size"]))],
                       "filename string, rows long, columns int, size_bytes long").withColumn(
        "uploaded_at", F.current_timestamp())


# Default ports and JDBC driver classes per dialect.
DIALECTS = {
    "postgresql": {"port": 5432, "driver": "org.postgresql.Driver"},
    "mysql": {"port": 3306, "driver": "com.mysql.cj.jdbc.Driver"},
    "sqlite": {"port": None, "driver": "org.sqlite.JDBC"},
    "derby": {"port": None, "driver": "org.apache.derby.jdbc.EmbeddedDriver"},
}


def jdbc_options(dialect: str, database: str, host: str = "localhost", port: int | None = None,
                 user: str | None = None, password: str | None = None) -> dict:
    """``{"url", "properties"}`` for ``spark.read.jdbc``. Credentials go in the
    properties, never in the URL. Unknown dialects raise ``ValueError``."""
    d = (dialect or "").lower()
    if d not in DIALECTS:
        raise ValueError(f"unsupported dialect: {dialect}")
    props = {"driver": DIALECTS[d]["driver"]}
    if user:
        props["user"] = user
    if password:
        props["password"] = password
    if d == "sqlite":
        url = f"jdbc:sqlite:{database}"
    elif d == "derby":
        url = f"jdbc:derby:{database}"
    else:
        url = f"jdbc:{d}://{host or 'localhost'}:{port or DIALECTS[d]['port']}/{quote_plus(database)}"
    return {"url": url, "properties": props}
