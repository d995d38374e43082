"""Outputs (K1, K2): JSON-safe values and report writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _iso(c: Column) -> Column:
    """ISO text like Python's ``isoformat``: microseconds only when non-zero."""
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def _safe(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c.cast("double"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return _iso(c)
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, T.DecimalType):
        return c.cast("double")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _k, v: _safe(v, dt.valueType))
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """K1: NaN and +-Inf to null, timestamps to ISO text, decimals to double, recursively."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """K2: each report part to ``path/<part>`` (JSON values cleaned first)."""
    for name, part in report.items():
        out = json_safe(part) if fmt == "json" else part
        out.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")
