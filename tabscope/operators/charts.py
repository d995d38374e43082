"""Chart aggregations (V1-V10): histogram, category frequency, daily dynamics
and the small column pickers the report page uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.local import local_frame

from tabscope.functions.expressions import (
    STAT_PLACES,
    rnd,
    DATE_FORMATS,
    DATE_NAME_PATTERN,
    DEFAULT_BINS,
    TOP_CATEGORIES,
    is_finite,
    nan_to_null,
    parse_date,
    type_class,
)
from tabscope.operators.frequent import frequent_values
from tabscope.operators.quantiles import exact_quantiles
from tabscope.plans.profile import TableProfile, profiled
from tabscope.plans.spine import q

DYNAMICS_AGGS = ("sum", "mean", "median", "min", "max", "count", "nunique")


def _field(df: DataFrame, column: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == column:
            return f
    raise ValueError(f"column not found: {column}")


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """V1/V2: equal-width bins over [min, max] exactly as ``numpy.histogram``.

    Half-open bins, the last one closed; ``min == max`` widens the range by
    0.5 on each side; empty bins are kept; nulls, NaN and infinite values are dropped.
    Returns ``bin, lo, hi, label, count``.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    f = _field(df, column)
    if type_class(f.dataType) != "numeric":
        raise ValueError(f"histogram needs a numeric column, got {f.dataType.simpleString()}")
    spark = df.sparkSession
    v = df.select(q(column).cast("double").alias("v")).where(is_finite(F.col("v")))
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()[0]
    lo, hi = (0.0, 1.0) if r["lo"] is None else (float(r["lo"]), float(r["hi"]))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins

    def edge(k):
        return F.when(k >= bins, F.lit(hi)).otherwise(k.cast("double") * F.lit(step) + F.lit(lo))

    idx = F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("long")
    idx = F.when(idx == bins, bins - 1).otherwise(idx)
    staged = v.select("v", idx.alias("i"))
    staged = staged.select("v", F.when(F.col("v") < edge(F.col("i")), F.col("i") - 1).otherwise(F.col("i")).alias("i"))
    staged = staged.select(
        F.when((F.col("v") >= edge(F.col("i") + 1)) & (F.col("i") != bins - 1), F.col("i") + 1)
        .otherwise(F.col("i"))
        .alias("bin")
    )
    counts = staged.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    # The bin axis has exactly ``bins`` rows.
    axis = spark.range(bins).select(F.col("id").alias("bin"))
    out = axis.join(F.broadcast(counts), "bin", "left")
    lo_e, hi_e = edge(F.col("bin")), edge(F.col("bin") + 1)
    return out.select(
        F.col("bin").cast("int").alias("bin"),
        lo_e.alias("lo"),
        hi_e.alias("hi"),
        F.format_string("%.2f - %.2f", lo_e, hi_e).alias("label"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def category_frequency(df: DataFrame, column: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """V3: the k most frequent non-null values (ties by value): ``rank, value, count``."""
    f = _field(df, column)
    c = q(column)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        c = nan_to_null(c)
    long = df.select(F.lit(0).alias("c"), c.cast("string").alias("s"), F.lit(None).cast("double").alias("d")).where(F.col("s").isNotNull())
    return frequent_values(long, k).select(F.col("rank").cast("int").alias("rank"), F.col("s").alias("value"), F.col("cnt").alias("count"))


def parse_dates(df: DataFrame, column: str) -> F.Column:
    """A date column as a timestamp, bad values to null.

    Timestamps and dates pass through, integers are epoch nanoseconds, text
    uses the one listed format that fits most distinct values (order-free
    stand-in for "format of the first value"); values that do not fit are null.
    """
    f = _field(df, column)
    c = q(column)
    cls = type_class(f.dataType)
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if isinstance(f.dataType, T.DateType):
        return c.cast("timestamp_ntz")
    if cls == "numeric":
        # Epoch nanoseconds as a wall-clock (UTC) timestamp, without going through
        # the session time zone: epoch + whole days + remaining seconds.
        name = column.replace("`", "``")
        ns = f"CAST(`{name}` AS BIGINT)"
        us = f"(({ns} - pmod({ns}, 1000)) div 1000)"  # floor division, also below zero
        micros = F.expr(us)
        days = F.expr(f"(({us} - pmod({us}, 86400000000)) div 86400000000)")
        rem_s = ((micros - days * F.lit(86400000000)) / F.lit(1e6)).cast("decimal(18,6)")
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            days.cast("int"), F.lit(0), F.lit(0), rem_s)
    s = c.cast("string")
    distinct = df.select(s.alias("s")).where(F.col("s").isNotNull()).distinct()
    fits = distinct.agg(
        *[F.count(parse_date(F.col("s"), fmt)).alias(f"f{i}") for i, fmt in enumerate(DATE_FORMATS)]
    ).collect()[0]
    best = max(range(len(DATE_FORMATS)), key=lambda i: (fits[f"f{i}"], -i))
    if fits[f"f{best}"] == 0:
        return F.lit(None).cast("timestamp_ntz")
    return parse_date(s, DATE_FORMATS[best]).cast("timestamp_ntz")


def dynamics(df: DataFrame, date_column: str, value_column: str, agg: str = "sum") -> DataFrame:
    """V4: per-calendar-day aggregate of ``value_column`` (``day`` ISO text, ``value``).

    ``count`` / ``nunique`` use raw values (only rows without a date dropped);
    the numeric aggregations coerce values to double and drop rows where either
    side is missing. Days without data are absent. Sorted by day.
    """
    key = (agg or "sum").lower().strip()
    if key not in DYNAMICS_AGGS:
        raise ValueError(f"unknown aggregation: {agg}")
    _field(df, date_column)
    vf = _field(df, value_column)
    ts = parse_dates(df, date_column)
    day = F.date_format(F.to_date(ts), "yyyy-MM-dd")
    raw = q(value_column)
    if isinstance(vf.dataType, (T.FloatType, T.DoubleType)):
        raw = nan_to_null(raw)
    if key in ("count", "nunique"):
        w = df.select(day.alias("day"), raw.alias("value")).where(F.col("day").isNotNull())
        if isinstance(vf.dataType, (T.ArrayType, T.MapType, T.StructType)):
            w = w.select("day", F.to_json("value").alias("value"))
        fn = F.count("value") if key == "count" else F.count_distinct("value")
        out = w.groupBy("day").agg(fn.cast("double").alias("value"))
    else:
        num = raw.cast("double") if type_class(vf.dataType) == "numeric" else raw.cast("string").try_cast("double")
        w = df.select(day.alias("day"), num.alias("value")).where(
            F.col("day").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
        )
        if key == "median":
            out = exact_quantiles(w, ["day"], "value", [0.5], ["value"])
        else:
            fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[key]
            out = w.groupBy("day").agg(fn("value").cast("double").alias("value"))
    return out.select("day", "value").orderBy("day")


def column_missing(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """``column, ordinal, missing_count, missing_percentage`` in column order."""
    with profiled(df, profile) as p:
        n = p.n_rows
        rows = [(s.name, s.ordinal, p.patterns["null"][s.name]) for s in p.specs]
    d = local_frame(p.spark, rows, "column string, ordinal int, missing_count long")
    from tabscope.functions.expressions import PCT_PLACES, rnd, safe_ratio

    return d.select(
        "column", "ordinal", "missing_count",
        rnd(safe_ratio(F.col("missing_count"), F.lit(n)) * 100, PCT_PLACES).alias("missing_percentage"),
    )


def outlier_split(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """V6: per numeric column, normal / outlier / null row counts.

    ``normal_ref`` is all rows minus outliers (nulls counted as normal), the
    figure the reference's chart shows.
    """
    with profiled(df, profile) as p:
        o = p.outliers
        n = p.n_rows
    return o.select(
        "column",
        (F.col("non_null") - F.col("outlier_count")).cast("long").alias("normal"),
        F.col("outlier_count").cast("long").alias("outliers"),
        (F.lit(n) - F.col("non_null")).cast("long").alias("nulls"),
        (F.lit(n) - F.col("outlier_count")).cast("long").alias("normal_ref"),
        rnd(F.col("lower_bound"), STAT_PLACES).alias("lower_bound"),
        rnd(F.col("upper_bound"), STAT_PLACES).alias("upper_bound"),
    )


def date_candidates(df: DataFrame, profile: TableProfile | None = None) -> DataFrame:
    """V7: columns offered as the dynamics date axis (all columns if none qualifies)."""
    with profiled(df, profile) as p:
        st = p.stats.select("column", "ordinal", "type")
    hit = st.where((F.col("type") == "datetime") | F.col("column").rlike(DATE_NAME_PATTERN))
    if hit.limit(1).count() == 0:
        return st.select("column", "ordinal")
    return hit.select("column", "ordinal")


def top_missing_columns(df: DataFrame, k: int = 5, profile: TableProfile | None = None) -> DataFrame:
    """V8: the k columns with most missing values (missing > 0; ties by column order)."""
    m = column_missing(df, profile)
    return m.where(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "ordinal").limit(k)


def columns_with_outliers(df: DataFrame, k: int = 5, profile: TableProfile | None = None) -> DataFrame:
    """The first k numeric columns (column order) that have outliers."""
    with profiled(df, profile) as p:
        o = p.outliers.join(p.stats.select("column", "ordinal"), "column")
    return o.where(F.col("outlier_count") > 0).orderBy("ordinal").limit(k).select(
        "column", "ordinal", F.col("outlier_count").cast("long").alias("outlier_count"), "outlier_percentage"
    )
