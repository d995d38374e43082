"""Column statistics from mergeable sketches: one scan, a state of bounded size for each column.

The exact report counts every distinct value, so its frequency table grows
with the data. Here every task keeps, for each column, a HyperLogLog sketch of
the values, a KLL sketch of the numbers, a frequent-items summary and plain sums;
tasks send these states only. Null counts, ranges and means are exact; the
others carry their error bound in a column of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.expressions import PCT_PLACES, STAT_PLACES, is_finite, rnd, safe_ratio
from tabscope.plans import spine

#: Columns of one scan: Spark keeps the states of up to 128 groups in a hash map and sorts all rows for more.
COLUMNS_AT_ONCE = 100
#: Three standard errors of the estimate of a HyperLogLog sketch of 2^lg registers of 8 bits.
HLL_WIDTH = 3 * 0.8326
#: Frequent items: a value is missed or overstated by at most this share of the rows, divided by the tracked items.
ITEMS_ERROR = 3.5


def kll_rank_error(k: int) -> float:
    """The rank error of a KLL sketch of size ``k`` that 99 % of queries keep (fixed formula of its library)."""
    return 2.296 / k**0.9021


def _long(base: DataFrame, specs: list) -> DataFrame:
    """(column, h, d): every value as a 64-bit hash and, if it is a number, as a double."""
    cells = [
        F.struct(F.when(spine.q(s.name).isNotNull(), F.xxhash64(spine.as_text(spine.q(s.name), s.dtype))).cast("long").alias("h"),
                 spine._dval(s).alias("d")).cast("struct<h:bigint,d:double>").alias(s.name)
        for s in specs
    ]
    return base.select(*cells).unpivot([], [spine.q(s.name) for s in specs], "column", "v").select("column", "v.h", "v.d")


def approx_profile(df: DataFrame, columns: list[str] | None = None, lg_registers: int = 14, kll_size: int = 800) -> DataFrame:
    """P3 and P5 by sketches, a row a column: ``column, ordinal, n_rows, missing_count, missing_percentage,
    unique_estimate, unique_error, mean, std, min, max, q25, median, q75, rank_error, skewness, kurtosis``.

    ``unique_error`` is three standard errors of the estimate, in values.
    A quantile is a value whose rank is off by at most ``rank_error`` (a share of the values). NaN is
    missing; infinite values count as values and stay out of the statistics.
    """
    base = spine.clean(df.select(*[spine.q(c) for c in columns]) if columns else df)
    specs = spine.column_specs(base)
    rank_error = kll_rank_error(kll_size)
    out = None
    for lo in range(0, len(specs), COLUMNS_AT_ONCE):
        some = specs[lo : lo + COLUMNS_AT_ONCE]
        v = F.when(is_finite(F.col("d")), F.col("d"))
        got = _long(base, some).groupBy("column").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("h").alias("present"), F.hll_sketch_agg("h", lg_registers).alias("hll"),
            F.kll_sketch_agg_double(v, kll_size).alias("kll"), F.count(v).alias("n_num"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
        )
        out = got if out is None else out.unionAll(got)
    if out is None:
        raise ValueError("the table has no columns")
    names = spine.specs_frame(df.sparkSession, specs).select("column", "ordinal")
    estimate = F.when(F.col("present") > 0, F.hll_sketch_estimate("hll")).otherwise(0)
    at = lambda p: rnd(F.when(F.col("n_num") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(p))), STAT_PLACES)
    stat = lambda c: rnd(F.when(~F.isnan(c), F.col(c)), STAT_PLACES).alias(c)
    missing = F.col("n_rows") - F.col("present")
    rows = names.join(out, "column", "left").fillna(0, ["n_rows", "present", "n_num"])  # a row a column
    return rows.select(
        "column", "ordinal", "n_rows", missing.alias("missing_count"), rnd(safe_ratio(missing, F.col("n_rows")) * 100, PCT_PLACES).alias("missing_percentage"),
        estimate.alias("unique_estimate"), F.ceil(estimate * F.lit(HLL_WIDTH / math.sqrt(1 << lg_registers))).alias("unique_error"),
        stat("mean"), stat("std"), stat("min"), stat("max"), at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"),
        F.when(F.col("n_num") > 0, F.lit(rank_error)).alias("rank_error"), stat("skewness"), stat("kurtosis"),
    ).orderBy("ordinal")


def approx_top_values(df: DataFrame, columns: list[str], k: int = 10, tracked: int = 10_000) -> DataFrame:
    """P9 by frequent-items summaries: ``column, rank, value, count_estimate, count_error``.

    Every value that occurs more than ``count_error`` times is among the tracked
    ones, and an estimate is off by no more than that. Values are shown as text; a table without rows gives none.
    """
    base = spine.clean(df.select(*[spine.q(c) for c in columns]))
    specs = spine.column_specs(base)
    cells = [spine.value_key(spine.as_text(spine.q(s.name), s.dtype)).alias(s.name) for s in specs]
    out = None
    for lo in range(0, len(specs), COLUMNS_AT_ONCE):
        some = [spine.q(s.name) for s in specs[lo : lo + COLUMNS_AT_ONCE]]
        long = base.select(*cells).unpivot([], some, "column", "v").where("v IS NOT NULL")
        got = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(v, {int(k)}, {int(tracked)})").alias("top"))
        out = got if out is None else out.unionAll(got)
    one = out.select("column", "n", F.posexplode("top").alias("i", "t"))
    return one.select("column", (F.col("i") + 1).alias("rank"), F.col("t.item").alias("value"), F.col("t.count").alias("count_estimate"),
                      F.ceil(F.col("n") * F.lit(ITEMS_ERROR / tracked)).alias("count_error"))
