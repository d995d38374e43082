"""Registered checks: one Spark query per operator over the generated tables
(or inputs Spark derives from them), each with a DuckDB oracle where SQL can
express it. ``__spark_entry__`` only re-exports these two mappings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.local import local_frame
from tabscope.plans import oracle as O
from tabscope.plans.fixtures import register_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.table(name)


def _columns(spark, sf_dir, view):
    from tabscope.operators.columns import profile_columns

    return profile_columns(_t(spark, sf_dir, view))


# ----------------------------------------------------------------- column profile
@check("profile_columns", O.profile_sql("li_nulls"))
def q_profile_columns(spark, sf_dir):
    return _columns(spark, sf_dir, "li_nulls")


@check("profile_columns_outliers", O.profile_sql("li_outliers"))
def q_profile_columns_outliers(spark, sf_dir):
    return _columns(spark, sf_dir, "li_outliers")


@check("profile_columns_kinds", O.profile_sql("li_kinds"))
def q_profile_columns_kinds(spark, sf_dir):
    return _columns(spark, sf_dir, "li_kinds")


@check("profile_columns_orders", O.profile_sql("orders"))
def q_profile_columns_orders(spark, sf_dir):
    return _columns(spark, sf_dir, "orders")


@check("column_types", O.profile_subset("li_kinds", ['"column"', "ordinal", '"type"']))
def q_column_types(spark, sf_dir):
    from tabscope.operators.columns import column_types

    return column_types(_t(spark, sf_dir, "li_kinds"))


@check("column_missing", O.missing_sql("li_nulls"))
def q_column_missing(spark, sf_dir):
    from tabscope.operators.charts import column_missing

    return column_missing(_t(spark, sf_dir, "li_nulls"))


@check("column_uniqueness", O.profile_subset("orders", ['"column"', "ordinal", "unique_count", "unique_ratio"]))
def q_column_uniqueness(spark, sf_dir):
    from tabscope.operators.columns import column_uniqueness

    return column_uniqueness(_t(spark, sf_dir, "orders"))


@check("column_entropy", O.profile_subset("orders", ['"column"', "ordinal", "entropy"]))
def q_column_entropy(spark, sf_dir):
    from tabscope.operators.columns import column_entropy

    return column_entropy(_t(spark, sf_dir, "orders"))


@check("numeric_stats", O.profile_subset(
    "li_nulls", ['"column"', "ordinal", "mean", "median", "std", '"min"', '"max"', "q25", "q75"], "mean IS NOT NULL"))
def q_numeric_stats(spark, sf_dir):
    from tabscope.operators.columns import numeric_stats

    return numeric_stats(_t(spark, sf_dir, "li_nulls"))


@check("numeric_stats_first3", O.profile_subset(
    "li_nulls", ['"column"', "ordinal", "mean", "median", "std", '"min"', '"max"', "q25", "q75"], "mean IS NOT NULL",
    " ORDER BY ordinal LIMIT 3"))
def q_numeric_stats_first3(spark, sf_dir):
    from tabscope.operators.columns import numeric_stats

    return numeric_stats(_t(spark, sf_dir, "li_nulls"), limit=3)


@check("outliers_iqr", O.profile_subset(
    "li_outliers", ['"column"', "outlier_count", "outlier_percentage", "lower_bound", "upper_bound"],
    "outlier_count IS NOT NULL"))
def q_outliers_iqr(spark, sf_dir):
    from tabscope.operators.columns import outliers_iqr

    return outliers_iqr(_t(spark, sf_dir, "li_outliers"))


@check("skew_kurtosis", O.profile_subset("lineitem", ['"column"', "skewness", "kurtosis"], "mean IS NOT NULL"))
def q_skew_kurtosis(spark, sf_dir):
    from tabscope.operators.columns import skew_kurtosis

    return skew_kurtosis(_t(spark, sf_dir, "lineitem"))


TOP_VALUES_SQL = """SELECT "column", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS "count",
  {r_pct} AS percentage
FROM (
  SELECT "column", value, cnt, n, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank
  FROM (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS cnt,
               (SELECT count(*) FROM orders) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
        UNION ALL
        SELECT 'o_orderpriority', o_orderpriority, count(*), (SELECT count(*) FROM orders) FROM orders
        WHERE o_orderpriority IS NOT NULL GROUP BY 2) f
) r WHERE rank <= 10"""


TOP_VALUES_SQL = TOP_VALUES_SQL.replace("{r_pct}", O.r("cnt * 100.0 / n", 2))


@check("top_values", TOP_VALUES_SQL)
def q_top_values(spark, sf_dir):
    from tabscope.operators.columns import top_values

    return top_values(_t(spark, sf_dir, "orders"))


@check("quality_score", O.profile_subset("li_outliers", ['"column"', "ordinal", "quality_score"]))
def q_quality_score(spark, sf_dir):
    from tabscope.operators.columns import quality_score

    return quality_score(_t(spark, sf_dir, "li_outliers"))


@check("quality_status", f"SELECT \"column\", ordinal, quality_score, status FROM ({O.profile_sql('li_nulls')}) p")
def q_quality_status(spark, sf_dir):
    from tabscope.operators.columns import quality_status

    return quality_status(_t(spark, sf_dir, "li_nulls"))


# ------------------------------------------------------------------ table profile
@check("table_completeness", O.completeness_sql("li_nulls"))
def q_table_completeness(spark, sf_dir):
    from tabscope.operators.table import table_completeness

    return table_completeness(_t(spark, sf_dir, "li_nulls"))


@check("overall_quality", f"""SELECT s AS overall_quality_score,
  CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 70 THEN 'good' ELSE 'needs cleaning' END AS verdict
FROM (SELECT {O.r('avg(quality_score)', 2)} AS s FROM ({O.profile_sql('li_outliers')}) p) x""")
def q_overall_quality(spark, sf_dir):
    from tabscope.operators.table import overall_quality

    return overall_quality(_t(spark, sf_dir, "li_outliers"))


DUP_SQL = f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows,
  {O.r(f"coalesce(sum(c - 1), 0) * 100.0 / (SELECT count(*) FROM {O.src('li_dups')})", 2)} AS duplicate_percentage,
  CAST(coalesce(sum(c), 0) AS BIGINT) AS rows_in_duplicate_groups,
  CAST(count(*) AS BIGINT) AS duplicate_groups,
  CAST(floor(coalesce(sum(c), 0) / 2) AS BIGINT) AS duplicate_groups_ref
FROM (SELECT count(*) AS c FROM {O.src('li_dups')} GROUP BY ALL HAVING count(*) > 1) g"""
DUP_SQL = DUP_SQL.replace("GROUP BY ALL", "GROUP BY l_returnflag, l_linestatus, l_linenumber")


@check("duplicate_rows", DUP_SQL)
def q_duplicate_rows(spark, sf_dir):
    from tabscope.operators.table import duplicate_rows

    return duplicate_rows(_t(spark, sf_dir, "li_dups"))


@check("duplicate_row_list", """SELECT text, lang, source, n_chars, CAST(group_size AS BIGINT) AS group_size FROM (
  SELECT text, lang, source, n_chars, count(*) OVER (PARTITION BY text, lang, source, n_chars) AS group_size
  FROM documents) d WHERE group_size > 1""")
def q_duplicate_row_list(spark, sf_dir):
    from tabscope.operators.table import duplicate_row_list

    return duplicate_row_list(_t(spark, sf_dir, "documents").drop("doc_id"))


@check("column_duplicates", O.profile_subset("orders", ['"column"', "ordinal", "duplicate_count"], "duplicate_count > 0"))
def q_column_duplicates(spark, sf_dir):
    from tabscope.operators.table import column_duplicates

    return column_duplicates(_t(spark, sf_dir, "orders"))


@check("missing_patterns", O.missing_patterns_sql("li_nulls"))
def q_missing_patterns(spark, sf_dir):
    from tabscope.operators.table import missing_patterns

    return missing_patterns(_t(spark, sf_dir, "li_nulls"))


@check("missing_correlation", O.missing_corr_sql("li_nulls"))
def q_missing_correlation(spark, sf_dir):
    from tabscope.operators.table import missing_correlation

    return missing_correlation(_t(spark, sf_dir, "li_nulls"))


@check("correlation_matrix", O.corr_matrix_sql("li_nulls"))
def q_correlation_matrix(spark, sf_dir):
    from tabscope.operators.table import correlation_matrix

    return correlation_matrix(_t(spark, sf_dir, "li_nulls"))


@check("correlation_matrix_kinds", O.corr_matrix_sql("li_kinds"))
def q_correlation_matrix_kinds(spark, sf_dir):
    from tabscope.operators.table import correlation_matrix

    return correlation_matrix(_t(spark, sf_dir, "li_kinds"))


@check("strong_correlations", O.strong_corr_sql("li_linear"))
def q_strong_correlations(spark, sf_dir):
    from tabscope.operators.table import strong_correlations

    return strong_correlations(_t(spark, sf_dir, "li_linear"))


@check("strong_correlations_hide_ids", O.strong_corr_sql("li_linear", hide_ids=True))
def q_strong_correlations_hide_ids(spark, sf_dir):
    from tabscope.operators.table import strong_correlations

    return strong_correlations(_t(spark, sf_dir, "li_linear"), hide_ids=True)


@check("profile_columns_exact", O.profile_sql("orders_exact"))
def q_profile_columns_exact(spark, sf_dir):
    """Whole numbers beyond 2^53 and a decimal column are grouped exactly."""
    return _columns(spark, sf_dir, "orders_exact")


def _top_sql(view: str, columns: dict[str, str], k: int = 10) -> str:
    s = O.src(view)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {shown} AS value, count(*) AS cnt, (SELECT count(*) FROM {s}) AS n, {order} AS o FROM {s} "
        f"WHERE {c} IS NOT NULL GROUP BY 2, 5" for c, (shown, order) in columns.items())
    return f"""SELECT "column", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS "count", {O.r("cnt * 100.0 / n", 2)} AS percentage
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, o, value) AS rank FROM ({parts}) p) q WHERE rank <= {k}"""


@check("top_values_numbers", _top_sql("lineitem", {
    "l_quantity": ("printf('%.1f', l_quantity)", "l_quantity"), "l_linenumber": ("CAST(l_linenumber AS VARCHAR)", "CAST(l_linenumber AS DOUBLE)"),
    "l_orderkey": ("CAST(l_orderkey AS VARCHAR)", "CAST(l_orderkey AS DOUBLE)")}))
def q_top_values_numbers(spark, sf_dir):
    from tabscope.operators.columns import top_values

    return top_values(_t(spark, sf_dir, "lineitem"), columns=["l_quantity", "l_linenumber", "l_orderkey"])


@check("top_values_long_text", """SELECT CAST(row_number() OVER (ORDER BY cnt DESC, k) AS INTEGER) AS rank, CAST(cnt AS BIGINT) AS "count", CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest
FROM (SELECT k, any_value(text) AS t, count(*) AS cnt FROM (
  SELECT text, CASE WHEN length(text) > 256 THEN concat(chr(57344), 'long', chr(57344), substring(text, 1, 200), sha256(text)) ELSE text END AS k
  FROM documents WHERE text IS NOT NULL) x GROUP BY k) y ORDER BY cnt DESC, k LIMIT 100""")
def q_top_values_long_text(spark, sf_dir):
    """The 100 most frequent documents as top values: they come back whole, not as their key in F."""
    from tabscope.operators.columns import top_values

    out = top_values(_t(spark, sf_dir, "documents"), k=100, columns=["text"])
    return out.select("rank", "count", F.length("value").alias("chars"), F.md5("value").alias("digest"))


_APPROX = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_discount", "l_tax"]
_APPROX_NUMBERS = [c for c in _APPROX if c not in ("l_returnflag", "l_shipdate")]


@check("approx_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
  CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, TRUE AS unique_within, """
    + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {O.r(f'avg({c})', 4)} AS mean, TRUE AS quantiles_within" if c in _APPROX_NUMBERS
       else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS BOOLEAN) AS quantiles_within")
    + f" FROM {O.src('li_nulls')}" for c in _APPROX))
def q_approx_profile(spark, sf_dir):
    """The sketch profile next to exact figures: estimates of distinct values and ranks of quantiles are within the bounds it states."""
    from tabscope.operators.approx import approx_profile
    from tabscope.operators.columns import column_uniqueness

    t = _t(spark, sf_dir, "li_nulls").select(*_APPROX)
    own = approx_profile(t).collect()  # a row a column
    ranks = t.agg(*[F.count_if(F.col(f"`{r['column']}`") < r[x]).alias(f"{r['column']}:{x}:<") for r in own if r["rank_error"] for x in ("q25", "median", "q75")],
                  *[F.count_if(F.col(f"`{r['column']}`") <= r[x]).alias(f"{r['column']}:{x}:=") for r in own if r["rank_error"] for x in ("q25", "median", "q75")]).first()
    rows = []
    for r in own:
        n, within = r["n_rows"] - r["missing_count"], None
        if r["rank_error"]:
            slack = r["rank_error"] * n + 1
            within = all(ranks[f"{r['column']}:{x}:<"] - slack <= p * n <= ranks[f"{r['column']}:{x}:="] + slack for x, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
        rows.append((r["column"], r["n_rows"], r["missing_count"], r["unique_estimate"], r["unique_error"], r["min"], r["max"], r["mean"], within))
    found = local_frame(spark, rows, "column string, n_rows long, missing_count long, estimate long, error long, min double, max double, mean double, quantiles_within boolean")
    out = found.join(column_uniqueness(t).select("column", "unique_count"), "column")
    return out.select("column", "n_rows", "missing_count", "unique_count", (F.abs(F.col("estimate") - F.col("unique_count")) <= F.col("error")).alias("unique_within"),
                      "min", "max", "mean", "quantiles_within")


@check("approx_top_values", """SELECT 'l_returnflag' AS "column", l_returnflag AS value, CAST(count(*) AS BIGINT) AS exact, TRUE AS within FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), CAST(count(*) AS BIGINT), TRUE FROM lineitem GROUP BY 2""")
def q_approx_top_values(spark, sf_dir):
    """Frequent-items summaries next to exact counts of the same values."""
    from tabscope.operators.approx import approx_top_values

    li = _t(spark, sf_dir, "lineitem")
    found = approx_top_values(li, ["l_returnflag", "l_linenumber"], k=10)
    long = li.select("l_returnflag", F.col("l_linenumber").cast("string")).unpivot([], ["l_returnflag", "l_linenumber"], "column", "value")
    exact = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("exact"))
    return found.join(exact, ["column", "value"]).select("column", "value", "exact", (F.abs(F.col("count_estimate") - F.col("exact")) <= F.col("count_error")).alias("within"))


@check("top_values_unique", """SELECT "column", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS "count" FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, o, value) AS rank FROM (
    SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS value, CAST(o_orderkey AS DOUBLE) AS o, count(*) AS cnt FROM orders GROUP BY 2, 3
    UNION ALL SELECT 'code', concat('order-', o_orderkey), NULL, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey AS DOUBLE), count(*) FROM orders GROUP BY 2, 3
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, NULL, count(*) FROM orders GROUP BY 2) x) y WHERE rank <= 10""")
def q_top_values_unique(spark, sf_dir):
    """Columns whose values all differ, one of many small ties and one of few values: exact without counting every value where that is proven."""
    from tabscope.operators.columns import top_values

    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("code"), "o_custkey", "o_orderpriority")
    return top_values(orders, columns=orders.columns).select("column", "rank", "value", "count")


@check("profile_table", f"""SELECT 'columns' AS part, CAST(count(*) AS BIGINT) AS rows, {O.r('avg(quality_score)', 2)} AS figure FROM ({O.profile_sql('li_nulls')}) p
UNION ALL SELECT 'completeness', 1, completeness_percentage FROM ({O.completeness_sql('li_nulls')}) c
UNION ALL SELECT 'column_duplicates', CAST(count(*) AS BIGINT), CAST(sum(duplicate_count) AS DOUBLE) FROM ({O.profile_sql('li_nulls')}) p WHERE duplicate_count > 0
UNION ALL SELECT 'missing_patterns', 1, CAST(rows_with_missing AS DOUBLE) FROM ({O.missing_patterns_sql('li_nulls')}) m
UNION ALL SELECT 'missing_correlation', CAST(count(*) AS BIGINT), CAST(sum(correlation) AS DOUBLE) FROM ({O.missing_corr_sql('li_nulls')}) m
UNION ALL SELECT 'correlation_matrix', CAST(count(*) AS BIGINT), {O.r('sum(correlation)', 3)} FROM ({O.corr_matrix_sql('li_nulls')}) m
UNION ALL SELECT 'overall_quality', 1, {O.r('avg(quality_score)', 2)} FROM ({O.profile_sql('li_nulls')}) p""")
def q_profile_table(spark, sf_dir):
    """The whole report from one set of scans; a figure from each part."""
    from tabscope.operators.table import profile_table

    rep = profile_table(_t(spark, sf_dir, "li_nulls"))
    figures = {
        "columns": F.expr("avg(quality_score)"), "completeness": F.max("completeness_percentage"), "column_duplicates": F.sum("duplicate_count"),
        "missing_patterns": F.max("rows_with_missing"), "missing_correlation": F.sum("correlation"), "correlation_matrix": F.sum("correlation"),
        "overall_quality": F.max("overall_quality_score"),
    }
    from tabscope.functions.expressions import rnd

    places = {"columns": 2, "correlation_matrix": 3}
    out = None
    for part, figure in figures.items():
        value = figure.cast("double")
        row = rep[part].agg(F.count("*").alias("rows"), (rnd(value, places[part]) if part in places else value).alias("figure")).select(F.lit(part).alias("part"), "rows", "figure")
        out = row if out is None else out.union(row)
    return out


@check("constant_columns", O.profile_subset("li_kinds", ['"column"', "ordinal"], "unique_count <= 1"))
def q_constant_columns(spark, sf_dir):
    from tabscope.operators.table import constant_columns

    return constant_columns(_t(spark, sf_dir, "li_kinds"))


@check("high_cardinality", O.profile_subset("orders", ['"column"', "ordinal", "unique_ratio"], "unique_count * 1.0 / "
                                            "(SELECT count(*) FROM orders) > 0.9"))
def q_high_cardinality(spark, sf_dir):
    from tabscope.operators.table import high_cardinality

    return high_cardinality(_t(spark, sf_dir, "orders"))


@check("data_size", """SELECT 'o_orderkey' AS "column", CAST(0 AS INTEGER) AS ordinal, CAST(8 * count(o_orderkey) AS BIGINT) AS bytes FROM orders
UNION ALL SELECT 'o_custkey', 1, CAST(8 * count(o_custkey) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderstatus', 2, CAST(coalesce(sum(strlen(o_orderstatus)), 0) AS BIGINT) FROM orders
UNION ALL SELECT 'o_totalprice', 3, CAST(8 * count(o_totalprice) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderdate', 4, CAST(8 * count(o_orderdate) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderpriority', 5, CAST(coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) FROM orders""")
def q_data_size(spark, sf_dir):
    from tabscope.operators.table import data_size

    return data_size(_t(spark, sf_dir, "orders"))


@check("type_distribution", f"""SELECT storage_type, CAST(count(*) AS BIGINT) AS columns, CAST(sum(n) AS BIGINT) AS "values" FROM (
{' UNION ALL '.join(f"SELECT '{t}' AS storage_type, count({c}) AS n FROM {O.src('li_nulls')}" for c, _, t in O.SCHEMAS['li_nulls'])}) x GROUP BY 1""")
def q_type_distribution(spark, sf_dir):
    from tabscope.operators.table import type_distribution

    return type_distribution(_t(spark, sf_dir, "li_nulls"))


@check("semantic_type_distribution", f"""SELECT "type", CAST(count(*) AS BIGINT) AS columns
FROM ({O.profile_sql('li_kinds')}) p GROUP BY 1""")
def q_semantic_type_distribution(spark, sf_dir):
    from tabscope.operators.table import semantic_type_distribution

    return semantic_type_distribution(_t(spark, sf_dir, "li_kinds"))


@check("table_summary", f"""SELECT c.rows, c.columns, c.missing_percentage,
  (SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate)) AS BIGINT) FROM {O.src('li_nulls')}) AS duplicates,
  CAST(7 AS INTEGER) AS numeric_columns, CAST(3 AS INTEGER) AS categorical_columns
FROM ({O.completeness_sql('li_nulls')}) c""")
def q_table_summary(spark, sf_dir):
    from tabscope.operators.table import table_summary

    return table_summary(_t(spark, sf_dir, "li_nulls"))


@check("table_warnings", f"""SELECT "column", ordinal, 'constant' AS warning FROM ({O.profile_sql('li_kinds')}) p
WHERE unique_count <= 1
UNION ALL
SELECT "column", ordinal, 'high_cardinality' FROM ({O.profile_sql('li_kinds')}) p
WHERE unique_count * 1.0 / (SELECT count(*) FROM lineitem) > 0.9""")
def q_table_warnings(spark, sf_dir):
    from tabscope.operators.table import table_warnings

    return table_warnings(_t(spark, sf_dir, "li_kinds"))


# ---------------------------------------------------------------- chart data
def histogram_sql(table: str, col: str, bins: int) -> str:
    return f"""WITH v AS (SELECT CAST({col} AS DOUBLE) AS v FROM {table} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
mm AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
p AS (SELECT lo, hi, (hi - lo) / {bins} AS step FROM mm),
i0 AS (SELECT v.v, CAST(floor((v.v - p.lo) / (p.hi - p.lo) * {bins}.0) AS BIGINT) AS i, p.lo, p.hi, p.step FROM v, p),
i1 AS (SELECT v, CASE WHEN i = {bins} THEN {bins - 1} ELSE i END AS i, lo, hi, step FROM i0),
i2 AS (SELECT v, CASE WHEN v < (CASE WHEN i >= {bins} THEN hi ELSE i * step + lo END) THEN i - 1 ELSE i END AS i,
              lo, hi, step FROM i1),
i3 AS (SELECT CASE WHEN v >= (CASE WHEN i + 1 >= {bins} THEN hi ELSE (i + 1) * step + lo END) AND i <> {bins - 1}
              THEN i + 1 ELSE i END AS bin FROM i2),
c AS (SELECT bin, count(*) AS cnt FROM i3 GROUP BY bin),
axis AS (SELECT range AS bin FROM range({bins}))
SELECT CAST(axis.bin AS INTEGER) AS bin,
  CASE WHEN axis.bin >= {bins} THEN p.hi ELSE axis.bin * p.step + p.lo END AS lo,
  CASE WHEN axis.bin + 1 >= {bins} THEN p.hi ELSE (axis.bin + 1) * p.step + p.lo END AS hi,
  printf('%.2f - %.2f', CASE WHEN axis.bin >= {bins} THEN p.hi ELSE axis.bin * p.step + p.lo END,
                        CASE WHEN axis.bin + 1 >= {bins} THEN p.hi ELSE (axis.bin + 1) * p.step + p.lo END) AS label,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS "count"
FROM axis CROSS JOIN p LEFT JOIN c ON c.bin = axis.bin"""


@check("histogram", histogram_sql("lineitem", "l_extendedprice", 30))
def q_histogram(spark, sf_dir):
    from tabscope.operators.charts import histogram

    return histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 30)


@check("histogram_edges", histogram_sql("lineitem", "l_discount", 10))
def q_histogram_edges(spark, sf_dir):
    from tabscope.operators.charts import histogram

    return histogram(_t(spark, sf_dir, "lineitem"), "l_discount", 10)


@check("histogram_int", histogram_sql("orders", "o_custkey", 7))
def q_histogram_int(spark, sf_dir):
    from tabscope.operators.charts import histogram

    return histogram(_t(spark, sf_dir, "orders"), "o_custkey", 7)


@check("category_frequency", """SELECT CAST(row_number() OVER (ORDER BY cnt DESC, value) AS INTEGER) AS rank, value,
  CAST(cnt AS BIGINT) AS "count"
FROM (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS cnt FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1) f
ORDER BY cnt DESC, value LIMIT 20""")
def q_category_frequency(spark, sf_dir):
    from tabscope.operators.charts import category_frequency

    return category_frequency(_t(spark, sf_dir, "orders"), "o_custkey")


def _dyn_sql(fn: str, value: str = "value") -> str:
    expr = {
        "sum": f"sum({value})", "mean": f"avg({value})", "median": f"quantile_cont({value}, 0.5)",
        "min": f"min({value})", "max": f"max({value})", "count": f"count({value})", "nunique": f"count(DISTINCT {value})",
    }[fn]
    where = "ts IS NOT NULL" + ("" if fn in ("count", "nunique") else f" AND {value} IS NOT NULL")
    return f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST({expr} AS DOUBLE) AS value
FROM events WHERE {where} GROUP BY 1"""


def _dyn_query(fn: str, value: str):
    def q(spark, sf_dir):
        from tabscope.operators.charts import dynamics

        return dynamics(_t(spark, sf_dir, "events"), "ts", value, fn)

    return q


for _fn, _val in [("sum", "value"), ("mean", "value"), ("median", "value"), ("min", "value"), ("max", "value"),
                  ("count", "event_type"), ("nunique", "user_id")]:
    check(f"dynamics_{_fn}", _dyn_sql(_fn, _val))(_dyn_query(_fn, _val))


@check("dynamics_empty", "SELECT CAST(NULL AS VARCHAR) AS day, CAST(NULL AS DOUBLE) AS value FROM events WHERE event_type <> event_type")
def q_dynamics_empty(spark, sf_dir):
    """V4e: no value of the column is a number, so no day has a sum."""
    return _dyn_query("sum", "event_type")(spark, sf_dir)


@check("dynamics_text_dates", f"""SELECT strftime(CAST(d AS DATE), '%Y-%m-%d') AS day, CAST(sum(o_totalprice) AS DOUBLE) AS value
FROM (SELECT try_strptime(order_day, '%Y-%m-%d') AS d, o_totalprice FROM {O.src('orders_text_dates')}) x
WHERE d IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1""")
def q_dynamics_text_dates(spark, sf_dir):
    from tabscope.operators.charts import dynamics

    return dynamics(_t(spark, sf_dir, "orders_text_dates"), "order_day", "o_totalprice", "sum")


@check("dynamics_zoned_dates", f"""SELECT strftime(CAST(substr(zoned_day, 1, 10) AS DATE), '%Y-%m-%d') AS day, CAST(sum(o_totalprice) AS DOUBLE) AS value
FROM {O.src('orders_zoned')} GROUP BY 1""")
def q_dynamics_zoned_dates(spark, sf_dir):
    from tabscope.operators.charts import dynamics

    return dynamics(_t(spark, sf_dir, "orders_zoned"), "zoned_day", "o_totalprice", "sum")


@check("dynamics_minute_dates", f"""SELECT strftime(CAST(substr(minute_day, 1, 10) AS DATE), '%Y-%m-%d') AS day, CAST(count(*) AS DOUBLE) AS value
FROM {O.src('orders_zoned')} GROUP BY 1""")
def q_dynamics_minute_dates(spark, sf_dir):
    from tabscope.operators.charts import dynamics

    return dynamics(_t(spark, sf_dir, "orders_zoned"), "minute_day", "o_totalprice", "count")


@check("outlier_split", f"""SELECT "column", CAST(n - outlier_count - missing_count AS BIGINT) AS normal,
  CAST(outlier_count AS BIGINT) AS outliers, CAST(missing_count AS BIGINT) AS nulls,
  CAST(n - outlier_count AS BIGINT) AS normal_ref, lower_bound, upper_bound
FROM (SELECT *, (SELECT count(*) FROM lineitem) AS n FROM ({O.profile_sql('li_outliers')}) p
      WHERE outlier_count IS NOT NULL) x""")
def q_outlier_split(spark, sf_dir):
    from tabscope.operators.charts import outlier_split

    return outlier_split(_t(spark, sf_dir, "li_outliers"))


@check("date_candidates", O.profile_subset(
    "li_kinds", ['"column"', "ordinal"],
    "\"type\" = 'datetime' OR regexp_matches(\"column\", '(?i)(date|dt|time|created|updated|opened|closed|трад|дата)')"))
def q_date_candidates(spark, sf_dir):
    from tabscope.operators.charts import date_candidates

    return date_candidates(_t(spark, sf_dir, "li_kinds"))


@check("top_missing_columns", f"""SELECT * FROM ({O.missing_sql('li_nulls')}) m WHERE missing_count > 0
ORDER BY missing_count DESC, ordinal LIMIT 5""")
def q_top_missing_columns(spark, sf_dir):
    from tabscope.operators.charts import top_missing_columns

    return top_missing_columns(_t(spark, sf_dir, "li_nulls"))


@check("columns_with_outliers", O.profile_subset(
    "li_outliers", ['"column"', "ordinal", "outlier_count", "outlier_percentage"], "outlier_count > 0",
    " ORDER BY ordinal LIMIT 5"))
def q_columns_with_outliers(spark, sf_dir):
    from tabscope.operators.charts import columns_with_outliers

    return columns_with_outliers(_t(spark, sf_dir, "li_outliers"))


# ------------------------------------------------------------ guarded SQL surface
def _sql_check(name: str, spark_sql: str, duck_sql: str | None = None, oracle: bool = True,
               current: str | None = None) -> None:
    def q(spark, sf_dir):
        from tabscope.operators.sql import guarded_sql
        from tabscope.sources.catalog import load_catalog

        return guarded_sql(load_catalog(spark, sf_dir), spark_sql, current_table=current)

    check(name, (duck_sql or spark_sql) if oracle else None)(q)


_sql_check("sql_filter_project", """SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross,
  CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band
FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity BETWEEN 10 AND 20 AND l_linestatus LIKE 'F%'""")
_sql_check("sql_join_inner", """SELECT o.o_orderkey, c.c_name, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000""")
_sql_check("sql_join_left", """SELECT c.c_custkey, count(o.o_orderkey) AS orders
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
_sql_check("sql_join_full", """SELECT s.s_suppkey, n.n_name
FROM supplier s FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey""")
_sql_check("sql_join_using", """SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)""")
_sql_check("sql_semi_join", """SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
_sql_check("sql_anti_join", """SELECT s_suppkey, s_name FROM supplier
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount > 0.09)""")
_sql_check("sql_range_join", """SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c
ON s.s_nationkey = c.c_nationkey AND c.c_acctbal BETWEEN s.s_acctbal - 100 AND s.s_acctbal + 100""")
_sql_check("sql_interval_join", """SELECT a.event_id, b.event_id AS next_event_id FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '10' MINUTE""")
_sql_check("sql_group_agg", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc,
  min(l_shipdate) AS first_ship, max(l_tax) AS max_tax, count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
_sql_check("sql_distinct_agg", """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS orders
FROM orders GROUP BY o_orderstatus HAVING count(*) > 10""")
_sql_check("sql_cube", """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g_flag,
  CAST(grouping(l_linestatus) AS INT) AS g_status, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
_sql_check("sql_rollup", """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g_flag,
  CAST(grouping(l_linestatus) AS INT) AS g_status, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
_sql_check("sql_grouping_sets", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
_sql_check("sql_approx", """SELECT o_orderstatus, approx_count_distinct(o_custkey) AS approx_customers,
  percentile_approx(o_totalprice, 0.5) AS approx_median FROM orders GROUP BY o_orderstatus""", oracle=False)
_sql_check("sql_approx_error", """WITH near AS (SELECT o_orderstatus, approx_count_distinct(o_custkey) AS customers,
  percentile_approx(o_totalprice, 0.5) AS middle FROM orders GROUP BY o_orderstatus)
SELECT o_orderstatus, abs(max(customers) - count(DISTINCT o_custkey)) <= 0.25 * count(DISTINCT o_custkey) AS customers_near,
  abs(count_if(o_totalprice <= middle) / count(o_totalprice) - 0.5) <= 0.0002 + 1 / count(o_totalprice) AS median_near
FROM orders JOIN near USING (o_orderstatus) GROUP BY o_orderstatus""",
           "SELECT o_orderstatus, TRUE AS customers_near, TRUE AS median_near FROM orders GROUP BY o_orderstatus")
_sql_check("sql_window_rank", """SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS rk,
  lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_price
FROM orders""")
_sql_check("sql_window_frame", """SELECT event_id, user_id,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_sum,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_n
FROM events""")
_sql_check("sql_top_k", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
_sql_check("sql_set_ops", """SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) a
UNION ALL SELECT 'customer_only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) b
UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) c""")
_sql_check("sql_cte_subquery", """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, round(total, 2) AS total FROM customer JOIN spend ON c_custkey = o_custkey
WHERE total > (SELECT avg(total) FROM spend)""")
_sql_check("sql_string_funcs", """SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low, substring(n_name, 1, 3) AS pre,
  CAST(length(n_name) AS INT) AS len, concat_ws('-', n_name, CAST(n_regionkey AS STRING)) AS tagged,
  replace(n_name, 'A', 'a') AS repl, regexp_extract(n_name, '([A-Z]+)', 1) AS caps, trim(n_name) AS trimmed
FROM nation""")
_sql_check("sql_date_funcs", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
  dayofweek(o_orderdate) AS dow, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS days
FROM orders""", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
  CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days
FROM orders""")
_sql_check("sql_math_funcs", """SELECT p_partkey, round(ln(p_retailprice), 6) AS ln_price, power(p_size, 2) AS size_sq,
  abs(p_retailprice - 1500) AS dist, CAST(floor(p_retailprice / 100) AS BIGINT) AS bucket, p_size % 7 AS m,
  round(sqrt(p_retailprice), 6) AS root
FROM part""")
_sql_check("sql_array_funcs", """SELECT vec_id, label, size(embedding) AS dim, CAST(array_max(embedding) AS DOUBLE) AS mx,
  round(aggregate(embedding, CAST(0 AS DOUBLE), (acc, x) -> acc + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 6) AS sq_norm
FROM embeddings""", """SELECT vec_id, label, CAST(len(embedding) AS INT) AS dim, CAST(list_max(embedding) AS DOUBLE) AS mx,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS sq_norm
FROM embeddings""")
_sql_check("sql_json_funcs", """SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events""",
           """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
_sql_check("sql_values", """SELECT v.code, v.label, count(*) AS n
FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial')) AS v(code, label) ON o_orderstatus = v.code
GROUP BY v.code, v.label""")
_sql_check("sql_temp_view", """CREATE TEMPORARY VIEW big_orders AS SELECT * FROM orders WHERE o_totalprice > 300000;
SELECT o_orderstatus, count(*) AS n FROM big_orders GROUP BY o_orderstatus""",
           """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_orderstatus""")
_sql_check("sql_current_alias", """SELECT o_orderpriority, count(*) AS n FROM df GROUP BY o_orderpriority""",
           """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""", current="orders")


# --------------------------------------------------------------- joins and keys
@check("asof_join", """SELECT l.event_id, l.user_id, l.ts, l.value, r.event_id AS p_event_id, r.value AS p_value,
  r.ts AS p_ts, r.event_type AS p_event_type, r.props AS p_props
FROM (SELECT * FROM events WHERE event_type = 'click') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
ON l.user_id = r.user_id AND l.ts >= r.ts""")
def q_asof_join(spark, sf_dir):
    from tabscope.operators.asof import asof_join

    ev = _t(spark, sf_dir, "events")
    clicks = ev.where(F.col("event_type") == "click").select("event_id", "user_id", "ts", "value")
    buys = ev.where(F.col("event_type") == "purchase")
    return asof_join(clicks, buys, "user_id", "ts", right_prefix="p_")


@check("asof_join_null_keys", """SELECT l.event_id, l.k, r.event_id AS p_event_id, r.value AS p_value
FROM (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS k, ts FROM events WHERE event_type = 'click') l
ASOF LEFT JOIN (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS k, ts, value FROM events WHERE event_type = 'purchase') r
ON l.k = r.k AND l.ts >= r.ts""")
def q_asof_join_null_keys(spark, sf_dir):
    from tabscope.operators.asof import asof_join

    ev = _t(spark, sf_dir, "events").withColumn("k", F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END"))
    clicks = ev.where(F.col("event_type") == "click").select("event_id", "k", "ts")
    buys = ev.where(F.col("event_type") == "purchase").select("event_id", "k", "ts", "value")
    return asof_join(clicks, buys, "k", "ts", right_prefix="p_").drop("ts", "p_ts")


@check("interval_join_hot_key", f"""SELECT a.event_id, b.event_id AS next_event_id
FROM {O.src('events_hot')} JOIN (SELECT * FROM {O.src('events_hot')}) b ON events_hot.user_id = b.user_id
  AND b.ts > events_hot.ts AND b.ts <= events_hot.ts + INTERVAL '10' MINUTE""".replace("SELECT a.event_id", "SELECT events_hot.event_id"))
def q_interval_join_hot_key(spark, sf_dir):
    """A third of all events lie on one user; the join splits it by time."""
    from tabscope.operators.bands import band_join

    ev = _t(spark, sf_dir, "events_hot").select("event_id", "user_id", "ts")
    out = band_join(ev, ev, "user_id", "ts", low=0, high=600, include_low=False)
    return out.select("event_id", F.col("r_event_id").alias("next_event_id"))


@check("range_join", """SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c
ON s.s_nationkey = c.c_nationkey AND c.c_acctbal - s.s_acctbal BETWEEN -100 AND 100""")
def q_range_join(spark, sf_dir):
    from tabscope.operators.bands import band_join

    s = _t(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_acctbal AS bal", "s_suppkey")
    c = _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "c_acctbal AS bal", "c_custkey")
    return band_join(s, c, "nation", "bal", low=-100, high=100).select("s_suppkey", F.col("r_c_custkey").alias("c_custkey"))


@check("running_totals_hot_key", f"""SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS running_n, round(sum(value) OVER w, 3) AS running_sum
FROM {O.src('events_hot')} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q_running_totals_hot_key(spark, sf_dir):
    from tabscope.operators.bands import running_totals

    out = running_totals(_t(spark, sf_dir, "events_hot"), "user_id", ["ts", "event_id"], "value", partitions=8)
    return out.select("event_id", "user_id", "running_n", F.round("running_sum", 3).alias("running_sum"))


@check("rank_hot_key", f"""SELECT event_id, user_id, event_type, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense_rank
FROM {O.src('events_hot')} WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def q_rank_hot_key(spark, sf_dir):
    """A third of all events lie on one user, and most of its events tie with many others."""
    from tabscope.operators.segments import ranked

    out = ranked(_t(spark, sf_dir, "events_hot").select("event_id", "user_id", "event_type"), "user_id", "event_type")
    return out.select("event_id", "user_id", "event_type", "rank", "dense_rank")


@check("moving_sum_hot_key", f"""SELECT event_id, user_id, round(sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 3) AS moving_sum,
  CAST(count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS around, lag(event_id) OVER w AS previous_id, lead(event_id, 2) OVER w AS later_id
FROM {O.src('events_hot')} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_moving_sum_hot_key(spark, sf_dir):
    """Moving frames, lag and lead within a user that holds a third of the events."""
    from tabscope.operators.segments import windowed

    columns = {
        "moving_sum": lambda w: F.round(F.sum("value").over(w.rowsBetween(-3, 0)), 3), "around": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-3, 2)),
        "previous_id": lambda w: F.lag("event_id").over(w), "later_id": lambda w: F.lead("event_id", 2).over(w),
    }
    ev = _t(spark, sf_dir, "events_hot").select("event_id", "user_id", "ts", "value")
    out = windowed(ev, "user_id", ["ts", "event_id"], columns, preceding=3, following=2)
    return out.select("event_id", "user_id", *columns)


@check("check_primary_key", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(o_orderkey) AS BIGINT) AS null_keys,
  CAST((SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS duplicate_keys,
  CAST(coalesce((SELECT sum(c) FROM (SELECT count(*) AS c FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1)), 0) AS BIGINT) AS duplicate_rows,
  (count(*) = count(o_orderkey)) AND NOT EXISTS (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) AS is_primary_key
FROM orders""")
def q_check_primary_key(spark, sf_dir):
    from tabscope.operators.keys import check_primary_key

    return check_primary_key(_t(spark, sf_dir, "orders"), "o_orderkey")


@check("check_primary_key_composite", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_keys,
  CAST((SELECT count(*) FROM (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)) AS BIGINT) AS duplicate_keys,
  CAST(coalesce((SELECT sum(c) FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)), 0) AS BIGINT) AS duplicate_rows,
  NOT EXISTS (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1) AS is_primary_key
FROM conversations""")
def q_check_primary_key_composite(spark, sf_dir):
    from tabscope.operators.keys import check_primary_key

    return check_primary_key(_t(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@check("check_foreign_key", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(doc_id) AS BIGINT) AS null_keys,
  CAST(count(*) FILTER (WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)) AS BIGINT) AS orphan_rows,
  CAST(count(DISTINCT doc_id) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)) AS BIGINT) AS orphan_keys
FROM labels""")
def q_check_foreign_key(spark, sf_dir):
    from tabscope.operators.keys import check_foreign_key

    return check_foreign_key(_t(spark, sf_dir, "labels"), "doc_id", _t(spark, sf_dir, "documents"), "doc_id")


@check("check_foreign_key_lineitem", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_keys,
  CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS BIGINT) AS orphan_rows,
  CAST(count(DISTINCT l_orderkey) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS BIGINT) AS orphan_keys
FROM lineitem""")
def q_check_foreign_key_lineitem(spark, sf_dir):
    from tabscope.operators.keys import check_foreign_key

    return check_foreign_key(_t(spark, sf_dir, "lineitem"), "l_orderkey", _t(spark, sf_dir, "orders"), "o_orderkey")


# ----------------------------------------------------------------- normality
@check("normality_jb", f"""SELECT "column", CAST(n AS BIGINT) AS n, {O.r('jb', 4)} AS jarque_bera, {O.r('exp(-jb / 2)', 6)} AS p_value,
  exp(-jb / 2) > 0.05 AS is_normal
FROM (SELECT "column", n, n / 6.0 * (power(s, 2) + power(k, 2) / 4.0) AS jb FROM (
  {' UNION ALL '.join(
      f"SELECT '{c}' AS \"column\", count(x) AS n, avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS s, "
      f"avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3 AS k FROM (SELECT CAST({c} AS DOUBLE) AS x, "
      f"avg(CAST({c} AS DOUBLE)) OVER () AS mu FROM {O.src('li_nulls')}) z WHERE x IS NOT NULL"
      for c, cls, _ in O.SCHEMAS['li_nulls'] if cls == 'numeric')}) m) j""")
def q_normality_jb(spark, sf_dir):
    from tabscope.operators.normality import normality_jb

    return normality_jb(_t(spark, sf_dir, "li_nulls"))



# --------------------------------------------------------------------- logs
@check("chat_summaries", r"""SELECT conv_id,
  CASE WHEN t <> '' THEN t END AS title, CAST(messages_count AS BIGINT) AS messages_count,
  CAST(turns AS BIGINT) AS turns, last_turn, created_at, updated_at
FROM (SELECT conv_id, min(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' HOUR + conv_id * INTERVAL '1' DAY) AS created_at,
        max(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' HOUR + conv_id * INTERVAL '1' DAY) AS updated_at, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS messages_count, count(*) AS turns,
        max(turn) AS last_turn,
        substring(split_part(regexp_replace(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'),
          '^[\s\x85\xa0]+', ''), '[\s\x85\xa0]+$', ''), chr(10), 1), 1, 40) AS t
      FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id) x""")
def q_chat_summaries(spark, sf_dir):
    from tabscope.operators.logs import chat_summaries

    conv = _t(spark, sf_dir, "conversations").selectExpr(
        "*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(conv_id AS INT), CAST(turn AS INT)) AS created_at",
        "IF(conv_id % 2 = 0, 'web', 'mail') AS source_id")
    return chat_summaries(conv, source_id="web")


@check("chat_transcript", r"""SELECT conv_id, turn, role, text FROM conversations
WHERE role IN ('user', 'assistant') AND text IS NOT NULL
  AND regexp_replace(text, '[\s\x85\xa0]+', '', 'g') <> ''""")
def q_chat_transcript(spark, sf_dir):
    from tabscope.operators.logs import chat_transcript

    return chat_transcript(_t(spark, sf_dir, "conversations"))


# ------------------------------------------------------------ sinks and sources
@check("json_safe", """SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value, user_id, event_type, props,
  event_id % 5 = 0 AS no_struct FROM events""")
def q_json_safe(spark, sf_dir):
    from tabscope.sources.sinks import json_safe

    ev = _t(spark, sf_dir, "events")
    ev = ev.withColumn("value", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    ev = ev.withColumn("nested", F.when(F.col("event_id") % 5 != 0, F.struct("value")))
    return json_safe(ev).withColumn("no_struct", F.col("nested").isNull()).drop("nested")


@check("catalog_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows, "
    f"CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS INTEGER) AS columns, "
    f"CAST({chr(39) + 'o_orderkey' + chr(39) if t == 'orders' else 'NULL'} AS VARCHAR) AS primary_key, "
    f"CAST({chr(39) + 'o_custkey -> customer(c_custkey)' + chr(39) if t == 'orders' else 'NULL'} AS VARCHAR) AS foreign_keys FROM {t}"
    for t in ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
              "nation", "orders", "pages", "part", "region", "supplier"]))
def q_catalog_tables(spark, sf_dir):
    from tabscope.sources.catalog import catalog_tables, load_catalog

    cat = load_catalog(spark, f"file://{sf_dir}" if sf_dir.startswith("/") else sf_dir)
    cat.register("orders", cat.loaders["orders"], ["o_orderkey"],
                 [{"constrained_columns": ["o_custkey"], "referred_table": "customer", "referred_columns": ["c_custkey"]}])
    return catalog_tables(cat)


@check("catalog_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST({i} AS INTEGER) AS ordinal, '{k}' AS type, TRUE AS nullable, "
    f"CAST(count({c}) AS BIGINT) AS non_null FROM {t}"
    for t in ("orders", "lineitem", "events", "documents") for i, (c, _, k) in enumerate(O.SCHEMAS[t])))
def q_catalog_columns(spark, sf_dir):
    from tabscope.sources.catalog import catalog_columns, load_catalog

    return catalog_columns(load_catalog(spark, sf_dir)).where(F.col("table").isin("orders", "lineitem", "events", "documents"))


_DUCK_TO_SPARK = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
                  "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' "
                  "ELSE lower(data_type) END")
_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
           "nation", "orders", "pages", "part", "region", "supplier"]


@check("describe_tables", "SELECT c.\"table\", c.rows, c.columns, d.dtypes FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows, "
    f"CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS INTEGER) AS columns FROM {t}"
    for t in _TABLES) + ") c JOIN (SELECT table_name AS \"table\", string_agg(column_name || ': ' || " + _DUCK_TO_SPARK
    + ", ', ' ORDER BY ordinal_position) AS dtypes FROM information_schema.columns GROUP BY table_name) d USING (\"table\")")
def q_describe_tables(spark, sf_dir):
    from tabscope.sources.catalog import describe_tables, load_catalog

    return describe_tables(load_catalog(spark, sf_dir))


# Columns of the relational tables that can be keys, by kind.
_KEY_COLUMNS = {
    "region": "r_regionkey:whole r_name:text", "nation": "n_nationkey:whole n_name:text n_regionkey:whole",
    "customer": "c_custkey:whole c_name:text c_nationkey:whole c_mktsegment:text",
    "supplier": "s_suppkey:whole s_name:text s_nationkey:whole",
    "part": "p_partkey:whole p_name:text p_brand:text p_type:text p_size:whole",
    "orders": "o_orderkey:whole o_custkey:whole o_orderstatus:text o_orderdate:time o_orderpriority:text",
    "lineitem": "l_orderkey:whole l_partkey:whole l_suppkey:whole l_linenumber:whole l_returnflag:text "
                "l_linestatus:text l_shipdate:time",
}
_KEY_COLUMNS = {t: [tuple(c.split(":")) for c in cs.split()] for t, cs in _KEY_COLUMNS.items()}


def _found_keys_sql() -> str:
    """Unique columns, pairs in tables without one, and inclusions, over all column pairs of ``_KEY_COLUMNS``."""
    values = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, cs in _KEY_COLUMNS.items() for c, k in cs)
    single = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, n FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d FROM {t}) WHERE n > 0 AND n = d"
        for t, cs in _KEY_COLUMNS.items() for c, _ in cs)
    double = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{a},{b}' AS c, n FROM (SELECT count(*) AS n, count({a}) AS x, count({b}) AS y, "
        f"count(DISTINCT ({a}, {b})) AS d FROM {t}) WHERE n > 0 AND n = x AND n = y AND n = d"
        for t, cs in _KEY_COLUMNS.items() for i, (a, _) in enumerate(cs) for b, _ in cs[i + 1:])
    return f"""WITH vals AS ({values}), single AS ({single}), double AS ({double}),
  totals AS (SELECT t, c, count(*) AS d FROM vals GROUP BY t, c)
SELECT t AS "table", 'unique' AS kind, c AS columns, CAST(NULL AS VARCHAR) AS referred_table,
  CAST(NULL AS VARCHAR) AS referred_columns, CAST(n AS BIGINT) AS distinct_values, CAST(NULL AS BIGINT) AS referred_values
FROM (SELECT * FROM single UNION ALL SELECT * FROM double WHERE t NOT IN (SELECT t FROM single)) u
UNION ALL
SELECT x.t, 'inclusion', x.c, x.pt, x.pc, CAST(x.held AS BIGINT), CAST(x.n AS BIGINT) FROM (
  SELECT a.t, a.c, b.t AS pt, b.c AS pc, s.n, count(*) AS held FROM vals a JOIN vals b ON a.k = b.k AND a.v = b.v
  JOIN single s ON s.t = b.t AND s.c = b.c WHERE a.t <> b.t OR a.c <> b.c GROUP BY 1, 2, 3, 4, 5) x
JOIN totals ON totals.t = x.t AND totals.c = x.c WHERE totals.d = x.held"""


@check("find_keys", _found_keys_sql())
def q_find_keys(spark, sf_dir):
    from tabscope.operators.keys import find_keys
    from tabscope.sources.catalog import Catalog, parquet_loader

    cat = Catalog(spark)
    for t in _KEY_COLUMNS:
        cat.register(t, parquet_loader(spark, f"{sf_dir}/{t}.parquet"))
    found = find_keys(cat)
    return found.withColumn("columns", F.array_join("columns", ",")).withColumn(
        "referred_columns", F.array_join("referred_columns", ","))


@check("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_sample_rows(spark, sf_dir):
    from tabscope.sources.catalog import load_catalog, sample_rows

    return sample_rows(load_catalog(spark, sf_dir), "orders", 5)


@check("source_metadata")
def q_source_metadata(spark, sf_dir):
    from tabscope.sources.readers import source_metadata

    return source_metadata(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).drop("uploaded_at")


@check("source_metadata_rows", """SELECT 'lineitem.parquet' AS filename, CAST(count(*) AS BIGINT) AS rows,
  CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS INTEGER) AS columns, TRUE AS has_size FROM lineitem""")
def q_source_metadata_rows(spark, sf_dir):
    """The receipt with its file size as a flag, which SQL can state."""
    return q_source_metadata(spark, sf_dir).select("filename", "rows", "columns", (F.col("size_bytes") > 0).alias("has_size"))


@check("catalog_table", """SELECT 'named' AS lookup, CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders
UNION ALL SELECT 'current', CAST(count(*) AS BIGINT), CAST(sum(o_orderkey) AS BIGINT) FROM orders""")
def q_catalog_table(spark, sf_dir):
    """A table by name, then the current one, which is the last that was named."""
    from tabscope.sources.catalog import load_catalog

    cat = load_catalog(spark, sf_dir)
    lookups = [("named", cat.table("orders")), ("current", cat.table())]
    first, second = (df.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")).select(
        F.lit(name).alias("lookup"), "rows", "keys") for name, df in lookups)
    return first.unionByName(second)


_DIFF_METRICS = ["missing_percentage", "unique_ratio", "entropy", "mean", "std", "median", "quality_score"]


@check("profile_diff", "SELECT coalesce(b.\"column\", a.\"column\") AS \"column\", b.\"type\" AS type_before, "
       "a.\"type\" AS type_after, b.\"type\" <> a.\"type\" AS type_changed, " + ", ".join(
           f"b.{m} AS {m}_before, a.{m} AS {m}_after, a.{m} - b.{m} AS {m}_delta" for m in _DIFF_METRICS)
       + f" FROM ({O.profile_sql('lineitem')}) b FULL OUTER JOIN ({O.profile_sql('li_nulls')}) a ON b.\"column\" = a.\"column\"")
def q_profile_diff(spark, sf_dir):
    from tabscope.operators.diff import profile_diff

    return profile_diff(_columns(spark, sf_dir, "lineitem"), _columns(spark, sf_dir, "li_nulls"))


@check("dynamics_stream", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS events,
  round(sum(value), 6) AS value_sum, max(value) AS value_max FROM events GROUP BY 1""")
def q_dynamics_stream(spark, sf_dir):
    from tabscope.streaming.dynamics import run_dynamics_stream

    from tabscope.operators.quantiles import scratch_path

    ev = _t(spark, sf_dir, "events")
    path = scratch_path(spark, "events-stream")  # four files, days mixed: most rows come late
    ev.repartition(4, F.col("event_id") % 4).write.parquet(path)
    out = run_dynamics_stream(spark, path, ev.schema, "ts", "value", files_per_batch=1)
    return out.select("day", "events", F.round("value_sum", 6).alias("value_sum"), "value_max")


# ------------------------------------------------------------------- file readers
@check("read_csv", """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def q_read_csv(spark, sf_dir):
    """Spark writes a CSV copy of ``orders`` (with pandas NA tokens) to the scratch
    folder; ``read_any`` reads it back with NA handling and type inference."""
    from tabscope.operators.quantiles import scratch_path
    from tabscope.sources.readers import read_any

    path = scratch_path(spark, "orders") + ".csv"
    src = _t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("N/A")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice",
        F.when(F.col("o_orderkey") % 19 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    src.write.option("header", True).csv(path)
    return read_any(spark, path)


@check("read_json", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_type, value FROM events""")
def q_read_json(spark, sf_dir):
    """A JSON Lines copy of ``events`` with a date-named text column, read back:
    ``created_at`` comes back as a timestamp (shown as text for the comparison)."""
    from tabscope.operators.quantiles import scratch_path
    from tabscope.sources.readers import read_any

    path = scratch_path(spark, "events") + ".json"
    _t(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_type", "value"
    ).write.json(path)
    df = read_any(spark, path)
    assert dict(df.dtypes)["created_at"].startswith("timestamp")
    return df.select("event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                     "event_type", "value")


@check("read_csv_texts", """SELECT doc_id, text, lang || '"' || source AS tag FROM documents""")
def q_read_csv_texts(spark, sf_dir):
    """Texts with quotes, commas and line breaks through a CSV copy of ``documents``."""
    from tabscope.operators.quantiles import scratch_path
    from tabscope.sources.readers import read_csv

    path = scratch_path(spark, "documents") + ".csv"
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.concat("lang", F.lit('"'), "source").alias("tag"))
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return read_csv(spark, path)


@check("read_json_arrays", "SELECT page_id, url, html FROM pages")
def q_read_json_arrays(spark, sf_dir):
    """A folder of JSON arrays made of ``pages``, an array of at most 50 in each file."""
    from tabscope.operators.quantiles import scratch_path
    from tabscope.sources.readers import read_any

    path = scratch_path(spark, "pages") + ".json"
    rows = _t(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("k")).agg(F.to_json(F.collect_list(F.struct("page_id", "url", "html"))).alias("value"))
    rows.write.partitionBy("k").text(path)
    return read_any(spark, path).select("page_id", "url", "html")


@check("profile_columns_documents", O.profile_sql("documents"))
def q_profile_columns_documents(spark, sf_dir):
    """Whole documents (up to 20,000 words): long values enter F as prefix + SHA-256."""
    return _columns(spark, sf_dir, "documents")


@check("profile_columns_events", O.profile_sql("events"))
def q_profile_columns_events(spark, sf_dir):
    return _columns(spark, sf_dir, "events")


@check("write_report", O.profile_sql("li_nulls"))
def q_write_report(spark, sf_dir):
    """K2: the column report written as JSON to the scratch folder and read back."""
    from tabscope.operators.quantiles import scratch_path
    from tabscope.sources.sinks import write_report

    cols = _columns(spark, sf_dir, "li_nulls")
    path = scratch_path(spark, "report")
    write_report({"columns": cols}, path)
    return spark.read.schema(cols.schema).json(f"{path}/columns")


@check("profile_columns_mixed", O.profile_sql("orders_mixed"))
def q_profile_columns_mixed(spark, sf_dir):
    """Mixed date formats, a non-ISO date format, min == max and NaN next to null."""
    return _columns(spark, sf_dir, "orders_mixed")


@check("histogram_constant", histogram_sql(O.src("orders_mixed"), "five", 3))
def q_histogram_constant(spark, sf_dir):
    from tabscope.operators.charts import histogram

    return histogram(_t(spark, sf_dir, "orders_mixed"), "five", 3)


@check("histogram_nan", histogram_sql(O.src("orders_mixed"), "price_nan", 12))
def q_histogram_nan(spark, sf_dir):
    from tabscope.operators.charts import histogram

    return histogram(_t(spark, sf_dir, "orders_mixed"), "price_nan", 12)


@check("apply_transform", """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice
FROM orders GROUP BY o_orderstatus""")
def q_apply_transform(spark, sf_dir):
    """Q6: a user transform written in pandas syntax (pandas API on Spark)."""
    from tabscope.operators.transform import apply_transform
    from tabscope.sources.catalog import load_catalog

    def by_status(df, tables):
        psdf = df.pandas_api()
        out = psdf.groupby("o_orderstatus")["o_totalprice"].sum().round(2).reset_index()
        return out.sort_values("o_totalprice", ascending=False)

    return apply_transform(load_catalog(spark, sf_dir), by_status, "orders")


_FEEDBACK_SRC = """SELECT conv_id AS chat_id,
  CASE WHEN turn % 3 = 0 THEN ' Like ' WHEN turn % 3 = 1 THEN 'DISLIKE' ELSE 'meh' END AS feedback,
  CASE WHEN turn % 2 = 0 THEN '   ' ELSE text END AS comment, turn
FROM conversations"""


@check("clean_feedback", r"""SELECT *, CASE WHEN feedback IN ('like', 'dislike') THEN 'web' END AS source_id,
  CASE WHEN feedback IN ('like', 'dislike') THEN NULL ELSE 'feedback must be ''like'' or ''dislike''' END AS reason,
  CAST(CASE WHEN feedback IN ('like', 'dislike') THEN count(*) FILTER (WHERE feedback IN ('like', 'dislike')) OVER () END AS BIGINT) AS ids
FROM (SELECT chat_id, lower(trim(feedback)) AS feedback,
  CASE WHEN regexp_replace(comment, '^[\s\x85\xa0]+|[\s\x85\xa0]+$', '', 'g') = '' THEN NULL
       ELSE regexp_replace(comment, '^[\s\x85\xa0]+|[\s\x85\xa0]+$', '', 'g') END AS comment, turn
FROM (""" + _FEEDBACK_SRC + """) f) g""")
def q_clean_feedback(spark, sf_dir):
    """L4 over inputs derived from every conversation turn: kinds trimmed and
    lower-cased, anything else rejected with a reason, blank comments to null,
    accepted rows stamped and told apart by id."""
    from tabscope.operators.logs import clean_feedback

    register_views(spark, sf_dir)
    accepted, rejected = clean_feedback(spark.sql(_FEEDBACK_SRC), source_id="web")
    ids = accepted.where("created_at IS NOT NULL").agg(F.count_distinct("id")).first()[0]
    accepted = accepted.select("chat_id", "feedback", "comment", "turn", "source_id", F.lit(None).cast("string").alias("reason"), F.lit(ids).cast("long").alias("ids"))
    return accepted.union(rejected.select("chat_id", "feedback", "comment", "turn", F.lit(None).cast("string"), "reason", F.lit(None).cast("long")))


@check("clean_tickets", r"""SELECT subject, description, email,
  CASE WHEN subject = '' THEN 'subject is required' WHEN description = '' THEN 'description is required' END AS reason,
  CASE WHEN subject <> '' AND description <> '' THEN 'mail' END AS source_id
FROM (SELECT regexp_replace(subject, '^[\s\x85\xa0]+|[\s\x85\xa0]+$', '', 'g') AS subject,
        regexp_replace(coalesce(description, ''), '^[\s\x85\xa0]+|[\s\x85\xa0]+$', '', 'g') AS description, email
      FROM (SELECT CASE WHEN turn % 4 = 0 THEN '  ' ELSE role END AS subject, CASE WHEN turn % 7 = 5 THEN ' ' ELSE text END AS description,
                   CAST(NULL AS VARCHAR) AS email FROM conversations) t) u""")
def q_clean_tickets(spark, sf_dir):
    """L5 over inputs derived from conversations: subject and description required, rejected rows with their reason."""
    from tabscope.operators.logs import clean_tickets

    src = _t(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 4 == 0, F.lit("  ")).otherwise(F.col("role")).alias("subject"),
        F.when(F.col("turn") % 7 == 5, F.lit(" ")).otherwise(F.col("text")).alias("description"), F.lit(None).cast("string").alias("email"))
    accepted, rejected = clean_tickets(src, source_id="mail")
    none = F.lit(None).cast("string")
    return accepted.where("id IS NOT NULL AND created_at IS NOT NULL").select("subject", "description", "email", none.alias("reason"), "source_id").union(
        rejected.select("subject", "description", "email", "reason", none))


@check("append_log", """SELECT conv_id, turn, role, batch FROM (
  SELECT conv_id, turn, role, 1 AS batch FROM conversations WHERE role IN ('user', 'assistant')
  UNION ALL
  SELECT conv_id, turn, role, 2 AS batch FROM conversations WHERE role IN ('user', 'assistant')) x""")
def q_append_log(spark, sf_dir):
    """K3: two appends of the displayable chat turns to one log table, read back."""
    from tabscope.operators.logs import append_log, chat_transcript
    from tabscope.operators.quantiles import scratch_path

    path = scratch_path(spark, "chatlog")
    turns = chat_transcript(_t(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")
    for b in (1, 2):
        append_log(turns.withColumn("batch", F.lit(b)), path, partition_by=["batch"])
    return spark.read.parquet(path).select("conv_id", "turn", "role", F.col("batch").cast("int").alias("batch"))


@check("sql_result", """SELECT 'o_orderkey,o_totalprice' AS columns, CAST(least(50, count(*)) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS total_rows,
  count(*) > 50 AS truncated, CAST(arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS BIGINT) AS first_key FROM orders""")
def q_sql_result(spark, sf_dir):
    """Q5: the shape of a guarded query's result: columns, a preview, the whole number of rows."""
    from tabscope.operators.sql import read_only_sql
    from tabscope.sources.catalog import load_catalog

    r = read_only_sql(load_catalog(spark, sf_dir), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
                      count_rows=True)
    return local_frame(spark, [(",".join(r.columns), len(r.rows), r.total_rows, r.truncated, r.rows[0][0])],
                       "columns string, shown long, total_rows long, truncated boolean, first_key long")


@check("preview", """SELECT """ + ", ".join(
    f"substring(CAST({c} AS VARCHAR), 1, 60) AS {c}"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    + " FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) t")
def q_preview(spark, sf_dir):
    """K4: bounded text preview (50 rows, cells cut to 60 characters) of orders by key."""
    from tabscope.operators.sql import preview

    return preview(_t(spark, sf_dir, "orders").orderBy("o_orderkey"))


@check("catalog_status", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", 'ok' AS status, CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in _TABLES)
       + " UNION ALL SELECT 'broken', 'error', NULL")
def q_catalog_status(spark, sf_dir):
    """A catalog of all tables and one whose files are no Parquet; that one is kept with its error."""
    from tabscope.operators.quantiles import scratch_path
    from tabscope.sources.catalog import catalog_status, load_catalog

    cat = load_catalog(spark, sf_dir)
    path = scratch_path(spark, "broken")
    _t(spark, sf_dir, "region").select("r_name").write.text(path)
    cat.register("broken", lambda s: s.read.schema("a long").parquet(path))
    return catalog_status(cat).select("table", "status", "rows")
