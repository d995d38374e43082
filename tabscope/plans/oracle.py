"""DuckDB SQL that computes the same report rows as the Spark operators, used as
an independent oracle by ``__spark_entry__.oracle_sql``. Built column by
column from the schema of each input (spelled out below), straight from the
metric definitions: no shared code with the Spark side."""

from __future__ import annotations

from itertools import combinations

from tabscope.plans.fixtures import DERIVED

# (name, class, Spark type name) per registered input.
SCHEMAS = {
    "li_nulls": [
        ("l_orderkey", "numeric", "bigint"), ("l_partkey", "numeric", "bigint"), ("l_linenumber", "numeric", "int"),
        ("l_quantity", "numeric", "double"), ("l_extendedprice", "numeric", "double"), ("l_discount", "numeric", "double"),
        ("l_tax", "numeric", "double"), ("l_returnflag", "string", "string"), ("l_linestatus", "string", "string"),
        ("l_shipdate", "datetime", "timestamp_ntz"),
    ],
    "li_outliers": [
        ("l_orderkey", "numeric", "bigint"), ("l_quantity", "numeric", "double"),
        ("l_extendedprice", "numeric", "double"), ("l_discount", "numeric", "double"), ("l_returnflag", "string", "string"),
    ],
    "li_kinds": [
        ("l_orderkey", "numeric", "bigint"), ("l_linenumber", "numeric", "int"), ("l_returnflag", "string", "string"),
        ("is_discounted", "boolean", "boolean"), ("ship_day", "string", "string"), ("l_shipdate", "datetime", "timestamp_ntz"),
        ("one", "numeric", "int"), ("nothing", "numeric", "double"), ("line_code", "string", "string"),
    ],
    "orders": [
        ("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"), ("o_orderstatus", "string", "string"),
        ("o_totalprice", "numeric", "double"), ("o_orderdate", "datetime", "timestamp_ntz"),
        ("o_orderpriority", "string", "string"),
    ],
    "orders_exact": [
        ("big_key", "numeric", "bigint"), ("wide_key", "numeric", "decimal(38,0)"), ("two_big", "numeric", "bigint"),
        ("o_totalprice", "numeric", "double"),
    ],
    "li_linear": [
        ("order_id", "numeric", "bigint"), ("line_place", "numeric", "double"), ("shelf", "numeric", "double"),
        ("l_quantity", "numeric", "double"), ("units", "numeric", "double"),
    ],
    "orders_mixed": [
        ("o_orderkey", "numeric", "bigint"), ("mixed_day", "string", "string"), ("slash_day", "string", "string"),
        ("five", "numeric", "double"), ("price_nan", "numeric", "double"),
    ],
    "documents": [
        ("doc_id", "numeric", "bigint"), ("text", "string", "string"), ("lang", "string", "string"),
        ("source", "string", "string"), ("n_chars", "numeric", "bigint"),
    ],
    "events": [
        ("event_id", "numeric", "bigint"), ("ts", "datetime", "timestamp_ntz"), ("user_id", "numeric", "bigint"),
        ("event_type", "string", "string"), ("value", "numeric", "double"), ("props", "string", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "numeric", "bigint"), ("l_partkey", "numeric", "bigint"), ("l_suppkey", "numeric", "bigint"),
        ("l_linenumber", "numeric", "int"), ("l_quantity", "numeric", "double"), ("l_extendedprice", "numeric", "double"),
        ("l_discount", "numeric", "double"), ("l_tax", "numeric", "double"), ("l_returnflag", "string", "string"),
        ("l_linestatus", "string", "string"), ("l_shipdate", "datetime", "timestamp_ntz"),
    ],
}

# DuckDB spellings of the date formats tried for text columns (same order as Spark's list).
DUCK_DATE_FORMATS = [
    "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S",
    "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y",
]


def src(view: str) -> str:
    """A derived input as a DuckDB subquery, or a plain table name."""
    if view in DERIVED:
        return f"({DERIVED[view]}) AS {view}"
    return view


def r(x: str, p: int) -> str:
    """Half away from zero on the double-scaled value (same arithmetic as the Spark side)."""
    t = f"(abs(CAST({x} AS DOUBLE)) * {float(10 ** p)})"
    whole = f"({t} - fmod({t}, 1.0))"
    return f"(sign(CAST({x} AS DOUBLE)) * ({whole} + CASE WHEN {t} - {whole} >= 0.5 THEN 1.0 ELSE 0.0 END) / {float(10 ** p)} + 0.0)"


def column_block(view: str, name: str, ordinal: int, cls: str, stype: str) -> str:
    """One report row for one column: every P1-P12 metric."""
    s = src(view)
    num = cls == "numeric"
    if cls == "string":
        fits = ", ".join(
            f"count(DISTINCT v) FILTER (WHERE try_strptime(v, '{f}') IS NOT NULL)" for f in DUCK_DATE_FORMATS
        )
        datefit = f"greatest({fits})"
    else:
        datefit = "0"
    if cls == "numeric":
        typ = ("CASE WHEN nn = 0 THEN 'empty' WHEN nd = 2 THEN 'binary' "
               "WHEN nd / nn < 0.05 THEN 'categorical' ELSE 'numeric' END")
    elif cls == "boolean":
        typ = "CASE WHEN nn = 0 THEN 'empty' WHEN nd = 2 THEN 'binary' ELSE 'boolean' END"
    elif cls == "datetime":
        typ = "CASE WHEN nn = 0 THEN 'empty' ELSE 'datetime' END"
    else:
        typ = ("CASE WHEN nn = 0 THEN 'empty' WHEN datefit = nd THEN 'datetime' "
               "WHEN nd / nn < 0.5 THEN 'categorical' ELSE 'text' END")
    vexpr = f"CAST(\"{name}\" AS VARCHAR)" if cls == "string" else f"\"{name}\""
    if stype == "double":  # NaN is missing, like pandas
        vexpr = f"CASE WHEN isnan(\"{name}\") THEN NULL ELSE \"{name}\" END"
    if num:
        stats = f"""
  s AS (SELECT avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mn, max(x) AS mx,
               quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q75
        FROM (SELECT CAST("{name}" AS DOUBLE) AS x FROM {s}) WHERE x IS NOT NULL AND NOT isnan(x)),
  m AS (SELECT avg(power(x - s.mean, 2)) AS m2, avg(power(x - s.mean, 3)) AS m3, avg(power(x - s.mean, 4)) AS m4,
               count(*) FILTER (WHERE x < s.q25 - 1.5 * (s.q75 - s.q25) OR x > s.q75 + 1.5 * (s.q75 - s.q25)) AS outl
        FROM (SELECT CAST("{name}" AS DOUBLE) AS x FROM {s} WHERE "{name}" IS NOT NULL
              AND NOT isnan(CAST("{name}" AS DOUBLE))) q, s),"""
        numcols = f"""
    {r('s.mean', 4)} AS mean, {r('s.med', 4)} AS median, {r('s.std', 4)} AS std, {r('s.mn', 4)} AS "min",
    {r('s.mx', 4)} AS "max", {r('s.q25', 4)} AS q25, {r('s.q75', 4)} AS q75,
    CASE WHEN nn > 0 THEN CAST(m.outl AS BIGINT) END AS outlier_count,
    CASE WHEN nn > 0 THEN {r('m.outl * 100.0 / nn', 2)} END AS outlier_percentage,
    {r('s.q25 - 1.5 * (s.q75 - s.q25)', 4)} AS lower_bound, {r('s.q75 + 1.5 * (s.q75 - s.q25)', 4)} AS upper_bound,
    CASE WHEN nn >= 3 AND m.m2 > power(1e-15 * s.mean, 2) THEN {r('m.m3 / power(m.m2, 1.5)', 4)} END AS skewness,
    CASE WHEN nn >= 3 AND m.m2 > power(1e-15 * s.mean, 2) THEN {r('m.m4 / power(m.m2, 2) - 3', 4)} END AS kurtosis,
    CASE WHEN nn > 0 THEN {r('m.outl * 100.0 / nn', 2)} END AS op"""
        joins = ", s, m"
    else:
        stats = ""
        numcols = """
    CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std,
    CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", CAST(NULL AS DOUBLE) AS q25,
    CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS BIGINT) AS outlier_count, CAST(NULL AS DOUBLE) AS outlier_percentage,
    CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound, CAST(NULL AS DOUBLE) AS skewness,
    CAST(NULL AS DOUBLE) AS kurtosis, CAST(NULL AS DOUBLE) AS op"""
        joins = ""
    return f"""(WITH
  f AS (SELECT {vexpr} AS v, count(*) AS cnt FROM {s} GROUP BY 1),
  t AS (SELECT sum(cnt) AS n FROM f),
  b AS (SELECT coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS miss,
               count(*) FILTER (WHERE v IS NOT NULL) AS nd,
               -sum((cnt / t.n) * log2(cnt / t.n + 1e-9)) AS ent,
               coalesce(sum(cnt) FILTER (WHERE cnt > 1), 0) AS dup,
               {datefit} AS datefit
        FROM f, t),{stats}
  k AS (SELECT t.n AS n, b.*, t.n - b.miss AS nn FROM t, b),
  row0 AS (SELECT '{name}' AS "column", CAST({ordinal} AS INTEGER) AS ordinal, {typ} AS "type",
    '{stype}' AS storage_type, CAST(miss AS BIGINT) AS missing_count, {r('miss * 100.0 / n', 2)} AS missing_percentage,
    CAST(nd AS BIGINT) AS unique_count, {r('nd / n', 4)} AS unique_ratio, {r('ent', 4)} AS entropy,
    CAST(dup AS BIGINT) AS duplicate_count,{numcols}
    FROM k{joins})
  SELECT *, greatest(0.0, least(100.0, {r('100 - 0.5 * missing_percentage - CASE WHEN op > 0 THEN least(0.3 * op, 15) ELSE 0 END + CASE WHEN unique_ratio > 0.1 AND unique_ratio < 0.8 THEN 5 ELSE 0 END', 2)})) AS quality_score
  FROM row0)"""


PROFILE_COLS = [
    '"column"', "ordinal", '"type"', "storage_type", "missing_count", "missing_percentage", "unique_count",
    "unique_ratio", "entropy", "duplicate_count", "mean", "median", "std", '"min"', '"max"', "q25", "q75",
    "outlier_count", "outlier_percentage", "lower_bound", "upper_bound", "skewness", "kurtosis", "quality_score",
]


def profile_sql(view: str) -> str:
    """All column rows of ``view`` plus the status band (the P11 report)."""
    blocks = [column_block(view, n, i, c, t) for i, (n, c, t) in enumerate(SCHEMAS[view])]
    body = "\nUNION ALL\n".join(f"SELECT * FROM {b}" for b in blocks)
    cols = ", ".join(PROFILE_COLS)
    return f"""SELECT {cols},
  CASE WHEN quality_score >= 90 THEN 'good' WHEN quality_score >= 70 THEN 'acceptable' ELSE 'needs attention' END AS status
FROM ({body}) p"""


def profile_subset(view: str, cols: list[str], where: str | None = None, order_limit: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(cols)} FROM ({profile_sql(view)}) pr{w}{order_limit}"


def missing_sql(view: str) -> str:
    s = src(view)
    parts = [
        f"SELECT '{n}' AS \"column\", CAST({i} AS INTEGER) AS ordinal, CAST(count(*) - count(\"{n}\") AS BIGINT) AS missing_count, "
        f"{r(f'(count(*) - count(\"{n}\")) * 100.0 / count(*)', 2)} AS missing_percentage FROM {s}"
        for i, (n, _, _) in enumerate(SCHEMAS[view])
    ]
    return "\nUNION ALL\n".join(parts)


def completeness_sql(view: str) -> str:
    s = src(view)
    cols = SCHEMAS[view]
    miss = " + ".join(f"(count(*) - count(\"{n}\"))" for n, _, _ in cols)
    c = len(cols)
    return f"""SELECT CAST(n AS BIGINT) AS rows, CAST({c} AS INTEGER) AS columns, CAST(n * {c} AS BIGINT) AS total_cells,
  CAST(m AS BIGINT) AS missing_cells, {r(f'm * 100.0 / (n * {c})', 2)} AS missing_percentage,
  {r(f'100 - m * 100.0 / (n * {c})', 2)} AS completeness_percentage
FROM (SELECT count(*) AS n, {miss} AS m FROM {s}) x"""


def missing_patterns_sql(view: str) -> str:
    s = src(view)
    names = [f'"{n}"' for n, _, _ in SCHEMAS[view]]
    all_null = " AND ".join(f"{n} IS NULL" for n in names)
    any_null = " OR ".join(f"{n} IS NULL" for n in names)
    return f"""SELECT CAST(count(*) FILTER (WHERE {all_null}) AS BIGINT) AS completely_empty_rows,
  CAST(count(*) FILTER (WHERE {any_null}) AS BIGINT) AS rows_with_missing FROM {s}"""


def missing_corr_sql(view: str, threshold: float = 0.5) -> str:
    s = src(view)
    names = [n for n, _, _ in SCHEMAS[view]]
    flags = ", ".join(f"CASE WHEN \"{n}\" IS NULL THEN 1.0 ELSE 0.0 END AS f{i}" for i, n in enumerate(names))
    pairs = [
        f"SELECT '{names[i]}' AS col1, '{names[j]}' AS col2, corr(f{i}, f{j}) AS c FROM fl"
        for i, j in combinations(range(len(names)), 2)
    ]
    return f"""WITH fl AS (SELECT {flags} FROM {s})
SELECT col1, col2, {r('c', 3)} AS correlation FROM ({' UNION ALL '.join(pairs)}) x
WHERE c IS NOT NULL AND NOT isnan(c) AND abs(c) > {threshold}"""


def corr_pairs_sql(view: str) -> str:
    s = src(view)
    nums = [n for n, c, _ in SCHEMAS[view] if c == "numeric"]
    parts = []
    for a in nums:
        for b in nums:
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {nums.index(a)} AS i, {nums.index(b)} AS j, "
                         f"corr(CAST(\"{a}\" AS DOUBLE), CAST(\"{b}\" AS DOUBLE)) AS c FROM {s}")
    return f"SELECT col1, col2, i, j, CASE WHEN isnan(c) THEN NULL ELSE c END AS c FROM ({' UNION ALL '.join(parts)}) x"


def corr_matrix_sql(view: str) -> str:
    return f"SELECT col1, col2, {r('c', 4)} AS correlation FROM ({corr_pairs_sql(view)}) y"


def strong_corr_sql(view: str, hide_ids: bool = False, threshold: float = 0.7) -> str:
    ids = ""
    if hide_ids:
        pat = "(^|_)id(_|$)"
        ids = f" AND NOT regexp_matches(lower(col1), '{pat}') AND NOT regexp_matches(lower(col2), '{pat}')"
    return f"""SELECT col1, col2, {r('c', 3)} AS correlation,
  CASE WHEN abs(c) > 0.9 THEN 'strong' ELSE 'moderate' END AS strength
FROM ({corr_pairs_sql(view)}) y WHERE i < j AND c IS NOT NULL AND abs(c) > {threshold}{ids}"""
