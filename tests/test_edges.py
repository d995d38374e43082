"""Edge inputs: zero rows, all null, constant, NaN next to null, booleans, nested values."""

import math

import pytest


def test_zero_rows(spark):
    from tabscope.plans.profile import TableProfile

    df = spark.range(10).selectExpr("id", "cast(id as string) s").where("1 = 0")
    p = TableProfile(df)
    rows = {r["column"]: r for r in p.columns.collect()}
    assert rows["id"]["type"] == "empty" and rows["id"]["unique_ratio"] is None and rows["id"]["missing_percentage"] is None
    c = p.completeness().collect()[0]
    assert c["rows"] == 0 and c["missing_percentage"] is None


def test_all_null_constant_nan_bool_nested(spark):
    from tabscope.plans.profile import TableProfile

    df = spark.sql("""SELECT id,
        CAST(NULL AS DOUBLE) AS nothing,
        1 AS one,
        CASE WHEN id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 7 = 0 THEN NULL ELSE id * 0.5 END AS nanny,
        id % 2 = 0 AS flag,
        id > 1000 AS never,
        array(id, id + 1) AS arr,
        named_struct('a', id % 3) AS st
      FROM range(100)""")
    p = TableProfile(df)
    rows = {r["column"]: r for r in p.columns.collect()}
    assert rows["nothing"]["type"] == "empty" and rows["nothing"]["missing_count"] == 100
    assert rows["one"]["type"] == "categorical" and rows["one"]["unique_count"] == 1
    assert rows["one"]["skewness"] is None and rows["one"]["std"] == 0.0
    # NaN counts as missing, like pandas
    assert rows["nanny"]["missing_count"] == len([i for i in range(100) if i % 11 == 0 or i % 7 == 0])
    assert rows["flag"]["type"] == "binary" and rows["flag"]["mean"] is None
    assert rows["never"]["type"] == "boolean"
    assert rows["arr"]["type"] == "nested" and rows["arr"]["unique_count"] == 100
    assert rows["st"]["unique_count"] == 3
    consts = {r["column"] for r in p.constant_columns().collect()}
    assert consts == {"nothing", "one", "never"}
    m = {(r["col1"], r["col2"]): r["correlation"] for r in p.correlation_matrix().collect()}
    assert m[("one", "id")] is None and m[("id", "id")] == 1.0


def test_one_row(spark):
    from tabscope.plans.profile import TableProfile

    p = TableProfile(spark.sql("SELECT 1.5 AS x, 'a' AS s"))
    r = {x["column"]: x for x in p.columns.collect()}
    assert r["x"]["std"] is None and r["x"]["median"] == 1.5 and r["x"]["skewness"] is None


def test_normality_over_all_rows(spark):
    from tabscope.operators.normality import normality_jb

    df = spark.sql("SELECT CAST(id % 10 AS DOUBLE) AS x, CASE WHEN id < 2 THEN id END AS few FROM range(200000)")
    rows = {r["column"]: r for r in normality_jb(df).collect()}
    assert set(rows) == {"x"} and rows["x"]["n"] == 200000 and rows["x"]["is_normal"] is False


def test_large_integers_and_decimals_are_exact(spark):
    from tabscope.plans.profile import TableProfile

    df = spark.sql("SELECT id + 1152921504606846976 AS k, CAST(id + 100000000000000000000 AS DECIMAL(30,0)) AS d, "
                   "1152921504606846976 + id DIV 500 AS two FROM range(1000)")
    with TableProfile(df) as p:
        rows = {r["column"]: r for r in p.columns.collect()}
        assert {c: (r["type"], r["unique_count"], r["duplicate_count"]) for c, r in rows.items()} == {
            "k": ("numeric", 1000, 0), "d": ("numeric", 1000, 0), "two": ("binary", 2, 1000)}
        assert [r["column"] for r in p.constant_columns().collect()] == []
        top = p.top_values(columns=["two", "d"]).collect()
    assert sorted(r["value"] for r in top if r["column"] == "two") == ["1152921504606846976", "1152921504606846977"]
    assert all(r["value"].startswith("1000000000000000000") for r in top if r["column"] == "d")


def test_infinite_values_count_but_stay_out_of_statistics(spark):
    from tabscope.plans.profile import TableProfile

    df = spark.sql("SELECT CASE WHEN id = 7 THEN CAST('Infinity' AS DOUBLE) WHEN id = 8 THEN CAST('-Infinity' AS DOUBLE) "
                   "WHEN id = 9 THEN CAST('NaN' AS DOUBLE) ELSE CAST(id AS DOUBLE) END AS x FROM range(7 + 3)")
    with TableProfile(df) as p:
        r = p.columns.collect()[0]
    assert (r["missing_count"], r["unique_count"], r["mean"], r["min"], r["max"], r["outlier_count"]) == (1, 9, 3.0, 0.0, 6.0, 0)


def test_float_columns_show_their_own_digits(spark):
    from tabscope.operators.columns import top_values

    got = top_values(spark.sql("SELECT CAST(0.1 AS FLOAT) AS f, 0.5D AS d FROM range(3)"), columns=["f", "d"]).collect()
    assert {(r["column"], r["value"], r["count"]) for r in got} == {("f", "0.1", 3), ("d", "0.5", 3)}


def test_operators_leave_no_cached_table(spark):
    from tabscope.operators import columns, table

    df = spark.range(50).selectExpr("id", "id % 3 AS k")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for fn in (columns.column_types, columns.top_values, columns.profile_columns, table.correlation_matrix, table.overall_quality):
        fn(df).collect()
    table.profile_table(df)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_boolean_top_values(spark):
    from tabscope.plans.profile import TableProfile

    df = spark.sql("SELECT id % 3 = 0 AS flag, CAST(id AS DOUBLE) AS x FROM range(3000)")
    tv = {r["value"]: r["count"] for r in TableProfile(df).top_values(columns=["flag"]).collect()}
    assert tv == {"True": 1000, "False": 2000}
    assert TableProfile(df).numeric.collect()[0]["median"] == 1499.5


def test_long_text_enters_frequencies_hashed(spark):
    from tabscope.plans.profile import TableProfile

    long_a, long_b = "a" * 300, "a" * 299 + "b"  # same 200-char prefix, different values
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,), ("short",)], "t string")
    p = TableProfile(df)
    r = p.columns.collect()[0]
    assert r["unique_count"] == 3 and r["duplicate_count"] == 2
    assert p.data_size().collect()[0]["bytes"] == 300 + 300 + 300 + 5
    top = p.top_values(columns=["t"]).orderBy("rank").collect()[0]
    assert top["count"] == 2 and top["value"] == long_a


def test_correlation_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    from tabscope.plans.profile import TableProfile

    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 1))
    data = {f"x{i}": (base[:, 0] * i + rng.normal(size=500) * 3) for i in range(8)}
    pdf = pd.DataFrame(data)
    pdf.loc[rng.random(500) < 0.2, "x3"] = np.nan
    pdf["const"] = 7.0
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns))
    a = {(r["col1"], r["col2"]): r["correlation"] for r in TableProfile(df).correlation_matrix().collect()}
    want = pdf.corr()
    assert len(a) == 81
    for (i, j), r in a.items():
        assert (r is None) if "const" in (i, j) else r == pytest.approx(want.loc[i, j], abs=1e-4), (i, j)


def test_awkward_column_names(spark):
    from tabscope.operators.normality import normality_jb
    from tabscope.plans.profile import TableProfile

    df = spark.sql("SELECT id AS `a.b`, CAST(id % 3 AS STRING) AS `c d`, id * 0.5 AS `e-f` FROM range(50)")
    p = TableProfile(df)
    rows = {r["column"]: r for r in p.columns.collect()}
    assert set(rows) == {"a.b", "c d", "e-f"} and rows["a.b"]["unique_count"] == 50
    assert p.correlation_matrix().count() == 4
    assert {r["column"] for r in normality_jb(df).collect()} == {"a.b", "e-f"}
