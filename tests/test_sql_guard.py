"""Read-only guard: one refused statement per write/DDL kind, plus path relations,
reflection, nested writes and the ASOF alias trap."""

import pytest

from tabscope.operators.sql import RefusedQuery, guarded_sql, read_only_sql, split_statements

REFUSED = [
    "INSERT INTO orders SELECT * FROM orders",
    "UPDATE orders SET o_totalprice = 0",
    "DELETE FROM orders WHERE o_orderkey = 1",
    "DROP TABLE orders",
    "ALTER TABLE orders ADD COLUMNS (x INT)",
    "ALTER TABLE orders RENAME COLUMN o_custkey TO c",
    "MERGE INTO orders USING orders o2 ON orders.o_orderkey = o2.o_orderkey WHEN MATCHED THEN DELETE",
    "SET spark.sql.ansi.enabled = false",
    "TRUNCATE TABLE orders",
    "CACHE TABLE orders",
    "CREATE VIEW v AS SELECT 1",
    "CREATE GLOBAL TEMPORARY VIEW v AS SELECT 1",
    "CREATE TABLE t AS SELECT * FROM orders",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT java_method('java.lang.Math', 'abs', -1)",
    "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM x",
    "SELECT * FROM orders asof JOIN customer ON o_custkey = c_custkey",
    "SELECT * FROM no_such_table",
    "SELECT * FROM read_files('/tmp')",
    "",
    "SELEC 1",
]


@pytest.fixture(scope="module")
def cat(spark):
    from tabscope.sources.catalog import load_catalog

    return load_catalog(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("stmt", REFUSED)
def test_refused(cat, stmt):
    with pytest.raises(RefusedQuery):
        guarded_sql(cat, stmt)


def test_allowed_and_multi_statement(cat):
    df = guarded_sql(cat, "CREATE TEMPORARY VIEW big AS SELECT * FROM orders WHERE o_totalprice > 1000; "
                          "SELECT count(*) AS n FROM big")
    assert df.collect()[0]["n"] > 0
    r = read_only_sql(cat, "WITH c AS (SELECT o_custkey FROM orders) SELECT * FROM c", preview_rows=7, count_rows=True)
    assert len(r.rows) == 7 and r.truncated and r.total_rows == 1500
    assert guarded_sql(cat, "SELECT count(*) AS n FROM df", current_table="region").collect()[0]["n"] == 5
    assert guarded_sql(cat, "SELECT * FROM range(3)").count() == 3


def test_views_do_not_leak_between_calls(cat):
    guarded_sql(cat, "CREATE TEMPORARY VIEW leak AS SELECT 1 AS a; SELECT * FROM leak").collect()
    with pytest.raises(RefusedQuery):
        guarded_sql(cat, "SELECT * FROM leak")


def test_split_statements():
    assert split_statements("select ';' as a; -- x;\nselect 2 /* ; */") == ["select ';' as a", "select 2"]


def test_in_memory_catalog_drops_its_views(spark):
    from tabscope.sources.catalog import Catalog

    cat = Catalog(spark).register("mem", spark.range(5).toDF("a"))
    out = guarded_sql(cat, "CREATE TEMPORARY VIEW m2 AS SELECT a * 2 AS b FROM mem; SELECT sum(b) AS s FROM m2")
    assert out.collect()[0]["s"] == 20
    names = {t.name for t in spark.catalog.listTables()}
    assert "mem" not in names and "m2" not in names


def test_no_way_round_the_guard(cat, spark, tmp_path):
    out = str(tmp_path / "secret")
    spark.range(3).write.parquet(out)
    spark.range(3).write.mode("overwrite").saveAsTable("hidden_orders")
    try:
        for stmt in (
            f"SELECT count(*) FROM IDENTIFIER('parquet.' || '`{out}`')",
            f"SELECT (SELECT count(*) FROM IDENTIFIER('parquet.`{out}`')) AS n",
            "SELECT IDENTIFIER('o_' || 'orderkey') FROM orders",
            # the name of a CTE holds inside its statement part only
            "SELECT * FROM (WITH hidden_orders AS (SELECT 1) SELECT * FROM hidden_orders) a JOIN hidden_orders b",
            "WITH a AS (SELECT * FROM hidden_orders), hidden_orders AS (SELECT 1) SELECT * FROM a",
            "SELECT * FROM orders WHERE o_orderkey IN (SELECT id FROM hidden_orders)",
        ):
            with pytest.raises(RefusedQuery):
                guarded_sql(cat, stmt)
    finally:
        spark.sql("DROP TABLE hidden_orders")
    nested = "WITH a AS (SELECT o_orderkey FROM orders), b AS (SELECT * FROM a) SELECT count(*) AS n FROM b WHERE o_orderkey IN (SELECT * FROM a)"
    assert guarded_sql(cat, nested).collect()[0]["n"] == 1500


def test_callers_views_are_left_alone(spark):
    from tabscope.sources.catalog import Catalog

    spark.range(2).createOrReplaceTempView("mine")
    cat = Catalog(spark).register("mine", spark.range(5).toDF("a"))
    with pytest.raises(RefusedQuery):
        guarded_sql(cat, "SELECT * FROM mine")
    assert spark.table("mine").count() == 2
    spark.catalog.dropTempView("mine")
