"""Report writing, catalog status, user transforms and streaming dynamics."""

import os

from pyspark.sql import functions as F


def test_write_report_roundtrip(spark, sample_profile, tmp_path):
    from tabscope.sources.sinks import write_report

    rep = sample_profile.report()
    write_report({"columns": rep["columns"], "completeness": rep["completeness"]}, str(tmp_path / "rep"))
    back = spark.read.json(str(tmp_path / "rep" / "columns"))
    assert back.count() == 8 and "quality_score" in back.columns


def test_catalog_status_and_failure_isolation(spark, tmp_path):
    from tabscope.sources.catalog import catalog_status, load_catalog

    good = tmp_path / "db"
    spark.range(3).write.parquet(str(good / "t1.parquet"))
    (good / "broken.parquet").write_text("not parquet")
    cat = load_catalog(spark, str(good))
    st = {r["table"]: r["status"] for r in catalog_status(cat).collect()}
    assert st == {"t1": "ok", "broken": "error"}


def test_apply_transform(spark):
    from tabscope.operators.transform import apply_transform
    from tabscope.sources.catalog import load_catalog

    cat = load_catalog(spark, "/root/testdata/sf0.001")

    def by_status(df, tables):
        return df.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"))

    out = apply_transform(cat, by_status, "orders")
    assert out.count() == cat.table("orders").select("o_orderstatus").distinct().count()
    ps = apply_transform(cat, lambda df, t: df.pandas_api().groupby("r_regionkey").count().reset_index(), "region")
    assert ps.count() == 5


def test_dynamics_stream_matches_batch(spark):
    from tabscope.operators.charts import dynamics
    from tabscope.streaming.dynamics import run_dynamics_stream

    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(os.path.join(sf, "events.parquet"))
    s = {r["day"]: r["events"] for r in run_dynamics_stream(spark, sf, ev.schema, "ts", "value", glob="events.parquet").collect()}
    b = {r["day"]: int(r["value"]) for r in dynamics(ev, "ts", "event_id", "count").collect()}
    assert s == b


def test_dynamics_stream_counts_late_rows(spark, tmp_path):
    from tabscope.streaming.dynamics import run_dynamics_stream

    schema = "ts timestamp_ntz, value double"
    src = str(tmp_path / "in")
    for k, days in enumerate((["2024-01-10", "2024-01-10"], ["2024-01-20"], ["2024-01-01", "2024-01-10", None])):
        spark.createDataFrame([(None if d is None else f"{d} 05:00:00", 1.5) for d in days], "d string, value double").selectExpr(
            "CAST(d AS timestamp_ntz) AS ts", "value").coalesce(1).write.mode("append").parquet(src)
    got = {r["day"]: (r["events"], r["value_sum"], r["value_max"]) for r in
           run_dynamics_stream(spark, src, spark.read.schema(schema).parquet(src).schema, "ts", "value", files_per_batch=1).collect()}
    assert got == {"2024-01-10": (3, 4.5, 1.5), "2024-01-20": (1, 1.5, 1.5), "2024-01-01": (1, 1.5, 1.5)}


def test_zoned_and_millisecond_dates(spark):
    from tabscope.operators.charts import dynamics
    from tabscope.operators.columns import column_types

    for text in ("2024-01-0{0}T10:00:00.000Z", "2024-01-0{0}T23:30:00+03:00", "2024-01-0{0} 10:30", "2024-01-0{0} 10:30:00.123"):
        df = spark.createDataFrame([(text.format(i % 3 + 1), 1.0) for i in range(9)], "d string, v double")
        assert {r["column"]: r["type"] for r in column_types(df).collect()}["d"] == "datetime", text
        assert [(r["day"], r["value"]) for r in dynamics(df, "d", "v").collect()] == [(f"2024-01-0{i}", 3.0) for i in (1, 2, 3)], text
