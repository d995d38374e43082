"""Readers, sinks, catalog, key checks and log intake."""

import datetime as dt
import json

import pytest


def test_read_any_and_metadata(spark, sample_path, tmp_path):
    from tabscope.sources.readers import read_any, source_metadata

    df = read_any(spark, sample_path)
    assert df.count() == 26
    m = source_metadata(df, "golden_sample.csv").collect()[0]
    assert (m["rows"], m["columns"]) == (26, 8) and m["size_bytes"] > 0
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path / "x.xlsx"))


def test_read_json_array_and_dates(spark, tmp_path):
    from tabscope.sources.readers import read_json

    p = tmp_path / "x.json"
    p.write_text(json.dumps([{"a": 1, "created_at": "2024-01-02 03:04:05", "t": "x"},
                             {"a": 2, "created_at": "2024-01-03", "t": "y"}]))
    df = read_json(spark, str(p))
    assert dict(df.dtypes)["created_at"].startswith("timestamp")
    assert df.count() == 2


def test_jdbc_options():
    from tabscope.sources.readers import jdbc_options

    o = jdbc_options("postgresql", "db name", user="u", password="p@ss")
    assert o["url"] == "jdbc:postgresql://localhost:5432/db+name"
    assert o["properties"]["password"] == "p@ss" and "p@ss" not in o["url"]
    assert jdbc_options("mysql", "d", host="h")["url"] == "jdbc:mysql://h:3306/d"
    with pytest.raises(ValueError):
        jdbc_options("oracle", "d")


def test_json_safe(spark):
    from tabscope.sources.sinks import json_safe

    df = spark.createDataFrame([(float("nan"), dt.datetime(2024, 1, 2, 3, 4, 5), [float("inf"), 1.0]),
                                (2.0, dt.datetime(2024, 1, 2, 3, 4, 5, 123), [0.5])],
                               "x double, ts timestamp_ntz, arr array<double>")
    rows = json_safe(df).collect()
    assert rows[0]["x"] is None and rows[0]["ts"] == "2024-01-02T03:04:05" and rows[0]["arr"] == [None, 1.0]
    assert rows[1]["ts"] == "2024-01-02T03:04:05.000123"


def test_catalog_and_keys(spark):
    from tabscope.operators.keys import check_foreign_key, check_primary_key
    from tabscope.sources.catalog import catalog_tables, load_catalog

    cat = load_catalog(spark, "/root/testdata/sf0.001")
    assert "orders" in cat.names and cat.table("region").count() == 5
    with pytest.raises(KeyError):
        cat.table("nope")
    t = {r["table"]: r["rows"] for r in catalog_tables(cat).collect()}
    assert t["region"] == 5 and t["nation"] == 25
    pk = check_primary_key(cat.table("orders"), "o_orderkey").collect()[0]
    assert pk["is_primary_key"] and pk["duplicate_keys"] == 0
    notpk = check_primary_key(cat.table("lineitem"), "l_orderkey").collect()[0]
    assert not notpk["is_primary_key"]
    fk = check_foreign_key(cat.table("lineitem"), "l_orderkey", cat.table("orders"), "o_orderkey").collect()[0]
    assert fk["orphan_rows"] == 0


def test_feedback_and_tickets(spark):
    from tabscope.operators.logs import clean_feedback, clean_tickets

    fb = spark.createDataFrame([("c1", " LIKE ", "  "), ("c2", "meh", "x"), ("c3", "dislike", " ok ")],
                               "chat_id string, feedback string, comment string")
    ok, bad = clean_feedback(fb)
    got = {r["chat_id"]: (r["feedback"], r["comment"]) for r in ok.collect()}
    assert got == {"c1": ("like", None), "c3": ("dislike", "ok")}
    assert [r["chat_id"] for r in bad.collect()] == ["c2"]
    tk = spark.createDataFrame([(" ", "d", "a@b"), ("s", "d", " ")], "subject string, description string, email string")
    ok, bad = clean_tickets(tk)
    assert ok.collect()[0]["email"] is None and bad.collect()[0]["reason"] == "subject is required"


def test_chat_summaries_title(spark):
    from tabscope.operators.logs import chat_summaries

    conv = spark.createDataFrame([(1, 0, "system", "be nice"), (1, 1, "user", "  first line that is quite long, longer than forty\nsecond"),
                                  (1, 2, "assistant", "hi"), (2, 0, "assistant", "hello")],
                                 "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in chat_summaries(conv).collect()}
    assert rows[1]["title"] == "first line that is quite long, longer th" and rows[1]["messages_count"] == 2
    assert rows[2]["title"] is None
    assert rows[1]["created_at"] is None


def test_chat_list_by_source_newest_first(spark):
    from tabscope.operators.logs import chat_summaries

    conv = spark.sql("""SELECT * FROM VALUES (1, 0, 'user', 'old', 'a', TIMESTAMP'2024-01-01 10:00:00'),
      (1, 1, 'assistant', 'x', 'a', TIMESTAMP'2024-01-01 11:00:00'), (2, 0, 'user', 'new', 'a', TIMESTAMP'2024-02-01 10:00:00'),
      (3, 0, 'user', 'other', 'b', TIMESTAMP'2024-03-01 10:00:00') AS t(conv_id, turn, role, text, source_id, created_at)""")
    rows = chat_summaries(conv, source_id="a").collect()
    assert [(r["conv_id"], r["title"], str(r["created_at"]), str(r["updated_at"])) for r in rows] == [
        (2, "new", "2024-02-01 10:00:00", "2024-02-01 10:00:00"), (1, "old", "2024-01-01 10:00:00", "2024-01-01 11:00:00")]


def test_intake_stamps_are_stable(spark):
    from tabscope.operators.logs import clean_feedback

    fb = spark.createDataFrame([("c1", "like", "2024-01-01 00:00:00"), ("c1", "like", "2024-01-01 00:00:00"), ("c2", "dislike", None)],
                               "chat_id string, feedback string, created_at string")
    ok, _ = clean_feedback(fb.where("created_at IS NOT NULL"), source_id="web")
    first, again = (sorted(r["id"] for r in ok.collect()) for _ in range(2))
    assert first == again and len(set(first)) == 2
    assert {r["source_id"] for r in ok.collect()} == {"web"}
    assert clean_feedback(fb)[0].where("created_at IS NULL").count() == 0


def test_csv_cells_with_quotes_breaks_and_codes(spark, tmp_path):
    from tabscope.sources.readers import read_csv

    p = tmp_path / "x.csv"
    p.write_text('id,say,code,flag\n1,"say ""hi"", ok",10D,true\n2,"two\nlines",20F,false\n,,,\nNA,NA,NA,NA\n\n5,short\n')
    df = read_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "say": "string", "code": "string", "flag": "boolean"}
    assert sorted(map(tuple, df.collect()), key=str) == sorted([
        (1, 'say "hi", ok', "10D", True), (2, "two\nlines", "20F", False), (None,) * 4, (None,) * 4, (5, "short", None, None)], key=str)
    p.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells than the header"):
        read_csv(spark, str(p)).collect()


def test_json_arrays_in_a_folder(spark, tmp_path):
    from tabscope.sources.readers import read_any

    folder = tmp_path / "recs.json"
    folder.mkdir()
    (folder / "a.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    (folder / "b.json").write_text('[{"a": 3}]')
    assert sorted(r["a"] for r in read_any(spark, str(folder)).collect()) == [1, 2, 3]


def test_json_safe_keeps_null_structs(spark):
    from tabscope.sources.sinks import json_safe

    df = spark.sql("SELECT CAST(NULL AS STRUCT<a: DOUBLE>) AS s UNION ALL SELECT named_struct('a', CAST('NaN' AS DOUBLE))")
    assert sorted(str(r["s"]) for r in json_safe(df).collect()) == ["None", "Row(a=None)"]


def test_catalog_by_uri_lists_keys(spark):
    from tabscope.sources.catalog import catalog_tables, load_catalog

    cat = load_catalog(spark, "file:///root/testdata/sf0.001")
    cat.register("orders", cat.loaders["orders"], ["o_orderkey"],
                 [{"constrained_columns": ["o_custkey"], "referred_table": "customer", "referred_columns": ["c_custkey"]}])
    row = next(r for r in catalog_tables(cat).collect() if r["table"] == "orders")
    assert (row["primary_key"], row["foreign_keys"]) == ("o_orderkey", "o_custkey -> customer(c_custkey)")


def test_clusters_need_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from tabscope.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
