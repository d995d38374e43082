"""Windows over split keys, intake ids and repeated rows: results against pandas, and many tasks for one hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import duplicates, logs, segments
from tabscope.operators.table import duplicate_row_list


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(12)
    n = 900
    key = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b", "c"], n))
    out = pd.DataFrame({"id": np.arange(n), "k": key, "o": rng.integers(0, 6, n), "v": rng.normal(size=n).round(3)})
    out.loc[out["k"] == "b", "k"] = None  # null is a key too
    out.loc[::17, "o"] = None
    return out


@pytest.fixture(scope="module")
def frame(spark, events):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in events.itertuples(index=False)]
    rows = [(int(a), b, None if c is None else int(c), float(d)) for a, b, c, d in rows]
    return spark.createDataFrame(rows, "id int, k string, o int, v double").repartition(5)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranked(frame, events, partitions):
    got = segments.ranked(frame, "k", "o", partitions).toPandas().set_index("id").sort_index()
    order = events["o"].fillna(-1)
    groups = order.groupby(events["k"].fillna("null"))
    assert (got["rank"] == groups.rank(method="min").astype(int)).all()
    assert (got["dense_rank"] == groups.rank(method="dense").astype(int)).all()
    for k, own in got.groupby(events["k"].fillna("null")):
        assert sorted(own["row_number"]) == list(range(1, len(own) + 1))
        assert (own.groupby("rank")["row_number"].min() == own.groupby("rank")["rank"].first()).all()


@pytest.mark.parametrize("partitions,reach", [(1, 3), (7, 3), (40, 3), (60, 45)])
def test_windowed(frame, events, partitions, reach):
    columns = {
        "s": lambda w: F.sum("v").over(w.rowsBetween(-reach, 2)), "n": lambda w: F.count("v").over(w.rowsBetween(-reach, 2)),
        "p": lambda w: F.lag("id", reach).over(w), "q": lambda w: F.lead("id", 2).over(w),
    }
    got = segments.windowed(frame, "k", ["v", "id"], columns, preceding=reach, following=2, partitions=partitions).toPandas().set_index("id")
    assert len(got) == len(events)
    for _, own in events.sort_values(["v", "id"]).groupby(events["k"].fillna("null")):
        v, ids = own["v"].to_numpy(), own["id"].to_numpy()
        for i, e in enumerate(ids):
            part = v[max(0, i - reach) : i + 3]
            r = got.loc[e]
            assert r["s"] == pytest.approx(part.sum(), abs=1e-9) and r["n"] == len(part)
            assert (None if pd.isna(r["p"]) else int(r["p"])) == (int(ids[i - reach]) if i >= reach else None)
            assert (None if pd.isna(r["q"]) else int(r["q"])) == (int(ids[i + 2]) if i + 2 < len(ids) else None)


def test_hot_key_fills_many_segments(frame):
    data, keys = segments._segmented(frame, ["k"], ["v"], 12)
    sizes = data.groupBy("_pid", *keys).count().toPandas()
    assert sizes["count"].max() <= 3 * 900 / 12 and (sizes["_k0"] == "hot").sum() >= 4


def test_names_of_the_operator_are_refused(frame):
    with pytest.raises(ValueError):
        segments.ranked(frame.withColumn("_tie", F.lit(1)), "k", "o")
    with pytest.raises(ValueError):
        segments.windowed(frame, "k", "v", {"v": lambda w: F.sum("v").over(w)})


def test_empty(frame):
    assert segments.ranked(frame.limit(0), "k", "o").collect() == []
    assert segments.windowed(frame.limit(0), "k", "v", {"p": lambda w: F.lag("id").over(w)}, preceding=1).collect() == []


def test_ids_of_equal_rows(spark):
    raw = spark.range(0, 3000, 1, 12).select(F.lit("like").alias("feedback"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    accepted, rejected = logs.clean_feedback(raw, "web")
    rows = accepted.select("id", "n").collect()
    assert len({r["id"] for r in rows}) == len(rows) == 3000 and rejected.count() == 0
    staged = raw.withColumn("_row", F.coalesce(F.col("n").cast("string"), F.lit("x")))
    told = logs._told_apart(staged)
    assert sorted(int(r["_twin"]) for r in told.where("n IS NULL").collect()) == list(range(1, 1001))
    busiest = told.where("n IS NULL").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert busiest < 1000


def test_hot_duplicates_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CHUNK_COPIES", 100)
    df = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long").alias("a"), F.lit("x" * 50).alias("t"))
    out = duplicate_row_list(df)
    assert [tuple(r) for r in out.groupBy("a", "group_size").count().collect()] == [(0, 2000, 2000)]
    per_task = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(per_task) >= 4 and per_task.max() <= 800
