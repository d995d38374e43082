"""Distributed exact quantiles and numpy-identical histograms against numpy."""

import numpy as np
import pandas as pd
import pytest


def _frame(spark):
    rng = np.random.default_rng(7)
    hot = np.full(3000, 5.0)  # one value holding a third of the rows
    vals = np.concatenate([hot, rng.normal(10, 3, 4000).round(2), rng.integers(0, 50, 2000).astype(float)])
    groups = np.where(np.arange(len(vals)) % 3 == 0, "a", "b")
    groups[:3000] = "a"
    pdf = pd.DataFrame({"g": groups, "v": vals})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("partitions", [7, None])
def test_exact_quantiles_match_numpy(spark, partitions):
    from tabscope.operators.quantiles import exact_quantiles

    pdf, df = _frame(spark)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = exact_quantiles(df, ["g"], "v", probs, partitions=partitions).collect()
    got = {r["g"]: [r[f"q{int(round(p * 100))}"] for p in probs] for r in out}
    for g, sub in pdf.groupby("g"):
        exp = np.percentile(sub["v"].to_numpy(), [p * 100 for p in probs])
        assert got[g] == pytest.approx(list(exp), rel=1e-12, abs=1e-9)


def test_exact_quantiles_weighted(spark):
    from tabscope.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([("x", 1.0, 3), ("x", 2.0, 1), ("x", 10.0, 4), ("y", 7.0, 1)], "k string, v double, w long")
    out = {r["k"]: (r["q50"], r["q25"]) for r in exact_quantiles(df, ["k"], "v", [0.5, 0.25], weight="w", partitions=3).collect()}
    x = np.array([1, 1, 1, 2, 10, 10, 10, 10], dtype=float)
    assert out["x"] == pytest.approx((np.percentile(x, 50), np.percentile(x, 25)))
    assert out["y"] == (7.0, 7.0)


@pytest.mark.parametrize("bins", [1, 3, 10, 30])
def test_histogram_matches_numpy(spark, bins):
    from tabscope.operators.charts import histogram

    rng = np.random.default_rng(3)
    # values sitting exactly on bin edges are the hard case
    v = np.concatenate([rng.integers(0, 11, 500) / 100.0, rng.normal(0, 1, 500), [np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    rows = histogram(df, "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(v[~np.isnan(v)], bins=bins)
    assert [r["count"] for r in rows] == list(counts)
    assert [r["lo"] for r in rows] + [rows[-1]["hi"]] == pytest.approx(list(edges), rel=0, abs=0)


def test_histogram_constant_column(spark):
    from tabscope.operators.charts import histogram

    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")
    rows = histogram(df, "v", 3).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 3, 0]
    assert rows[0]["lo"] == 4.5 and rows[-1]["hi"] == 5.5


def test_dynamics_date_kinds(spark):
    import datetime as dt

    from tabscope.operators.charts import dynamics

    ns = int(dt.datetime(2024, 3, 5, 12, 0).timestamp()) * 10**9
    df = spark.createDataFrame(
        [(ns, dt.date(2024, 3, 5), "2024-03-05", 1.0), (ns + 86400 * 10**9, dt.date(2024, 3, 6), "bad", 3.0),
         (None, None, None, 5.0)],
        "epoch_ns long, d date, txt string, v double")
    by_ns = {r["day"]: r["value"] for r in dynamics(df, "epoch_ns", "v", "sum").collect()}
    assert by_ns == {"2024-03-05": 1.0, "2024-03-06": 3.0}
    by_date = {r["day"]: r["value"] for r in dynamics(df, "d", "v", "max").collect()}
    assert by_date == {"2024-03-05": 1.0, "2024-03-06": 3.0}
    by_txt = {r["day"]: r["value"] for r in dynamics(df, "txt", "v", "count").collect()}
    assert by_txt == {"2024-03-05": 1.0}
    import pytest

    with pytest.raises(ValueError):
        dynamics(df, "d", "v", "mode")


@pytest.mark.parametrize("partitions", [7, None])
def test_exact_quantiles_empty_and_null_groups(spark, partitions):
    from tabscope.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", float("nan"))], "k string, v double")
    out = {r["k"]: r["q50"] for r in exact_quantiles(df, ["k"], "v", [0.5], partitions=partitions).collect()}
    assert out == {"b": 2.0}
    empty = df.where("1 = 0")
    assert exact_quantiles(empty, ["k"], "v", [0.5], partitions=partitions).count() == 0


def test_exact_quantiles_over_the_whole_range_of_doubles(spark):
    """Magnitudes from the smallest double to the largest, signs, zeros, infinities, nulls, NaN and a null key."""
    from tabscope.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(12)
    wide = np.concatenate([
        rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 3,
        np.nextafter(1.0, 2.0) ** np.arange(200), 1.0 + np.arange(300) * 2.0**-52,  # neighbours that share every bit but the last
    ])
    inf = [1.0, 2.0, float("inf"), float("inf"), float("inf"), -float("inf"), -float("inf"), -float("inf"), 3.0]
    rows = [("wide", float(v)) for v in wide] + [("inf", v) for v in inf] + [(None, 4.0), (None, 8.0), ("wide", None), ("wide", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: list(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"wide", "inf", None}
    ordered = np.sort(wide)
    for p, v in zip(probs, got["wide"]):
        at = p * (len(ordered) - 1)
        lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert v == (lo if lo == hi else lo + (hi - lo) * (at - np.floor(at)))
    assert got["inf"][0] == -float("inf") and got["inf"][3] == 2.0 and got["inf"][-1] == float("inf")
    assert got[None] == pytest.approx([4.0, 4.4, 5.0, 6.0, 7.08, 8.0])


def test_quantile_cells_keep_the_order_of_doubles(spark):
    from pyspark.sql import functions as F

    from tabscope.operators.quantiles import log_cell

    rng = np.random.default_rng(13)
    v = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-320, 308, 3000), [0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, np.inf, -np.inf]])
    cells = [r[0] for r in spark.createDataFrame(pd.DataFrame({"v": np.sort(v)})).select(log_cell(F.col("v")), "v").orderBy("v").collect()]
    assert cells == sorted(cells) and cells[0] == -33_000 and cells[-1] == 33_000 and max(cells[:-1]) < 33_000


def test_exact_quantiles_without_a_broadcast(spark, monkeypatch):
    from tabscope.operators import quantiles

    monkeypatch.setattr(quantiles, "BROADCAST_INTERVALS", 0)
    pdf, df = _frame(spark)
    got = {r["g"]: r["q50"] for r in quantiles.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == pytest.approx(pdf.groupby("g")["v"].median().to_dict(), rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
