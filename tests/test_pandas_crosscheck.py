"""Column and table metrics against direct pandas/numpy expressions on random
frames with nulls (hypothesis drives the shapes; few examples, Spark is slow)."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


def _pop_skew(x):
    d = x - x.mean()
    m2 = (d ** 2).mean()
    return (d ** 3).mean() / m2 ** 1.5 if m2 > 0 else None


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), n=st.integers(30, 400), null_frac=st.floats(0.0, 0.4))
def test_metrics_match_pandas(spark, seed, n, null_frac):
    from tabscope.plans.profile import TableProfile

    rng = np.random.default_rng(seed)
    a = rng.integers(0, 20, n).astype(float)
    b = a * 2 + rng.normal(0, 3, n)
    c = rng.choice(["x", "y", "z", "w"], n).astype(object)
    for arr in (a, b):
        arr[rng.random(n) < null_frac] = np.nan
    c[rng.random(n) < null_frac] = None
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c string")
    p = TableProfile(df)
    rows = {r["column"]: r for r in p.columns.collect()}
    for col in ["a", "b", "c"]:
        s = pdf[col]
        r = rows[col]
        assert r["missing_count"] == int(s.isnull().sum())
        assert r["unique_count"] == int(s.nunique())
        probs = s.fillna("__NA__").value_counts() / len(s)
        ent = float(-np.sum(probs * np.log2(probs + 1e-9)))
        assert abs(r["entropy"] - ent) < 1.5e-4
        assert r["entropy"] <= math.log2(max(s.nunique() + 1, 1)) + 1e-9
        assert 0 <= r["quality_score"] <= 100
        assert r["duplicate_count"] == int(pdf.duplicated(subset=[col], keep=False).sum())
    for col in ["a", "b"]:
        x = pdf[col].dropna()
        r = rows[col]
        if len(x) == 0:
            continue
        for k, v in [("mean", x.mean()), ("median", x.median()), ("q25", x.quantile(0.25)), ("q75", x.quantile(0.75)),
                     ("min", x.min()), ("max", x.max())]:
            assert abs(r[k] - v) < 1.5e-4, (col, k, r[k], v)
        if len(x) > 1:
            assert abs(r["std"] - x.std()) < 1.5e-4
        sk = _pop_skew(x.to_numpy())
        if len(x) >= 3 and sk is not None:
            assert abs(r["skewness"] - sk) < 1.5e-4
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        out = int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum())
        assert r["outlier_count"] == out
    # correlation matrix (pairwise complete) and missingness correlation
    m = {(r["col1"], r["col2"]): r["correlation"] for r in p.correlation_matrix().collect()}
    pc = pdf[["a", "b"]].corr()
    if not math.isnan(pc.loc["a", "b"]):
        assert abs(m[("a", "b")] - pc.loc["a", "b"]) < 1.5e-4 and abs(m[("a", "b")]) <= 1
    miss = {(r["col1"], r["col2"]): r["correlation"] for r in p.missing_correlation().collect()}
    mc = pdf.isnull().corr()
    for (x, y), v in miss.items():
        assert abs(v - mc.loc[x, y]) < 1.5e-3
    d = p.duplicates().collect()[0]
    assert d["duplicate_rows"] == int(pdf.duplicated().sum())
    assert d["duplicate_rows"] == n - len(pdf.drop_duplicates())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), bins=st.integers(1, 40))
def test_histogram_counts_sum_to_non_null(spark, seed, bins):
    from tabscope.operators.charts import histogram

    rng = np.random.default_rng(seed)
    v = np.round(rng.exponential(5, 300), 1)
    v[::17] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    rows = histogram(df, "v", bins).collect()
    assert sum(r["count"] for r in rows) == int((~np.isnan(v)).sum())
    assert [r["count"] for r in sorted(rows, key=lambda r: r["bin"])] == list(np.histogram(v[~np.isnan(v)], bins)[0])
