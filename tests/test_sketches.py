"""Moments, null patterns, frequent values and sketches against numpy and plain counts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import approx, frequent
from tabscope.operators.charts import histogram
from tabscope.operators.table import correlation_matrix, missing_correlation, strong_correlations
from tabscope.plans import moments, spine
from tabscope.plans.profile import TableProfile


@pytest.fixture
def no_arrow(spark):
    """A session with Spark's own default for Arrow."""
    key = "spark.sql.execution.arrow.pyspark.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


def test_pair_moments_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5)) * [1, 1e-3, 1e6, 1, 1] + [1e9, 0, -1e12, 5, 0]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=4000)
    x[:, 4] = 7.25  # constant
    x[rng.random((4000, 5)) < 0.1] = np.nan
    x[5, 1] = np.inf
    x[::2, 2] = np.where(np.arange(2000) % 2, np.nan, x[::2, 2])
    names = [f"a{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(9)
    got = moments.pair_moments(df, names)
    for i in range(5):
        for j in range(5):
            ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            a, b = x[ok, i], x[ok, j]
            assert got["n"][i, j] == ok.sum() and got["low"][i, j] == a.min() and got["high"][i, j] == a.max()
            assert got["mean"][i, j] == pytest.approx(a.mean(), rel=1e-12)
            assert got["square"][i, j] == pytest.approx(((a - a.mean()) ** 2).sum(), rel=1e-7, abs=1e-12)
            r = moments.pearson(got, i, j)
            if 4 in (i, j):
                assert r is None
            else:
                assert r == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-7)


def test_pairs_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None, 2), (2.0, None, 3), (None, 1.0, 3), (None, 4.0, 9)], "a double, b double, c int")
    got = {(r["col1"], r["col2"]): r["correlation"] for r in correlation_matrix(df).collect()}
    assert got["a", "b"] is None and got["a", "c"] == 1.0 and got["b", "b"] == 1.0
    assert all(r["correlation"] is None for r in correlation_matrix(df.limit(0)).collect())


def test_reports_on_a_default_session(no_arrow):
    df = no_arrow.range(200).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0 + F.col("id") % 3).alias("b"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("c"))
    assert correlation_matrix(df).count() == 9
    assert {(r["col1"], r["col2"]) for r in strong_correlations(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    with TableProfile(df) as p:
        assert {k: v.columns and v.count() >= 0 for k, v in p.report().items()} and len(p.report()) == 16


@pytest.mark.parametrize("n_columns", [3, 62, 130])
def test_null_patterns(spark, n_columns):
    rng = np.random.default_rng(n_columns)
    there = rng.random((60, n_columns)) < 0.6
    there[:, -1] = there[:, 0]  # missing together
    there[0], there[1] = True, False
    names = [f"x{i}" for i in range(n_columns)]
    df = spark.createDataFrame([tuple(1 if v else None for v in r) for r in there.tolist()], ", ".join(f"{n} int" for n in names)).repartition(4)
    specs = spine.column_specs(df)
    for m in (spine.null_patterns(df, specs), spine.patterns_from_frequencies(spine.frequencies(df, specs), specs)):
        got = spine.pattern_stats(m, specs)
        assert got["rows"] == 60 and got["completely_empty_rows"] == (~there).all(axis=1).sum() and got["rows_with_missing"] == (~there).any(axis=1).sum()
        assert [got["null"][n] for n in names] == (~there).sum(axis=0).tolist()
        both = (~there).astype(int).T @ (~there).astype(int)
        assert spine.co_nulls(m, list(range(n_columns))) == {(i, j): int(both[i, j]) for i in range(n_columns) for j in range(i + 1, n_columns)}
    assert ("x0", names[-1], 1.0) in [tuple(r) for r in missing_correlation(df).collect()]


def test_counters_keep_their_bound():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 5000, 20_000), np.repeat([7, 8, 9], [900, 400, 300])])
    rng.shuffle(values)
    exact = Counter(values.tolist())
    hashes, counts, dropped = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for part in np.array_split(values, 40):
        found, n = np.unique(part, return_counts=True)
        hashes, counts, dropped = frequent.trimmed(*frequent.added([hashes, found], [counts, n]), dropped, 50)
    held = dict(zip(hashes.tolist(), counts.tolist()))
    assert len(held) <= 50 and dropped <= len(values) / 50
    assert all(held.get(v, 0) <= n <= held.get(v, 0) + dropped for v, n in exact.items())


@pytest.mark.parametrize("counters,k", [(4, 3), (30, 5), (4096, 10), (4, 9)])
def test_frequent_values(spark, counters, k):
    rng = np.random.default_rng(counters)
    columns = {
        0: [f"v{i}" for i in rng.zipf(1.6, 3000) % 200], 1: [f"u{i:05d}" for i in rng.permutation(3000)],
        2: ["x"] * 3000, 3: [f"t{i // 3:04d}" for i in range(3000)], 4: [],
    }
    rows = [(c, v, None) for c, vs in columns.items() for v in vs] + [(5, None, float(v)) for v in rng.integers(0, 40, 2000)]
    df = spark.createDataFrame(rows, "c int, s string, d double").repartition(7)
    got = {}
    for r in frequent.frequent_values(df, k, counters).orderBy("c", "rank").collect():
        got.setdefault(r["c"], []).append((r["rank"], r["s"] if r["s"] is not None else r["d"], r["cnt"]))
    want = {}
    for c in (0, 1, 2, 3, 5):
        found = Counter(columns[c] if c in columns else [r[2] for r in rows if r[0] == 5])
        want[c] = [(i + 1, v, n) for i, (v, n) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])]
    assert got == want


def test_long_texts_among_top_values(spark):
    texts = ["a" * 500, "a" * 500, "a" * 499 + "b", "short", "short", "short"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, n int")
    with TableProfile(df) as p:
        alone = [(r["value"], r["count"]) for r in p.top_values(k=2, columns=["t"]).orderBy("rank").collect()]
        p.freq.count()
        assert [(r["value"], r["count"]) for r in p.top_values(k=2, columns=["t"]).orderBy("rank").collect()] == alone == [("short", 3), ("a" * 500, 2)]


def test_approx_profile_bounds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000).round(4)
    df = spark.createDataFrame([(float(v), f"s{i % 700}", None if i % 4 == 0 else i, float("nan")) for i, v in enumerate(x)], "x double, s string, n int, e double").repartition(6)
    got = {r["column"]: r for r in approx.approx_profile(df).collect()}
    assert list(got) == ["x", "s", "n", "e"] and got["n"]["missing_count"] == 5000 and got["e"]["missing_count"] == 20_000
    for c, exact in (("x", len(set(x))), ("s", 700), ("n", 15_000), ("e", 0)):
        assert abs(got[c]["unique_estimate"] - exact) <= got[c]["unique_error"]
    assert got["x"]["mean"] == pytest.approx(x.mean(), abs=1e-4) and got["x"]["std"] == pytest.approx(x.std(ddof=1), abs=1e-4)
    for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        assert abs((x <= got["x"][name]).mean() - p) <= got["x"]["rank_error"] + 1e-3
    assert got["s"]["median"] is None and got["e"]["mean"] is None
    bare = approx.approx_profile(df.limit(0)).collect()
    assert [(r["column"], r["n_rows"], r["unique_estimate"], r["missing_percentage"]) for r in bare] == [(c, 0, 0, None) for c in ("x", "s", "n", "e")]


def test_approx_top_values_bounds(spark):
    rng = np.random.default_rng(6)
    v = [f"v{i}" for i in rng.zipf(1.5, 30_000) % 5000]
    df = spark.createDataFrame([(x,) for x in v], "v string").repartition(5)
    exact = Counter(v)
    got = approx.approx_top_values(df, ["v"], k=8, tracked=1000).collect()
    assert all(abs(r["count_estimate"] - exact[r["value"]]) <= r["count_error"] for r in got)
    assert {x for x, n in exact.items() if n > 2 * got[0]["count_error"]} <= {r["value"] for r in got} or len(got) == 8


def test_infinite_values_stay_out_of_histograms(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    got = histogram(df, "v", 2).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["count"]) for r in got] == [(1.0, 1.5, 1), (1.5, 2.0, 1)]
