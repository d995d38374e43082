"""As-of join and duplicate detection against brute force on small fixtures."""

import numpy as np
import pandas as pd


def _brute_asof(left: pd.DataFrame, right: pd.DataFrame) -> dict:
    out = {}
    for _, l in left.iterrows():
        cand = right[(right.k == l.k) & (right.ts <= l.ts)]
        out[l.id] = None if cand.empty else cand.sort_values(["ts", "rid"]).iloc[-1].rid
    return out


def test_asof_join_matches_brute_force(spark):
    from tabscope.operators.asof import asof_join

    rng = np.random.default_rng(11)
    n = 400
    # key 0 is hot: most rows, spread over all partitions
    lk = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n))
    left = pd.DataFrame({"id": np.arange(n), "k": lk, "ts": pd.to_datetime(rng.integers(0, 10_000, n), unit="s")})
    m = 150
    rk = np.where(rng.random(m) < 0.6, 0, rng.integers(1, 8, m))
    right = pd.DataFrame({"rid": np.arange(m) + 1000, "k": rk,
                          "ts": pd.to_datetime(rng.choice(10_000, m, replace=False), unit="s")})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right).withColumnRenamed("ts", "rts"),
                    "k", "ts", "rts", partitions=6).collect()
    exp = _brute_asof(left, right)
    assert len(got) == n
    for r in got:
        assert (r["rid"] if r["rid"] is not None else None) == exp[r["id"]], r


def test_duplicates_match_pandas(spark):
    from tabscope.operators.duplicates import duplicate_row_list, duplicate_rows

    pdf = pd.DataFrame({"a": [1, 1, 1, 2, None, None, 3], "b": ["x", "x", "x", "y", None, None, "z"]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b string")
    r = duplicate_rows(df).collect()[0]
    assert r["duplicate_rows"] == int(pdf.duplicated().sum()) == 3
    assert r["rows_in_duplicate_groups"] == int(pdf.duplicated(keep=False).sum()) == 5
    assert r["duplicate_groups"] == 2 and r["duplicate_groups_ref"] == 2
    assert duplicate_row_list(df).count() == 5


def test_asof_null_keys_never_match(spark):
    from tabscope.operators.asof import asof_join

    left = spark.sql("SELECT * FROM VALUES (1, NULL, TIMESTAMP_NTZ'2024-01-02 00:00:00'), (2, 'a', TIMESTAMP_NTZ'2024-01-02 00:00:00'), "
                     "(3, 'a', NULL) AS t(id, k, ts)")
    right = spark.sql("SELECT * FROM VALUES (10, NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00'), (11, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:00') AS t(rid, k, rts)")
    for p in (1, 4):
        got = {r["id"]: r["rid"] for r in asof_join(left, right, "k", "ts", "rts", partitions=p).collect()}
        assert got == {1: None, 2: 11, 3: None}
    assert asof_join(left, right, "k", "ts", "rts", how="inner").count() == 1


def test_band_join_and_running_totals_match_pandas(spark):
    from tabscope.operators.bands import band_join, running_totals

    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": np.arange(300), "k": np.where(rng.random(300) < 0.4, 0, rng.integers(1, 5, 300)), "v": rng.integers(0, 400, 300) / 2})
    df = spark.createDataFrame(pdf)
    for low, high, inc_low, inc_high in ((-3, 5, True, True), (0, 4, False, True), (2, 2, True, True), (1, 6, True, False)):
        got = sorted((r["id"], r["r_id"]) for r in band_join(df, df, "k", "v", low=low, high=high, include_low=inc_low, include_high=inc_high).collect())
        both = pdf.merge(pdf, on="k")
        gap = both.v_y - both.v_x
        keep = ((gap >= low) if inc_low else (gap > low)) & ((gap <= high) if inc_high else (gap < high))
        assert got == sorted(zip(both.id_x[keep].tolist(), both.id_y[keep].tolist()))
    odd = spark.sql("SELECT * FROM VALUES (1, NULL, 1.0D), (2, 0, NULL), (3, 0, 1.0D) AS t(id, k, v)")
    assert [(r["id"], r["r_id"]) for r in band_join(odd, odd, "k", "v").collect()] == [(3, 3)]
    ordered = pdf.sort_values(["v", "id"])
    want = dict(zip(ordered.id, zip(ordered.groupby("k").cumcount() + 1, ordered.groupby("k").v.cumsum())))
    for r in running_totals(df, "k", ["v", "id"], "v", partitions=7).collect():
        assert (r["running_n"], r["running_sum"]) == want[r["id"]]
    got = {r["id"]: (r["running_n"], r["running_sum"]) for r in running_totals(odd, "k", ["id"], "v", partitions=2).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.0), 3: (2, 1.0)}


def test_band_join_on_times(spark):
    from tabscope.operators.bands import band_join

    ev = spark.sql("SELECT id, 1 AS u, TIMESTAMP_NTZ'1969-12-31 23:59:50' + make_dt_interval(0, 0, 0, id * 4.25) AS ts FROM range(9)")
    got = sorted((r["id"], r["r_id"]) for r in band_join(ev, ev, "u", "ts", high=8.5, include_low=False).collect())
    assert got == [(i, j) for i in range(9) for j in (i + 1, i + 2) if j < 9]
