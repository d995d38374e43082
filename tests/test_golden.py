"""Golden values of the 26-row sample (FIXTURES.md section 1)."""

import pytest

GOLDEN = {
    # column: type, missing, missing%, unique, ratio, entropy, score, dup
    "station": ("text", 0, 0, 24, 0.9231, 4.5466, 100, 4),
    "height": ("numeric", 0, 0, 24, 0.9231, 4.5466, 100, 4),
    "rain": ("numeric", 0, 0, 24, 0.9231, 4.5466, 100, 4),
    "zone": ("categorical", 0, 0, 3, 0.1154, 1.4979, 100, 26),
    "wind": ("numeric", 0, 0, 19, 0.7308, 4.1039, 100, 12),
    "grade": ("numeric", 0, 0, 24, 0.9231, 4.5466, 100, 4),
    "river": ("categorical", 0, 0, 4, 0.1538, 1.9878, 100, 26),
    "gauge": ("numeric", 10, 38.46, 15, 0.5769, 3.3459, 85.77, 12),
}
NUMERIC = {
    # mean, median, std, min, max, q25, q75, lower, upper, outliers, skew, kurtosis
    "height": (517.6538, 509, 274.4828, 120, 972, 281.75, 742.75, -409.75, 1434.25, 0, 0.072, -1.2736),
    "rain": (671.1154, 670, 139.5153, 460, 912, 554.75, 788.75, 203.75, 1139.75, 0, 0.0652, -1.2189),
    "wind": (8.0769, 7.5, 5.628, 0, 18, 3.25, 12.75, -11, 27, 0, 0.1193, -1.1463),
    "grade": (6.6077, 6.65, 0.9273, 5, 8.2, 5.925, 7.275, 3.9, 9.3, 0, -0.0931, -0.9404),
    "gauge": (73.4375, 74, 9.1139, 60, 88, 66, 80.5, 44.25, 102.25, 0, -0.1122, -1.1954),
}


def test_sample_loads(sample):
    assert sample.count() == 26
    types = dict(sample.dtypes)
    assert types["height"] == "bigint" and types["grade"] == "double" and types["station"] == "string"
    assert types["gauge"] == "bigint"


def test_column_profile_golden(sample_profile):
    rows = {r["column"]: r for r in sample_profile.columns.collect()}
    for col, (typ, miss, miss_pct, uniq, ratio, ent, score, dup) in GOLDEN.items():
        r = rows[col]
        assert r["type"] == typ, col
        assert r["missing_count"] == miss and r["missing_percentage"] == pytest.approx(miss_pct)
        assert r["unique_count"] == uniq and r["unique_ratio"] == pytest.approx(ratio)
        assert r["entropy"] == pytest.approx(ent, abs=1e-4)
        assert r["quality_score"] == pytest.approx(score)
        assert r["duplicate_count"] == dup
    for col, vals in NUMERIC.items():
        r = rows[col]
        got = (r["mean"], r["median"], r["std"], r["min"], r["max"], r["q25"], r["q75"], r["lower_bound"],
               r["upper_bound"], r["outlier_count"], r["skewness"], r["kurtosis"])
        for g, e in zip(got, vals):
            assert g == pytest.approx(e, abs=1.5e-4), (col, got, vals)


def test_table_level_golden(sample_profile, sample):
    c = sample_profile.completeness().collect()[0]
    assert (c["total_cells"], c["missing_cells"]) == (208, 10)
    m = sample_profile.missing_patterns().collect()[0]
    assert (m["rows_with_missing"], m["completely_empty_rows"]) == (10, 0)
    d = sample_profile.duplicates().collect()[0]
    assert (d["duplicate_rows"], d["rows_in_duplicate_groups"], d["duplicate_groups"], d["duplicate_groups_ref"]) == (2, 4, 2, 2)
    assert [r["column"] for r in sample_profile.constant_columns().collect()] == []
    assert sorted(r["column"] for r in sample_profile.high_cardinality().collect()) == ["grade", "height", "rain", "station"]
    assert sample_profile.missing_correlation().count() == 0


def test_strong_correlations_golden(sample_profile):
    got = {(r["col1"], r["col2"]): (r["correlation"], r["strength"]) for r in sample_profile.strong_correlations().collect()}
    expected = {
        ("height", "rain"): (0.997, "strong"), ("height", "grade"): (0.897, "moderate"),
        ("rain", "grade"): (0.896, "moderate"), ("wind", "gauge"): (0.999, "strong"),
    }
    assert got == expected


def test_histogram_golden(sample):
    from tabscope.operators.charts import histogram

    rows = histogram(sample, "height", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [7, 5, 4, 5, 5]
    edges = [r["lo"] for r in rows] + [rows[-1]["hi"]]
    assert edges == pytest.approx([120, 290.4, 460.8, 631.2, 801.6, 972])


def test_report_has_all_parts(sample_profile):
    rep = sample_profile.report()
    for key in ("columns", "top_values", "completeness", "duplicates", "correlation_matrix", "warnings"):
        assert key in rep
    assert rep["correlation_matrix"].count() == 25
    tv = rep["top_values"].where("column = 'zone'").orderBy("rank").collect()
    assert tv[0]["value"] == "hill" and tv[0]["count"] == 13
