"""``TableProfile``: builds each shared scan once and derives every column and
table metric from them. Public operators (``tabscope.operators``) are thin
views of this object, so a full report costs: one frequency aggregate with the
null patterns (persisted until ``close``), one distributed quantile selection
over its numeric part, one correlation pass and the hash-first duplicate
pass. Only per-column rows reach the driver.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.functions.local import local_frame

from tabscope.functions.expressions import (
    CORR_LIST_THRESHOLD,
    CORR_PLACES,
    CORR_STRONG_THRESHOLD,
    MISSING_CORR_THRESHOLD,
    as_text,
    fixed_width,
    is_id_like,
    verdict_band,
    HIGH_CARDINALITY_THRESHOLD,
    IQR_K,
    NUMERIC_CATEGORICAL_RATIO,
    PCT_PLACES,
    STAT_PLACES,
    TEXT_CATEGORICAL_RATIO,
    TOP_VALUES,
    quality_score,
    rnd,
    safe_ratio,
    status_band,
)
from tabscope.operators.frequent import frequent_values
from tabscope.operators.quantiles import exact_quantiles
from tabscope.plans import spine
from tabscope.plans.moments import pair_moments, pearson
from tabscope.session import ensure_checkpoint_dir, reuse


class TableProfile:
    """Shared scans of one table. Use it in a ``with`` block, or call ``close``, to free the cache."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None):
        self.raw = df
        selected = df.select(*[spine.q(c) for c in columns]) if columns else df
        self._persisted: list[DataFrame] = []
        self.base = spine.clean(selected)
        self.specs = spine.column_specs(self.base)
        self.spark = df.sparkSession

    def __enter__(self) -> "TableProfile":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ------------------------------------------------------------------ scans
    @cached_property
    def _pattern_table(self) -> DataFrame:
        """M, written. It rides along in F's scan; when F has not been built (a
        missing-values question alone) M is its own small aggregate."""
        if "freq" in self.__dict__:
            return spine.patterns_from_frequencies(self.freq, self.specs)
        return spine.null_patterns(self.base, self.specs)

    @cached_property
    def patterns(self) -> dict:
        """Null-pattern facts from M."""
        return spine.pattern_stats(self._pattern_table, self.specs)

    @cached_property
    def n_rows(self) -> int:
        return int(self.patterns["rows"])

    @cached_property
    def freq(self) -> DataFrame:
        f = reuse(spine.frequencies(self.base, self.specs))
        self._persisted.append(f)
        return f

    def close(self) -> None:
        """Free the cached frequency table; facts already collected stay."""
        for d in self._persisted:
            d.unpersist()
        self._persisted.clear()
        self.__dict__.pop("freq", None)

    # ------------------------------------------------------- per-column facts
    @cached_property
    def _basic(self) -> list[dict]:
        """Counts, distinct values, entropy, range and date fits of every column, from F."""
        freq = self.freq  # before the row count, which then rides in it
        n = self.n_rows
        got = {r["column"]: r.asDict() for r in spine.column_stats(freq, self.specs, n).collect()}
        facts = []
        for s in self.specs:
            r = got.get(s.name, {})
            facts.append({
                "column": s.name, "ordinal": s.ordinal, "storage_type": s.type_name, "cls": s.cls,
                "integral": s.integral, "n_rows": n, "missing_count": int(r.get("missing_count") or 0),
                "unique_count": int(r.get("unique_count") or 0), "entropy_raw": r.get("entropy_raw"),
                "duplicate_count": int(r.get("duplicate_count") or 0), "vmin": r.get("vmin"), "vmax": r.get("vmax"),
                "n_num": int(r.get("n_num") or 0), "mean": r.get("mean"),
                "date_fit_max": int(r.get("date_fit_max") or 0),
            })
        return facts

    @cached_property
    def _facts(self) -> list[dict]:
        """The basic facts plus quantiles, central moments and outlier counts (two more passes over F)."""
        facts = [dict(f) for f in self._basic]
        by_name = {f["column"]: f for f in facts}
        live = [f for f in facts if f["cls"] == "numeric" and f["n_num"] > 0]
        if live:
            q = exact_quantiles(spine.numeric_frequencies(self.freq), ["column"], "dval", [0.25, 0.5, 0.75],
                                ["q25", "median", "q75"], weight="cnt")
            for r in q.collect():
                by_name[r["column"]].update(q25=r["q25"], median=r["median"], q75=r["q75"])
            small = []
            for f in live:
                iqr = f["q75"] - f["q25"]
                f["lower_bound"], f["upper_bound"] = f["q25"] - IQR_K * iqr, f["q75"] + IQR_K * iqr
                small.append((f["column"], f["mean"], f["lower_bound"], f["upper_bound"]))
            fences = local_frame(self.spark, small, "column string, mean double, lower_bound double, upper_bound double")
            # One row per numeric column: a bounded broadcast.
            j = spine.numeric_frequencies(self.freq).join(F.broadcast(fences), "column")
            d = F.col("dval") - F.col("mean")
            w = F.col("cnt")
            agg = j.groupBy("column").agg(
                F.sum(w * d * d).alias("m2"), F.sum(w * d * d * d).alias("m3"), F.sum(w * d * d * d * d).alias("m4"),
                F.sum(F.when(F.col("dval") < F.col("lower_bound"), w).otherwise(0)).alias("below"),
                F.sum(F.when(F.col("dval") > F.col("upper_bound"), w).otherwise(0)).alias("above"),
            )
            for r in agg.collect():
                by_name[r["column"]].update(m2=r["m2"], m3=r["m3"], m4=r["m4"], below=int(r["below"]), above=int(r["above"]))
        return facts

    @cached_property
    def facts(self) -> DataFrame:
        """The collected facts as one local relation; every per-column view below is
        a projection of it (evaluated on the driver, no job)."""
        return self._frame(self._facts)

    def _frame(self, facts: list[dict]) -> DataFrame:
        schema = ("column string, ordinal int, storage_type string, cls string, integral boolean, n_rows long, "
                  "missing_count long, unique_count long, entropy_raw double, duplicate_count long, vmin double, "
                  "vmax double, n_num long, mean double, date_fit_max long, q25 double, median double, q75 double, "
                  "m2 double, m3 double, m4 double, below long, above long, lower_bound double, upper_bound double")
        names = [x.split()[0] for x in schema.split(", ")]
        rows = [tuple(f.get(k) for k in names) for f in facts]
        return local_frame(self.spark, rows, schema)

    @cached_property
    def stats(self) -> DataFrame:
        """Column facts + semantic type (P1-P4, T7), one row per column."""
        frame = self._frame(self._basic)
        n = self.n_rows
        return frame.select(
            "column", "ordinal", "storage_type", "cls", "integral",
            self._type_expr().alias("type"),
            "missing_count",
            rnd(safe_ratio(F.col("missing_count"), F.lit(n)) * 100, PCT_PLACES).alias("missing_percentage"),
            "unique_count",
            rnd(safe_ratio(F.col("unique_count"), F.lit(n)), STAT_PLACES).alias("unique_ratio"),
            F.when(F.lit(n) > 0, rnd(F.col("entropy_raw"), STAT_PLACES)).alias("entropy"),
            "duplicate_count", "vmin", "vmax", "n_num", "mean",
            (F.lit(n) - F.col("missing_count")).alias("non_null"),
        )

    @cached_property
    def outliers(self) -> DataFrame:
        """(column, outlier_count, outlier_percentage, lower_bound, upper_bound, below, above, non_null)."""
        o = F.col("below") + F.col("above")
        return self.facts.where(F.col("n_num") > 0).select(
            "column",
            o.alias("outlier_count"),
            rnd(safe_ratio(o, F.col("n_num")) * 100, PCT_PLACES).alias("outlier_percentage"),
            "lower_bound", "upper_bound", "below", "above",
            F.col("n_num").alias("non_null"),
        )

    @staticmethod
    def _shape() -> dict:
        """Standard deviation, population skewness and excess kurtosis from the central sums.

        Skewness and kurtosis are null below 3 values or when the variance
        vanishes against the mean's resolution.
        """
        n = F.col("n_num").cast("double")
        var_pop = F.col("m2") / n
        enough = (F.col("n_num") >= 3) & (var_pop > F.pow(F.lit(1e-15) * F.col("mean"), 2))
        return {
            "std": F.when(F.col("n_num") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (n - 1))),
            "skewness": F.when(enough, (F.col("m3") / n) / F.pow(var_pop, 1.5)),
            "kurtosis": F.when(enough, (F.col("m4") / n) / F.pow(var_pop, 2) - 3.0),
        }

    @cached_property
    def numeric(self) -> DataFrame:
        """Numeric statistics block (P5 + P7), rounded."""
        shape = self._shape()
        return self.facts.where(F.col("n_num") > 0).select(
            "column",
            "ordinal",
            rnd(F.col("mean"), STAT_PLACES).alias("mean"),
            rnd(F.col("median"), STAT_PLACES).alias("median"),
            rnd(shape["std"], STAT_PLACES).alias("std"),
            rnd(F.col("vmin"), STAT_PLACES).alias("min"),
            rnd(F.col("vmax"), STAT_PLACES).alias("max"),
            rnd(F.col("q25"), STAT_PLACES).alias("q25"),
            rnd(F.col("q75"), STAT_PLACES).alias("q75"),
            rnd(shape["skewness"], STAT_PLACES).alias("skewness"),
            rnd(shape["kurtosis"], STAT_PLACES).alias("kurtosis"),
            F.col("n_num").alias("n"),
            shape["skewness"].alias("_skew_raw"),
            shape["kurtosis"].alias("_kurt_raw"),
        )

    def top_values(self, k: int = TOP_VALUES, columns: list[str] | None = None, types=("categorical", "text", "boolean")) -> DataFrame:
        """(column, rank, value, count, percentage): most frequent non-null values.

        Of columns given by name, before F is built, rare values are not shuffled
        (``operators.frequent``). From F, ``row_number() <= k`` lets Spark
        insert a partial group limit before the shuffle. Either way the k rows
        a column are written, not collected; long texts among them are read again whole.
        """
        single = [s.name for s in self.specs if s.type_name == "float"]
        as_float = F.when(F.col("column").isin(single), F.col("dval").cast("float").cast("string")).otherwise(F.col("dval").cast("string"))
        if columns is not None and "freq" not in self.__dict__:
            ranked = self._frequent([s for s in self.specs if s.name in columns], k)
        else:
            freq = self.freq
            if columns is None:
                columns = [r["column"] for r in self.stats.where(F.col("type").isin(list(types))).select("column").collect()]
            f = freq.where(F.col("column").isin(columns) & (F.col("sval").isNotNull() | F.col("dval").isNotNull()))
            w = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("dval"), F.asc("sval"))
            ranked = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ensure_checkpoint_dir(self.spark)
        n = self.n_rows
        rows = ranked.select("column", F.col("rank").cast("int").alias("rank"), F.coalesce("sval", as_float).alias("value"), F.col("cnt").alias("count")).checkpoint()
        out = spine.with_whole_texts(self.base, self.specs, rows)
        return out.withColumn("percentage", rnd(safe_ratio(F.col("count"), F.lit(n)) * 100, PCT_PLACES))

    def _frequent(self, specs: list[spine.ColumnSpec], k: int) -> DataFrame:
        if not specs:
            return local_frame(self.spark, [], "column string, rank int, sval string, dval double, cnt long")
        cell = "struct<c:int,s:string,d:double>"
        cells = [F.struct(F.lit(i).alias("c"), spine._sval(s).alias("s"), spine._dval(s).alias("d")).cast(cell).alias(s.name) for i, s in enumerate(specs)]
        long = self.base.select(*cells).unpivot([], [spine.q(s.name) for s in specs], "column", "v").select("v.c", "v.s", "v.d")
        found = frequent_values(long.where("s IS NOT NULL OR d IS NOT NULL"), k)
        names = F.element_at(F.array(*[F.lit(s.name) for s in specs]), F.col("c") + 1)
        return found.select(names.alias("column"), "rank", F.col("s").alias("sval"), F.col("d").alias("dval"), "cnt")

    @cached_property
    def columns(self) -> DataFrame:
        """Column report (P11): one flat row per column, including score and status.

        Two projections of the collected facts (no join, no job)."""
        facts = self.facts
        n = self.n_rows
        shape = self._shape()
        has_num = F.col("n_num") > 0
        outl = F.col("below") + F.col("above")
        base = facts.select(
            "*",
            rnd(safe_ratio(F.col("missing_count"), F.lit(n)) * 100, PCT_PLACES).alias("missing_percentage"),
            rnd(safe_ratio(F.col("unique_count"), F.lit(n)), STAT_PLACES).alias("unique_ratio"),
            F.when(F.lit(n) > 0, rnd(F.col("entropy_raw"), STAT_PLACES)).alias("entropy"),
            F.when(has_num, outl).alias("outlier_count"),
            F.when(has_num, rnd(safe_ratio(outl, F.col("n_num")) * 100, PCT_PLACES)).alias("outlier_percentage"),
        )
        base = base.select("*", self._type_expr().alias("type"))
        score = quality_score(F.col("missing_percentage"), F.col("outlier_percentage"), F.col("unique_ratio"))
        return base.select(
            "column", "ordinal", "type", "storage_type", "missing_count", "missing_percentage", "unique_count",
            "unique_ratio", "entropy", "duplicate_count",
            F.when(has_num, rnd(F.col("mean"), STAT_PLACES)).alias("mean"),
            F.when(has_num, rnd(F.col("median"), STAT_PLACES)).alias("median"),
            F.when(has_num, rnd(shape["std"], STAT_PLACES)).alias("std"),
            F.when(has_num, rnd(F.col("vmin"), STAT_PLACES)).alias("min"),
            F.when(has_num, rnd(F.col("vmax"), STAT_PLACES)).alias("max"),
            F.when(has_num, rnd(F.col("q25"), STAT_PLACES)).alias("q25"),
            F.when(has_num, rnd(F.col("q75"), STAT_PLACES)).alias("q75"),
            "outlier_count", "outlier_percentage",
            rnd(F.col("lower_bound"), STAT_PLACES).alias("lower_bound"),
            rnd(F.col("upper_bound"), STAT_PLACES).alias("upper_bound"),
            F.when(has_num, rnd(shape["skewness"], STAT_PLACES)).alias("skewness"),
            F.when(has_num, rnd(shape["kurtosis"], STAT_PLACES)).alias("kurtosis"),
            score.alias("quality_score"),
            status_band(score).alias("status"),
        )

    def _type_expr(self):
        """P1 semantic type rule over the facts columns."""
        nonnull = F.lit(self.n_rows) - F.col("missing_count")
        ratio_nn = F.col("unique_count") / nonnull
        return (
            F.when(nonnull <= 0, "empty")
            .when(
                F.col("cls") == "numeric",
                F.when(F.col("unique_count") == 2, "binary")
                .when(ratio_nn < NUMERIC_CATEGORICAL_RATIO, "categorical")
                .otherwise("numeric"),
            )
            .when(F.col("cls") == "boolean", F.when(F.col("unique_count") == 2, "binary").otherwise("boolean"))
            .when(F.col("cls") == "datetime", "datetime")
            .when(F.col("cls") == "nested", "nested")
            .when((F.col("cls") == "string") & (F.col("date_fit_max") == F.col("unique_count")), "datetime")
            .when(ratio_nn < TEXT_CATEGORICAL_RATIO, "categorical")
            .otherwise("text")
        )

    # -------------------------------------------------------------- table level
    def high_cardinality(self, threshold: float = HIGH_CARDINALITY_THRESHOLD) -> DataFrame:
        n = self.n_rows
        st = self.stats
        ratio = safe_ratio(F.col("unique_count"), F.lit(n))
        return st.where(ratio > threshold).select("column", "ordinal", rnd(ratio, STAT_PLACES).alias("unique_ratio"))

    def constant_columns(self) -> DataFrame:
        """Columns with at most one distinct non-null value (all-null included)."""
        return self.stats.where(F.col("unique_count") <= 1).select("column", "ordinal")

    def completeness(self) -> DataFrame:
        """One row of size and completeness figures."""
        n, c = self.n_rows, len(self.specs)
        missing = sum(self.patterns["null"].values())
        cells = n * c
        pct = (missing / cells * 100) if cells else None
        row = (n, c, cells, missing, pct, (100 - pct) if pct is not None else None)
        df = local_frame(self.spark, 
            [row],
            "rows long, columns int, total_cells long, missing_cells long, missing_raw double, complete_raw double",
        )
        return df.select(
            "rows", "columns", "total_cells", "missing_cells",
            rnd(F.col("missing_raw"), PCT_PLACES).alias("missing_percentage"),
            rnd(F.col("complete_raw"), PCT_PLACES).alias("completeness_percentage"),
        )

    def missing_patterns(self) -> DataFrame:
        """Rows with every value missing and rows with at least one missing."""
        p = self.patterns
        return local_frame(self.spark, 
            [(p["completely_empty_rows"], p["rows_with_missing"])],
            "completely_empty_rows long, rows_with_missing long",
        )

    def missing_correlation(self, threshold: float = MISSING_CORR_THRESHOLD) -> DataFrame:
        """Phi coefficient of the null flags of two columns, |r| > threshold.

        Equals Pearson on 0/1 flags; pairs with a constant flag drop out.
        """
        null, n = [self.patterns["null"][s.name] for s in self.specs], self.n_rows
        varying = [i for i, k in enumerate(null) if 0 < k < n]
        rows = []
        for (i, j), both in spine.co_nulls(self._pattern_table, varying).items():
            r = (n * both - null[i] * null[j]) / math.sqrt(null[i] * (n - null[i]) * null[j] * (n - null[j]))
            if abs(r) > threshold:
                rows.append((self.specs[i].name, self.specs[j].name, i, j, r))
        df = local_frame(self.spark, rows, "col1 string, col2 string, i int, j int, r double")
        return df.select("col1", "col2", rnd(F.col("r"), CORR_PLACES).alias("correlation"))

    @cached_property
    def _corr_pairs(self) -> list[tuple[str, str, int, int, float | None]]:
        """Pairwise-complete Pearson for every ordered numeric pair (diagonal included)."""
        names = [s.name for s in self.specs if s.numeric]
        if not names:
            return []
        state = pair_moments(self.base, names)
        at = range(len(names))
        found = {(i, j): pearson(state, i, j) for i in at for j in at if i <= j}
        return [(names[i], names[j], i, j, found[min(i, j), max(i, j)]) for i in at for j in at]

    def correlation_matrix(self) -> DataFrame:
        """T10 in long form: ``col1, col2, correlation`` for all numeric pairs.

        Empty when fewer than two numeric columns (the reference's "not available").
        """
        rows = self._corr_pairs if sum(1 for s in self.specs if s.numeric) >= 2 else []
        df = local_frame(self.spark, rows, "col1 string, col2 string, i int, j int, r double")
        return df.select("col1", "col2", rnd(F.col("r"), STAT_PLACES).alias("correlation"))

    def strong_correlations(self, hide_ids: bool = False, threshold: float = CORR_LIST_THRESHOLD) -> DataFrame:
        """Pairs i<j with |r| > threshold, labelled strong above 0.9."""
        rows = [
            (a, b, i, j, r)
            for a, b, i, j, r in (self._corr_pairs if sum(1 for s in self.specs if s.numeric) >= 2 else [])
            if i < j and r is not None and abs(r) > threshold
        ]
        df = local_frame(self.spark, rows, "col1 string, col2 string, i int, j int, r double")
        if hide_ids:
            df = df.where(~is_id_like(F.col("col1")) & ~is_id_like(F.col("col2")))
        return df.select(
            "col1",
            "col2",
            rnd(F.col("r"), CORR_PLACES).alias("correlation"),
            F.when(F.abs("r") > CORR_STRONG_THRESHOLD, "strong").otherwise("moderate").alias("strength"),
        )

    def data_size(self) -> DataFrame:
        """T15 re-aimed: logical bytes per column (fixed width, or UTF-8 bytes of the text)."""
        widths = {s.name: fixed_width(s.dtype) for s in self.specs}
        # Variable-width columns: UTF-8 byte lengths in long form, one scan (F holds long values by their key only).
        var = [s for s in self.specs if widths[s.name] is None]
        got = {}
        if var:
            lengths = self.base.select(*[F.octet_length(as_text(spine.q(s.name), s.dtype)).cast("long").alias(s.name) for s in var])
            long = lengths.unpivot([], [spine.q(s.name) for s in var], "column", "v")
            got = {r[0]: r[1] for r in long.groupBy("column").agg(F.sum("v")).collect()}
        text_bytes = local_frame(self.spark, [(k, int(v or 0)) for k, v in got.items()], "column string, var_bytes long")
        st = self.stats.select("column", "ordinal", "non_null").join(text_bytes, "column", "left")
        width = F.lit(None).cast("long")
        for name, w in widths.items():
            if w is not None:
                width = F.when(F.col("column") == name, F.lit(w)).otherwise(width)
        size = F.when(width.isNotNull(), width * F.col("non_null")).otherwise(F.coalesce(F.col("var_bytes"), F.lit(0)))
        return st.select("column", "ordinal", size.cast("long").alias("bytes"))

    def type_distribution(self) -> DataFrame:
        """Storage type name -> number of columns and of their non-null values."""
        found: dict[str, list[int]] = {}
        for s in self.specs:
            own = found.setdefault(s.type_name, [0, 0])
            own[0] += 1
            own[1] += self.n_rows - self.patterns["null"][s.name]
        return local_frame(self.spark, sorted((k, *v) for k, v in found.items()), "storage_type string, columns long, values long")

    def semantic_type_distribution(self) -> DataFrame:
        """Semantic type -> number of columns (one row per column, counted on the driver)."""
        from collections import Counter

        counts = Counter(r["type"] for r in self.stats.select("type").collect())
        return local_frame(self.spark, sorted(counts.items()), "type string, columns long")

    def overall_quality(self) -> DataFrame:
        """Mean column score and its verdict band."""
        avg = F.avg("quality_score")
        return self.columns.agg(rnd(avg, PCT_PLACES).alias("overall_quality_score")).select(
            "overall_quality_score", verdict_band(F.col("overall_quality_score")).alias("verdict")
        )

    def warnings(self) -> DataFrame:
        """Constant and high-cardinality columns with a ``warning`` label."""
        const = self.constant_columns().select("column", "ordinal", F.lit("constant").alias("warning"))
        high = self.high_cardinality().select("column", "ordinal", F.lit("high_cardinality").alias("warning"))
        return const.unionByName(high)

    def duplicates(self) -> DataFrame:
        from tabscope.operators.duplicates import duplicate_rows

        return duplicate_rows(self.base, self.n_rows)

    def summary(self) -> DataFrame:
        """Rows, columns, missing %, duplicate rows, numeric / other column counts."""
        comp = self.completeness().select("rows", "columns", "missing_percentage")
        dups = int(self.duplicates().collect()[0]["duplicate_rows"])
        n_num = sum(1 for s in self.specs if s.numeric)
        return comp.select(
            "rows", "columns", "missing_percentage", F.lit(dups).cast("long").alias("duplicates"),
            F.lit(n_num).alias("numeric_columns"), F.lit(len(self.specs) - n_num).alias("categorical_columns"),
        )

    def report(self) -> dict[str, DataFrame]:
        """Every report part as a small DataFrame."""
        return {
            "columns": self.columns,
            "top_values": self.top_values(),
            "completeness": self.completeness(),
            "duplicates": self.duplicates(),
            "column_duplicates": self.stats.where(F.col("duplicate_count") > 0).select("column", "duplicate_count"),
            "missing_patterns": self.missing_patterns(),
            "missing_correlation": self.missing_correlation(),
            "correlation_matrix": self.correlation_matrix(),
            "strong_correlations": self.strong_correlations(),
            "constant_columns": self.constant_columns(),
            "high_cardinality": self.high_cardinality(),
            "data_size": self.data_size(),
            "type_distribution": self.type_distribution(),
            "semantic_type_distribution": self.semantic_type_distribution(),
            "overall_quality": self.overall_quality(),
            "warnings": self.warnings(),
        }


@contextmanager
def profiled(df: DataFrame, profile: TableProfile | None = None, columns: list[str] | None = None):
    """The given profile, or one of ``df`` that is closed at the end: results are local by then."""
    own = profile or TableProfile(df, columns)
    try:
        yield own
    finally:
        if profile is None:
            own.close()
