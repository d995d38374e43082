"""Column-expression building blocks shared by the operators (all JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's report rules.
# Rounding places: statistics 4, percentages 2, correlations 3.
STAT_PLACES = 4
PCT_PLACES = 2
CORR_PLACES = 3
# Entropy smoothing term inside log2(p + eps).
ENTROPY_EPS = 1e-9
# IQR outlier fence multiplier.
IQR_K = 1.5
# Quality score: missing penalty factor, outlier penalty factor, outlier penalty cap,
# diversity bonus and its open unique-ratio interval.
SCORE_MISSING_FACTOR = 0.5
SCORE_OUTLIER_FACTOR = 0.3
SCORE_OUTLIER_CAP = 15.0
SCORE_BONUS = 5.0
SCORE_BONUS_LOW, SCORE_BONUS_HIGH = 0.1, 0.8
# Column status bands (score >= 90 good, >= 70 acceptable, else needs attention).
STATUS_BANDS = [(90.0, "good"), (70.0, "acceptable")]
STATUS_ELSE = "needs attention"
# Table verdict bands (overall score >= 90 excellent, >= 70 good, else needs cleaning).
VERDICT_BANDS = [(90.0, "excellent"), (70.0, "good")]
VERDICT_ELSE = "needs cleaning"
# Correlation thresholds: strong-correlation list, "strong" label, missingness pairs.
CORR_LIST_THRESHOLD = 0.7
CORR_STRONG_THRESHOLD = 0.9
MISSING_CORR_THRESHOLD = 0.5
HIGH_CARDINALITY_THRESHOLD = 0.9
# Id-like column names hidden from the strong-correlation list.
ID_NAME_PATTERN = r"(?i)(^|_)id(_|$)"
# Date-column name hints used by the dynamics column picker.
DATE_NAME_PATTERN = r"(?i)(date|dt|time|created|updated|opened|closed|трад|дата)"
# Semantic-type thresholds: distinct/non-null below these is categorical.
NUMERIC_CATEGORICAL_RATIO = 0.05
TEXT_CATEGORICAL_RATIO = 0.5
# Defaults: histogram bins, top values, top categories, preview rows.
DEFAULT_BINS = 30
TOP_VALUES = 10
TOP_CATEGORIES = 20
PREVIEW_ROWS = 50
# Date formats tried for text columns (one format must fit every value).
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy/MM/dd",
    "dd.MM.yyyy",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
]


def parse_date(c: Column, fmt: str) -> Column:
    """Text as a timestamp in one format, else null. A zone in the text is read and then
    left out: the wall-clock time stays, as a report by calendar day shows it."""
    if fmt.endswith("XXX"):
        zoned = c.rlike(r"(Z|[+-]\d{2}:\d{2})$")
        return F.when(zoned, F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:\d{2})$", ""), F.lit(fmt[:-3])))
    return F.try_to_timestamp(c, F.lit(fmt))


def date_shape(c: Column) -> Column:
    """The text with every digit as 0, empty where no date format can fit: what decides which formats are tried."""
    shape = F.translate(c, "123456789", "000000000")
    return F.when(shape.rlike(r"^(0000[-/]00[-/]00|00[./]00[./]0000$|[+-]0|00[./]00[./][+-])"), shape).otherwise(F.lit(""))


def may_fit(shape: Column, fmt: str) -> Column:
    """Whether a text of this shape can have this format. Signed years, a fraction of any length
    and either case of T are let through; whether the digits make a date is for the parser."""
    zoned = fmt.endswith("XXX")
    body = re.sub("[yMdHms]", "0", fmt.removesuffix("XXX").replace("'T'", "T"))
    body = re.escape(body.split(".S")[0]) + (r"(\.0*)?" if ".S" in body else "")
    pattern = body.replace("T", "[Tt]") + (r"(Z|[+-]00:00)" if zoned else "")
    return (shape != "") & (shape.rlike(f"^{pattern}$") | shape.rlike(r"^[+-]|[./][+-]"))


def is_finite(c: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def rnd(c: Column, places: int) -> Column:
    """Round half away from zero on the binary value scaled in double arithmetic.

    Spark's ``round`` rounds the shortest decimal text of a double (0.00015 -> 0.0002)
    while pandas/numpy round the binary value (0.0001). This spelled-out rule is
    the same IEEE arithmetic in any engine; ``+ 0.0`` drops the sign of zero.
    """
    scale = float(10 ** places)
    t = F.abs(c.cast("double")) * F.lit(scale)
    whole = t - t % F.lit(1.0)
    r = whole + F.when(t - whole >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.signum(c) * r / F.lit(scale) + F.lit(0.0)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 (zero-row tables, D4)."""
    return F.when(den > 0, num.cast("double") / den)


def quality_score(missing_pct: Column, outlier_pct: Column, unique_ratio: Column) -> Column:
    """0-100 column score from the *rounded* report inputs.

    ``outlier_pct`` is null for columns without an outlier block.
    """
    score = F.lit(100.0) - missing_pct * SCORE_MISSING_FACTOR
    score = score - F.when(
        outlier_pct > 0, F.least(outlier_pct * SCORE_OUTLIER_FACTOR, F.lit(SCORE_OUTLIER_CAP))
    ).otherwise(F.lit(0.0))
    score = score + F.when(
        (unique_ratio > SCORE_BONUS_LOW) & (unique_ratio < SCORE_BONUS_HIGH), F.lit(SCORE_BONUS)
    ).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), rnd(score, PCT_PLACES)))


def band(score: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    out = None
    for threshold, label in bands:
        out = F.when(score >= threshold, label) if out is None else out.when(score >= threshold, label)
    return out.otherwise(otherwise)


def status_band(score: Column) -> Column:
    return band(score, STATUS_BANDS, STATUS_ELSE)


def verdict_band(score: Column) -> Column:
    return band(score, VERDICT_BANDS, VERDICT_ELSE)


def entropy_term(cnt: Column, n_rows: Column) -> Column:
    """-p*log2(p + eps) for one category of ``cnt`` rows out of ``n_rows``."""
    p = cnt.cast("double") / n_rows
    return -p * F.log2(p + F.lit(ENTROPY_EPS))


def is_id_like(name: Column) -> Column:
    return name.rlike(ID_NAME_PATTERN)


def type_class(dt: T.DataType) -> str:
    """Storage class of a Spark type used by the profile rules."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "nested"
    if isinstance(dt, T.BinaryType):
        return "binary"
    return "other"


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def as_text(col: Column, dt: T.DataType) -> Column:
    """Display / grouping text of a value: nested values as JSON, binary as hex."""
    cls = type_class(dt)
    if cls == "nested":
        return F.to_json(col) if not isinstance(dt, T.VariantType) else col.cast("string")
    if cls == "binary":
        return F.hex(col)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return nan_to_null(col).cast("string")
    if isinstance(dt, T.BooleanType):
        # Python's spelling, as the reference shows values with str().
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    return col.cast("string")


def fixed_width(dt: T.DataType) -> int | None:
    """Bytes per non-null value for fixed-width types (logical size, T15)."""
    widths = {
        T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
        T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
    }
    for k, w in widths.items():
        if isinstance(dt, k):
            return w
    if isinstance(dt, T.DecimalType):
        return 16 if dt.precision > 18 else 8
    return None
