"""Chat, feedback and ticket logs (L1-L5) as append-only tables.

The reference rewrites whole JSON documents per change; here logs are rows
(``conv_id, turn, role, text`` for chats) and intake is a validating
projection whose output is appended with ``write.mode("append")``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

# Roles shown to users, title length, accepted feedback kinds.
CHAT_ROLES = ["user", "assistant"]
TITLE_CHARS = 40
FEEDBACK_KINDS = ["like", "dislike"]
# Python's str.strip()/splitlines() whitespace and line breaks.
_WS = r"[\s\u0085\u00a0\u2028\u2029\u001c\u001d\u001e\u001f]"
_LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def _blank_to_null(c: Column) -> Column:
    s = _strip(c)
    return F.when(s == "", F.lit(None)).otherwise(s)


def chat_summaries(conversations: DataFrame, source_id: str | None = None) -> DataFrame:
    """L1/L2: per conversation: ``conv_id, title, messages_count, turns, last_turn, created_at, updated_at``.

    ``messages_count`` counts user and assistant turns; ``title`` is the first
    line of the first user message, 40 characters, after trimming. Times are
    the first and last ``created_at`` of the turns (null without that column).
    ``source_id`` keeps the chats of one source. Newest update first.
    """
    if source_id is not None:
        conversations = conversations.where(F.col("source_id") == source_id)
    time = F.col("created_at") if "created_at" in conversations.columns else F.lit(None).cast("timestamp")
    first_user = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    agg = conversations.groupBy("conv_id").agg(
        F.count(F.when(F.col("role").isin(CHAT_ROLES), F.lit(1))).alias("messages_count"),
        first_user.alias("_first"),
        F.count(F.lit(1)).alias("turns"),
        F.max("turn").alias("last_turn"),
        F.min(time).alias("created_at"),
        F.max(time).alias("updated_at"),
    )
    first_line = F.split(_strip(F.col("_first.text")), _LINE_BREAK, 2).getItem(0)
    title = F.substring(first_line, 1, TITLE_CHARS)
    return agg.select(
        "conv_id",
        F.when(title != "", title).alias("title"),
        "messages_count",
        "turns",
        "last_turn",
        "created_at",
        "updated_at",
    ).orderBy(F.desc_nulls_last("updated_at"), "conv_id")


def chat_transcript(conversations: DataFrame) -> DataFrame:
    """L3: displayable turns only (user / assistant with non-blank text)."""
    return conversations.where(
        F.col("role").isin(CHAT_ROLES) & F.col("text").isNotNull() & (_strip(F.col("text")) != "")
    ).select("conv_id", "turn", "role", "text")


def _stamped(df: DataFrame, source_id: str | None) -> DataFrame:
    """Adds ``source_id`` and ``created_at`` where they are missing, and an ``id`` made of the row's
    values, so that the row written and the row read again are the same."""
    given = F.lit(source_id).cast("string")
    df = df.withColumn("source_id", F.coalesce(F.col("source_id"), given) if "source_id" in df.columns else given)
    now = F.current_timestamp()
    df = df.withColumn("created_at", F.coalesce(F.col("created_at").cast("timestamp"), now) if "created_at" in df.columns else now)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    return _told_apart(df.withColumn("_row", F.sha2(row, 256))).withColumn("id", F.sha2(F.concat_ws("-", "_row", "_twin"), 256)).drop("_row", "_twin")


def _told_apart(df: DataFrame) -> DataFrame:
    """``df`` (with ``_row``, a digest) with ``_twin``: equal rows are numbered from 1 without gaps.

    The rows are written with the number of the partition that read them. Each
    partition numbers its own equal rows; those it shares with other partitions
    start after the sum of their counts before it. So rows that are all equal
    are numbered by all tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = rows.groupBy("_row", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_row").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_row", "_part", F.sum("_n").over(before).alias("_start")).where(F.col("_start").isNotNull())
    own = F.row_number().over(Window.partitionBy("_row", "_part").orderBy("_row"))
    numbered = rows.withColumn("_own", own).join(starts, ["_row", "_part"], "left")
    return numbered.withColumn("_twin", (F.col("_own") + F.coalesce("_start", F.lit(0))).cast("string")).drop("_part", "_own", "_start")


def clean_feedback(raw: DataFrame, source_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L4: ``(accepted, rejected)``. Kind is trimmed and lower-cased and must be
    like/dislike; blank texts become null; accepted rows get an id, ``created_at``
    and ``source_id``."""
    kind = F.lower(_strip(F.coalesce(F.col("feedback"), F.lit(""))))
    staged = raw.withColumn("feedback", kind)
    for c in ("comment", "user_message", "assistant_message"):
        if c in raw.columns:
            staged = staged.withColumn(c, _blank_to_null(F.col(c)))
    ok = F.col("feedback").isin(FEEDBACK_KINDS)
    accepted = _stamped(staged.where(ok), source_id)
    rejected = staged.where(~ok).withColumn("reason", F.lit("feedback must be 'like' or 'dislike'"))
    return accepted, rejected


def clean_tickets(raw: DataFrame, source_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``. Subject and description are required after
    trimming; email is optional (blank to null); accepted rows are stamped as in L4."""
    staged = raw.withColumn("subject", _strip(F.coalesce(F.col("subject"), F.lit("")))).withColumn(
        "description", _strip(F.coalesce(F.col("description"), F.lit("")))
    )
    if "email" in raw.columns:
        staged = staged.withColumn("email", _blank_to_null(F.col("email")))
    reason = F.when(F.col("subject") == "", "subject is required").when(
        F.col("description") == "", "description is required"
    )
    accepted = _stamped(staged.where(reason.isNull()), source_id)
    rejected = staged.where(reason.isNotNull()).withColumn("reason", reason)
    return accepted, rejected


def append_log(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K3: append rows to a log table (no whole-file rewrite)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
