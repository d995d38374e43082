"""Streaming dynamics (E3): daily aggregates over an append-only stream.

State is one row a day, whatever the number of events, so days are never
closed and late rows count: there is no watermark. Each micro-batch's updated
days are appended to a table under the checkpoint folder, and the latest
version of each day is read back, so a restart resumes from the streaming
checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir


def dynamics_stream_query(stream: DataFrame, ts: str, value: str):
    """The streaming aggregate: ``day -> events, value_sum, value_max``; rows without a time are left out."""
    s = stream.withColumn("day", F.date_format(F.col(ts).cast("timestamp_ntz"), "yyyy-MM-dd")).where("day IS NOT NULL")
    return s.groupBy("day").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col(value).cast("double")).alias("value_sum"),
        F.max(F.col(value).cast("double")).alias("value_max"),
    )


def run_dynamics_stream(spark: SparkSession, source_dir: str, schema, ts: str, value: str,
                        out_dir: str | None = None, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over Parquet files in ``source_dir`` until all available data
    is processed; return the final per-day table (``day, events, value_sum, value_max``)."""
    root = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/dynamics-stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    agg = dynamics_stream_query(reader.parquet(source_dir), ts, value)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.select("day", "events", "value_sum", "value_max", F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(f"{root}/updates")

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    updates = spark.read.parquet(f"{root}/updates")
    latest = Window.partitionBy("day").orderBy(F.desc("batch_id"))
    return updates.withColumn("_r", F.row_number().over(latest)).where("_r = 1").select(
        "day", "events", "value_sum", "value_max"
    )
