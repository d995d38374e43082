"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Sampling order of a source: this many bins are summed before rows are compared one by one.
BINS = 65536


def water_fill(sources: DataFrame, max_epochs: int, share: float = 1.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    The total, ``share`` of all sizes, is shared by weight. Sources whose
    share passes ``max_epochs`` times their size are clamped there and the rest
    is shared again among the others, until none is above. Each round is one
    grouped sum; if every source is clamped the targets stay below the total.
    """
    sources = checkpoint(sources.withColumn("cap", F.col("source_size") * max_epochs))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        n, caps, weight = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (total - (caps or 0)) / weight
    if level is None:
        return sources.withColumn("target", F.lit(0.0)).drop("cap")
    over = F.col("cap") <= F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(over, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("cap")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs`` (doc_id, text, source).

    Size is the number of words of the whole text. Sources in code point order
    take the weights in turn. Every document is taken ``floor(target / source
    size)`` times; the rest is a seeded sample of whole documents: in the order
    of a hash of seed and doc_id, each document whose middle lies below the
    wanted number of words is taken once more.

    Null or empty texts have size 0 and null sources form one source, the last.
    A null doc_id hashes as the empty text. Rows that repeat a doc_id count
    each and are sampled in the order of their size. An empty table gives an
    empty result. Other columns are ignored.
    """
    sized = checkpoint(docs.select("doc_id", "source", _size().alias("size"), _order(seed).alias("h")))
    copies = F.col("copies")
    return _with_copies(sized, F.col("size"), weights, max_epochs, ["doc_id", "size"]).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * copies).cast("long").alias("taken")
    )


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _order(seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _with_copies(sized: DataFrame, size: Column, weights: tuple[int, ...], max_epochs: int, ties: list[str | Column]) -> DataFrame:
    """``sized`` (source, h, and what ``size`` and ``ties`` name) with source_size, target and copies."""
    bins = checkpoint(sized.groupBy("source", F.floor(F.col("h") / (2**32 // BINS)).alias("bin")).agg(F.sum(size).alias("bin_size")))
    sums = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    ranked = numbered(sums, F.col("source").asc_nulls_last(), name="i")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    sources = checkpoint(
        water_fill(ranked.select("source", "source_size", weight.alias("weight")), max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "s")
    )
    own = F.col("source").eqNullSafe(F.col("s"))
    before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")
    crossing = (
        bins.withColumn("before", before).join(sources, own)
        .groupBy("s").agg(F.max(F.when(F.col("before") <= F.col("rest"), F.struct("bin", "before"))).alias("cut"))
        .select("s", "cut.bin", "cut.before")
    )
    params = checkpoint(sources.withColumnRenamed("s", "source").join(crossing, F.col("source").eqNullSafe(F.col("s"))).drop("source"))
    rows = sized.join(params, own).withColumn("own_bin", F.floor(F.col("h") / (2**32 // BINS)))
    edge = rows.where("own_bin = bin")
    middle = F.col("before") + F.sum(size).over(Window.partitionBy("source").orderBy("h", *ties).rowsBetween(Window.unboundedPreceding, 0)) - size / 2
    edge = edge.withColumn("extra", (middle <= F.col("rest")).cast("long"))
    rest = rows.where("own_bin <> bin").withColumn("extra", (F.col("own_bin") < F.col("bin")).cast("long"))
    copies = F.col("whole") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0)
    return rest.unionByName(edge).withColumn("copies", copies.cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as ``mix_sources`` takes it.

    Copies are counted for the row itself, so rows that repeat a doc_id, or have
    none, keep their own; among rows of equal doc_id and size the digest of the
    text decides.
    """
    rows = docs.select("doc_id", "source", "text", _order(seed).alias("h"), F.struct("*").alias("row"))
    plan = _with_copies(rows, _size(), weights, max_epochs, ["doc_id", _size(), F.md5("text")]).where("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
