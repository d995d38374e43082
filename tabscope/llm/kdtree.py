"""Sharding by k-d tree partitioning (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

DIMS = ("size_dim", "source_dim", "lang_dim", "id_dim")
CELLS = 65536  # steps of a dimension
STEPS = 4096  # parts of an id range in one refinement
ROWS = 50_000  # rows that one task numbers
LOW = -(2**62)  # stands for a null id


def _cut(node_rows: DataFrame, nodes: dict[int, tuple[str, float]]) -> dict[int, tuple[str, int, int]]:
    """For each node (dimension, share of its size that goes left): (dimension, cell, id).

    Left is what is at most (cell, id). One grouped sum over cells finds the
    cell that holds the weighted median, then the ids in it are halved into
    ``STEPS`` parts until one id is left. Only one row a node reaches the driver.
    """
    coord = F.coalesce(*[F.when(F.col("node") == k, F.col(dim)) for k, (dim, _) in nodes.items()])
    share = F.coalesce(*[F.when(F.col("node") == k, F.lit(s)) for k, (_, s) in nodes.items()])
    run = Window.partitionBy("node").orderBy("part")
    all_ = Window.partitionBy("node")

    def crossing(sums: DataFrame, need: Column) -> dict[int, tuple]:
        got = sums.withColumn("upto", F.sum("w").over(run)).withColumn("need", need).where(F.col("upto") >= F.col("need"))
        got = got.groupBy("node").agg(F.min(F.struct("part", (F.col("need") - F.col("upto") + F.col("w")).alias("left"), "lo", "hi")).alias("x"))
        return {r["node"]: (r["x"]["part"], r["x"]["left"], r["x"]["lo"], r["x"]["hi"]) for r in got.collect()}

    rows = node_rows.where(F.col("node").isin(list(nodes))).withColumn("c", coord)
    ids = (F.min("id").alias("lo"), F.max("id").alias("hi"))
    found = crossing(rows.groupBy("node", F.col("c").alias("part")).agg(F.sum("size").alias("w"), *ids), F.sum("w").over(all_) * share)
    cells = {k: x[0] for k, x in found.items()}
    state = {k: x[1:] for k, x in found.items()}
    while any(lo < hi for _, lo, hi in state.values()):
        at = lambda i: F.coalesce(*[F.when(F.col("node") == k, F.lit(v[i])) for k, v in state.items()])  # noqa: E731, B023
        cell = F.coalesce(*[F.when(F.col("node") == k, F.lit(v)) for k, v in cells.items()])
        step = F.floor((at(2).cast("decimal(38,0)") - at(1)) / STEPS) + 1
        inside = rows.where((F.col("c") == cell) & F.col("id").between(at(1), at(2)))
        part = F.floor((F.col("id").cast("decimal(38,0)") - at(1)) / step).alias("part")
        state = {k: x[1:] for k, x in crossing(inside.groupBy("node", part).agg(F.sum("size").alias("w"), *ids), at(0)).items()}
    return {k: (nodes[k][0], cells[k], state[k][2]) for k in cells}


def kd_shards(docs: DataFrame, n_shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text, lang, source).

    Dimensions are the logarithm of the size, hashes of source and language,
    and the place of doc_id in its range, each in 65,536 cells. A node is split
    along its widest dimension, widths taken as parts of what the whole table
    spans in that dimension (ties in the order above), at the weighted median of
    (cell, doc_id): the left side gets its number of leaves' share of the bytes,
    so leaf sizes differ by about one document a level and a hot source or a
    large group of equal texts is split by doc_id. With ``target_bytes`` the
    number of leaves is the total over it, rounded up.

    Size is the UTF-8 bytes of the text plus 1 (null text: 1, crc 0). Null
    source, language or doc_id count as a value of their own. Rows with one
    doc_id stay together. An empty table gives an empty result; fewer
    documents than shards leave some shards empty. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    code = lambda c: F.floor(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).cast("binary")) / (2**32 // CELLS))
    meta = checkpoint(
        docs.select(
            "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), code("source").alias("source_dim"), code("lang").alias("lang_dim"),
        ).withColumn("size_dim", F.least(F.floor(F.log2("size") * 2048), F.lit(CELLS - 1)))
    )
    lo, hi, total, n = meta.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    meta = meta.withColumn("id_dim", F.coalesce(F.floor((F.col("doc_id").cast("decimal(38,0)") - lo) * CELLS / (hi - lo + 1)), F.lit(0)).cast("long"))
    if target_bytes:
        n_shards = max(1, -(-(total or 0) // target_bytes))
    whole = meta.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).first()
    node: Column = F.lit(0)
    leaves = {0: n_shards}  # node -> leaves below it
    first = {0: 0}  # node -> its first shard
    while any(x > 1 for x in leaves.values()):
        placed = meta.withColumn("node", node)
        open_ = [k for k, x in leaves.items() if x > 1]
        spans = placed.where(F.col("node").isin(open_)).groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()
        widest = {r["node"]: max(DIMS, key=lambda d: (r[d] / max(1, whole[d]), -DIMS.index(d))) for r in spans}  # noqa: B023
        cuts = _cut(placed, {k: (d, (leaves[k] // 2) / leaves[k]) for k, d in widest.items()}) if widest else {}
        nxt, start, goes = {}, {}, []
        for k, x in leaves.items():
            if x == 1 or k not in cuts:
                nxt[2 * k + 1], start[2 * k + 1] = (1, first[k])
                right = F.lit(2 * k + 1)
            else:
                dim, cell, at = cuts[k]
                left = (F.col(dim) < cell) | ((F.col(dim) == cell) & (F.col("id") <= at))
                nxt[2 * k + 1], start[2 * k + 1] = x // 2, first[k]
                nxt[2 * k + 2], start[2 * k + 2] = x - x // 2, first[k] + x // 2
                right = F.when(left, F.lit(2 * k + 1)).otherwise(F.lit(2 * k + 2))
            goes.append(F.when(F.col("node") == k, right))
        meta = checkpoint(placed.withColumn("node", F.coalesce(*goes)))
        node, leaves, first = F.col("node"), nxt, start
    shard = F.coalesce(*[F.when(F.col("node") == k, F.lit(s)) for k, s in first.items()])
    rows = meta.withColumn("node", node).withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n // ROWS + 1)))
    counts = rows.groupBy("shard", "bucket").count()
    before = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32"))
    return rows.withColumn("own", own).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("own") - 1 + F.col("before")).alias("slot")
    )
