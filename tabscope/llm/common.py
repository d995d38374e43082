"""Helpers shared by the operators: shared-folder checkpoints, stable shards, connected components."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

SHARD_BYTES = 8 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, for files that tasks of other executors read."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shards_for(n_bytes: int, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards of about ``shard_bytes`` hold ``n_bytes``."""
    return max(1, math.ceil(n_bytes / shard_bytes))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is; ``df`` is written already."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shard_of(key: Column, n: int) -> Column:
    """A shard number that depends on the key alone, so a recomputed task gets the same rows."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def bytes_of(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes and the start of each item, plus the end of the last."""
    ends = np.cumsum([len(b) for b in lists], dtype=np.int64) if lists else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(lists), np.uint8), np.concatenate([[0], ends]).astype(np.int64)


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LONG_SPAN = 256  # bytes; longer spans are hashed by blake2b
PAD = 16
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true values."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data``, as a number."""
    return _padded_eights(np.concatenate([data, np.zeros(PAD, np.uint8)]))


def _padded_eights(data: np.ndarray) -> np.ndarray:
    """The same of an array that ends in ``PAD`` spare bytes, without a copy."""
    return np.ndarray(len(data) - PAD + 1, "<u8", data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, eight bytes at a step; no two spans of one length up to 8 share one."""
    size = (ends - starts).astype(np.int64)
    out = mixed_bits(size.astype(np.uint64) * BASE)
    eights = _eights(data)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = starts[live].astype(np.int64), size[live]
    while len(live):
        step = mixed_bits((out[live] ^ (eights[at] & LOW_BYTES[np.minimum(left, 8)])) * BASE)
        out[live] = mixed_bits(step * BASE)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def differing(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Which spans of ``data`` are not byte for byte those of ``other``, which ends in ``PAD`` spare bytes."""
    out = sizes != other_sizes
    x, y = _eights(data), _padded_eights(other)
    live = np.flatnonzero(~out & (sizes > 0) & (sizes <= LONG_SPAN))
    a, b, left = starts[live].astype(np.int64), other_starts[live].astype(np.int64), sizes[live].astype(np.int64)
    while len(live):
        wrong = (x[a] ^ y[b]) & LOW_BYTES[np.minimum(left, 8)] != 0
        out[live[wrong]] = True
        more = (left > 8) & ~wrong
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i in np.flatnonzero(~out & (sizes > LONG_SPAN)).tolist():
        out[i] = not np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[other_starts[i] : other_starts[i] + sizes[i]])
    return out


class WordCache:
    """Numbers of words, found by hash and compared byte by byte."""

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, number of each word
        self.raw, self.ends = np.zeros(1 << 16, np.uint8), np.zeros(1, np.int64)  # the words' bytes, with room at the end

    def __len__(self) -> int:
        return len(self.keys)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each span, places of the spans that are new). New words get numbers in that order.

        A span whose hash belongs to another word gets -1: such a word is never kept.
        """
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        head = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0)
        distinct = hashes[order[head]]
        slot = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(np.append(self.keys, np.uint64(0))[slot] != distinct) if len(self.keys) else np.arange(len(distinct))
        some = order[head[new]]
        if len(new):
            known = len(self.keys)
            size = (ends - starts)[some]
            used = int(self.ends[-1])
            self.ends = np.concatenate([self.ends, used + np.cumsum(size)])
            if self.ends[-1] + PAD > len(self.raw):
                self.raw = np.concatenate([self.raw[:used], np.zeros(2 * int(self.ends[-1]) - used + PAD, np.uint8)])
            self.raw[used : self.ends[-1]] = data[ranges(starts[some], size)]
            self.places = np.insert(self.places, slot[new], known + np.arange(len(new)))
            self.keys = np.insert(self.keys, slot[new], distinct[new])
        word = np.empty(len(hashes), np.int64)
        word[order] = np.repeat(self.places[np.searchsorted(self.keys, distinct)], np.diff(np.append(head, len(order))))
        if len(word):
            at, size = self.ends[:-1][word], ends - starts
            own = self.ends[1:][word] - at
            wrong = size != own
            long = np.flatnonzero(~wrong & (size > 8))  # up to 8 bytes, spans of one length and hash are equal
            wrong[long] = differing(data, starts[long], size[long], self.raw, at[long], own[long])
            word[wrong] = -1
        return word, some


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``start .. start + length - 1`` of all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        if not keep.any():
            break
        la, lb = la[keep], lb[keep]
        a, b = a[keep], b[keep]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): component is the smallest reachable node.

    Alternating large-star and small-star rounds: every round is two grouped
    minima and two joins, so a hub is summed before the shuffle and its edges
    may be split by an adaptive join; nothing is gathered per node. Each round
    is written to the checkpoint folder. Self loops and repeated edges are
    allowed; an empty input gives an empty result.
    """
    now = checkpoint(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    nodes = checkpoint(now.select(F.col("u").alias("node")).union(now.select("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpoint(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        now = checkpoint(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    lows = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(lows, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def numbered(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """``df`` with a gapless number from 0 in the given order, without one task sorting all rows.

    Rows are range partitioned and written to the checkpoint folder, which
    fixes the partition numbers; the rows of each partition are counted and
    numbered on their own, from the sum of the counts before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpoint(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").count()
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_own", own).join(starts, "_part").withColumn(name, F.col("_own") - 1 + F.col("_start")).drop("_part", "_own", "_start")
