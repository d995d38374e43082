"""WARC volumes and their fixity audit by Merkle trees."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, shard_of, shards_for, small_side

VOLUME_BYTES = 8 << 20
FANOUT, HEIGHT = 16, 5
#: Fixed words of the file format.
VERSION = b"WARC/1.0\r\n"
DATE = "2000-01-01T00:00:00Z"
ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:([^>\r\n]*)>")
LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")


def write_warc(pages: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> str:
    """Writes ``pages`` (page_id, url, html) as gzip WARC volumes below ``path`` and returns it.

    The volume is a hash of page_id, so one site or a group of equal pages is
    spread; its records lie in the order of page_id. The records of a page_id (or
    of none) that holds over half of ``volume_bytes`` are spread by a hash of the
    record too, equal ones in chunks of copies, so no id fills a volume by itself.
    Spark's text writer makes the files: a record ends with the line break that
    the writer adds. Null url or html count as empty, null page_id as the word
    null; repeated rows are records each; an empty table writes no volume. Other
    columns are ignored.
    """
    text = lambda c, empty: F.coalesce(F.col(c).cast("string"), F.lit(empty))
    rows = pages.select(F.col("page_id").alias("id"), F.regexp_replace(text("url", ""), r"[\r\n]", " ").alias("uri"), text("html", "").alias("body"))
    size = F.octet_length("body") + F.octet_length("uri") + 200
    sizes = checkpoint(rows.groupBy("id").agg(F.sum(size).alias("bytes")).groupBy((F.col("bytes") > volume_bytes // 2).alias("hot"), F.when(F.col("bytes") > volume_bytes // 2, F.col("id")).alias("hot_id")).agg(F.sum("bytes").alias("bytes")))
    n = shards_for(sizes.agg(F.sum("bytes")).first()[0] or 0, volume_bytes)
    hot, key = sizes.where("hot").select("hot_id"), F.coalesce(F.col("id").cast("long"), F.lit(-1))
    placed, spread = rows.withColumn("copies", F.lit(1).cast("long")), not hot.isEmpty()
    if not spread:
        placed = placed.withColumn("volume", shard_of(key, n))
    else:
        same, hot = F.col("id").eqNullSafe(F.col("hot_id")), small_side(hot)
        cold = placed.join(hot, same, "left_anti").withColumn("volume", shard_of(key, n))
        equal = rows.join(hot, same, "left_semi").groupBy("id", "uri", "body").agg(F.count("*").alias("n"))
        chunk = F.greatest(F.floor(F.lit(volume_bytes // 8) / size), F.lit(1))  # copies that lie together
        dealt = equal.withColumn("chunk", chunk).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("chunk")))))
        copies = F.least(F.col("chunk"), F.col("n") - F.col("i") * F.col("chunk"))
        placed = cold.unionByName(dealt.select("id", "uri", "body", copies.alias("copies"), F.pmod(F.xxhash64(key, "uri", "body", "i"), F.lit(n)).cast("int").alias("volume")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text("id", "null"), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"),
    )
    lines = placed.select("id", F.concat(head, "body", F.lit("\r\n\r")).alias("value"), "volume", "copies")
    lines = lines.repartition(n, "volume").sortWithinPartitions("volume", "id", "value")
    if spread:
        lines = lines.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    lines.select("volume", "value").write.partitionBy("volume").option("compression", "gzip").text(path)
    return path


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(volume, content) of the gzip files below ``path``; empty if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "volume" not in files.columns:
        return spark.createDataFrame([], "volume int, content binary")
    return files.select(F.col("volume").cast("int").alias("volume"), "content")


def copy_warc(spark: SparkSession, source: str, path: str, change: Callable[[int, bytes], bytes] = lambda volume, data: data) -> str:
    """Writes the volumes of ``source`` again below ``path``, each through ``change`` (volume, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                volume = b.column("volume")[i].as_py()
                data = change(volume, gzip.decompress(b.column("content")[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([volume], pa.int32()), pa.array([data.removesuffix(b"\n")], pa.binary())], ["volume", "value"])

    out = read_volumes(spark, source).mapInArrow(run, "volume int, value binary")
    out.select("volume", F.col("value").cast("string")).write.partitionBy("volume").option("compression", "gzip").text(path)
    return path


def records(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the records of a volume, which cover all its bytes.

    Where a record doesn't end as its Content-Length says, it reaches to the
    next line that starts a record, or to the end.
    """
    out, at, n = [], 0, len(data)
    while at < n:
        head = data.find(b"\r\n\r\n", at)
        found = LENGTH.search(data, at, head + 2) if head >= 0 else None
        end = head + 8 + int(found[1]) if found else n + 1
        if not (data.startswith(VERSION, at) and end <= n and data[end - 4 : end] == b"\r\n\r\n" and (end == n or data.startswith(VERSION, end))):
            end = data.find(b"\n" + VERSION, at + 1) + 1 or n
        out.append((at, end - at))
        at = end
    return out


def tree(hashes: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(level, index, hash) of a Merkle tree of fixed height over ordered leaf hashes."""
    if len(hashes) > FANOUT**HEIGHT:
        raise ValueError("a volume holds too many records")
    out = []
    for level in range(HEIGHT + 1):
        out += [(level, i, h) for i, h in enumerate(hashes)]
        hashes = [hashlib.sha256(b"\x01" + b"".join(hashes[i : i + FANOUT])).digest() for i in range(0, len(hashes), FANOUT)]
    return out


def merkle_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(volume, level, index, hash, record_id, offset, length) of the trees of all volumes.

    Level 0 has a row a record: the SHA-256 of its bytes with its offset range.
    Each node above hashes the ordered hashes of up to 16 below it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = gzip.decompress(b.column("content")[i].as_py())
                own = records(data)
                nodes = tree([hashlib.sha256(b"\x00" + data[o : o + n]).digest() for o, n in own])
                rest = len(nodes) - len(own)
                ids = [(m := ID.search(data, o, o + min(n, 4096))) and m[1].decode("utf-8", "replace") for o, n in own]
                level, index, digest = zip(*nodes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(nodes), b.column("volume")[i].as_py(), np.int32)), pa.array(level, pa.int32()), pa.array(index, pa.int32()), pa.array(digest, pa.binary()),
                        pa.array(ids + [None] * rest, pa.string()), pa.array([o for o, _ in own] + [None] * rest, pa.int64()), pa.array([n for _, n in own] + [None] * rest, pa.int64()),
                    ],
                    ["volume", "level", "index", "hash", "record_id", "offset", "length"],
                )

    schema = "volume int, level int, index int, hash binary, record_id string, offset long, length long"
    return read_volumes(spark, path).mapInArrow(run, schema)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume, index, status, offset, length, other_offset, other_length, record_id) of the records that differ.

    ``a`` and ``b`` are the ``merkle_nodes`` of two replicas. Roots are compared
    first; at each level only the children of differing nodes are joined, so
    equal branches are left after one comparison. Status is ``corrupt`` (same
    record id, other bytes), ``missing`` (only in a), ``extra`` (only in b) or
    ``moved`` (same bytes at another place, as after a lost record).
    """
    differing = None
    for level in range(HEIGHT, -1, -1):
        x, y = (t.where(F.col("level") == level).select("volume", "index", F.col("hash").alias(h)) for t, h in ((a, "ha"), (b, "hb")))
        if differing is not None:
            parent = differing.withColumnRenamed("index", "parent")
            x, y = (t.withColumn("parent", F.floor(F.col("index") / FANOUT)).join(parent, ["volume", "parent"], "left_semi").drop("parent") for t in (x, y))
        differing = checkpoint(x.join(y, ["volume", "index"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("volume", "index"))
    leaf = lambda t, p: t.where("level = 0").join(differing, ["volume", "index"], "left_semi").select(
        "volume", F.coalesce("record_id", F.concat(F.lit("#"), F.col("index"))).alias("record_id"), *[F.col(c).alias(f"{p}{c}") for c in ("index", "hash", "offset", "length")]
    ).withColumn("copy", F.row_number().over(Window.partitionBy("volume", "record_id").orderBy(f"{p}index")))
    both = leaf(a, "a_").join(leaf(b, "b_"), ["volume", "record_id", "copy"], "full")
    status = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").when(F.col("a_hash") == F.col("b_hash"), "moved").otherwise("corrupt")
    return both.select(
        "volume", F.coalesce("a_index", "b_index").alias("index"), status.alias("status"), F.col("a_offset").alias("offset"), F.col("a_length").alias("length"),
        F.col("b_offset").alias("other_offset"), F.col("b_length").alias("other_length"), "record_id",
    )


def audited(spark: SparkSession, path: str, other: str) -> DataFrame:
    """(record_id, volume, offset, length, sha256, status) of every record of ``path``, audited against ``other``.

    Status is ``ok`` or that of ``audit``; records only in ``other`` follow
    with their place there.
    """
    a, b = checkpoint(merkle_nodes(spark, path)), checkpoint(merkle_nodes(spark, other))
    found = checkpoint(audit(a, b))
    leaves = a.where("level = 0").select("record_id", "volume", "index", "offset", "length", F.hex("hash").alias("sha256"))
    known = leaves.join(found.where("status <> 'extra'").select("volume", "offset", "status"), ["volume", "offset"], "left")
    extra = found.where("status = 'extra'").select("record_id", "volume", F.col("other_offset").alias("offset"), F.col("other_length").alias("length"), F.lit(None).cast("string").alias("sha256"), "status")
    return known.select("record_id", "volume", "offset", "length", F.lower("sha256").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status")).union(extra)


def bit_rot(volume: int, data: bytes, one_in: int = 61) -> bytes:
    """The volume with damage that depends on its bytes: in about one of ``one_in`` records a byte is changed, or lost."""
    out = bytearray()
    for o, n in records(data):
        record = bytearray(data[o : o + n])
        draw = int.from_bytes(hashlib.blake2b(bytes(record), digest_size=8).digest(), "little")
        if draw % one_in == 0:
            at = data.find(b"\r\n\r\n", o) - o + 4
            if at < n - 4:
                place = at + draw // one_in % (n - 4 - at)
                if draw >> 63:
                    del record[place]
                else:
                    record[place] ^= 0x55
        out += record
    return bytes(out)
