"""Records of large CSV files whose cells hold line breaks, read by many tasks.

Spark splits a file only where every line is a record. Here each split's lines
are read on their own and the quotes decide afterwards which lines belong together:

1. every line is a function of the state before it (outside or inside a quoted
   cell); each task carries both cases through its split and writes chunks of
   lines, with the state at the chunk's start and end in either case;
2. one row a split (its end states, its last chunk where a record starts) is chained
   along the file by running sums, which settles the state that each split begins in;
3. with its state known, each chunk is cut into records; only records that cross
   a chunk's bounds are shuffled, by the chunk that they start in.

The chunks are written to the checkpoint folder first: split bounds may differ
between two scans when the number of executors changes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.operators.quantiles import scratch_path

# A quoted cell starts right after a comma or the line's start; a quote elsewhere
# in an unquoted cell is text, and so is all between a closing quote and the next comma.
_REST_OF_CELL = rb"[^,]*+"
_QUOTED = rb'(?:[^"]++|"")*+'
_OPENS = re.compile(rb'(?:(?:"' + _QUOTED + rb'"' + _REST_OF_CELL + rb'|[^",]' + _REST_OF_CELL + rb'|),)*+"' + _QUOTED + rb"\Z")
_CLOSES = re.compile(_QUOTED + rb'"' + _REST_OF_CELL + rb"(,|\Z)")

# Text of one chunk; a longer line is a chunk of its own.
CHUNK_BYTES = 1 << 20
_BLANK = b" \t\r"

CHUNK = ("file string, block long, chunk long, in0 boolean, in1 boolean, end0 boolean, end1 boolean, "
         "from0 long, from1 long, last0 long, last1 long, blank boolean, text binary")
PIECE = "owner long, block long, chunk long, whole boolean, header boolean, record string"


def line_function(line: bytes) -> tuple[bool, bool]:
    """Whether a quoted cell is open after ``line``, for a line that begins outside and one that begins inside."""
    outside = _OPENS.match(line) is not None
    closed = _CLOSES.match(line)
    if closed is None:
        return outside, True
    return outside, closed.group(1) == b"," and _OPENS.match(line[closed.end():]) is not None


def _chunks(batches):
    """The lines of each split in file order as rows of ``CHUNK``, both cases carried along.

    ``from`` is the split's last chunk before this one where a record starts, ``last`` counts this one too (-1: none).
    """
    split, state, last = None, (False, True), (-1, -1)
    for batch in batches:
        out = []
        held, size, first = [], 0, None
        files, blocks, ids, raws = (batch.column(c) for c in ("file", "block", "line", "raw"))
        for i in range(batch.num_rows):
            here = (files[i].as_py(), blocks[i].as_py())
            line = raws[i].as_py()
            if held and (here != split or size + len(line) > CHUNK_BYTES):
                row, state, last = _chunk(split, first, held, state, last)
                out.append(row)
                held, size = [], 0
            if here != split:
                split, state, last = here, (False, True), (-1, -1)
            if not held:
                first = ids[i].as_py()
            held.append(line)
            size += len(line) + 1
        if held:
            row, state, last = _chunk(split, first, held, state, last)
            out.append(row)
        if out:
            yield _batch(out, CHUNK)


def _chunk(split, number, lines, state, last):
    start, ends, begun = state, [*state], [*last]
    for line in lines:
        for case in (0, 1):
            if not ends[case]:
                begun[case] = number
        if b'"' in line:
            f = line_function(line)
            ends = [f[ends[0]], f[ends[1]]]
    row = (*split, number, *start, *ends, *last, *begun, not any(v.strip(_BLANK) for v in lines), b"\n".join(lines))
    return row, tuple(ends), tuple(begun)


def _batch(rows, ddl: str):
    names = [c.split() for c in ddl.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], names=[n for n, _ in names])


def _records(batches):
    """Chunks of known state cut into whole records and parts of records that cross their bounds (``PIECE``)."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            out, held, owner, inside = [], [], r["owner"] if r["inside"] else r["chunk"], r["inside"]
            crossed, header = inside, r["header"]
            for line in r["text"].split(b"\n"):
                held.append(line)
                if b'"' in line:
                    inside = line_function(line)[inside]
                if inside:
                    continue
                if crossed or len(held) > 1 or line.strip(_BLANK):
                    out.append((owner, r["block"], r["chunk"], not crossed, header and not crossed, _text(held, True)))
                    header = header and crossed
                held, crossed, owner = [], False, r["chunk"]
            if held:
                # A later part of this record follows in another chunk.
                out.append((owner, r["block"], r["chunk"], False, header and not crossed, _text(held, False)))
            if out:
                yield _batch(out, PIECE)


def _text(lines: list[bytes], ended: bool) -> str:
    text = b"\n".join(lines)
    return (text.removesuffix(b"\r") if ended else text).decode("utf-8", "replace")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of every record but each file's header and blank lines, without its line end.

    Records end with ``\\n`` or ``\\r\\n`` outside quotes; breaks inside quoted cells are
    kept as they are. A quoted cell that is never closed runs to the end of its file.
    A record must fit into a task, nothing else grows with the file. Rows come in no set order.
    """
    value = F.col("value")
    block = F.col("_metadata.file_block_start")
    mark = "\ufeff"
    text = F.when((block == 0) & value.startswith(mark), value.substr(F.lit(2), F.length(value))).otherwise(value)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("line"),
        text.cast("binary").alias("raw"))
    written = scratch_path(spark, "csv-chunks")
    lines.mapInArrow(_chunks, CHUNK).write.option("compression", "zstd").parquet(written)
    chunks = spark.read.schema(CHUNK).parquet(written)

    splits = chunks.groupBy("file", "block").agg(
        F.max_by(F.struct("end0", "end1", "last0", "last1"), "chunk").alias("e"),
        F.min(F.when(~F.col("blank"), F.col("chunk"))).alias("first"))
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("e.end0") & ~F.col("e.end1")).cast("int")
    settles = F.col("e.end0") == F.col("e.end1")
    splits = splits.withColumn("turns", F.sum(swaps).over(along)).withColumn(
        "known", F.last(F.when(settles, F.struct(F.col("e.end0").cast("int").alias("state"), "turns")), ignorenulls=True).over(earlier))
    inside = (F.coalesce(F.col("known.state"), F.lit(0)) + F.col("turns") - swaps - F.coalesce(F.col("known.turns"), F.lit(0))) % 2 == 1
    last = F.when(F.col("inside"), F.col("e.last1")).otherwise(F.col("e.last0"))
    whole_file = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    splits = splits.withColumn("inside", inside).select(
        "file", "block", F.col("inside").alias("begins"), F.last(F.when(last >= 0, last), ignorenulls=True).over(earlier).alias("carried"),
        F.first("first", ignorenulls=True).over(whole_file).alias("top"))
    chained = scratch_path(spark, "csv-splits")
    splits.write.parquet(chained)
    splits = spark.read.schema("file string, block long, begins boolean, carried long, top long").parquet(chained)

    before = F.when(F.col("begins"), F.col("from1")).otherwise(F.col("from0"))
    placed = chunks.join(splits, ["file", "block"]).select(
        "block", "chunk", F.when(F.col("begins"), F.col("in1")).otherwise(F.col("in0")).alias("inside"),
        F.when(before >= 0, before).otherwise(F.col("carried")).alias("owner"),
        F.coalesce(F.col("chunk") == F.col("top"), F.lit(False)).alias("header"), "text")
    cut = scratch_path(spark, "csv-records")
    placed.mapInArrow(_records, PIECE).write.option("compression", "zstd").parquet(cut)
    pieces = spark.read.schema(PIECE).parquet(cut)
    # The conditions are part of the value, so a filter that Spark moves below them never sees a header or a part of a record.
    whole = pieces.select(F.when(F.col("whole") & ~F.col("header"), F.col("record")).alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("block", "chunk", "record")))
    crossing = pieces.where("NOT whole").groupBy("owner").agg(F.max("header").alias("header"), parts.alias("p")).select(
        F.when(~F.col("header"), F.array_join(F.col("p.record"), "\n")).alias("record"))
    return whole.unionByName(crossing).where("record IS NOT NULL")
