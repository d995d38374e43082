"""Near-duplicate embeddings by an inverted multi-index and multi-sequence traversal."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, connected_components, ranges
from .near_pairs import FOUND, coded, compared, filter_basis, packed, record, unpacked
from .vectors import dimension, distances, k_means, prepared, sample, unit

SAMPLE_ROWS = 4_096  # rows that fit the codebooks,
CENTROID_ROWS, MOST_SAMPLE_ROWS = 32, 65_536  # or as many a centroid, up to this bound
VISITS = 1 << 22  # cells that a slice of rows may visit at a time
CELL_ROWS = 1 << 18  # wanted rows of a cell, of all labels
CHUNK_ROWS, LEAST_CHUNK_ROWS = 3 << 17, 1 << 14  # rows of a label compared in one piece: a quarter of the largest label's between these,
CHUNK_BYTES = 72 << 20  # and what their codes and filters may take
CALL_CHUNKS = 4  # visiting chunks to a call


class Grid:
    """Two codebooks over the halves of unit vectors; their product is the grid of cells."""

    def __init__(self, vectors: np.ndarray, k: int) -> None:
        u = unit(vectors)
        self.half = u.shape[1] // 2
        self.books = [k_means(h, k) for h in self.halves(u)]
        self.gaps = [np.sqrt(distances(c, c)) for c in self.books]
        for gap in self.gaps:
            np.fill_diagonal(gap, np.inf)

    def halves(self, u: np.ndarray) -> list[np.ndarray]:
        return [u[:, : self.half], u[:, self.half :]]

    def home(self, u: np.ndarray) -> np.ndarray:
        i, j = (distances(h, c).argmin(axis=1) for h, c in zip(self.halves(u), self.books))
        return i * len(self.books[1]) + j

    def visits(self, u: np.ndarray, radius: float, target_recall: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that each row's traversal visits, nearest first.

        A row in the cell of centroid i is on the far side of every plane between
        i and another centroid, so the planes give a least distance for each
        half. Both halves' centroids are sorted by it; with each centroid of the first
        half the second half's sequence is walked until the sum passes ``radius``
        squared, so cells beyond it are never looked at. ``target_recall`` below 1
        cuts the radius to that of a random direction, of which only a part, normal with
        deviation radius / sqrt(dimensions), points across the planes. At 1, every
        direction counts. A pair is looked for once, from the row whose home comes
        first in the grid.
        """
        if target_recall < 1:
            radius *= min(1.0, NormalDist().inv_cdf((1 + target_recall) / 2) / math.sqrt(u.shape[1]))
        found = [distances(h, c) for h, c in zip(self.halves(u), self.books)]
        least = []
        for d, gap in zip(found, self.gaps):
            low = np.zeros_like(d)
            for k in range(len(gap)):
                np.maximum(low, (d - d[:, k : k + 1]) / (2 * np.maximum(gap[k], 1e-12)), out=low)
            least.append(low * low)
        n, k = least[1].shape
        turn = np.argsort(least[1], axis=1, kind="stable")
        # One sorted array of all rows' sequences: least distances of unit vectors stay below 8.
        base = 8.0 * np.arange(n)[:, None]
        sequence = (base + np.take_along_axis(least[1], turn, axis=1)).ravel()
        left = np.clip(radius**2 + 1e-9 - least[0], -1.0, 7.0)
        steps = np.searchsorted(sequence, (base + left).ravel(), "right") - np.repeat(np.arange(n) * k, least[0].shape[1])
        steps[left.ravel() < 0] = 0
        first = np.repeat(np.arange(len(steps)), steps)
        row, i = first // least[0].shape[1], first % least[0].shape[1]
        j = turn[row, ranges(np.zeros(len(steps), np.int64), steps)]
        cell = i * k + j
        later = cell >= self.home(u)[row]
        row, i, j, cell = row[later], i[later], j[later], cell[later]
        order = np.lexsort((least[0][row, i] + least[1][row, j], row))
        return row[order], cell[order]


def cut(sizes: np.ndarray, chunk_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows before, first chunk, chunks) of each cell of a label, and the rows of a chunk: chunks are equal parts of the cells in order."""
    n = int(sizes.sum())
    rows = -(-n // -(-n // chunk_rows))
    before = np.cumsum(sizes) - sizes
    first = np.minimum(before, n - 1) // rows
    return before, first, np.maximum(before + sizes - 1, before).clip(max=n - 1) // rows - first + 1, rows


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, target_recall: float = 1.0) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine, in
    double precision, is at least ``threshold``. Equal vectors of a label are
    counted first and stand for one. Each of these has a home cell in a product
    grid of two codebooks (fitted on 4,096 rows, or 32 a centroid up to 65,536; sqrt(n / 262,144)
    centroids each). The cells of a label, in grid order, are cut into equal chunks of a bounded number of
    rows, inside a cell by hash; a label that fits has one. A row visits, nearest first, the cells that can hold a link, all of them at the
    default ``target_recall`` of 1; less cuts the radius, trusting that links point
    in random directions. It is sent once to each later chunk with such a cell, as one byte a
    component with an error bound. A chunk compares its rows and its visitors (``near_pairs``) and
    returns link counts and a spanning forest, never all pairs. Rows of pairs so close to the
    threshold that the bytes can't tell are sent again, with their vectors, to the same chunks.

    n_links counts other rows; component_id is the smallest vec_id reachable,
    the row's own without links; kept marks that row. Rows with a null label or
    id, or a vector that is null, zero, of another length than most, or holds
    null or non-finite components link with nothing (a null id gives a null
    component and is not kept). Repeated rows count each. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    dim = dimension(rows, "embedding")
    kind = vectors.schema["embedding"].dataType
    dtype = np.dtype(np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in b.column("vec").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], ["id", "label", "vec", "key"])

    usable = prepared(rows.where("label IS NOT NULL"), dim, dtype).mapInArrow(digested, "id long, label long, vec binary, key binary")
    copies = usable.groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.any_value("vec").alias("vec"))
    copies = checkpoint(copies.withColumn("row", F.monotonically_increasing_id()))
    counts = checkpoint(copies.groupBy("label").count())
    n, largest = counts.agg(F.sum("count"), F.max("count")).first()
    out = vectors.select("vec_id", "label")
    if not n:
        return out.select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    k = max(4, math.ceil(math.sqrt(n / CELL_ROWS)))
    seen = sample(copies, min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, CENTROID_ROWS * k)), dtype)
    grid, basis = Grid(seen, k), filter_basis(unit(seen))
    cells = k * k
    slice_rows = max(1, min(1024, VISITS // cells))
    radius = math.sqrt(2 - 2 * threshold)
    chunk_rows = min(CHUNK_ROWS, max(LEAST_CHUNK_ROWS, largest // 4), max(1, CHUNK_BYTES // (dim + 128)))
    many = counts.where(F.col("count") > chunk_rows).select("label")
    vectors_of = lambda b: unpacked(b.column("vec"), dtype, dim).reshape(b.num_rows, dim).astype(np.float64)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                part = b.slice(at, slice_rows)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(grid.home(unit(vectors_of(part))), pa.int32())], ["label", "cell"])

    sizes: dict[int, np.ndarray] = {}
    for r in copies.select("label", "vec").join(F.broadcast(many), "label", "leftsemi").select("label", "vec").mapInArrow(homes, "label long, cell int").groupBy("label", "cell").count().collect():
        sizes.setdefault(r["label"], np.zeros(cells, np.int64))[r["cell"]] = r["count"]
    large = np.array(sorted(sizes), np.int64)
    plan = [cut(sizes[label], chunk_rows) for label in large.tolist()]
    before, first, span = (np.array([p[x] for p in plan], np.int64).reshape(len(plan), cells) for x in range(3))
    held, each = np.array([sizes[label] for label in large.tolist()], np.int64).reshape(len(plan), cells), np.array([p[3] for p in plan], np.int64)
    wide = int((first + span).max()) if len(plan) else 1

    def spread(row: np.ndarray, over: np.ndarray) -> np.ndarray:
        return ((row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % over

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                part = b.slice(at, slice_rows)
                x, rows = vectors_of(part), np.zeros(part.num_rows, record(dim))
                rows["code"], rows["scale"], rows["err"] = coded(x)
                for c in ("row", "id", "m"):
                    rows[c] = part.column(c).to_numpy()
                label = part.column("label").to_numpy()
                own, guest, there = np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(large):
                    of = np.minimum(np.searchsorted(large, label), len(large) - 1)
                    some = np.flatnonzero(large[of] == label)
                    of, u = of[some], unit(x[some])
                    home = grid.home(u)
                    own[some] = np.minimum(before[of, home] + spread(rows["row"][some], np.maximum(1, held[of, home])), held[of].sum(axis=1) - 1) // each[of]
                    row, cell = grid.visits(u, radius, target_recall)
                    reach, width = np.zeros((len(some), wide), bool), span[of[row], cell]
                    for s in range(int(width.max(initial=0))):
                        row, cell, width = row[width > s], cell[width > s], width[width > s]
                        reach[row, first[of[row], cell] + s] = True
                    guest, there = np.nonzero(reach & (np.arange(wide) > own[some, None]))
                    guest = some[guest]
                calls = lambda chunk: np.maximum(1, -(-chunk // CALL_CHUNKS))
                mine = np.repeat(np.arange(len(x)), calls(own))
                who = np.concatenate([mine, guest])
                chunk = np.concatenate([own[mine], there])
                call = np.concatenate([ranges(np.zeros(len(x), np.int64), calls(own)), spread(rows["row"][guest], calls(there))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[who]), pa.array(chunk, pa.int32()), pa.array(call, pa.int32()), pa.array(np.arange(len(who)) >= len(mine)), packed(rows[who])],
                    ["label", "chunk", "call", "visitor", "data"],
                )

    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * int(sum(f.max() + 1 for f in first)), -(-3 * n // chunk_rows))

    def met(placed: DataFrame, vec: np.dtype | None) -> DataFrame:
        by = ["label", "chunk", "call"]
        return checkpoint(
            placed.repartition(parts, *by).sortWithinPartitions(*by, "visitor").mapInArrow(lambda batches: compared(batches, threshold, basis, vec), FOUND)
        )

    found = met(copies.mapInArrow(sent, "label long, chunk int, call int, visitor boolean, data binary"), None)
    close = found.where("row IS NOT NULL").select("row", "label", "chunk", "call", "visitor")
    if not close.isEmpty():
        again = met(close.join(copies.select("row", "id", "m", "vec"), "row"), dtype)
        found = found.where("row IS NULL").union(again)
    counted = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    tied = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    stats = (
        copies.drop("vec").join(counted, "id", "left").join(tied, F.col("id") == F.col("node"), "left")
        .where("m > 1 OR links IS NOT NULL OR component IS NOT NULL")  # the others keep their own id and have no links
        .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = usable.select("id", "label", "key").join(checkpoint(stats), ["label", "key"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return out.join(linked, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
