"""Jaccard self-join of word n-gram sets by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, checkpoint, connected_components, local_components, mixed_bits, numbered, runs, shards_for, span_hashes

BUCKETS, SLICES = 1 << 21, 64  # of the table of estimated frequencies: 16 MB on the driver and in each worker
MAX_MATCHES = 4  # shared prefix tokens asked for at most
VERIFY_COST = 20  # of a candidate, in posting entries
LIST_ROWS = 16  # longer posting lists are compared as a block
HOT_ROWS = 4_096  # lists of more estimated rows are found by grouped sums
BLOCK_ROWS = 1024  # documents of a block compared at a time
TOKENS = 1 << 20  # prefix tokens of a bucket
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each).

    Words are the runs of bytes other than space and 0x09 to 0x0D of the text
    with A-Z in lower case.
    """
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts, ends = runs(~SPACE[data])
    words = span_hashes(data, starts, ends)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the ``width``-word shingles of each text; of fewer words, one for all of them."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    h = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for i in range(width):
        h = mixed_bits(h * BASE + words[i : i + len(h)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for w in words[at : at + n]:
                one = mixed_bits(one * BASE + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)).astype(np.int64) + 64
    piece = np.cumsum(size) // SLICE_BYTES
    edges = np.flatnonzero(np.diff(piece, prepend=-1)).tolist() + [batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


def token_frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Estimated document frequency of shingles: counts over ``BUCKETS`` hash buckets, from all documents.

    The order of tokens and the choice of prefixes rest on it; results don't.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in slices(b):
                found = np.concatenate(shingle_sets(part.column("text").to_pylist(), width)) % np.uint64(BUCKETS)
                np.add.at(table, found.astype(np.int64), 1)
        if table.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(table, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group["counts"])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    got = docs.select("text").mapInArrow(count, schema).groupBy("slice").applyInPandas(add, schema).collect()
    table = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in got:
        table[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return table.ravel()


def prefix(tokens: np.ndarray, frequency: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, int]:
    """(prefix of the set, matches it asks for).

    Tokens are ordered by estimated frequency, then hash. For l matches a
    prefix of n - ceil(t n) + l tokens suffices: two sets at the threshold that
    both show such a prefix share l tokens of it. The l of least cost is taken:
    the posting entries read, plus the cost of verifying at most a l-th of them.
    """
    n = len(tokens)
    free = n - int(-(-threshold * n // 1))
    f = frequency[(tokens % np.uint64(BUCKETS)).astype(np.int64)]
    order = np.lexsort((tokens, f))
    most = min(MAX_MATCHES, n - free)
    entries = np.cumsum(f[order[: free + most]])[free:]
    cost = entries * (1 + VERIFY_COST / np.arange(1, most + 1))
    matches = int(cost.argmin()) + 1
    return tokens[order[: free + matches]], matches


def _prefixes(docs: DataFrame, width: int, threshold: Fraction, frequency: np.ndarray) -> DataFrame:
    """(doc_id, n, digest, matches, tokens): the digest of the whole set, and its prefix as 64-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                picked = [prefix(s, shared.value, threshold) if len(s) else (s, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([m for _, m in picked], pa.int32()), pa.array([t.tobytes() for t, _ in picked], pa.binary()),
                    ],
                    ["doc_id", "n", "digest", "matches", "tokens"],
                )
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, matches int, tokens binary")


ENTRY = np.dtype([("token", "<u8"), ("id", "<i8"), ("n", "<i4"), ("matches", "<i2"), ("level", "<i2")])


def _entries(batch: pa.RecordBatch, threshold: Fraction) -> np.ndarray:
    """The posting entries of a batch of representatives; level l: the token is in prefixes for l matches and more."""
    tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
    sizes = np.array([len(t) for t in tokens])
    out = np.zeros(sizes.sum(), ENTRY)
    out["token"] = np.concatenate(tokens) if tokens else []
    n, matches = batch.column("n").to_numpy(), batch.column("matches").to_numpy()
    out["id"], out["n"], out["matches"] = np.repeat(batch.column("id").to_numpy(), sizes), np.repeat(n, sizes), np.repeat(matches, sizes)
    place = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out["level"] = np.maximum(1, place + 1 - np.repeat(sizes - matches, sizes))
    return out


def _columns(data: bytes) -> np.ndarray:
    """Entries from their columns, one after another."""
    out = np.empty(len(data) // ENTRY.itemsize, ENTRY)
    at = 0
    for c in ENTRY.names:
        out[c] = np.frombuffer(data, ENTRY[c], len(out), at)
        at += len(out) * ENTRY[c].itemsize
    return out


def list_pairs(entries: np.ndarray, threshold: Fraction) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """From the entries of a bucket: ((a, b, matches asked for, shared tokens), (pivot, member) of long lists).

    a < b are documents of one posting list whose sizes and prefixes allow a link.
    """
    e = entries[np.lexsort((entries["id"], entries["token"]))]
    new = np.diff(e["token"], prepend=~e["token"][:1]) != 0
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(e)))
    e_size, e_start = np.repeat(size, size), np.repeat(starts, size)
    long = e_size > LIST_ROWS
    members = (e["id"][e_start[long]], e["id"][long])
    keep = (e_size > 1) & ~long
    e, e_start, place = e[keep], e_start[keep], np.flatnonzero(keep)
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none)]
    for gap in range(1, LIST_ROWS):
        i = np.flatnonzero((e_start[gap:] == e_start[:-gap]) & (place[gap:] - place[:-gap] == gap)) if len(e) > gap else none
        x, y = e[i], e[i + gap]
        need = np.minimum(x["matches"], y["matches"])
        small, large = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
        ok = (x["level"] <= need) & (y["level"] <= need) & (small * threshold.denominator >= large * threshold.numerator) & (x["id"] != y["id"])
        found.append((x["id"][ok], y["id"][ok], need[ok].astype(np.int64), np.ones(ok.sum(), np.int64)))
    a, b, need, one = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((b, a))
    a, b, need, one = a[order], b[order], need[order], one[order]
    first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)) if len(a) else none
    return (a[first], b[first], need[first], np.add.reduceat(one, first) if len(first) else none), members


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, each on its own (null as empty)."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])


def linked(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (a, b) of all links between the two sides, or among all if there is one side.

    Intersections come from products of 0/1 matrices over the tokens that
    occur more than once, a few thousand tokens at a time.
    """
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    tokens, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = df > 1
    column, row = (np.cumsum(often) - 1)[column][often[column]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    x, y = (np.flatnonzero(sides == s) for s in (sides.min(), sides.max()))
    place = np.zeros(len(sets), np.int64)
    place[y] = np.arange(len(y))
    place[x] = np.arange(len(x))
    shared = np.zeros((len(x), len(y)), np.float32)
    one_side = sides.min() == sides.max()
    in_x = sides[row] == sides.min()
    edges = np.searchsorted(column, np.arange(0, often.sum() + 4096, 4096))
    mx = my = None
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        r, c = row[lo:hi], column[lo:hi] - k * 4096
        mx = np.zeros((len(x), 4096), np.float32)
        mx[place[r[in_x[lo:hi]]], c[in_x[lo:hi]]] = 1
        if one_side:
            my = mx
        else:
            my = np.zeros((len(y), 4096), np.float32)
            my[place[r[~in_x[lo:hi]]], c[~in_x[lo:hi]]] = 1
        shared += mx @ my.T
    del mx, my, tokens, column, row, order
    i, j = [], []
    for lo in range(0, len(x), 256):  # in exact numbers, some rows at a time
        some = shared[lo : lo + 256].astype(np.int64)
        near = np.nonzero(some * threshold.denominator >= threshold.numerator * (n[x[lo : lo + 256]][:, None] + n[y][None, :] - some))
        i.append(near[0] + lo)
        j.append(near[1])
    i, j = np.concatenate(i), np.concatenate(j)
    u, v = ids[x[i]], ids[y[j]]
    nodes = np.unique(ids)
    low = local_components(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v))
    tied = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[tied], nodes[low[tied]]


def similar_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of distinct
    ``width``-word shingles is at least ``threshold``; component_id is the
    smallest doc_id reachable over links, the own one included. A text of
    fewer words counts as one shingle; null text, or one without words, has an
    empty set and links with nothing. Rows that repeat a doc_id count as one
    document with all their links; a null doc_id links with nothing and has a
    null component. An empty table gives an empty result; other columns are
    ignored.

    Equal sets are grouped first, so copies stand as one. Each of the rest shows
    a prefix of its rarest tokens, lengthened for each document while that is
    estimated to save verifying; a pair is verified when it shares as many
    prefix tokens as the less demanding of the two asks for. Posting lists of
    over 16 documents give no pairs: their members meet under the list's
    smallest document and are compared whole, in blocks. Both go in two rounds:
    each document with its smallest candidate and list, then only what is in
    different groups still.
    """
    t = Fraction(threshold).limit_denominator(1000)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequency = token_frequencies(rows, width)
    shown = checkpoint(_prefixes(rows, width, t, frequency))
    known = shown.where("doc_id IS NOT NULL AND n > 0")
    reps = known.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "matches", "tokens")).alias("x"))
    reps = reps.select(F.col("x.doc_id").alias("id"), "x.n", "x.matches", "x.tokens")
    n_buckets = shards_for((shown.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 8, TOKENS)
    shared = spark.sparkContext.broadcast(frequency)

    def hot(e: np.ndarray) -> np.ndarray:
        return shared.value[(e["token"] % np.uint64(BUCKETS)).astype(np.int64)] > HOT_ROWS

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = _entries(b, t)
            e = e[~hot(e)]
            bucket = ((e["token"] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(e)]
            parts = [b"".join(np.ascontiguousarray(e[lo:hi][c]).tobytes() for c in ENTRY.names) for lo, hi in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([zlib.compress(x, 1) for x in parts], pa.binary())], ["bucket", "entries"])

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = _entries(b, t)
            e = e[hot(e)]
            yield pa.RecordBatch.from_arrays([pa.array(e["token"].view(np.int64)), pa.array(e["id"])], ["token", "id"])

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        (a, b, need, n), (pivot, member) = list_pairs(np.concatenate([_columns(zlib.decompress(x)) for x in group["entries"]]), t)
        pivot, member = np.unique(np.stack([pivot, member]), axis=1)
        zero = np.zeros(len(pivot), np.int64)
        return pd.DataFrame({"a": np.concatenate([a, pivot]), "b": np.concatenate([b, member]), "need": np.concatenate([need, zero]), "n": np.concatenate([n, zero])})

    listed = reps.mapInArrow(cold, "bucket int, entries binary").groupBy("bucket").applyInPandas(pairs, "a long, b long, need long, n long")
    frequent = reps.mapInArrow(warm, "token long, id long").select(F.col("token").alias("a"), F.col("id").alias("b"), F.lit(-1).cast("long"), F.lit(0).cast("long"))
    found = checkpoint(listed.union(frequent))  # both read one exchange of the prefixes
    asked = found.where("need > 0").groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("n").alias("n")).where("n >= need")
    frequent = found.where("need < 0").select(F.col("a").alias("token"), F.col("b").alias("id"))
    pivots = checkpoint(frequent.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1"))
    blocks = found.where("need = 0").select("a", "b").union(frequent.join(pivots, "token").select("a", F.col("id").alias("b"))).distinct()
    asked = checkpoint(asked.select("a", "b"))
    blocks = checkpoint(blocks)
    wanted = asked.select(F.explode(F.array("a", "b")).alias("doc_id")).union(blocks.select("b")).distinct()
    # Joined by sorting at every size: an estimate would broadcast small tables of ids and so change what is moved.
    whole = checkpoint(rows.mapInArrow(_packed, "doc_id long, text binary").join(wanted.hint("merge"), "doc_id"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        sets = shingle_sets([unpack.decompress(x).decode("utf-8", "surrogatepass") for x in group["text"]], width)
        a, b = linked(group["id"].to_numpy(), sets, group["own"].to_numpy(), t)
        pa.default_memory_pool().release_unused()
        return pd.DataFrame({"a": a, "b": b})

    def links(members: DataFrame) -> DataFrame:
        """Spanning links among the members (id) of each center, compared in pairs of parts of bounded size."""
        members = checkpoint(members)
        sizes = members.groupBy("center", "kind").agg(F.count("*").alias("n")).where("n > 1").select("center", "kind", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"))
        cut = members.join(checkpoint(sizes), ["center", "kind"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.select("center", "kind", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id")
        both = cut.join(whole.hint("merge"), F.col("id") == F.col("doc_id")).drop("doc_id")
        return checkpoint(both.groupBy("center", "kind", "low", "high").applyInPandas(verify, "a long, b long"))

    stars = lambda pairs: pairs.select(F.col("a").alias("center"), F.explode(F.array("a", "b")).alias("id"), F.lit(0).alias("kind")).distinct()
    within = lambda lists: lists.select(F.col("a").alias("center"), F.col("b").alias("id"), F.lit(1).alias("kind"))
    # First each document with the smallest of its candidates, and with the list of the smallest pivot.
    first = asked.groupBy("b").agg(F.min("a").alias("a"))
    found = links(stars(first).union(within(blocks.groupBy("b").agg(F.min("a").alias("a")))))
    groups = connected_components(found)
    # Then the pairs that are in different groups still, and the lists that hold members of several groups.
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    pairs_left = asked.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs_left = pairs_left.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    mixed = blocks.join(of("b"), "b", "left").groupBy("a").agg(F.min(F.coalesce("of_b", "b")).alias("low"), F.max(F.coalesce("of_b", "b")).alias("high"))
    lists_left = blocks.join(mixed.where("low <> high").select("a"), "a")
    rest = checkpoint(stars(pairs_left).union(within(lists_left)))
    if not rest.isEmpty():
        groups = connected_components(found.union(links(rest)))
    least = known.groupBy("digest").agg(F.min("doc_id").alias("id"))
    labels = checkpoint(least.join(groups, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component_id")))
    own = shown.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(labels, "digest", "left")
    by_id = own.groupBy("doc_id").agg(F.min("component_id").alias("least"))
    return own.drop("component_id").join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, one a group, in the columns of ``docs``.

    Rows with a null doc_id, and documents without words, all stay. Different
    texts under one doc_id are grouped each on its own; among those of a group
    the one of the smallest digest stays, and one of equal rows.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        groups = checkpoint(similar_groups(docs, width, threshold))
        return docs.join(groups.where("component_id < doc_id").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*names)
    # Numbers in the order of (doc_id, digest of the text) stand for doc_id; of rows equal in both, the one of the smallest hash of all columns is taken.
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.select("doc_id", digest.alias("digest"), F.struct("*").alias("row"))
    usable = rows.where("doc_id IS NOT NULL")
    ids = checkpoint(numbered(usable.select("doc_id", "digest").distinct(), F.col("doc_id"), F.col("digest"), name="number"))
    once = usable.groupBy("doc_id", "digest").agg(F.min_by("row", F.struct(F.xxhash64("row"), F.to_json("row"))).alias("row"))
    once = checkpoint(once.join(ids.hint("merge"), ["doc_id", "digest"]).select("number", "row"))
    groups = checkpoint(similar_groups(once.select(F.col("number").alias("doc_id"), "row.text"), width, threshold))
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("number"))
    kept = once.join(gone.hint("merge"), "number", "left_anti").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*names)
