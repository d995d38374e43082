"""Removal of byte strings that repeat across documents, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import checkpoint, free_name, ranges, shards_for

WIDTH = 50  # bytes of a repeated string
GRAM = 20  # bytes of an anchor
SHARD_BYTES = 4 << 20  # documents of a shard
BUCKET_BYTES = 4 << 20  # text for each bucket of windows
ARRAY_BYTES = 2 << 20  # text of one suffix array
ANCHORS = 1 << 22  # anchors of a bucket
CHUNK = 1 << 18
PLACE_BITS = np.uint64(31)

_random = np.random.default_rng(50)
LETTER = _random.integers(0, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0xD1342543DE82EF95)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place, put together from hashes of 1, 2, 4, 8, 16 bytes."""
    h = {1: LETTER[data]}
    for n in (1, 2, 4, 8):
        m = len(h[n]) - n
        h[2 * n] = h[n][:m] * np.uint64(pow(int(BASE), n, 1 << 64)) + h[n][n:]
    m = len(data) - GRAM + 1
    out = h[16][:m] * np.uint64(pow(int(BASE), 4, 1 << 64)) + h[4][16 : 16 + m]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def window_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, document) of all runs of windows with one anchor.

    A window is ``WIDTH`` bytes of one document. Its anchor is the gram of the
    least hash in it, the first of equals, and so depends on the window's bytes
    alone: equal windows of any documents have equal anchors.
    """
    valid = np.zeros(len(data), bool)
    counts = np.maximum(0, lengths - WIDTH + 1)
    valid[ranges(starts, counts)] = True
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    out = []
    for lo in range(0, len(data) - WIDTH + 1, CHUNK):
        part = data[lo : lo + CHUNK + WIDTH - 1]
        hashes = _grams(part)
        low = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        span, reach = WIDTH - GRAM + 1, 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :]) if span > reach else low
        place = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        ok = np.flatnonzero(valid[lo : lo + len(place)])
        if len(ok):
            p = place[ok]
            edge = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(ok, prepend=-2) != 1))
            first = ok[edge]
            out.append((first + lo, np.diff(np.append(edge, len(ok))), hashes[p[edge]], owner[first + lo]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def suffix_array(data: np.ndarray, wanted: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """The places in ``wanted`` (flags), ordered by the ``depth`` bytes from each.

    Larsson-Sadakane refinement: places are first sorted by 8 bytes and ranked
    by group; each round sorts the members of groups that are still open by the
    rank of the place h bytes on, which doubles the sorted depth h. Singletons
    stay, and so do places whose rank no wanted place will ask for.
    """
    n = len(data)
    raw = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    key = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        words = np.frombuffer(raw, ">u8", (n - o + 7) // 8, o)
        key[o::8] = words
    steps, h = [], 8
    while h < depth:
        steps.append(min(h, depth - h))
        h += steps[-1]
    needs = [wanted]
    for step in steps[:0:-1]:
        more = needs[0].copy()
        more[step:] |= needs[0][:-step]
        needs.insert(0, more)
    order = np.argsort(key)
    head = np.diff(key[order], prepend=~key[order[:1]]) != 0
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    rank = np.zeros(n + depth, np.int64)
    rank[order] = np.repeat(at, size)
    rank[n:] = -1
    open_ = np.repeat(size > 1, size)
    for step, need in zip(steps, needs):
        slots = np.flatnonzero(open_ & need[order])
        if not len(slots):
            break
        p = order[slots]
        pair = (rank[p] << 32) + rank[p + step] + 1
        by = np.argsort(pair)
        p, pair = p[by], pair[by]
        order[slots] = p
        at = np.flatnonzero(np.diff(pair, prepend=-1) != 0)
        size = np.diff(np.append(at, len(p)))
        rank[p] = np.repeat(slots[at], size)
        open_[slots] = np.repeat(size > 1, size)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, firsts: np.ndarray, counts: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """The common prefix, up to ``depth``, of each place in ``order`` with the place before it.

    Kasai's walk in text order: the prefix at the next place is at least one
    less than here, if the neighbour's next place is in the array too and comes
    first there (equal strings may lie in any order). All runs of places (``firsts``, ``counts``) are walked side by side, comparing eight
    bytes at a time.
    """
    n = len(data)
    raw = np.concatenate([data, np.zeros(depth + 16, np.uint8)]).tobytes()
    key = np.empty(n + depth, np.uint64)
    for o in range(8):
        key[o::8] = np.frombuffer(raw, ">u8", (n + depth - o + 7) // 8, o)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(n + 1, n, np.int64)
    place[order] = np.arange(len(order))
    lcp = np.zeros(n, np.int64)
    lanes, h, last = np.arange(len(firsts)), np.zeros(len(firsts), np.int64), np.full(len(firsts), -1)
    for j in range(int(counts.max()) if len(counts) else 0):
        on = counts[lanes] > j
        lanes, h, last = lanes[on], h[on], last[on]
        p = firsts[lanes] + j
        q = before[p]
        h = np.where((last >= 0) & (place[last + 1] < place[p]), np.maximum(h - 1, 0), 0)
        h[q < 0] = 0
        go = np.flatnonzero(q >= 0)
        while len(go):
            x = key[p[go] + h[go]] ^ key[q[go] + h[go]]
            same = np.full(len(go), 8)
            some = x != 0
            same[some] = 7 - (np.frexp(x[some].astype(np.float64))[1] - 1) // 8
            h[go] = np.minimum(h[go] + np.maximum(same, 0), depth)
            go = go[(same == 8) & (h[go] < depth)]
        lcp[p] = h
        last = q
    return lcp[order]


def window_classes(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least doc of each window's class, class of each window, class windows in order, least doc of classes) of a shard of strings."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    firsts, counts = np.cumsum(lengths) - lengths, lengths - WIDTH + 1
    wanted = np.zeros(len(data), bool)
    places = ranges(firsts, counts)
    wanted[places] = True
    order = suffix_array(data, wanted)
    lcp = common_prefixes(data, order, firsts, counts)
    new = lcp < WIDTH
    new[:1] = True
    heads = np.flatnonzero(new)
    owner = np.repeat(docs, lengths)
    least = np.minimum.reduceat(owner[order], heads)
    of = np.empty(len(data), np.int64)
    of[order] = np.cumsum(new) - 1
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[order[heads]]
    return least[of[places]], of[places], np.ascontiguousarray(windows).view(f"S{WIDTH}").ravel(), least


def merge_classes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted windows of two shards with the least doc of each: b is looked up in a by binary search."""
    (ka, da), (kb, db) = a, b
    at = np.searchsorted(ka, kb)
    both = (at < len(ka)) & (ka[np.minimum(at, len(ka) - 1)] == kb)
    da = da.copy()
    da[at[both]] = np.minimum(da[at[both]], db[both])
    return np.insert(ka, at[~both], kb[~both]), np.insert(da, at[~both], db[~both])


def covered_masks(strings: list[bytes], least: np.ndarray, of: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For occurrences (string number ``of``, ``docs``): bit j tells that window j of the string starts in a smaller doc too.

    ``least`` holds the smallest doc of each string, the strings are distinct.
    """
    sizes = np.array([len(s) for s in strings])
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // ARRAY_BYTES, prepend=-1)).tolist() + [len(strings)]
    shards = [window_classes(strings[lo:hi], least[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    merged = shards[0][2:]
    for s in shards[1:]:
        merged = merge_classes(merged, s[2:])
    smallest = np.concatenate([merged[1][np.searchsorted(merged[0], s[2])][s[1]] for s in shards] if len(shards) > 1 else [shards[0][0]])
    counts = sizes - WIDTH + 1
    first = np.cumsum(counts) - counts
    out = np.zeros(len(of), np.uint64)
    for j in range(int(counts.max())):
        on = np.flatnonzero(counts[of] > j)
        out[on] |= (smallest[first[of[on]] + j] < docs[on]).astype(np.uint64) << np.uint64(j)
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its type and length, compressed."""
    return zlib.compress(b"".join(f"{a.dtype.str}:{len(a)};".encode() + a.tobytes() for a in arrays), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zlib.decompress(data), 0, []
    while at < len(data):
        colon, end = data.index(b":", at), data.index(b";", at)
        out.append(np.frombuffer(data, data[at:colon].decode(), int(data[colon + 1 : end]), end + 1))
        at = end + 1 + out[-1].nbytes
    return out


def _shards(docs: DataFrame, key: str) -> DataFrame:
    """(shard, ids, lengths, text, rest): documents packed where they are read, in the order of doc_id; written once.

    ``rest`` holds the other columns, ``key`` is the name of doc_id's copy among them. The written rows are what every later
    step reads, so a shard's number and order are the same in all of them.
    """

    def pack(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pa.compute.sort_indices(pa.table({"k": rows.column(key)}), sort_keys=[("k", "ascending")]))
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]
        ids = np.asarray(pa.compute.fill_null(rows.column(key), 2**63 - 1))
        lengths = np.array([len(t) for t in texts], np.int64)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.drop_columns(["text"]).append_column("text", pa.nulls(len(rows), pa.string())).select(rows.schema.names))
        data = b"".join(texts)
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([_pack(ids.astype("<i8"), lengths)], pa.binary()), "n_bytes": pa.array([len(data)], pa.int64()),
            "text": pa.array([pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)], pa.binary()), "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            own = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0)).astype(np.int64) + 16
            at = 0
            while at < b.num_rows:
                ends = np.cumsum(own[at:])
                n = max(1, int(np.searchsorted(ends, SHARD_BYTES - size, side="right")))
                held.append(b.slice(at, n))
                size += int(ends[min(n, len(ends)) - 1])
                at += n
                if size >= SHARD_BYTES or at < b.num_rows:
                    yield pack(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))

    rows = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    packed = rows.mapInArrow(run, "ids binary, n_bytes long, text binary, rest binary")
    return checkpoint(packed.withColumn("shard", F.monotonically_increasing_id()))


class _Runs:
    """The runs of windows of a packed shard, with their anchors as sorted distinct keys."""

    def __init__(self, ids: bytes, text: bytes, n_bytes: int, buckets: int) -> None:
        self.ids, self.lengths = _unpack(ids)
        self.text = pa.decompress(text, n_bytes, "zstd", asbytes=True) if n_bytes else b""
        self.starts = np.cumsum(self.lengths) - self.lengths
        known = np.where(self.ids == 2**63 - 1, 0, self.lengths)  # a null doc_id takes no part
        data = np.frombuffer(self.text, np.uint8)
        self.first, self.count, self.anchor, self.doc = window_runs(data, self.starts, self.lengths)
        keep = known[self.doc] > 0
        self.first, self.count, self.anchor, self.doc = (x[keep] for x in (self.first, self.count, self.anchor, self.doc))
        key = ((self.anchor & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32)) | (self.anchor >> np.uint64(32))
        self.keys, self.of = np.unique(key, return_inverse=True)
        doc_id = self.ids[self.doc]
        low, high = np.full(len(self.keys), 2**63 - 1), np.full(len(self.keys), -(2**63))
        np.minimum.at(low, self.of, doc_id)
        np.maximum.at(high, self.of, doc_id)
        self.shared = low < high  # in two documents of this shard


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Removes every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    ``docs`` has doc_id, text and any other columns; text counts as UTF-8 bytes
    (null: empty), matches don't cross documents, and strings are judged on the
    input. Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) a row; or,
    with ``keep_text``, the columns of ``docs`` with the remaining text, without
    bytes that a cut left as part of a character. Equal doc_ids are one document
    to each other; rows with a null doc_id take no part and lose nothing; empty
    and null texts stay as they are. An empty table gives an empty result.

    Documents are packed into shards. An anchor, the least hashed 20-byte gram
    of a window, is found for each window; windows whose anchor occurs in one
    document only can't repeat, and one bit an anchor tells each shard so. The
    rest, runs of windows with one anchor, go to that anchor's bucket, equal
    runs of a shard once, with their smallest doc_id. A bucket builds suffix
    arrays with common prefixes over shards of its distinct runs; neighbours
    with 50 common bytes form a class, and classes of several shards are merged
    by binary search. Every shard gets back, for each run, the windows that
    start in a smaller document.
    """
    own_id = free_name(docs, "_doc")
    packed = _shards(docs, own_id)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    n_anchor, n_bucket = shards_for(total // 12, ANCHORS), shards_for(total, BUCKET_BYTES)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                runs = _Runs(*(b.column(c)[i].as_py() for c in ("ids", "text", "n_bytes")), n_anchor)
                bucket = (runs.keys >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
                if len(bucket):
                    rows = [(int(bucket[lo]), runs.keys[lo:hi].astype(np.uint32).tobytes()) for lo, hi in zip(edges, edges[1:])]
                    keys, values = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b.column("shard")[i].as_py()] * len(rows), pa.int64()), pa.array(values, pa.binary())], ["bucket", "shard", "anchors"])

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint32) for x in group["anchors"]]
        ordered = np.sort(np.concatenate(parts))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        bits = []
        for x in parts:
            at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
            bits.append(zlib.compress(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes(), 1))
        return pd.DataFrame({"shard": group["shard"], "bucket": group["bucket"], "n": [len(x) for x in parts], "bits": bits})

    marks = packed.select("shard", "ids", "text", "n_bytes").mapInArrow(anchors, "bucket int, shard long, anchors binary")
    marks = marks.groupBy("bucket").applyInPandas(shared, "shard long, bucket int, n int, bits binary")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "shard": [], "data": []}
        marked = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        bits = [np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8), count=r["n"]).astype(bool) for r in marked]
        for row in left.to_pylist():
            runs = _Runs(row["ids"], row["text"], row["n_bytes"], n_anchor)
            often = np.concatenate([*bits, np.zeros(0, bool)]) | runs.shared if len(runs.keys) else runs.shared
            pick = np.flatnonzero(often[runs.of])
            pick = pick[np.argsort(runs.ids[runs.doc[pick]], kind="stable")]
            doc_id = runs.ids[runs.doc[pick]]
            entry: dict[bytes, int] = {}
            of = np.array([entry.setdefault(runs.text[a : a + n], len(entry)) for a, n in zip(runs.first[pick].tolist(), (runs.count[pick] + WIDTH - 1).tolist())], np.int64)
            strings = list(entry)
            first = np.unique(of, return_index=True)[1]
            smallest = doc_id[first]
            own = doc_id == smallest[of]  # the others start in a smaller document of this shard
            out["bucket"].append(-1)
            out["shard"].append(row["shard"])
            out["data"].append(_pack(runs.first[pick[~own]].astype(np.uint32), runs.count[pick[~own]].astype(np.uint8), runs.first[pick[own]].astype(np.uint32), of[own].astype(np.uint32)))
            bucket = (runs.anchor[pick[first]] % np.uint64(n_bucket)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
            for lo, hi in zip(edges, edges[1:]):
                some = order[lo:hi]
                own_strings = [strings[i] for i in some.tolist()]
                out["bucket"].append(int(bucket[some[0]]))
                out["shard"].append(row["shard"])
                # both numbers rise, so their steps are packed
                out["data"].append(_pack(np.diff(some, prepend=0).astype(np.uint32), np.diff(smallest[some], prepend=0), np.array([len(s) for s in own_strings], np.uint8), np.frombuffer(b"".join(own_strings), np.uint8)))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "shard": pa.array(out["shard"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    by_shard = packed.select("shard", "ids", "text", "n_bytes").groupBy("shard")
    pieces = by_shard.cogroup(marks.groupBy("shard")).applyInArrow(cut, "bucket int, shard long, data binary")

    def classes(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return group[["shard", "bucket", "data"]]  # what a shard noted for itself
        entry: dict[bytes, int] = {}
        of, docs, edges = [], [], [0]
        numbers = []
        for data in group["data"]:
            number, smallest, size, text = _unpack(data)
            number, smallest = np.cumsum(number), np.cumsum(smallest)
            raw, end = text.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
            of += [entry.setdefault(raw[a:b], len(entry)) for a, b in zip([0, *end[:-1]], end)]
            docs.append(smallest)
            numbers.append(number)
            edges.append(len(of))
        of, docs = np.array(of, np.int64), np.concatenate(docs)
        least = np.full(len(entry), 2**63 - 1)
        np.minimum.at(least, of, docs)
        masks = covered_masks(list(entry), least, of, docs)
        found = []
        for number, lo, hi in zip(numbers, edges, edges[1:]):
            some = np.flatnonzero(masks[lo:hi])
            found.append(_pack(number[some], masks[lo:hi][some]))
        return pd.DataFrame({"shard": group["shard"], "bucket": group["bucket"], "data": found})

    to = F.when(F.col("bucket") < 0, F.col("shard")).otherwise(-1).alias("to")
    answers = pieces.groupBy("bucket", to).applyInPandas(classes, "shard long, bucket int, data binary")
    names = docs.columns
    digest = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema]) if keep_text else digest

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        rows = right.to_pylist()
        for row in left.to_pylist():
            ids, lengths = _unpack(row["ids"])
            text = pa.decompress(row["text"], row["n_bytes"], "zstd", asbytes=True) if row["n_bytes"] else b""
            step = np.zeros(len(text) + 1, np.int32)
            local = next((_unpack(r["data"]) for r in rows if r["bucket"] < 0), None)
            if local:
                all_first, all_count, own_first, own_of = local
                np.add.at(step, all_first.astype(np.int64), 1)
                np.add.at(step, all_first.astype(np.int64) + all_count + WIDTH - 1, -1)
                mask = np.zeros(int(own_of.max()) + 1 if len(own_of) else 0, np.uint64)
                for r in rows:
                    if r["bucket"] >= 0:
                        number, found = _unpack(r["data"])
                        mask[number] = found
                bits = mask[own_of]
                for j in range(WIDTH - GRAM + 1):
                    at = own_first[(bits >> np.uint64(j)) & np.uint64(1) == 1].astype(np.int64) + j
                    np.add.at(step, at, 1)
                    np.add.at(step, at + WIDTH, -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            data = np.frombuffer(text, np.uint8)
            ends = np.cumsum(lengths)
            total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
            removed = (total[ends] - total[ends - lengths]).astype(np.int64)
            kept, spans = [], np.zeros(len(ids), np.int64)
            for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
                if removed[i]:
                    part = gone[a:b]
                    spans[i] = int(part[0]) + int((part[1:] > part[:-1]).sum())
                    kept.append(data[a:b][~part].tobytes())
                else:
                    kept.append(text[a:b])
            rest = pa.ipc.open_stream(row["rest"]).read_all()
            if keep_text:
                texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                tables.append(rest.set_column(rest.schema.get_field_index("text"), "text", texts).select(names))
            else:
                tables.append(pa.table({
                    "doc_id": rest.column(own_id), "n_bytes": pa.array(lengths), "n_removed": pa.array(removed), "n_spans": pa.array(spans),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                }))
        return pa.concat_tables(tables) if tables else pa.table({"doc_id": pa.array([], pa.int64())})

    return packed.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(finish, schema)
