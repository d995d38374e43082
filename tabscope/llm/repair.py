"""Token ids in binary shards, compressed by Re-Pair grammars with random access."""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, checkpoint, ranges, shared_path, shards_for, text_bytes

END = 2
MAGIC = b"RPAIR001"
SHARD_BYTES = 4 << 20  # text of a shard
CACHE_WORDS = 3_000_000
SLICE_CHARS = 1 << 20
#: A pair is replaced while it occurs this often; a round takes at most this many pairs.
MIN_COUNT, ROUND_PAIRS = 2, 8192
SYMBOLS = 1 << 16
SPACES = re.compile(r"\s\s")
# Classes of bytes: letters, digits, signs, space, line break, end of text; 0 (bytes beyond ASCII, the
# apostrophe, other white space) is cut off from none of its neighbours.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 3
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[48:58] = 2
CLASS[[39, 32, 10, 255]] = [0, 4, 5, 6]
#: Where the second of two classes starts a piece.
BREAK = np.array([[c >= 4 or p >= 5 or (p in (1, 2, 3) and c in (1, 2, 3) and p != c) for c in range(8)] for p in range(8)]).ravel()


# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for 256 and up.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
LINE = BYTE_CHARACTERS[10]


class Encoder:
    """The tokenizers library on whole texts, by way of a cache of their words, found by hash and compared byte by byte.

    The pre-tokenizer of a byte-level BPE starts a new part at a single space,
    around a line break, and between ASCII letters, digits and signs (the
    apostrophe aside), so pieces cut there encode on their own to the ids they
    have in the text. Unknown pieces go to the library many at a time, joined
    by line breaks. Texts with adjacent white space or a special token go to the library whole.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.letters = Tokenizer.from_str(definition)
        self.letters.pre_tokenizer = pre_tokenizers.Split(LINE, "isolated")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = WordCache()
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _joined(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each), from texts of words with line breaks between them."""
        mark = self.line[0]
        found = [np.array([*e.ids, mark], np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, np.int32)])
        return ids[ids != mark], np.diff(np.flatnonzero(ids == mark), prepend=-1) - 1

    def learn(self, raw: list[bytes]) -> None:
        """Adds the ids of unknown words.

        Words of letters, with at most one space in front, are one pre-token:
        they skip the pre-tokenizer, in its alphabet of byte characters. The
        rest is joined by line breaks; what itself holds a line break or ends in
        white space goes to the library alone.
        """
        words = [w.decode() for w in raw]
        kind = np.array([0 if (w[1:] if w[0] == " " else w).isalpha() and max(w) < "\u2000" else 1 if not (w[-1].isspace() or "\n" in w or w in self.special) else 2 for w in words])
        letters, plain, odd = (np.flatnonzero(kind == k).tolist() for k in range(3))
        own = self.whole([words[i] for i in odd])
        parts = [
            self._joined(self.letters, [b"\n".join([raw[i] for i in letters[k : k + 200]]).decode("latin-1").translate(BYTE_CHARACTERS) for k in range(0, len(letters), 200)]),
            self._joined(self.tokenizer, ["\n".join([words[i] for i in plain[k : k + 2000]]) for k in range(0, len(plain), 2000)]),
            (np.array([x for ids in own for x in ids], np.int32), np.array([len(ids) for ids in own], np.int64)),
        ]
        counts = np.zeros(len(words), np.int64)
        if sum(len(n) for _, n in parts) != len(words):
            raise ValueError("a line break joined other text")
        counts[[*letters, *plain, *odd]] = np.concatenate([n for _, n in parts])
        order = np.argsort(kind, kind="stable")  # the words in the order of ``parts``
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.concatenate([ids for ids, _ in parts])
        self.flat = np.concatenate([self.flat, flat[ranges(starts, counts)]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        size, part, out = 0, [], []
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= SLICE_CHARS:
                out.append(self._slice(part))
                size, part = 0, []
        out.append(self._slice(part))
        return np.concatenate([i for i, _ in out]), np.concatenate([n for _, n in out])

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        direct = {i: t for i, t in enumerate(texts) if SPACES.search(t) or any(s in t for s in self.special)}
        pieces = [b"" if i in direct else t.encode("utf-8") for i, t in enumerate(texts)]
        raw = b"\xff".join([*pieces, b""])
        data = np.frombuffer(raw, np.uint8)
        kind = CLASS[data]
        pair = kind.copy()
        pair[1:] += kind[:-1] << 3
        pair[:1] = 6 << 3 | kind[:1]
        cut = np.flatnonzero(BREAK[pair])
        first, end = cut, np.append(cut[1:], len(data))
        keep = kind[first] != 6
        first, end = first[keep], end[keep]
        word, new = self.known.lookup(data, first, end)
        if len(new):
            self.learn([raw[a:b] for a, b in zip(first[new].tolist(), end[new].tolist())])
        offsets = np.cumsum([0] + [len(p) + 1 for p in pieces])
        # A text with a word whose hash is another word's goes to the library whole.
        direct |= {i: texts[i] for i in (np.searchsorted(offsets, first[word < 0], side="right") - 1).tolist()}
        word = np.maximum(word, 0)
        count = (self.starts[1:] - self.starts[:-1])[word] if len(word) else word
        ids = self.flat[ranges(self.starts[word], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        lengths = np.diff(sums[np.searchsorted(first, offsets)])
        if direct:
            found = dict(zip(direct, self.whole(list(direct.values()))))
            split = np.split(ids, np.cumsum(lengths)[:-1])
            split = [np.array(found[i], np.int32) if i in found else x for i, x in enumerate(split)]
            return np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids, lengths


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sequence, last flags) of Re-Pair over one shard.

    Each round counts all neighbouring pairs, takes the most frequent ones, those of at
    least a 32nd of the largest count (and ``min_count``), and replaces their occurrences from left
    to right by new symbols; of overlapping occurrences every second one
    stays. Pairs never cross the end of a document (``last``). It stops when no
    pair occurs ``min_count`` times or the 16-bit symbols are used up.
    """
    seq, rules, symbols = ids.astype(np.uint16), [], first_rule
    while len(seq) > 1 and symbols < SYMBOLS:
        keys = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        inner = ~last[:-1]
        ordered = np.sort(keys[inner])
        if not len(ordered):
            break
        edge = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
        counts = np.diff(np.append(edge, len(ordered)))
        if counts.max() < min_count:
            break
        often = np.flatnonzero(counts >= max(min_count, counts.max() // 32))
        room = min(ROUND_PAIRS, SYMBOLS - symbols)
        often = often[np.argsort(-counts[often], kind="stable")[:room]]
        chosen = np.sort(ordered[edge[often]])
        # Few pairs share the upper bits of their product with a chosen one; only those are looked up.
        spread = np.uint32(0x9E3779B1)
        table = np.zeros(1 << 18, bool)
        table[(chosen * spread) >> np.uint32(14)] = True
        maybe = np.flatnonzero(table[(keys * spread) >> np.uint32(14)] & inner)
        place = np.minimum(np.searchsorted(chosen, keys[maybe]), len(chosen) - 1)
        hit = chosen[place] == keys[maybe]
        at, place = maybe[hit], place[hit]
        run = np.diff(at, prepend=-2) != 1  # starts of runs of overlapping occurrences
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at, place = at[since % 2 == 0], place[since % 2 == 0]
        rules.append(chosen)
        seq[at] = symbols + place
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        seq, last = seq[keep], last[keep]
        symbols += len(chosen)
    pairs = np.concatenate([*rules, np.zeros(0, np.uint32)])
    return np.stack([pairs >> 16, pairs & 0xFFFF], axis=1).astype(np.uint16), seq, last


def pack(doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray, first_rule: int) -> bytes:
    """The bytes of a shard file: header, rules with expansion lengths, documents, sequence.

    Little-endian: magic, then unsigned 32-bit numbers of documents, rules,
    symbols and the first rule's id; rules as two 16-bit ids each; the length
    each rule expands to (32 bits); per document its id (64 bits, null as the
    least number), ids with end id (64 bits) and first symbol (64 bits); the
    symbols (16 bits). Any document decodes from its own symbols alone.
    """
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    rules, seq, last = compress(ids, last, first_rule)
    size = np.ones(SYMBOLS, np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        size[first_rule + r] = size[a] + size[b]
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])[: len(lengths)]
    head = MAGIC + struct.pack("<4I", len(lengths), len(rules), len(seq), first_rule)
    arrays = (rules.astype("<u2"), size[first_rule : first_rule + len(rules)].astype("<u4"), doc_ids.astype("<i8"), lengths.astype("<i8"), starts.astype("<i8"), seq.astype("<u2"))
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A read shard file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        docs, rules, symbols, self.first_rule = struct.unpack_from("<4I", data, 8)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * rules).reshape(-1, 2)
        self.rule_size, self.doc_ids, self.lengths, self.starts = take("<u4", rules), take("<i8", docs), take("<i8", docs), take("<i8", docs)
        self.seq = take("<u2", symbols)
        size = np.ones(SYMBOLS, np.int64)
        size[self.first_rule : self.first_rule + rules] = self.rule_size
        self.offset = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(self.offset[-1], np.int32)
        flat[self.offset[: self.first_rule]] = np.arange(self.first_rule)
        for r, (a, b) in enumerate(self.rules.tolist()):
            o = self.offset
            to = o[self.first_rule + r]
            mid = to + size[a]
            flat[to:mid] = flat[o[a] : o[a + 1]]
            flat[mid : mid + size[b]] = flat[o[b] : o[b + 1]]
        self.flat, self.size = flat, size

    def expand(self, seq: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.offset[seq], self.size[seq])]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the i-th document; expansion lengths skip what lies outside."""
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.seq)
        seq = self.seq[self.starts[i] : end]
        stop = int(self.lengths[i]) if stop is None else min(stop, int(self.lengths[i]))
        ends = np.cumsum(self.size[seq])
        lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        before = ends[lo - 1] if lo else 0
        return self.expand(seq[lo : hi + 1])[start - before : stop - before]


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END, shard_bytes: int = SHARD_BYTES) -> str:
    """Encodes ``docs`` (doc_id, text) and writes a shard file for each range of ascending doc_id.

    Range bounds are quantiles of doc_id, one value for each ``shard_bytes`` of
    text, and depend on nothing else, so a lost task writes the same file
    again. Each shard is one group of bounded size; its file is one binary row
    of Spark's text writer, which ends it with a line break. Null doc_id sort
    first, equal ids by text; null text counts as empty. An empty table writes
    no file. Returns ``path``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = shards_for(text_bytes(rows), shard_bytes)
    cuts = np.unique(np.array(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], np.int64))
    with open(tokenizer_path) as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast(definition)
    first_rule = _vocabulary(definition)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.compute.fill_null(b.column("doc_id"), -(2**63)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, ids, side="right").astype(np.int32)), *b.columns], ["shard", "doc_id", "text"])

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["doc_id"].astype("Int64").fillna(-(2**63)).to_numpy(np.int64)
        order = np.lexsort((group["text"].to_numpy(), ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        kept = sys.__dict__.setdefault("_tabscope_encoder", {})  # stays with the worker between tasks
        key = zlib.crc32(shared.value.encode())
        if key not in kept:
            kept.clear()
            kept[key] = Encoder(shared.value)
        ids, texts = ids[order], group["text"].to_numpy()[order].tolist()
        found, lengths = kept[key].encode(texts)
        at = np.cumsum(lengths + 1) - 1
        out = np.full(len(found) + len(texts), end_id, np.int32)
        body = np.ones(len(out), bool)
        body[at] = False
        out[body] = found
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "content": [pack(ids, out, lengths + 1, first_rule)]})

    files = rows.mapInArrow(placed, "shard int, doc_id long, text string").groupBy("shard").applyInPandas(packed, "shard int, content binary")
    files.select("shard", F.col("content").cast("string")).write.partitionBy("shard").text(path)
    return path


def _vocabulary(definition: str) -> int:
    from tokenizers import Tokenizer

    n = Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)
    if n >= SYMBOLS:
        raise ValueError("16-bit symbols hold vocabularies of fewer than 65,536 ids")
    return n


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the shard files below ``path``.

    ``ids`` are the document's ids as little-endian unsigned 32-bit integers;
    ``start`` counts the ids of all documents before it.
    """
    return _located(spark, path, "doc_id long, shard int, own long, n_tokens long, ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids")


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as ``read_ids`` with the unsigned crc32 of the ids' bytes."""
    return _located(spark, path, "doc_id long, shard int, own long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32")


def _located(spark, path: str, schema: str, value, kind: pa.DataType, name: str) -> DataFrame:
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Shard(b.column("content")[i].as_buffer())
                ids = s.expand(s.seq)
                ends = np.cumsum(s.lengths)
                out = [value(ids[e - n : e]) for e, n in zip(ends.tolist(), s.lengths.tolist())]
                least = s.doc_ids == -(2**63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=least), pa.array(np.full(len(out), b.column("shard")[i].as_py(), np.int32)), pa.array(ends - s.lengths), pa.array(s.lengths), pa.array(out, kind)],
                    ["doc_id", "shard", "own", "n_tokens", name],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = checkpoint(files.select("content", F.col("shard").cast("int").alias("shard")).mapInArrow(decoded, schema))
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(starts, "shard").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", name)


def encode_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes ``docs`` to the shared folder and returns ``read_digests`` of the files."""
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_digests(spark, write_ids(docs, tokenizer_path, shared_path(spark, "token-ids")))
