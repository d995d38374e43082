"""SentencePiece encoding by batched Viterbi in numpy, and decoding."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import WordCache, ranges, runs

SPACE = "▁"
CACHE_WORDS = 2_000_000
SLICE_CHARS = 1 << 20
LONG = 96  # words of more characters advance on their own
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10
FRONT = b"\xff" + SPACE.encode()
AGAIN = re.compile(b"(?<=" + SPACE.encode() + b")\xff")


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points as random odd-looking 64-bit numbers."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


STEP = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary:
    """Sorted hashes of the pieces of a model, with their scores and bytes."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:-1], 16)] = i
        self.longest = max(len(pieces[i]) for i in normal)
        self.lines_apart = not any("\n" in pieces[i] for i in normal)
        codes = np.zeros((len(normal), self.longest), np.uint32)
        hashes = np.zeros(len(normal), np.uint64)
        for r, i in enumerate(normal):
            codes[r, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        lengths = np.array([len(pieces[i]) for i in normal])
        for j in range(self.longest):
            inside = lengths > j
            hashes[inside] = hashes[inside] * STEP + _mixed(codes[inside, j])
        hashes += lengths.astype(np.uint64)
        order = np.argsort(hashes)
        self.keys, self.codes, self.lengths = hashes[order], codes[order], lengths[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.ids = np.array(normal, np.int32)[order]
        self.scores = np.round(np.array([sp.get_score(i) for i in normal])[order] * 1024).astype(np.int64)
        self.unknown_score = self.scores.min() - UNKNOWN_PENALTY * 1024
        kept = set(normal)
        raw = [pieces[i].replace(SPACE, " ").encode() if i in kept else bytes([int(pieces[i][3:-1], 16)]) if sp.is_byte(i) else b"" for i in range(n)]
        raw[self.unknown] = "⁇".encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """hit[l - 1, r, i]: the sorted place of the piece of l characters at i in word r, or -1. ``codes`` is (words, length)."""
        m, size = codes.shape
        mixed = _mixed(codes)
        found = np.full((min(self.longest, size), m, size), -1, np.int32)
        h = np.zeros((m, size), np.uint64)
        for n in range(1, found.shape[0] + 1):
            w = size - n + 1
            h = h[:, :w] * STEP + mixed[:, n - 1 : n - 1 + w]
            key = h + np.uint64(n)
            r, i = np.nonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])  # most substrings are no piece
            place = np.minimum(np.searchsorted(self.keys, key[r, i]), len(self.keys) - 1)
            hit = (self.keys[place] == key[r, i]) & (self.lengths[place] == n)
            r, i, place = r[hit], i[hit], place[hit]
            same = np.ones(len(r), bool)
            for j in range(n):
                same &= codes[r, i + j] == self.codes[place, j]
            found[n - 1, r[same], i[same]] = place[same]
        return found

    def segment(self, codes: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length: the segmentation of the largest sum of scores.

        Of equal sums the longest last piece wins. A character without a piece
        of its own may stand alone as unknown, and becomes its UTF-8 bytes.
        """
        m, size = codes.shape
        found = self.probe(codes)
        longest = found.shape[0]
        if size > LONG:
            back = np.zeros((m, size + 1), np.int32)
            for r in range(m):
                score = [0] * (size + 1)
                own = found[:, r, :]
                hits: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
                for n, i in zip(*(x.tolist() for x in np.nonzero(own[::-1] >= 0))):
                    n = longest - n
                    hits[i + n].append((n, int(self.scores[own[n - 1, i]])))
                for j in range(1, size + 1):
                    top = None
                    for n, s in hits[j]:
                        if top is None or score[j - n] + s > top:
                            top, back[r, j] = score[j - n] + s, n
                    if own[0, j - 1] < 0 and (top is None or score[j - 1] + int(self.unknown_score) > top):
                        top, back[r, j] = score[j - 1] + int(self.unknown_score), 1
                    score[j] = top
        else:
            best = np.zeros((size + 1, m), np.int64)
            back = np.zeros((m, size + 1), np.int32)
            low = np.iinfo(np.int64).min // 2
            for j in range(1, size + 1):
                span = min(longest, j)
                n = np.arange(span, 0, -1)
                place = found[n - 1, :, j - n]  # longest first
                value = np.where(place >= 0, self.scores[place], low)
                value[-1] = np.where(place[-1] >= 0, value[-1], self.unknown_score)
                value = value + best[j - n]
                top = value.argmax(axis=0)
                best[j] = value[top, np.arange(m)]
                back[:, j] = n[top]
        at, rows = np.full(m, size), np.arange(m)
        steps = []
        while len(rows):
            n = back[rows, at]
            at = at - n
            steps.append((rows, at, found[n - 1, rows, at]))
            rows, at = rows[at > 0], at[at > 0]
        row, pos, place = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((pos, row))
        row, pos, place = row[order], pos[order], place[order]
        ids = np.where(place >= 0, self.ids[place], -1)
        edges = np.searchsorted(row, np.arange(m + 1))
        bad = np.flatnonzero(ids < 0)
        size = np.ones(len(ids), np.int64)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[row[bad], pos[bad]].tolist()]
        size[bad] = [len(x) for x in raw]
        ids = np.repeat(ids, size)
        to = np.cumsum(size) - size
        ids[ranges(to[bad], size[bad])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        cuts = np.append(to, len(ids))[edges].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """A vocabulary with the ids of the words seen so far, found by hash and compared byte by byte."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known = WordCache()
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        sizes = np.array([len(w) for w in words])
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, 400_000 // int(size))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step].tolist()
                codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
                for i, x in zip(some, self.vocabulary.segment(codes)):
                    ids[i] = x
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each).

        Pieces hold white space in front only, so words, each with the spaces
        before it, are segmented on their own. They are cut at a byte that UTF-8
        never holds.
        """
        if len(self.known) > CACHE_WORDS:
            self.clear()
        parts = [b"" if not t else FRONT + t.encode("utf-8", "surrogatepass").replace(b" ", FRONT) for t in texts]
        parts = [AGAIN.sub(b"", p) if FRONT + FRONT in p else p for p in parts]
        if self.vocabulary.lines_apart:
            parts = [p.replace(b"\n", b"\xff\n\xff") for p in parts]
        raw = b"\xff".join(parts)
        data = np.frombuffer(raw, np.uint8)
        first, end = runs(data != 0xFF)
        word, new = self.known.lookup(data, first, end)
        text = lambda at: [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(first[at].tolist(), end[at].tolist())]
        if len(new):
            self.learn(text(new))
        odd = np.flatnonzero(word < 0)
        if len(odd):  # words whose hash is another word's: segmented now, never found again
            word[odd] = len(self.starts) - 1 + np.arange(len(odd))
            self.learn(text(odd))
        count = (self.starts[1:] - self.starts[:-1])[word] if len(word) else word
        ids = self.flat[ranges(self.starts[word], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        if len(odd):
            self.clear()
        return ids, np.diff(sums[np.searchsorted(first, offsets)])


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """UTF-8 of each text: the pieces' bytes without the space in front of the first word."""
    size = np.diff(vocabulary.byte_starts)[ids]
    raw = vocabulary.bytes[ranges(vocabulary.byte_starts[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(np.concatenate([[0], lengths]))].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(ends, ends[1:])]


def _slices(batch: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    piece = np.cumsum(size + 16) // SLICE_CHARS
    edges = np.flatnonzero(np.diff(piece, prepend=-1)).tolist() + [batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with a column ``piece_ids`` (array of int) of its whole texts.

    Each text is read as SentencePiece reads it without further normalisation:
    a space in front and every space shown as U+2581. Each word gets the
    segmentation of the largest sum of the model's piece scores; characters
    without a piece become their UTF-8 bytes. Null or empty text gives no ids.
    Other columns are kept, one named piece_ids is replaced; rows that repeat
    count each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop("piece_ids")
    out = StructType([*docs.schema.fields]).add("piece_ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.__dict__.setdefault("_tabscope_pieces", {})  # stays with the worker between tasks
        key = zlib.crc32(shared.value.keys.tobytes())
        if key not in kept:
            kept.clear()
            kept[key] = Encoder(shared.value)
        for b in batches:
            text = b.column("text")
            for part in _slices(b, np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0))):
                ids, lengths = kept[key].encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "piece_ids"])

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded) of ``encoded`` (doc_id, piece_ids).

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit
    integers; ``decoded`` is the UTF-8 text. Null ids decode to the empty text;
    ids outside the vocabulary raise. U+2581 of the original comes back as a
    space; all else comes back as it was.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(b.column("piece_ids")), 0))
            for part in _slices(b, size * 3):
                lists = part.column("piece_ids")
                lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
                ids = np.asarray(lists.flatten()).astype(np.int64)
                raw = ids.astype("<u4").tobytes()
                ends = (4 * np.cumsum(lengths)).tolist()
                crc = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends, lengths.tolist())]
                texts = pa.array(decode_ids(shared.value, ids, lengths), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths), pa.array(crc, pa.int64()), texts], ["doc_id", "n_pieces", "ids_crc32", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded binary")
