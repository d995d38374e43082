"""Frequent phrases by Rabin-Karp fingerprints, and their collocation scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, checkpoint, mixed_bits, small_side, span_hashes

LONGEST = 5
SHARD_WORDS = 3 << 19  # words and breaks of a shard
SLICE_BYTES = 2 << 20  # text cut into words at a time
PRINT, PLACE = 5, 3  # bytes of a fingerprint within its bucket, and of a place or word number in a shard
BUCKET_ENTRIES = 1 << 20  # fingerprints that meet in one group, about
NO_LANG = "und"

# Fixed classes of bytes: breaks, which end a piece, become a line break; white space within a piece, a space.
TABLE = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))
GAP = re.compile(rb"[\t-\r .,;:!?]")


class Known(dict):
    """Numbers of words, given as they come; 0 is a break and -1 nothing between two spaces."""

    def __init__(self, words: list[bytes] = ()) -> None:
        super().__init__({b"": -1, b"\n": 0, **{w: i + 1 for i, w in enumerate(words)}})

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) - 1
        return out

    def words(self) -> list[bytes]:
        return list(self)[2:]


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size, cut before white space or a break."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        gap = GAP.search(raw, at + SLICE_BYTES)
        if not gap:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:]


def word_numbers(raw: bytes, known: Known) -> np.ndarray:
    """The numbers of the words of a text in lower case, with a 0 for each stretch of breaks and at the end."""
    found = []
    for part in _parts(raw):
        tokens = part.lower().translate(TABLE).replace(b"\n", b" \n ").split(b" ")
        found.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
    got = np.concatenate([*found, np.zeros(1, np.int32)])
    got = got[got >= 0]
    return got[(got > 0) | (np.append(np.int32(0), got[:-1]) > 0)]


class Shard:
    """Some consecutive words: their numbers (from 1, a 0 ends a piece), the words, and the language of each stretch.

    The first ``own`` places count as starts of phrases; the few after them
    belong to the next shard and only end phrases that start here.
    """

    def __init__(self, seq: np.ndarray, own: int, words: list[bytes], lang_at: np.ndarray, lang: np.ndarray, langs: list[str]) -> None:
        self.seq, self.own, self.words, self.lang_at, self.lang, self.langs = seq, own, words, lang_at, lang, langs

    def pack(self) -> bytes:
        ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        names = [x.encode() for x in self.langs]
        head = np.array([len(self.seq), self.own, len(self.words), len(self.lang_at), len(names), *[len(x) for x in names]], np.int64)
        planes = np.ascontiguousarray(self.seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :PLACE].T)  # compresses better than whole numbers
        arrays = (planes, ends, self.lang_at.astype(np.int64), self.lang.astype(np.int32))
        body = b"".join([np.array([len(head)], np.int64).tobytes(), head.tobytes(), *[a.tobytes() for a in arrays], *names, *self.words])
        return zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def unpack(cls, packed: bytes) -> Shard:
        body = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        head = np.frombuffer(body, np.int64, n, 8).tolist()
        n_seq, own, n_words, n_at, n_langs, *sizes = head
        at = 8 * (n + 1)

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        planes = take(np.uint8, PLACE * n_seq).reshape(PLACE, n_seq).astype(np.int32)
        seq = planes[0] | planes[1] << 8 | planes[2] << 16
        ends, lang_at, lang = take(np.int64, n_words), take(np.int64, n_at), take(np.int32, n_at)
        langs = []
        for k in sizes:
            langs.append(body[at : at + k].decode())
            at += k
        cuts = [0, *ends.tolist()]
        return cls(seq, own, [body[at + a : at + b] for a, b in zip(cuts, cuts[1:])], lang_at, lang, langs)

    def languages(self, at: np.ndarray) -> np.ndarray:
        return self.lang[np.searchsorted(self.lang_at, at, side="right") - 1]

    def starts(self, n: int) -> np.ndarray:
        """The places where a phrase of ``n`` words starts."""
        m = min(self.own, len(self.seq) - n + 1)
        if m <= 0:
            return np.zeros(0, np.int64)
        full = self.seq[:m] > 0
        for i in range(1, n):
            full &= self.seq[i : i + m] > 0
        return np.flatnonzero(full)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix polynomials over the words' hashes, and the powers that bring a difference back to its start."""
        data, cuts = np.frombuffer(b"".join(self.words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in self.words], dtype=np.int64)])
        own = np.concatenate([[np.uint64(0)], span_hashes(data, cuts[:-1], cuts[1:])]).astype(np.uint64)
        power = np.full(len(self.seq) + 1, BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.zeros(len(self.seq) + 1, np.uint64)
        np.cumsum(own[self.seq] * power[:-1], out=sums[1:])
        power[1:] = BASE_INVERSE
        return sums, np.cumprod(power)

    def fingerprints(self, at: np.ndarray, n: int, prefixes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """64-bit fingerprints of (language, ``n`` words) at the places ``at``, alike in every shard."""
        sums, back = prefixes
        salt = mixed_bits(np.array([zlib.crc32(x.encode()) * 8 + n for x in self.langs], np.uint64) * BASE)
        return mixed_bits((sums[at + n] - sums[at]) * back[at] + salt[self.languages(at)])

    def distinct(self, at: np.ndarray, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, count, first place) of the different phrases at ``at``, compared word by word where prints agree."""
        order = np.argsort(prints)
        prints, at = prints[order], at[order]
        head = np.diff(prints, prepend=~prints[:1]) != 0
        group = np.cumsum(head) - 1
        like = at[np.flatnonzero(head)][group]
        same = self.languages(at) == self.languages(like)
        for i in range(n):
            same &= self.seq[at + i] == self.seq[like + i]
        parts = [(prints[head], np.bincount(group[same], minlength=int(head.sum())), at[head])]
        if not same.all():  # the rest, phrase by phrase
            found: dict[tuple, list] = {}
            for p, a, code in zip(prints[~same].tolist(), at[~same].tolist(), self.languages(at[~same]).tolist()):
                found.setdefault((code, *self.seq[a : a + n].tolist()), [p, 0, a])[1] += 1
            p, c, a = zip(*found.values())
            parts.append((np.array(p, np.uint64), np.array(c), np.array(a)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The texts of the phrases of ``n`` words at the places ``at``, words joined by spaces."""
        words = pa.array([b"", *self.words], pa.binary())
        parts = [words.take(pa.array(self.seq[at + i])) for i in range(n)]
        return pa.compute.binary_join_element_wise(*parts, b" ").cast(pa.string()) if n > 1 else parts[0].cast(pa.string())


class _Builder:
    """Collects words into shards."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.codes: dict[str, int] = {}
        self.seq: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes, lang: str) -> None:
        code = self.codes.setdefault(lang, len(self.codes))
        seq = word_numbers(raw, self.known)
        self.seq.append(seq)
        self.lang.append(np.full(len(seq), code, np.int32))
        self.size += len(seq)

    def shards(self, end: bool) -> Iterator[Shard]:
        """Whole shards of what was added; the rest stays, but at the ``end``."""
        none = np.zeros(0, np.int32)
        seq, lang = np.concatenate([*self.seq, none]), np.concatenate([*self.lang, none])
        words, names = self.known.words(), list(self.codes)

        def own(piece: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
            """The places numbered by their own words alone."""
            there = np.zeros(len(words) + 1, bool)
            there[0] = True
            there[piece] = True
            return (np.cumsum(there, dtype=np.int32) - np.int32(1))[piece], [words[i] for i in np.flatnonzero(there[1:]).tolist()]

        more, at = LONGEST - 1, 0
        while len(seq) - at >= SHARD_WORDS + more or (end and at < len(seq)):
            size = min(SHARD_WORDS, len(seq) - at)
            codes = lang[at : at + size + more]
            change = np.flatnonzero(np.diff(codes, prepend=-1))
            local, used = own(seq[at : at + size + more])
            yield Shard(local, size, used, change, codes[change], names)
            at += size
        self.clear()
        if at < len(seq):
            local, used = own(seq[at:])
            self.known = Known(used)
            self.codes = {x: i for i, x in enumerate(names)}
            self.seq, self.lang, self.size = [local], [lang[at:]], len(local)


def word_shards(docs: DataFrame) -> DataFrame:
    """(shard, langs, words, content): the words of all texts as numbers, in compressed shards of bounded size."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _Builder()

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            for s in built.shards(end):
                at = s.starts(1)
                words = np.bincount(s.languages(at), minlength=len(s.langs))
                live = np.flatnonzero(words)
                lists = pa.array([[s.langs[i] for i in live.tolist()]], pa.list_(pa.string())), pa.array([words[live].tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*lists, pa.array([s.pack()], pa.binary())], ["langs", "words", "content"])

        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                built.add(text.as_py(), lang)
                if built.size >= SHARD_WORDS + LONGEST:
                    yield from flush(False)
        yield from flush(True)

    out = rows.mapInArrow(run, "langs array<string>, words array<long>, content binary")
    return checkpoint(out.withColumn("shard", F.monotonically_increasing_id()))


def _bytes(x: np.ndarray, n: int) -> bytes:
    """The ``n`` low bytes of each unsigned number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


REQUEST = "bucket int, shard long, prints binary, counts binary, places binary, sizes binary"
REPLY = "shard long, counts binary, places binary, sizes binary"


def _requests(shard: int, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pd.DataFrame:
    """One row a bucket, which the upper 24 bits choose: the lower 40 bits of the prints, counts, places, lengths.

    A print shorter than the whole only lets more phrases through to the comparison of texts.
    """
    size, prints, counts, places = (np.concatenate(x) for x in zip(*[(np.full(len(p), n, np.uint8), p, c, a) for n, p, c, a in parts]))
    bucket = ((prints >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket)
    size, prints, counts, places, bucket = (x[order] for x in (size, prints, counts, places, bucket))
    live, cuts = np.unique(bucket, return_index=True)
    cuts = np.append(cuts, len(bucket)).tolist()
    rows = [
        (k, shard, _bytes(prints[a:b], PRINT), counts[a:b].astype("<u4").tobytes(), _bytes(places[a:b], PLACE), size[a:b].tobytes())
        for k, a, b in zip(live.tolist(), cuts, cuts[1:])
    ]
    return pd.DataFrame(rows, columns=["bucket", "shard", "prints", "counts", "places", "sizes"])


def _frequent(requests: DataFrame, least: int) -> DataFrame:
    """Back to each shard: where its phrases lie, with its own counts, whose fingerprint occurs ``least`` times in all."""

    def bucket(group: pd.DataFrame) -> pd.DataFrame:
        prints = _numbers(b"".join(group["prints"]), PRINT)
        counts = np.frombuffer(b"".join(group["counts"]), "<u4")
        order = np.argsort(prints)
        head = np.flatnonzero(np.diff(prints[order], prepend=~prints[order[:1]]) != 0)
        sums = np.add.reduceat(counts[order].astype(np.int64), head)
        hit = np.zeros(len(prints), bool)
        hit[order] = np.repeat(sums >= least, np.diff(np.append(head, len(order))))
        ends, rows, at = np.cumsum([len(x) // PRINT for x in group["prints"]]).tolist(), [], 0
        for shard, end, places, sizes in zip(group["shard"].tolist(), ends, group["places"], group["sizes"]):
            own = hit[at:end]
            if own.any():
                place = np.frombuffer(places, np.uint8).reshape(-1, PLACE)[own]
                rows.append((shard, counts[at:end][own].tobytes(), place.tobytes(), np.frombuffer(sizes, np.uint8)[own].tobytes()))
            at = end
        return pd.DataFrame(rows, columns=["shard", "counts", "places", "sizes"])

    return requests.groupBy("bucket").applyInPandas(bucket, REPLY)


def _reply(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, counts)."""
    places = _numbers(b"".join(rows["places"]), PLACE).astype(np.int64)
    return places, np.frombuffer(b"".join(rows["sizes"]), np.uint8), np.frombuffer(b"".join(rows["counts"]), "<u4")


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of 1 to 5 words that occur ``least`` times in their language, (lang, n)).

    Each shard hashes its one- and two-word phrases from prefix polynomials
    and sends (fingerprint, count, place of the first); groups of fingerprints
    add the counts and send the places of frequent ones back. Longer phrases
    go the same way where all their two-word parts are frequent. A shard's
    counts are of occurrences compared word by word. At the places that came
    back the phrases are written out, and the counts are summed by text: where
    fingerprints of different shards collide, the texts part again.
    """
    shards = word_shards(docs)
    totals = checkpoint(shards.select(F.explode(F.arrays_zip("langs", "words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.words").alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-2 * words // BUCKET_ENTRIES))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column("shard").to_pylist(), b.column("content")):
                s = Shard.unpack(content.as_buffer())
                own = s.prefixes()
                parts = []
                for n in (1, 2):
                    at = s.starts(n)
                    parts.append((n, *s.distinct(at, n, s.fingerprints(at, n, own))))
                out = _requests(shard, parts, buckets)
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out.columns, kinds)], list(out.columns))

    first = checkpoint(_frequent(shards.select("shard", "content").mapInArrow(short, REQUEST), least))

    def longer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: [] for c in REQUEST.split(", ")})
        if not len(left) or not len(right):
            return empty
        s = Shard.unpack(left["content"].iloc[0])
        at, sizes, _ = _reply(right)
        chosen = np.unique(_pair(s, at[sizes == 2]))
        starts = s.starts(2)
        if not len(chosen) or not len(starts):
            return empty
        keys = _pair(s, starts)
        found = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
        often = np.zeros(len(s.seq) + LONGEST, bool)
        often[starts[chosen[found] == keys]] = True
        # Pairs that start in the next shard's part are not known here, so they pass.
        often[s.own : len(s.seq)] = True
        own, parts = s.prefixes(), []
        for n in range(3, LONGEST + 1):
            at = s.starts(n)
            for i in range(n - 1):
                at = at[often[at + i]]
            if len(at):
                parts.append((n, *s.distinct(at, n, s.fingerprints(at, n, own))))
        return _requests(int(left["shard"].iloc[0]), parts, buckets) if parts else empty

    by_shard = shards.select("shard", "content").groupBy("shard")
    second = checkpoint(_frequent(by_shard.cogroup(first.groupBy("shard")).applyInPandas(longer, REQUEST), least))

    replies = first.unionAll(second)
    hits = replies.agg(F.sum(F.octet_length("sizes"))).first()[0] or 0
    groups = max(1, -(-hits // BUCKET_ENTRIES))

    def texts(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            s = Shard.unpack(left["content"].iloc[0])
            places, sizes, counts = _reply(right)
            own = s.prefixes()
            for n in np.unique(sizes).tolist():
                at, count = places[sizes == n], counts[sizes == n]
                group = (s.fingerprints(at, n, own) % np.uint64(groups)).astype(np.int64)
                lang = s.languages(at)
                order = np.lexsort((group, lang))
                edges = np.flatnonzero((np.diff(lang[order], prepend=-1) != 0) | (np.diff(group[order], prepend=-1) != 0))
                found = s.phrases(at[order], n)
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                    i = order[a]
                    rows.append((int(group[i]), s.langs[int(lang[i])], n, found[a:b].to_pylist(), count[order[a:b]].tobytes()))
        return pd.DataFrame(rows, columns=["group", "lang", "size", "phrases", "counts"])

    def added(table: pa.Table) -> pa.Table:
        """Sums by text; phrases of one text meet in one group."""
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4").astype(np.int64)
        coded = pa.concat_arrays(table.column("phrases").chunks).flatten().dictionary_encode()
        sums = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(sums, np.asarray(coded.indices), counts)
        often = np.flatnonzero(sums >= least)
        n = len(often)
        return pa.table({"lang": pa.repeat(table.column("lang")[0], n), "phrase": coded.dictionary.take(pa.array(often)), "size": pa.repeat(table.column("size")[0], n), "f": sums[often]})

    found = by_shard.cogroup(replies.groupBy("shard")).applyInPandas(texts, "group int, lang string, size int, phrases array<string>, counts binary")
    return checkpoint(found.groupBy("group", "lang", "size").applyInArrow(added, "lang string, phrase string, size int, f long")), totals


def _pair(s: Shard, at: np.ndarray) -> np.ndarray:
    """One number for (language, two words) of a shard; shards hold fewer than 2^21 words and few languages."""
    return (s.languages(at).astype(np.int64) << 42) | (s.seq[at].astype(np.int64) << 21) | s.seq[at + 1]


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, least: int = 100, factor: int = 1000, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    ``docs`` has text and lang (null: ``und``). Texts are lower-cased (A-Z) and split
    at ``. , ; : ! ?`` and the characters 0x0A to 0x0D into pieces, pieces at spaces and
    tabs into words. Candidates are phrases of 2 to 5 words with a = f >= ``least``
    occurrences inside pieces, overlaps included. Cutting one after its first k words gives
    l and r, the occurrences of its parts, and floor(factor a n / (l r)) in
    exact decimals, n being all words of the language; the cut of lowest score
    counts, then the smallest k. A candidate inside a longer one that occurs as
    often is dropped. The first ``top`` of a language by score, then a, then phrase (UTF-8 bytes) stay.

    Null text counts as empty; texts of any length are cut into shards of
    bounded size with the words that phrases need of the next one. Rows that
    repeat count each. An empty table, or one without frequent phrases, gives
    an empty result. Other columns are ignored.
    """
    frequent, totals = frequent_phrases(docs, least)
    words = frequent.withColumn("words", F.split("phrase", " "))
    candidates = words.where("size >= 2")
    cut = candidates.select("lang", "phrase", "size", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = frequent.select("lang", "phrase", "f")
    scored = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    scored = scored.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(small_side(totals), "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"({factor}BD * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # Every part of two or more words of each longer candidate, with the longer one's count.
    long = candidates.where("size >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    long = long.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    covered = long.groupBy("lang", _part(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("f").alias("cover"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").where("cover IS NULL OR cover < a")
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
