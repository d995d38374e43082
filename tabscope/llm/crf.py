"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

#: Bounds of the training sample: labelled rows of a language, and windows and words taken from each.
SAMPLE_ROWS = 400
WINDOWS, WINDOW_WORDS = 4, 40
FEATURES = 1 << 16
ROUNDS = 40
CACHE_WORDS = 200_000
SLICE_CHARS = 1 << 19
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Lower-case words that hold a letter."""
    words = WORDS.findall(text.lower()) if text else []
    if words and not text.isascii():
        words = [w for w in words if w.isalpha() or any(map(str.isalpha, w))]
    return words


def windows_of(words: list[str]) -> list[list[str]]:
    """Up to ``WINDOWS`` windows spread evenly over all words."""
    if len(words) <= WINDOWS * WINDOW_WORDS:
        return [words[i : i + WINDOW_WORDS] for i in range(0, len(words), WINDOW_WORDS)]
    step = (len(words) - WINDOW_WORDS) / (WINDOWS - 1)
    return [words[int(i * step) : int(i * step) + WINDOW_WORDS] for i in range(WINDOWS)]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, starts): character 2- and 3-grams, affixes of up to 3, and the word's lexicon.

    Each word is read between boundary marks, so grams that touch a mark are
    affixes. The lexicon gives one more feature: the language whose list holds
    the word, or none.
    """
    marked = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 2) - 1
    rows, ids = [], []
    for n in (2, 3, 4):
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        ok = owner[: len(h)] == owner[n - 1 :]
        if n == 4:
            ok &= (codes[: len(h)] == 2) | (codes[n - 1 :] == 3)
        at = np.flatnonzero(ok)
        rows.append(owner[at])
        ids.append((h[at] % np.uint64(FEATURES)).astype(np.int64))
    rows.append(np.arange(len(words)))
    ids.append(FEATURES + 1 + np.array([lexicon.get(w, -1) for w in words], np.int64))
    row, feature = np.concatenate(rows), np.concatenate(ids)
    order = np.argsort(row, kind="stable")
    return feature[order], np.searchsorted(row[order], np.arange(len(words)))


def forward_backward(emission: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every position of concatenated sequences.

    ``emission`` has log scores (positions, labels); ``first`` marks sequence
    starts, where the start scores replace the transition. The positions are cut
    into as many chunks as a chunk has positions. One pass multiplies the step
    matrices of all chunks together, a pass over chunks carries the forward and
    backward vectors across, and two passes fill the chunks, all side by side.
    """
    n, k = emission.shape
    if not n:
        return emission
    size = int(np.ceil(np.sqrt(n)))
    chunks = -(-n // size)
    e = np.ones((chunks * size, k))
    e[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
    e = np.maximum(e, 1e-30).reshape(chunks, size, k)
    new = np.zeros(chunks * size, bool)
    new[:n] = first
    new[n:] = True  # the padding doesn't reach back
    new = new.reshape(chunks, size)
    a = np.exp(trans - trans.max())
    s = np.exp(start - start.max())
    product = np.broadcast_to(np.eye(k), (chunks, k, k)).copy()
    for t in range(size):
        cut = new[:, t]
        moved = product @ a
        if cut.any():
            moved[cut] = product[cut].sum(axis=2)[:, :, None] * s
        product = moved * e[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    fore, back = np.empty((chunks, k)), np.empty((chunks, k))
    v = np.ones(k) / k
    for c in range(chunks):
        fore[c] = v
        v = v @ product[c]
        v /= v.sum()
    v = np.ones(k) / k
    for c in range(chunks - 1, -1, -1):
        back[c] = v
        v = product[c] @ v
        v /= v.sum()
    alpha = np.empty_like(e)
    v = fore
    for t in range(size):
        cut = new[:, t]
        moved = v @ a
        moved[cut] = s
        v = moved * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    v = back
    for t in range(size - 1, -1, -1):
        alpha[:, t] *= v
        w = e[:, t] * v
        v = w @ a.T
        v[new[:, t]] = 1.0
        v /= v.sum(axis=1, keepdims=True)
    post = alpha.reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


class Model:
    """Weights of features, transitions and starts, with the lexicon."""

    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        k = len(labels)
        self.lexicon: dict[str, int] = {}
        self.weights = np.zeros((FEATURES + 1 + k, k))
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        ids, starts = features(words, self.lexicon)
        return np.add.reduceat(self.weights[ids], starts, axis=0)

    def fit(self, samples: list[tuple[str, list[str]]], seed: int = 3) -> Model:
        """Maximises the likelihood of code-switched sequences made of windows of one label each.

        Full-batch Adagrad with a small L2 penalty. Windows are dealt at random
        into sequences of five, so transitions learn when the language changes.
        """
        k = len(self.labels)
        code = {x: i for i, x in enumerate(self.labels)}
        seen = Counter((w, code[lab]) for lab, words in samples for w in words)
        total: Counter = Counter()
        for (w, _), c in seen.items():
            total[w] += c
        self.lexicon = {w: lab for (w, lab), c in seen.items() if total[w] >= 3 and c >= 0.9 * total[w]}
        order = np.random.default_rng(seed).permutation(len(samples))
        index: dict[str, int] = {}
        at, y, first = [], [], []
        for i, s in enumerate(order):
            lab, words = samples[s]
            first += [i % 5 == 0] + [False] * (len(words) - 1)
            y += [code[lab]] * len(words)
            at += [index.setdefault(w, len(index)) for w in words]
        at, y, first = np.array(at, np.int64), np.array(y, np.int64), np.array(first, bool)
        if not len(at):
            return self
        ids, starts = features(list(index), self.lexicon)
        lengths = np.diff(np.append(starts, len(ids)))
        owner = np.repeat(np.arange(len(index)), lengths)
        truth = np.eye(k)[y]
        inner = np.flatnonzero(~first[1:]) + 1
        counts = np.zeros((k, k))
        np.add.at(counts, (y[inner - 1], y[inner]), 1)
        past = [np.full_like(x, 1e-3) for x in (self.weights, self.trans, self.start)]
        for _ in range(ROUNDS):
            emission = np.add.reduceat(self.weights[ids], starts, axis=0)[at]
            post = forward_backward(emission, self.start, self.trans, first)
            gap = (truth - post) / len(at)
            by_word = np.stack([np.bincount(at, gap[:, j], len(index)) for j in range(k)], axis=1)
            by_feature = np.stack([np.bincount(ids, by_word[owner, j], len(self.weights)) for j in range(k)], axis=1)
            # expected transitions, from neighbouring posteriors under the current potentials
            pair = post[inner - 1][:, :, None] * np.exp(self.trans)[None] * post[inner][:, None, :]
            expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            grads = (by_feature - 1e-7 * self.weights, (counts - expected) / len(at) - 1e-5 * self.trans, gap[first].sum(axis=0))
            for x, g, p in zip((self.weights, self.trans, self.start), grads, past):
                p += g * g * 1e4
                x += 0.5 * g * 1e2 / np.sqrt(p)
        return self


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on at most ``sample_rows`` rows of each lang of ``docs`` (doc_id, text, lang).

    Rows with a null or letterless text or a null lang teach nothing; the rows
    of smallest hash of doc_id are taken and cut into windows where they lie.
    """
    rows = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    # A hash threshold leaves about four times the wanted rows of each language before they are ranked,
    # so what meets in one task doesn't grow with the table. One row a label reaches the driver.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    if counts:
        least = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 4 * sample_rows / n) * (1 << 40)))])
        rows = rows.where(draw < least[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(draw, F.xxhash64("doc_id"), "doc_id")
    rows = rows.where("text RLIKE '\\\\p{L}'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(lab, " ".join(w)) for lab, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) for w in windows_of(words_of(t)) if w]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["lang", "words"])

    samples = sorted((r["lang"], r["words"].split(" ")) for r in rows.select("lang", "text").mapInArrow(cut, "lang string, words string").collect())
    return Model(sorted({lab for lab, _ in samples})).fit(samples)


def label_words(model: Model, texts: list[str | None], cache: dict[str, int], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors of all words, number of words of each text). The cache keeps words' scores between calls."""
    words = [words_of(t) for t in texts]
    if len(cache) > CACHE_WORDS:
        cache.clear()
        scores.clear()
    new = list({w for ws in words for w in ws if w not in cache})
    for w in new:
        cache[w] = len(cache)
    if new:
        scores += [model.emissions(new[i : i + 16_384]) for i in range(0, len(new), 16_384)]
        scores[:] = [np.concatenate(scores)]
    lengths = np.array([len(ws) for ws in words], np.int64)
    at = np.array([cache[w] for ws in words for w in ws], np.int64)
    first = np.zeros(len(at), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    emission = scores[0][at] if len(at) else np.zeros((0, len(model.labels)))
    return forward_backward(emission, model.start, model.trans, first), lengths


def with_language(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``label`` and ``score`` for its whole texts.

    Every word gets posterior label probabilities by forward-backward; the
    label of the largest sum is taken, score is its mean. A null or empty text,
    one without a letter, or a model without labels gives ``und`` with score 0.
    Other columns are kept, ones of the two names are replaced; rows that
    repeat count each; an empty table gives an empty result.
    """
    docs = docs.drop(label, score).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, scores = shared.value, {}, []
        for b in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0)) + 64
            piece = np.cumsum(size) // SLICE_CHARS
            edges = np.flatnonzero(np.diff(piece, prepend=-1)).tolist() + [b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                part = b.slice(lo, hi - lo)
                best, mean = np.full(hi - lo, -1), np.zeros(hi - lo)
                if model.labels:
                    post, lengths = label_words(model, part.column("text").to_pylist(), cache, scores)
                    some = np.flatnonzero(lengths)
                    if len(some):
                        sums = np.add.reduceat(post, (np.cumsum(lengths) - lengths)[some], axis=0)
                        best[some] = sums.argmax(axis=1)
                        mean[some] = np.clip(sums.max(axis=1) / lengths[some], 0, 1)
                names = pa.array([model.labels[i] if i >= 0 else UNKNOWN for i in best], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, names, pa.array(mean)], [*part.schema.names, label, score])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(label, StringType()).add(score, DoubleType()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text); see ``with_language``. A null doc_id is kept."""
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "lang_pred", "score")


def held_out() -> Column:
    """Rows that teach nothing: the unsigned crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
