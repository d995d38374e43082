"""How far sources diverge in their words: one-hot level products give the joint count tables of all pairs of groups."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_side

BLOCK_TERMS = 1_024
TILE = 2_048  # columns of a tile of the product
UNIT = 1_000_000_000
HALF = 30  # bits of the low part of a price
ENTRIES = 500_000  # counts that a task holds before it passes them on
SLICE_BYTES = 4 << 20
#: On UTF-8 bytes: every byte of a character beyond ASCII belongs to a term.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in parts of bounded size, cut where no term is."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        gap = NO_TERM.search(raw, at + SLICE_BYTES)
        if not gap:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, rows that hold it) of the texts, passed on whenever many counts are held."""
    words: dict[tuple, Counter] = {}
    rows: dict[tuple, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in words.items():
            n, texts = len(found), rows[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, n), pa.repeat(source, n), pa.array(found, pa.binary(), size=n).cast(pa.string()), pa.array(np.fromiter(found.values(), np.int64, n)), pa.array(np.fromiter(map(texts.__getitem__, found), np.int64, n))],
                ["lang", "source", "term", "c", "d"],
            )
        words.clear()
        rows.clear()

    held = 0
    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
            key, own = (lang, source), set()
            count = words.setdefault(key, Counter())
            before = len(count)
            for part in _slices(text.as_py().lower()):
                found = TERM.findall(part)
                count.update(found)
                own.update(found)
            rows.setdefault(key, Counter()).update(own)
            held += len(count) - before
            if held > ENTRIES:
                yield from flush()
                held = 0
    yield from flush()


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly; ``total`` is the group's count plus the number of terms."""
    if not len(count) or int(count.max()) < (1 << 62) // UNIT:
        return 1 + UNIT * (count.astype(np.int64) + 1) // total
    return np.array([1 + UNIT * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most UNIT + 1, so the square fits 64 bits."""
    return (p - q) * (p - q) // q


def joint_tables(term: np.ndarray, column: np.ndarray, n_terms: int, n_columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(column, column, number of terms): the nonzero entries of X'X for the indicator matrix X of (term, column).

    A column is one count level of one group, so the entries of two groups'
    columns are their joint table. Tiles of columns are multiplied one by one;
    sums of at most ``n_terms`` ones are exact in single precision up to 2^24.
    """
    order = np.argsort(column, kind="stable")
    term, column = term[order], column[order]
    tiles = []
    for lo in range(0, n_columns, TILE):
        a, b = np.searchsorted(column, [lo, lo + TILE])
        x = np.zeros((n_terms, min(TILE, n_columns - lo)), np.float32 if n_terms < 1 << 24 else np.float64)
        x[term[a:b], column[a:b] - lo] = 1
        tiles.append((lo, x))
    for lo, x in tiles:
        for lo2, y in tiles:
            product = x.T @ y
            i, j = np.nonzero(product)
            yield i + lo, j + lo2, product[i, j].astype(np.int64)


def block_prices(rows: pd.DataFrame, groups: pd.DataFrame, n_lang: int, keep: int) -> pd.DataFrame:
    """Both parts for the terms of one block of a language.

    ``rows`` has term, source, count of every positive count; ``groups`` has
    source, total, n_terms of every group of the language. Pair prices are returned
    as sums over the block in two halves; term prices as the ``keep``
    best of each group.
    """
    groups = groups.sort_values("source", kind="stable")
    sources = groups["source"].to_numpy()
    n_groups, terms = len(groups), np.unique(rows["term"].to_numpy())
    group = pd.Series(np.arange(n_groups), index=sources)[rows["source"]].to_numpy()
    term = np.searchsorted(terms, rows["term"].to_numpy())
    count = rows["count"].to_numpy()
    total = (groups["total"] + groups["n_terms"]).to_numpy()
    # One column a (group, count level), the level 0 of every group included.
    dense_group, dense_term = np.divmod(np.arange(n_groups * len(terms)), len(terms))
    dense_count = np.zeros((n_groups, len(terms)), np.int64)
    dense_count[group, term] = count
    keys = np.stack([dense_group, dense_count.ravel()], axis=1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    column = np.empty(len(order), np.int64)
    column[order] = np.cumsum(new) - 1
    level = keys[order][new]
    p = probability(level[:, 1], total[level[:, 0]])
    high, low = np.zeros(n_groups * n_groups, np.int64), np.zeros(n_groups * n_groups, np.int64)
    for i, j, n in joint_tables(dense_term, column, len(terms), len(level)):
        value = price(p[i], p[j])
        pair = level[i, 0] * n_groups + level[j, 0]
        np.add.at(high, pair, n * (value >> HALF))
        np.add.at(low, pair, n * (value & ((1 << HALF) - 1)))
    a, b = np.divmod(np.arange(n_groups * n_groups), n_groups)
    apart = a != b
    pairs = pd.DataFrame({"source": sources[a[apart]], "part": "pair", "item": sources[b[apart]], "high": high[apart], "low": low[apart]})
    own = probability(count, total[group])
    in_lang = dense_count.sum(axis=0)
    q = probability(in_lang, np.full(len(terms), n_lang + int(groups["n_terms"].iloc[0]) if n_groups else 1))[term]
    more = own > q
    found = pd.DataFrame({"source": sources[group[more]], "part": "term", "item": terms[term[more]], "low": price(own[more], q[more])})
    found["high"] = 0
    found["bytes"] = [t.encode() for t in found["item"]]
    found = found.sort_values(["source", "low", "bytes"], ascending=[True, False, True], kind="stable").groupby("source", sort=False).head(keep)
    return pd.concat([pairs, found[list(pairs.columns)]], ignore_index=True)


def source_divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of every source of a language.

    ``docs`` has text, lang, source; nulls are read as ''. Terms are runs of
    ASCII letters and characters beyond ASCII, A-Z lower-cased; a language
    keeps those in at least ``min_docs`` of its rows. With V kept terms and N of
    their occurrences in a group, p = 1 + floor(10^9 (count + 1) / (N + V)).
    Part ``pair``: for each other source, the sum over all kept terms of
    floor((p - q)^2 / q) with its q. Part ``term``: the ``top_terms`` kept terms of the
    group with p over the language's q, by the same price. Ranks order by value
    descending, then by the item's UTF-8 bytes.

    Terms are dealt in blocks of about 1,024; in each the one-hot matrix of
    (group, count level) columns, times its transpose in tiles, counts the
    terms at every pair of levels, and each entry is priced once. All sums
    are exact integers. A task holds one block's matrix; tables of the
    languages are broadcast while they have at most 10,000 rows.

    A group without terms is there with its pairs; a language of one source has
    no pairs. Rows that repeat count each. Empty texts add their group. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, c long, d long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("c").alias("count"), F.sum("d").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = checkpoint(counts.withColumn("docs", in_lang).where(F.col("docs") >= min_docs).select("lang", "source", "term", "count"))

    n_terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("n_lang")).join(n_terms, "lang")
    langs = checkpoint(langs.withColumn("blocks", F.ceil(F.col("n_terms") / BLOCK_TERMS).cast("int")))
    few = small_side(langs)
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(few, "lang", "left")
    # New names of the key columns: both sides of the cogroup come from the same table.
    groups = checkpoint(groups.select(F.col("lang").alias("lang"), F.col("source").alias("source"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "n_lang", "blocks"))

    left = kept.join(few.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    right = groups.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def both(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "high": [], "low": []})
        out = block_prices(left, right, int(right["n_lang"].iloc[0]), top_terms)
        out.insert(0, "lang", key[0])
        return out

    found = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInPandas(both, "lang string, source string, part string, item string, high long, low long")
    # Languages without kept terms: the price of every pair is 0.
    bare = groups.where("blocks IS NULL").select("lang", "source")
    other = bare.select(F.col("lang").alias("lang"), F.col("source").alias("item"))
    bare = bare.join(other, "lang").where("source <> item")
    bare = bare.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    value = (wide("high") * F.lit(1 << HALF).cast("decimal(12,0)") + wide("low")).cast("long")
    summed = found.unionAll(bare).groupBy("lang", "source", "part", "item").agg(value.alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms)).select("lang", "source", "part", "item", "value", "rank")
