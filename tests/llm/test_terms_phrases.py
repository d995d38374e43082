"""Exact search, source divergence and phrase collocations against brute force, and the registered queries on small tables."""

import math
import re
from collections import Counter, defaultdict
from contextlib import contextmanager

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from tokenizers import Tokenizer

from tabscope.llm import common, divergence, ngram_join, phrases, pieces, queries, repair, term_search

DOCS = "doc_id long, text string, lang string, source string, n_chars int, term string, block int, phrase string, a int, size int"


@contextmanager
def in_workers(module):
    """Patched constants of the module reach the workers too."""
    cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def doc_rows():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdeF"), rng.integers(1, 4))) for _ in range(25)] + ["Ärger", "日本", "don't", "x-1"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for i in range(60):
        words = rng.choice(vocabulary, int(rng.integers(5, 60)), p=weight / weight.sum())
        gaps = rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;:"], len(words))
        out.append((i, "".join(w + g for w, g in zip(words, gaps)), [None, "aa", "bb", "bb"][i % 4], ["s1", "hot", "hot", None, "s2"][i % 5], 0, "t", 1, "p", 2, 3))
    out += [(90 + i, "New York City hall stands here. in New York City they say", "aa", "hot", 0, None, None, None, None, None) for i in range(12)]
    out += [(None, None, "aa", "s9", 0, None, None, None, None, None), (70, "", "cc", "s1", 0, None, None, None, None, None), (71, " .,\n", "cc", "s2", 0, None, None, None, None, None)]
    out += [(72, "lonely words", "dd", "s1", 0, None, None, None, None, None), (73, " ".join(["again"] * 700), "bb", "s1", 0, None, None, None, None, None)]
    return [*out, out[5], out[5]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3).cache()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_phrases(rows, least, top):
    found, totals = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 6):
                found[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, b[2].decode(), -b[1], b[3], b[4], totals[lang], -b[0]) for i, b in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_collocations(docs, small, monkeypatch):
    for name, value in {"SHARD_WORDS": 40, "SLICE_BYTES": 30, "BUCKET_ENTRIES": 100, "PRINT": 1}.items() if small else ():
        monkeypatch.setattr(phrases, name, value)  # many shards, pieces over several of them, many equal prints
    with in_workers(phrases):
        got = phrases.collocations(docs, least=8, top=25)
        rows = sorted(tuple(r) for r in got.collect())
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows == brute_phrases(doc_rows(), 8, 25)
    assert any(r[2] == "new york city hall stands" for r in rows) and not any(r[2] == "york city hall" for r in rows)


def test_equal_fingerprints_are_parted():
    words = [b"w%d" % i for i in range(6)]
    seq = np.array([1, 2, 0, 1, 3, 0, 1, 2, 0, 4, 5, 0], np.int32)
    s = phrases.Shard.unpack(phrases.Shard(seq, len(seq), words, np.array([0, 9]), np.array([0, 1]), ["x", "y"]).pack())
    at = s.starts(2)
    assert at.tolist() == [0, 3, 6, 9]
    prints, counts, first = s.distinct(at, 2, np.zeros(4, np.uint64))  # all prints collide
    assert sorted(zip(counts.tolist(), s.phrases(first, 2).to_pylist())) == [(1, "w0 w2"), (1, "w3 w4"), (2, "w0 w1")]
    assert (s.fingerprints(at, 2, s.prefixes())[[0, 0]] == s.fingerprints(at, 2, s.prefixes())[[0, 2]]).all()


def brute_divergence(rows, least=3, top=200):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        g = (r[2] or "", r[3] or "")
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))
        groups.add(g)
        counts[g].update(w)
        seen[g[0]].update(set(w))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        own = p(counts[lang, source])
        pairs = [(sum(f(own[t], q[t]) for t in kept), g) for la, g in groups if la == lang and g != source for q in [p(counts[la, g])]]
        whole = p(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        terms = [(f(own[t], whole[t]), t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(docs, small, monkeypatch):
    for name, value in {"BLOCK_TERMS": 5, "TILE": 7, "ENTRIES": 20, "SLICE_BYTES": 16}.items() if small else ():
        monkeypatch.setattr(divergence, name, value)
    with in_workers(divergence):
        got = divergence.source_divergence(docs, top_terms=4 if small else 200)
        rows = sorted(tuple(r) for r in got.collect())
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows == brute_divergence(doc_rows(), top=4 if small else 200)
    assert ("cc", "s1", "pair", "s2", 0, 1) in rows  # a language without kept terms


def test_joint_tables_are_exact(monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    rng = np.random.default_rng(1)
    level = rng.integers(0, 4, (9, 3))
    term, column = np.nonzero(np.ones_like(level))[0], (np.arange(3) * 4 + level).ravel()
    got = Counter()
    for i, j, n in divergence.joint_tables(term, column, 9, 12):
        got.update(dict(zip(zip(i.tolist(), j.tolist()), n.tolist())))
    assert got == Counter((a, b) for row in column.reshape(9, 3).tolist() for a in row for b in row)


def vector_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) * (rng.random((300, 12)) < 0.6)
    x[200:250] = x[7]  # ties
    out = [(i, [float(v) for v in row], 1, 2, 3, 4.0) for i, row in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [nan] * 12, [None] + [1.0] * 11, [-inf] * 12]
    out += [(400 + i, v, 1, 2, 3, 4.0) for i, v in enumerate(bad)]
    out += [(410, [0.0] * 12, 1, 2, 3, 4.0), (420, [1.5, -2.25], 1, 2, 3, 4.0), (421, [], 1, 2, 3, 4.0), (None, [1.0] * 12, 1, 2, 3, 4.0)]
    out += [(430, [1e200, -1e200, 3.0], 1, 2, 3, 4.0), (431, [4e9, 5e9], 1, 2, 3, 4.0), (440, [-1e300, 1e300], 1, 2, 3, 4.0)]
    return [*out, out[10], out[20], (30, [9.0] * 12, 1, 2, 3, 4.0)]  # a repeated row, a repeated query, another vector of a query


def brute_products(rows, step, k):
    fine = [(r[0], [math.floor(1024 * v) if abs(v) < 1e300 else int(v) * 1024 for v in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    first = {}
    for (i, w), r in zip(fine, (r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1]))):
        if i % step == 0 and (i not in first or r[1] < first[i][0]):
            first[i] = (r[1], w)
    most = 2**63 - 1
    out = []
    for q, (_, w) in first.items():
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(w, x)))), i) for i, x in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(32_768, 8_192), (40, 7)])
def test_top_products(spark, block, group, monkeypatch):
    monkeypatch.setattr(term_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(term_search, "QUERY_ROWS", group)
    vectors = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>, id int, block int, group int, score double").repartition(3)
    got = term_search.top_products(vectors, "vec_id % 10 = 0", 6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_products(vector_rows(), 10, 6)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in term_search.top_products(few, "vec_id % 10 = 0").collect()] == [(0, 1, 1, 5 * 1024 * 1024)]


def test_empty_tables_and_no_frequent_phrases(spark, docs):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).collect() == [] and divergence.source_divergence(empty).collect() == []
    assert term_search.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 10 = 0").collect() == []
    assert phrases.collocations(docs, least=10_000).collect() == []
    blank = spark.createDataFrame([(1, None, "aa", "s")], "doc_id long, text string, lang string, source string")
    assert phrases.collocations(blank, least=1).collect() == [] and divergence.source_divergence(blank).collect() == []


def complements(n):
    """Two words of ``n`` letters, each the other's complement, that polynomials modulo 2^64 can't tell apart."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 1024, 4096])
def test_words_of_one_polynomial(spark, n):
    x, y = complements(n)
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        ids, lengths = repair.Encoder(f.read()).encode([x, y, f"a {y} b {x}"])
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch([x, y, f"a {y} b {x}"], add_special_tokens=False)]
    assert ids.tolist() == sum(whole, []) and lengths.tolist() == [len(w) for w in whole]
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.decode_ids(vocabulary, *pieces.Encoder(vocabulary).encode([x, y])) == [x.encode(), y.encode()]
    rows = spark.createDataFrame([(1, x), (2, y), (3, f"{x} q"), (4, f"{y} q")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(rows).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_equal_hashes_are_compared(monkeypatch):
    texts = ["ones twos-and-more  threesomely onesomely", "twosomely", "", "threesomely 44 ones twosomely onesomely", "onesomely"]
    monkeypatch.setattr(common, "span_hashes", lambda data, starts, ends, real=common.span_hashes: np.where(ends - starts > 8, np.uint64(7), real(data, starts, ends)))  # long words collide
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        encoder = repair.Encoder(f.read())
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    own = pieces.Encoder(vocabulary)
    for _ in range(2):
        ids, lengths = encoder.encode(texts)
        assert ids.tolist() == sum((Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts), [])
        assert pieces.decode_ids(vocabulary, *own.encode(texts)) == [t.encode() for t in texts]


def test_spans_of_all_lengths():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.integers(0, 2500, 800)
    ends = starts + rng.integers(0, 400, 800)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    hashes = common.span_hashes(data, starts, ends)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    other = rng.permutation(800)
    got = common.differing(data, starts, ends - starts, np.append(data, np.zeros(common.PAD, np.uint8)), starts[other], (ends - starts)[other])
    assert got.tolist() == [words[i] != words[j] for i, j in enumerate(other)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small documents, embeddings and pages, and the same tables without rows."""
    full, bare = (str(tmp_path_factory.mktemp(x)) for x in ("full", "bare"))
    rng = np.random.default_rng(8)
    documents = spark.createDataFrame([(i, *r[1:5]) for i, r in enumerate(doc_rows())], "doc_id long, text string, lang string, source string, n_chars int")
    x = rng.normal(size=(120, 8))
    x[60:80] = x[:20] + rng.normal(size=(20, 8)) * 0.02
    vectors = spark.createDataFrame([(i, v.tolist(), [0, 1, None][i % 3]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(i, f"https://h{i % 3}.org/{i}", f"<p>page {i}</p>" * 30) for i in range(200)], "page_id long, url string, html string")
    for name, df in (("documents", documents), ("embeddings", vectors), ("pages", pages)):
        df.coalesce(1).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{bare}/{name}.parquet")
    return full, bare


COLUMNS = {
    "op1": "query_id rank vec_id score", "op2": "page_id volume offset length sha256 status", "op3": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id held_out lang_pred score", "op5": "doc_id n_bytes n_removed n_spans kept_sha256", "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id n_shingles component_id", "op8": "vec_id n_links component_id kept", "op9": "doc_id n_pieces ids_crc32", "op10": "doc_id size source_size target taken",
    "op11": "lang rank phrase a l r n score", "op12": "lang source part item value rank", "op13": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_queries(spark, tables, name):
    full, bare = tables
    out = queries.QUERIES[name](spark, full)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    rows = out.collect()
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{full}/{t}.parquet/*.parquet')")
        rel = con.execute(queries.ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(out.columns)
        want = [tuple(dict(zip(names, r))[c] for c in out.columns) for r in rel.fetchall()]
        near = lambda rs: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs), key=str)
        assert near(rows) == near(want)
    elif "doc_id" in out.columns:
        assert sorted(r["doc_id"] for r in rows) == list(range(len(doc_rows())))
    if name.startswith("op4_"):
        assert any(r["held_out"] for r in rows) and all(r["lang_pred"] in ("aa", "bb", "cc", "dd", "und") and 0 <= r["score"] <= 1 for r in rows)
    if name.startswith("op6_"):
        assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in rows)
    assert queries.QUERIES[name](spark, bare).collect() == []
