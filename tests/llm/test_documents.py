"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabscope.llm import crf, kdtree, mixing, ngram_join, pieces, repair, suffix_dedup
from tabscope.llm.common import connected_components, local_components, shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, id long, n int, h string, `_part` int, bucket int, digest string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "this very passage of some length is shared by several documents of the table, word for word"


def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    out = [" ".join(rng.choice(vocabulary, rng.integers(30, 90))) for _ in range(40)]
    out += [out[0], out[0], out[1] + " tail", "HEAD " + out[2], out[3].upper()]  # copies, near copies
    out += [f"{out[4]} {PASSAGE} {out[5]}", f"{PASSAGE}\n{out[6]}", PASSAGE]
    out += [None, "", " ", "one", "two words", "  spaces  and\ttabs \n\n lines ", "日本語 🎉 \x00 <|endoftext|> z", "a" * 3000, " ".join(rng.choice(vocabulary, 4000))]
    near = out[7].split()
    for i in range(40):  # a group of near copies, larger than a posting list may be
        out.append(" ".join(near[:i] + ["changed"] + near[i + 1 :]) if i < len(near) else out[7])
    return out


def rows():
    out = []
    for i, t in enumerate(texts()):
        lang = [None, "x", "y"][i % 3]
        out.append((1000 - 7 * i, t, lang, [None, "s1", "s2", "hot", "hot", "hot"][i % 6], 0, -1, 99, -5, 7, "h", 3, 4, "d"))
    out.append(out[3])  # a repeated row
    out.append((None, "a row without an id " + PASSAGE, None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets(docs):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] or 0, size(r[1])) for r in rows())
    sums = defaultdict(int)
    for r in rows():
        sums[r[3]] += size(r[1])
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, left, target = set(order), sum(sums.values()), {}
    while free:  # water-filling
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sums[s] <= weight[s] * level}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sums[s] for s in over}
        left -= sum(3 * sums[s] for s in over)
        free -= over
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s])
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= largest / 2 + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_repeats_rows(docs):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.select("doc_id").collect():
        got[r[0]] += 1
    repeated = rows()[3][0]
    assert {k: v for k, v in got.items() if k != repeated} == {k: v for k, v in want.items() if v and k != repeated}


def test_kd_shards_balance(docs):
    got = kdtree.kd_shards(docs, 4).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()
    )
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for shard in range(4):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= 2 * largest
    assert {r["shard"] for r in kdtree.kd_shards(docs, target_bytes=total // 3 + 1).collect()} == {0, 1, 2}


@pytest.mark.parametrize("shards", [4, 7, 16])
def test_kd_shards_are_the_leaves_of_the_tree(docs, shards):
    """Every row's shard and slot against the tree built in plain Python: widest dimension, weighted median, leaves."""
    code = lambda v: zlib.crc32(("\x00" if v is None else v).encode()) // 65536
    ids = [r[0] for r in rows() if r[0] is not None]
    lo, hi = min(ids), max(ids)
    points = []
    for r in rows():
        text = (r[1] or "").encode()
        place = 0 if r[0] is None else (r[0] - lo) * 65536 // (hi - lo + 1)
        points.append({"id": -(2**62) if r[0] is None else r[0], "size": len(text) + 1, "crc": zlib.crc32(text), "at": (min(int(np.log2(len(text) + 1) * 2048), 65535), code(r[3]), code(r[2]), place)})
    span = lambda some, d: max(p["at"][d] for p in some) - min(p["at"][d] for p in some)
    whole, shard_of, used = [max(1, span(points, d)) for d in range(4)], {}, set()

    def split(some, leaves, first):
        if leaves == 1 or not some:
            for p in some:
                shard_of[id(p)] = first
            return
        d = max(range(4), key=lambda d: (span(some, d) / whole[d], -d))
        used.add(d)
        order = sorted(some, key=lambda p: (p["at"][d], p["id"]))
        need, upto = sum(p["size"] for p in some) * (leaves // 2 / leaves), 0
        for p in order:
            upto += p["size"]
            if upto >= need:
                cut = (p["at"][d], p["id"])
                break
        split([p for p in some if (p["at"][d], p["id"]) <= cut], leaves // 2, first)
        split([p for p in some if (p["at"][d], p["id"]) > cut], leaves - leaves // 2, first + leaves // 2)

    split(points, shards, 0)
    assert shards < 16 or len(used) > 1
    want = sorted((p["id"], p["size"], p["crc"], shard_of[id(p)]) for p in points)
    assert sorted((-(2**62) if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in kdtree.kd_shards(docs, shards).collect()) == want


def test_kd_shards_split_equal_texts(spark):
    same = spark.range(640).select(F.col("id").alias("doc_id"), F.lit("equal").alias("text"), F.lit("x").alias("lang"), F.lit("s").alias("source"))
    assert {r["count"] for r in kdtree.kd_shards(same, 16).groupBy("shard").count().collect()} == {40}


@pytest.mark.parametrize("width,threshold,hot", [(3, 0.9, 4096), (5, 0.8, 4096), (5, 0.8, 3)])
def test_similar_groups(docs, width, threshold, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 1024 if hot > 3 else 16)
    got = ngram_join.similar_groups(docs, width, threshold).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows():
        w = WORDS.findall((r[1] or "").translate(lower))
        sets.append((r[0], frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((i or 0, len(s)) for i, s in sets)
    t = Fraction(threshold).limit_denominator(100)
    known = [(i, s) for i, s in sets if i is not None and s]
    group = {i: {i} for i, _ in sets if i is not None}
    for a, (i, x) in enumerate(known):
        for j, y in known[:a]:
            k = len(x & y)
            if k * t.denominator >= t.numerator * (len(x) + len(y) - k) and group[i] is not group[j]:
                group[i] |= group[j]
                for m in group[i]:
                    group[m] = group[i]
    for r in got:
        assert r["component_id"] == (min(group[r["doc_id"]]) if r["doc_id"] is not None else None)
    if width == 5:
        out = ngram_join.one_of_each_group(docs)
        assert out.columns == docs.columns
        kept = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
        assert kept == sorted(i for i, g in group.items() if min(g) == i)


def test_prefix_matches_suffice():
    """Any two sets at the threshold share as many prefix tokens as the less demanding asks for."""
    rng, t = np.random.default_rng(1), Fraction(8, 10)
    frequency = rng.integers(1, 50, ngram_join.BUCKETS)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        y = np.union1d(x[rng.random(len(x)) > 0.08], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64))
        k = len(np.intersect1d(x, y))
        if not len(y) or k * t.denominator < t.numerator * (len(x) + len(y) - k):
            continue
        (px, mx), (py, my) = (ngram_join.prefix(s, frequency, t) for s in (x, y))
        need = min(mx, my)
        cut = [p[: len(p) - m + need] for p, m in ((px, mx), (py, my))]
        assert len(np.intersect1d(*cut)) >= need


def test_suffix_dedup(docs):
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    data = [(r[0], (r[1] or "").encode()) for r in rows()]
    least = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - 49):
                least[b[p : p + 50]] = min(i, least.get(b[p : p + 50], i))
    want, texts_left = set(), {}
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p : p + 50]] < i:
                    gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        want.add((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        texts_left[i] = kept.decode("utf-8", "ignore")
    assert got == want
    out = suffix_dedup.remove_repeats(docs, keep_text=True)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["size"]) for r in out.collect()} == {(r[0], texts_left[r[0]], r[5]) for r in rows()}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data = np.concatenate([data, data[100:700], data[50:160], np.full(200, 97, np.uint8)])
    firsts, counts = np.array([0, 2000, 3100]), np.array([1500, 1000, len(data) - 3149])
    wanted = np.zeros(len(data), bool)
    for f, c in zip(firsts, counts):
        wanted[f : f + c] = True
    order, raw = suffix_dedup.suffix_array(data, wanted), data.tobytes()
    windows = [raw[i : i + 50] for i in order]
    assert sorted(order) == np.flatnonzero(wanted).tolist() and windows == sorted(windows)
    lcp = suffix_dedup.common_prefixes(data, order, firsts, counts)
    common = lambda a, b: next((k for k in range(50) if a[k] != b[k]), 50)
    assert lcp[1:].tolist() == [common(a, b) for a, b in zip(windows, windows[1:])]


def test_classes_merge_across_arrays(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 300)
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 123, 900).astype(np.uint8))
    strings = list(dict.fromkeys(base[a : a + n] for a, n in zip(rng.integers(0, 800, 60).tolist(), rng.integers(50, 80, 60).tolist())))
    strings = [s for s in strings if len(s) >= 50]
    least = rng.integers(0, 1000, len(strings))
    of, docs = np.arange(len(strings)), least
    masks = suffix_dedup.covered_masks(strings, least, of, docs)
    low = {}
    for s, d in zip(strings, least.tolist()):
        for p in range(len(s) - 49):
            low[s[p : p + 50]] = min(d, low.get(s[p : p + 50], d))
    want = [sum((low[s[p : p + 50]] < d) << p for p in range(len(s) - 49)) for s, d in zip(strings, least.tolist())]
    assert masks.tolist() == want


def test_repair_files(docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    where = repair.write_ids(docs, path, shared_path(spark, "test-ids"), shard_bytes=8000)
    tokenizer = Tokenizer.from_file(path)
    data = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in data:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in repair.read_digests(spark, where).collect()), key=key) == want
    for r in repair.read_ids(spark, where).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"]
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).count() > 2


def test_repair_random_access():
    rng = np.random.default_rng(4)
    ids = rng.choice(50, 20_000, p=np.arange(50, 0, -1) / 1275).astype(np.int32)
    ids[5000:9000] = ids[:4000]
    lengths = np.array([5000, 1, 4999, 10_000])
    shard = repair.Shard(repair.pack(np.array([3, 4, -(2**63), 9]), ids, lengths, 60))
    assert len(shard.rules) > 20 and len(shard.seq) < 0.7 * len(ids)
    assert (shard.expand(shard.seq) == ids).all()
    ends = np.cumsum(lengths)
    for i, a, b in [(0, 0, 5000), (0, 17, 4000), (1, 0, 1), (2, 4990, 4999), (3, 5000, 5001), (3, 1, None)]:
        own = ids[ends[i] - lengths[i] : ends[i]]
        assert (shard.document(i, a, b) == own[a:b]).all()


def test_pieces_round_trip_and_scores(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = pieces.Vocabulary(path)
    out = pieces.encode(docs, vocabulary)
    assert out.columns == [*docs.columns, "piece_ids"]
    got = {r["doc_id"]: r["decoded"].decode() for r in pieces.decode(out, vocabulary).collect()}
    assert got == {r[0]: r[1] or "" for r in rows()}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    encoder = pieces.Encoder(vocabulary)
    for word in {w for t in texts()[:12] for w in t.split()} | {"x" * 130, "lower" * 30}:
        text = "▁" + word
        best = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = max(best[i] + score.get(text[i:j], -1e17) for i in range(max(0, j - 16), j))
        ids, _ = encoder.encode([word])
        assert sum(sp.get_score(int(i)) for i in ids) == pytest.approx(best[-1])
        assert "".join(sp.id_to_piece(int(i)) for i in ids) == text


def test_crf_learns_languages(spark):
    rng = np.random.default_rng(6)
    parts = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["krz", "sch", "dor", "ung"], "cc": ["éau", "ple", "ieu", "oir"]}
    word = lambda x: "".join(rng.choice(parts[x], rng.integers(1, 4)))
    made = []
    for i in range(240):
        lang = list(parts)[i % 3]
        made.append((i, " ".join(word(lang) for _ in range(rng.integers(3, 60))), lang))
    train = spark.createDataFrame(made + [(900, None, "aa"), (901, "12 34", "bb"), (902, "balo", None)], "doc_id long, text string, lang string")
    model = crf.fit(train.where(~crf.held_out()))
    assert model.labels == ["aa", "bb", "cc"]
    odd = [(1000, None, "s"), (1001, "", "s"), (1002, "12 ² !?", "s"), (None, "krzsch dor", "s"), (1003, "balo " * 5000, "s"), (1003, "balo", "s")]
    mixed = train.select("doc_id", "text", F.lit("s").alias("score")).union(spark.createDataFrame(odd, "doc_id long, text string, score string"))
    got = crf.predict(mixed, model).collect()
    assert len(got) == 249 and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["lang_pred"])
    held = {r["doc_id"] for r in train.where(crf.held_out()).collect()}
    assert held == {i for i in [*range(240), 900, 901, 902] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([by[i] == {lang} for i, _, lang in made if i in held]) > 0.97
    assert by[1000] == by[1001] == by[1002] == by[901] == {"und"} and by[None] == {"bb"} and by[1003] == {"aa"}
    # a code-switched text: most words get the language of their part
    post, _ = crf.label_words(model, [" ".join([word("aa") for _ in range(8)] + [word("bb") for _ in range(8)])], {}, [])
    assert (post.argmax(axis=1) == [0] * 8 + [1] * 8).mean() > 0.8


def test_forward_backward_is_exact():
    rng = np.random.default_rng(7)
    e, s, a = rng.normal(size=(40, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    first = np.zeros(40, bool)
    first[[0, 1, 17]] = True
    got, want = crf.forward_backward(e, s, a, first), np.zeros((40, 3))
    for lo, hi in [(0, 1), (1, 17), (17, 40)]:
        alpha = [np.exp(s + e[lo])]
        for t in range(lo + 1, hi):
            alpha.append((alpha[-1] @ np.exp(a)) * np.exp(e[t]))
        beta = np.ones(3)
        for t in range(hi - 1, lo - 1, -1):
            p = alpha[t - lo] * beta
            want[t] = p / p.sum()
            beta = np.exp(a) @ (np.exp(e[t]) * beta)
    assert np.allclose(got, want)


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 300, (200, 2)).tolist() + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    a, b = np.array(pairs).T
    want = local_components(641, a, b)
    assert got == {int(i): int(want[i]) for i in {x for p in pairs for x in p if p[0] != p[1]}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = crf.fit(empty)
    outs = [
        mixing.mix_sources(empty), mixing.mixed(empty), kdtree.kd_shards(empty), ngram_join.similar_groups(empty), ngram_join.one_of_each_group(empty),
        suffix_dedup.remove_repeats(empty), suffix_dedup.remove_repeats(empty, keep_text=True), repair.encode_and_read(empty, path),
        crf.predict(empty, model), pieces.decode(pieces.encode(empty, vocabulary), vocabulary),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)
