"""The pipeline's stages against plain Python, one after another."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tabscope.llm import ngram_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
PARTS = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["krz", "sch", "dor", "ung"], "cc": ["\u00e9au", "ple", "ieu", "oir"]}


def rows():
    rng = np.random.default_rng(6)
    say = lambda x, n: " ".join("".join(rng.choice(PARTS[x], rng.integers(2, 5))) for _ in range(n))
    out = []
    for i in range(90):
        lang = list(PARTS)[i % 3]
        out.append((i, say(lang, int(rng.integers(20, 60))), lang, ["s1", "s2", "s3", None][int(rng.integers(0, 4))], i))
    passage = say("aa", 25)
    out += [(100, f"{say('aa', 9)} {passage}", "aa", "s1", 0), (101, f"{passage} {say('bb', 60)}", "bb", "s2", 0)]
    out += [(110, " ".join(say(x, 12) for x in PARTS), None, "s1", 0)]  # a third of each language
    out += [(120, None, "aa", "s1", 0), (121, "", "bb", "s1", 0), (122, "12 34 !?", "cc", "s2", 0)]
    out += [(None, say("aa", 30), None, s, 1) for s in ("s1", "s2", "s3", None, "s1", "s2")]
    out += [(130, out[4][1] + " krz", "bb", "s1", 0), (130, say("cc", 40), "cc", "s1", 0), (130, say("cc", 44), "cc", "s2", 0)]  # one links to 4, two to nothing
    return [*out, out[7], out[10]]  # repeated rows


def unlinked(data, width=5, t=0.8):
    """One row of each group of similar texts: the smallest (doc_id, digest of the text)."""
    known = {}
    for r in data:
        if r[0] is not None:
            known[r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()] = r
    keys = sorted(known)
    sets = []
    for k in keys:
        w = WORDS.findall((known[k][1] or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    low = list(range(len(keys)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x & y and len(x & y) >= t * len(x | y) - 1e-9:
                p, q = low[a], low[b]
                low = [min(p, q) if c in (p, q) else c for c in low]
    return [known[k] for a, k in enumerate(keys) if low[a] == a] + [r for r in data if r[0] is None]


def uncut(data):
    least = {}
    for i, b in ((r[0], (r[1] or "").encode()) for r in data):
        for p in range(len(b) - 49 if i is not None else 0):
            least[b[p : p + 50]] = min(i, least.get(b[p : p + 50], i))
    out = []
    for r in data:
        b, gone = (r[1] or "").encode(), set()
        for p in range(len(b) - 49 if r[0] is not None else 0):
            if least[b[p : p + 50]] < r[0]:
                gone |= set(range(p, p + 50))
        out.append((r[0], bytes(c for p, c in enumerate(b) if p not in gone).decode("utf-8", "ignore"), *r[2:]))
    return out


def filled(data, weights=(5, 2, 1), epochs=3):
    size = lambda r: len(WORDS.findall(r[1] or ""))
    by = defaultdict(list)
    for r in data:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cap = sum(map(size, data)), {s: epochs * sum(map(size, by[s])) for s in order}
    clamped = set()
    while True:
        left = [s for s in order if s not in clamped]
        level = (total - sum(cap[s] for s in clamped)) / sum(weight[s] for s in left)
        more = {s for s in left if cap[s] <= weight[s] * level}
        if not more:
            break
        clamped |= more
    out = []
    for s in order:
        whole, rest = divmod(cap[s] if s in clamped else weight[s] * level, cap[s] / epochs)
        draw = lambda r: int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        before = 0
        for r in sorted(by[s], key=lambda r: (draw(r), r[0] or 0, size(r), hashlib.md5(r[1].encode()).hexdigest())):
            out += [r] * int(whole + (rest > 0 and before + size(r) / 2 <= rest))
            before += size(r)
    return out


def test_stages(spark, tmp_path, monkeypatch):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            seen.append([tuple(r) for r in docs.collect()])
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids"]
    last = out.collect()
    assert Counter(seen[0]) == Counter(rows())
    said = lambda r: next((x for x, own in PARTS.items() if any(w.startswith(tuple(own)) for w in r[1].split()[-1:])), None)
    kept = [(*r[:2], "mixed" if r[0] == 110 else said(r), *r[3:]) for r in rows() if any(c.isalpha() for c in r[1] or "")]
    assert Counter((*r[:2], "mixed" if r[0] == 110 and r[2] in PARTS else r[2], *r[3:]) for r in seen[1]) == Counter(kept)
    assert {r[2] for r in rows() if r[0] is None} == {None} and {r[2] for r in seen[1] if r[0] is None} == {"aa"}
    assert Counter(seen[2]) == Counter(unlinked(seen[1])) and sum(r[0] == 130 for r in seen[2]) == 2
    assert Counter(seen[3]) == Counter(uncut(seen[2])) != Counter(seen[2])
    assert Counter(seen[4]) == Counter(filled(seen[3]))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["n_pieces"] == len(r["piece_ids"]) for r in last)
    plain = lambda t: " ".join(t.split())
    assert Counter((r["doc_id"], r["lang"], r["source"], plain(sp.decode(r["piece_ids"]))) for r in last) == Counter((r[0], r[2], r[3], plain(r[1])) for r in seen[4])


def test_equal_ids_and_texts_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(5, text, "x", "s", 2), (5, text, "x", "s", 1), (5, "another text that links to nothing here", "x", "s", 3), (9, text, "x", "s", 4)]
    out = ngram_join.one_of_each_group(spark.createDataFrame(data, SCHEMA))
    assert sorted(r["text"] for r in out.collect()) == sorted({text, data[2][1]})
