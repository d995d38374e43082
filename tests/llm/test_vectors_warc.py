"""Embedding operators against brute force, and the Merkle audit against planted damage."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import multi_index, rabitq, warc
from tabscope.llm.common import shared_path

SCHEMA = "vec_id long, embedding array<float>, label int, id long, m int, vec binary, cell int, links long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 20)) + 2 * rng.normal(size=(6, 20))[rng.integers(0, 6, 500)]
    x[100:150] = x[:50]  # equal vectors
    x[150:220] = x[220:221] + rng.normal(size=(70, 20)) * 0.12  # one large near group
    x[230:260] = 3 * x[260:290] + rng.normal(size=(30, 20)) * 0.3
    out = [(i, v.astype(np.float32).tolist(), int(i) % 3, -1, -2, b"x", 5, 6) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0] * 20, [nan] + [1.0] * 19, [None] + [1.0] * 19, [inf] * 20, [1.0] * 7, []]
    out += [(500 + i, v, 1, 0, 0, None, 0, 0) for i, v in enumerate(bad)]
    out += [(600, out[150][1], None, 0, 0, None, 0, 0), (None, out[150][1], 0, 0, 0, None, 0, 0), out[40]]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def usable(rows):
    ok = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 20 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok], np.float64)
    return ok, x @ x.T / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((x * x).sum(axis=1))


@pytest.mark.parametrize("block_rows", [64, 16_384])
def test_nearest(vectors, rows, block_rows, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK_ROWS", block_rows)
    ok, cosine = usable(rows)
    ids = np.array([r[0] for r in ok])
    got, found, total = rabitq.nearest(vectors, "vec_id % 10 = 0", 5).collect(), 0, 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == {i for i in ids.tolist() if i % 10 == 0}
    for q, have in by.items():
        at = int(np.flatnonzero(ids == q)[0])
        score = {int(i): cosine[at, j] for j, i in enumerate(ids) if i != q}
        order = sorted((int(i) for i in ids if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        assert sorted(have) == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in have.values())
        found += len({i for i, _ in have.values()} & set(order))
        total += len(set(order))
    assert found >= 0.97 * total


def test_nearest_with_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in rabitq.nearest(few, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert rabitq.nearest(few.limit(0), "vec_id = 0").count() == 0
    assert rabitq.nearest(few.limit(1), "vec_id = 0").count() == 0


@pytest.mark.parametrize("chunk,recall", [(16, 1.0), (2048, 0.999)])
def test_near_duplicates(vectors, rows, chunk, recall, monkeypatch):
    monkeypatch.setattr(multi_index, "CHUNK_ROWS", chunk)
    ok, cosine = usable(rows)
    label = np.array([-1 if r[2] is None else r[2] for r in ok])
    near = (cosine >= 0.93) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in ok])
    low = ids.copy()
    for _ in range(100):
        low = np.minimum(low, np.where(near, low, 10**9).min(axis=1))
    got = multi_index.near_duplicates(vectors, 0.93, recall).collect()
    assert len(got) == len(rows)
    links, component = dict(zip(ids.tolist(), near.sum(axis=1).tolist())), dict(zip(ids.tolist(), low.tolist()))
    assert sum(links.values()) > 500
    for r in got:
        i = r["vec_id"]
        assert r["n_links"] == links.get(i, 0)
        assert r["component_id"] == (component.get(i, i) if i is not None else None)
        assert r["kept"] == (i is not None and component.get(i, i) == i)


@pytest.mark.parametrize("k,threshold", [(4, 0.93), (9, 0.93), (9, 0.5), (7, 0.999)])
def test_traversal_visits_exactly_the_cells_in_reach(k, threshold):
    """The walk along the sorted halves against every cell's bound, worked out one by one."""
    rng = np.random.default_rng(14)
    u = multi_index.unit(rng.normal(size=(300, 12)) + 2 * rng.normal(size=(4, 12))[rng.integers(0, 4, 300)])
    grid, radius = multi_index.Grid(u, k), np.sqrt(2 - 2 * threshold)
    row, cell = grid.visits(u, radius, 1.0)
    got = {}
    for r, c in zip(row.tolist(), cell.tolist()):
        got.setdefault(r, []).append(c)
    home, wide = grid.home(u), len(grid.books[1])
    for r in range(len(u)):
        least = []
        for half, book in zip(grid.halves(u[r : r + 1]), grid.books):
            d = ((half - book) ** 2).sum(axis=1)
            least.append([max([0.0, *((d[i] - d[m]) / (2 * np.linalg.norm(book[i] - book[m])) for m in range(len(book)) if m != i)]) ** 2 for i in range(len(book))])
        sums = {i * wide + j: least[0][i] + least[1][j] for i in range(len(least[0])) for j in range(wide)}
        sure = {c for c, s in sums.items() if s <= radius**2 and c >= home[r]}
        maybe = {c for c, s in sums.items() if s <= radius**2 + 1e-8 and c >= home[r]}
        mine = got.get(r, [])
        assert len(mine) == len(set(mine)) and sure <= set(mine) <= maybe
        walked = [sums[c] for c in mine]
        assert all(a <= b + 1e-9 for a, b in zip(walked, walked[1:]))


def test_near_duplicates_in_few_directions(spark):
    """Vectors that vary in 2 of 64 dimensions: links point straight across the cells."""
    rng = np.random.default_rng(11)
    x = np.full((400, 64), 0.5)
    x[:, [0, 40]] += 4 * rng.normal(size=(400, 2))
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = u @ u.T >= 0.93
    got = multi_index.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert multi_index.near_duplicates(none).count() == 0
    odd = multi_index.near_duplicates(spark.createDataFrame([(1, None, 1), (None, [1.0], None)], "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, odd.collect()), key=str) == [(1, 1, 0, 1, True), (None, None, 0, None, False)]


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(10)
    bodies = ["<p>" + "x" * int(n) + "</p>" for n in rng.integers(0, 900, 300)]
    bodies[7] = "a body with\r\n\r\nWARC/1.0\r\nWARC-Type inside"
    bodies[8], bodies[9], bodies[10] = None, "", "é 日本 \x00 " * 9000
    data = [(i, None if i == 5 else f"http://site/{i}", b, "extra", i) for i, b in enumerate(bodies)] + [(None, "http://n", "b", "extra", 0), (11, "http://site/11", bodies[11], "extra", 0)]
    return spark.createDataFrame(data, "page_id long, url string, html string, value string, volume int")


def volumes(spark, path):
    return {r["volume"]: gzip.decompress(r["content"]) for r in warc.read_volumes(spark, path).collect()}


def test_warc_records_cover_their_volumes(spark, pages):
    path = warc.write_warc(pages, shared_path(spark, "test-warc"), volume_bytes=40_000)
    found = volumes(spark, path)
    assert len(found) > 2
    bodies = []
    for data in found.values():
        own = warc.records(data)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == len(data)
        bodies += [data[o : o + n].split(b"\r\n\r\n", 1)[1][:-4].decode() for o, n in own]
    assert sorted(bodies) == sorted(r["html"] or "" for r in pages.collect())


def test_warc_spreads_a_hot_page_id(spark):
    """A third of the rows without an id and a third equal in everything: no volume holds them all, no record is lost."""
    rng = np.random.default_rng(15)
    data = [(None, f"http://n/{i}", "n" * int(rng.integers(100, 700))) for i in range(400)] + [(7, "http://same", "s" * 400)] * 400
    data += [(100 + i, f"http://own/{i}", "o" * 400) for i in range(400)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    path = warc.write_warc(pages, shared_path(spark, "test-warc"), volume_bytes=40_000)
    found = volumes(spark, path)
    got = []
    for held in found.values():
        assert len(held) <= 2 * 40_000
        for o, n in warc.records(held):
            head, body = held[o : o + n].split(b"\r\n\r\n", 1)
            page = warc.ID.search(held, o, o + n)[1].decode()
            got.append((page, head.split(b"WARC-Target-URI: ")[1].split(b"\r\n")[0].decode(), body[:-4].decode()))
    assert sorted(got) == sorted(("null" if i is None else str(i), u, h) for i, u, h in data)
    assert {r["status"] for r in warc.audited(spark, path, path).collect()} == {"ok"}
    again = warc.write_warc(pages.repartition(7), shared_path(spark, "test-warc"), volume_bytes=40_000)
    assert volumes(spark, again) == found


def test_audit_finds_planted_damage(spark, pages):
    first = warc.write_warc(pages, shared_path(spark, "test-warc"), volume_bytes=40_000)

    def damage(volume, data):
        out = b""
        for o, n in warc.records(data):
            record = data[o : o + n]
            number = warc.ID.search(record)[1]
            if number == b"20":
                record = record.replace(b"<p>", b"<q>")
            elif number == b"33":
                record = b""  # lost
            elif number == b"44":
                record = record[:-30] + record[-20:]  # shorter than its header says
            elif number == b"55":
                record += record.replace(b"page:55>", b"page:5555>")
            out += record
        return out

    second = warc.copy_warc(spark, first, shared_path(spark, "test-warc"), damage)
    assert {r["status"] for r in warc.audited(spark, first, first).collect()} == {"ok"}
    got = warc.audited(spark, first, second).collect()
    by = {}
    for r in got:
        by.setdefault(r["status"], set()).add(r["record_id"])
    assert by["corrupt"] == {"20", "44"} and by["missing"] == {"33"} and by["extra"] == {"5555"}
    known = volumes(spark, first)
    for r in got:
        if r["status"] != "extra":
            record = known[r["volume"]][r["offset"] : r["offset"] + r["length"]]
            assert r["sha256"] == hashlib.sha256(b"\x00" + record).hexdigest()
    assert len([r for r in got if r["status"] != "extra"]) == pages.count()


def test_bit_rot_is_what_the_audit_reports(spark, pages):
    first = warc.write_warc(pages, shared_path(spark, "test-warc"), volume_bytes=40_000)
    second = warc.copy_warc(spark, first, shared_path(spark, "test-warc"), warc.bit_rot)
    want = set()
    for v, data in volumes(spark, first).items():
        after = warc.bit_rot(v, data)
        pieces = {after[o : o + n] for o, n in warc.records(after)}
        want |= {(v, o) for o, n in warc.records(data) if data[o : o + n] not in pieces}
    got = warc.audited(spark, first, second).where(F.col("status") != "ok").collect()
    assert want and {(r["volume"], r["offset"]) for r in got} == want and {r["status"] for r in got} == {"corrupt"}


def test_empty_archive(spark, pages):
    path = warc.write_warc(pages.limit(0), shared_path(spark, "test-warc"))
    assert warc.merkle_nodes(spark, path).count() == 0
