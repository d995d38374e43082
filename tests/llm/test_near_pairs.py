"""The comparison of chunks by byte codes against brute force, and what the multi-index sends to the chunks."""

import contextlib
import os
import threading

import numpy as np
import pyarrow as pa
import pytest

from tabscope.llm import multi_index, near_pairs
from tabscope.llm.common import local_components
from tabscope.llm.vectors import unit


def close_to(threshold, n, dim, rng):
    """Unit vectors of which n // 2 pairs have cosines within a few thousandths of the threshold."""
    x = unit(rng.normal(size=(n, dim)))
    for a in range(0, n - 1, 2):
        off = x[a + 1] - (x[a + 1] @ x[a]) * x[a]
        c = threshold + rng.normal() * 0.004
        x[a + 1] = c * x[a] + np.sqrt(1 - c * c) * off / np.linalg.norm(off)
    return x


def made(kind, rng):
    if kind == "close":
        return close_to(0.93, 600, 64, rng)
    if kind == "group":  # half of the rows in one group, some of it beyond the threshold
        x = rng.normal(size=(900, 64))
        x[:450] = x[0] + rng.normal(size=(450, 64)) * rng.uniform(0.05, 0.5, (450, 1))
        return x
    if kind == "flat":  # all lie near three dimensions
        return rng.normal(size=(700, 64)) * np.where(np.arange(64) < 3, 1.0, 0.02)
    return rng.normal(size=(500, 5)) * 10.0 ** rng.integers(-3, 4, (500, 1))


@pytest.mark.parametrize("kind", ["close", "group", "flat", "short"])
@pytest.mark.parametrize("tile,visit,edges,held", [(128, 1 << 15, 1 << 21, 1 << 16), (16, 100, 300, 20)])
def test_compared_finds_each_pair_once(kind, tile, visit, edges, held, monkeypatch):
    for name, value in (("TILE_ROWS", tile), ("VISIT_ROWS", visit), ("EDGES", edges), ("HELD", held)):
        monkeypatch.setattr(near_pairs, name, value)
    rng = np.random.default_rng(21)
    x = made(kind, rng)
    n, dim = x.shape
    u = unit(x)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    m = rng.integers(1, 4, n)

    def batch(at, chunk, call, visitor, exact=False):
        keys = {"label": np.full(len(at), 7), "chunk": np.full(len(at), chunk, np.int32), "call": np.full(len(at), call, np.int32), "visitor": np.full(len(at), visitor)}
        if exact:
            data = {"row": at, "id": at, "m": m[at], "vec": near_pairs.packed(x[at])}
        else:
            records = np.zeros(len(at), near_pairs.record(dim))
            records["code"], records["scale"], records["err"] = near_pairs.coded(x[at])
            records["row"], records["id"], records["m"] = at, at, m[at]
            data = {"data": near_pairs.packed(records)}
        cols = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in (keys | data).items()}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches, vec=None):
        return pa.Table.from_batches(near_pairs.compared(iter(batches), 0.93, near_pairs.filter_basis(u), vec), schema=near_pairs.FOUND_ARROW).to_pandas()

    a, b = np.arange(n // 3), np.arange(n // 3, n)
    first = run([batch(a, 0, 0, False), batch(b[:100], 1, 0, False), batch(b[100:], 1, 0, False), batch(a[::2], 1, 0, True), batch(b, 1, 1, False), batch(a[1::2], 1, 1, True)])
    flagged = first[first["row"].notna()]
    assert len(flagged) and not flagged.duplicated(["row", "chunk", "call", "visitor"]).any()
    second = run([batch(g["row"].to_numpy(np.int64), *key, exact=True) for key, g in sorted(flagged.groupby(["chunk", "call", "visitor"]))], np.dtype("f8"))
    assert second["row"].isna().all()
    links, ties = np.zeros(n, np.int64), []
    for t in (first, second):
        np.add.at(links, t["id"].to_numpy(), t["links"].to_numpy())
        ties.append(t[["id", "other"]].to_numpy())
    i, j = np.nonzero(near)
    assert len(i) and (links == near @ m).all()
    assert (local_components(n, *np.concatenate(ties).T) == local_components(n, i, j)).all()


def test_codes_keep_their_bound():
    rng = np.random.default_rng(22)
    for dim in (1, 3, 64, 1500):
        x = rng.normal(size=(200, dim)) * 10.0 ** rng.integers(-200, 200, (200, 1))
        codes, scale, err = near_pairs.coded(x)
        off = unit(x) - codes * scale.astype(np.float64)[:, None]
        assert (np.sqrt((off * off).sum(axis=1)) <= err).all() and (err < 0.2).all()
        assert dim * int(np.abs(codes).max()) ** 2 <= 1 << 24
        again = [near_pairs.coded(x[s : s + 7]) for s in range(0, 200, 7)]
        assert all((np.concatenate(p) == q).all() for p, q in zip(zip(*again), (codes, scale, err)))


def test_cells_make_up_chunks():
    before, first, span, rows = multi_index.cut(np.array([0, 3, 4, 0, 5, 25, 1, 9, 2, 0]), 10)
    assert rows == 10 and before.tolist() == [0, 0, 3, 7, 7, 12, 37, 38, 47, 49]
    assert first.tolist() == [0, 0, 0, 0, 0, 1, 3, 3, 4, 4] and span.tolist() == [1, 1, 1, 1, 2, 3, 1, 2, 1, 1]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_close_to_the_threshold_over_many_chunks(spark, kind, monkeypatch):
    monkeypatch.setattr(multi_index, "CHUNK_ROWS", 40)
    x = close_to(0.93, 400, 24, np.random.default_rng(23))
    x = x.astype(np.float32).astype(np.float64) if kind == "float" else x
    near = unit(x) @ unit(x).T >= 0.93
    np.fill_diagonal(near, False)
    low = local_components(400, *np.nonzero(near))
    got = multi_index.near_duplicates(spark.createDataFrame([(i, v.tolist(), 4) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int").repartition(3)).collect()
    assert 100 < near.sum() < 300
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(near[i].sum()), int(low[i])) for i in range(400)}


def test_rows_are_not_sent_to_every_cell(spark, monkeypatch):
    """Vectors without structure reach nearly all cells; what is shuffled stays a few times their size."""
    monkeypatch.setattr(multi_index, "CHUNK_ROWS", 2048)
    x = np.random.default_rng(24).normal(size=(8000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4).cache()
    table.count()

    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    most, ended = {}, threading.Event()

    def watch():  # files go when a query has ended
        while not ended.wait(0.02):
            for folder in folders:
                for at, _, names in os.walk(folder):
                    for name in names:
                        if name.startswith("shuffle_") and name.endswith(".data"):
                            with contextlib.suppress(OSError):
                                most[name] = os.path.getsize(os.path.join(at, name))

    watcher, before = threading.Thread(target=watch), set()
    for folder in folders:
        before |= {name for _, _, names in os.walk(folder) for name in names}
    watcher.start()
    try:
        assert {r["n_links"] for r in multi_index.near_duplicates(table).select("n_links").distinct().collect()} == {0}
    finally:
        ended.set()
        watcher.join()
    assert x.nbytes < sum(n for name, n in most.items() if name not in before) < 5 * x.nbytes
    table.unpersist()
