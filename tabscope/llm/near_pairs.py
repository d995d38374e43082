"""Pairs of vectors above a cosine inside one task: byte codes with error bounds, tiles around centres, a short filter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import local_components

TILE_ROWS = 128  # rows of a tile, and of a centre
FIT_ROWS, FIT_ROUNDS = 16, 3  # rows a centre that fit the centres, and rounds of that
VISIT_ROWS = 1 << 15  # visitors compared at a time
TILES = 128  # tiles that visitors' angles are found for at a time
WIDE = 1 << 10  # of them in one product
FILTER_DIMS = 27  # dimensions of the filter, besides the length of the rest
SLACK = 1e-5  # more than single precision loses in sums of products of unit vectors
HELD = 1 << 16  # pairs that pass the filter, compared together
EDGES = 1 << 21  # edges kept before they are cut down to a forest

FOUND = "id long, other long, links long, row long, label long, chunk int, call int, visitor boolean"
FOUND_ARROW = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64()), ("row", pa.int64()), ("label", pa.int64()), ("chunk", pa.int32()), ("call", pa.int32()), ("visitor", pa.bool_())])


def levels(dim: int) -> int:
    """The largest code: products of two rows of codes are whole numbers that single precision holds."""
    return max(1, min(127, math.isqrt((1 << 24) // max(dim, 1))))


def record(dim: int) -> np.dtype:
    return np.dtype([("row", "<i8"), ("id", "<i8"), ("m", "<i8"), ("scale", "<f4"), ("err", "<f4"), ("code", "i1", (dim,))])


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, err): the unit vector of each row lies within ``err`` of ``scale`` times its codes.

    Every step takes a row by itself, so a row's code is the same in any batch.
    """
    top = levels(x.shape[1])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    codes = np.rint(x * top)
    norm = np.sqrt((x * x).sum(axis=1))
    scale = (1 / (top * norm)).astype(np.float32)
    off = x / norm[:, None] - codes * scale.astype(np.float64)[:, None]
    err = np.sqrt((off * off).sum(axis=1)) * (1 + 1e-6) + 1e-7
    return codes.astype(np.int8), scale, err.astype(np.float32)


def packed(rows: np.ndarray) -> pa.Array:
    """Records, or rows of a matrix, as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(len(rows), 1)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])


def unpacked(column: pa.Array, dtype: np.dtype, items: int = 1) -> np.ndarray:
    """The values of a binary column without nulls, of which each cell holds ``items``."""
    if not len(column):
        return np.zeros(0, dtype)
    column = column.cast(pa.binary())
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * items * dtype.itemsize].view(dtype)


def filter_basis(u: np.ndarray) -> np.ndarray:
    """The orthonormal directions in which a sample of unit vectors has most of its length, as columns."""
    return np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :FILTER_DIMS]


class Rows:
    """Coded rows; with their vectors too where pairs are compared in double precision."""

    def __init__(self, records: np.ndarray, vec: np.ndarray | None = None) -> None:
        self.row, self.id, self.m = (np.ascontiguousarray(records[c]) for c in ("row", "id", "m"))
        self.scale, self.err = (records[c].astype(np.float64) for c in ("scale", "err"))
        self.code, self.vec = np.ascontiguousarray(records["code"]), vec

    def __len__(self) -> int:
        return len(self.row)

    def take(self, at: np.ndarray | slice) -> Rows:
        out = object.__new__(Rows)
        out.row, out.id, out.m, out.scale, out.err, out.code = (a[at] for a in (self.row, self.id, self.m, self.scale, self.err, self.code))
        out.vec = None if self.vec is None else self.vec[at]
        return out

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        out = object.__new__(Rows)
        for c in ("row", "id", "m", "scale", "err", "code"):
            setattr(out, c, np.concatenate([getattr(p, c) for p in parts]))
        out.vec = None if parts[0].vec is None else np.concatenate([p.vec for p in parts])
        return out

    def near(self) -> np.ndarray:
        """The coded vectors in single precision."""
        return self.code.astype(np.float32) * self.scale.astype(np.float32)[:, None]

    def units(self, at: np.ndarray) -> np.ndarray:
        x = self.vec[at].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


def short(near: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates on the basis and the length of the rest: their products are never below those of the vectors."""
    p = near @ basis
    rest = np.maximum(0, (near * near).sum(axis=1) - (p * p).sum(axis=1))
    return np.concatenate([p, np.sqrt(rest + 1e-6)[:, None]], axis=1, dtype=np.float32)


def nearest_centres(near: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, cosine) of each row, a block at a time."""
    cell, own = np.zeros(len(near), np.int64), np.zeros(len(near), np.float32)
    step = max(1, (1 << 23) // len(centres))
    for s in range(0, len(near), step):
        cos = near[s : s + step] @ centres.T
        cell[s : s + step] = at = cos.argmax(axis=1)
        own[s : s + step] = cos[np.arange(len(at)), at]
    return cell, own


def fitted_centres(near: np.ndarray, k: int) -> np.ndarray:
    """``k`` directions among the rows, by a few rounds of spherical k-means."""
    centres = near[np.arange(k) * len(near) // k]
    centres = centres / np.linalg.norm(centres, axis=1)[:, None]
    for _ in range(FIT_ROUNDS if k > 1 else 0):
        cell, _ = nearest_centres(near, centres)
        order = np.argsort(cell, kind="stable")
        some, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(near[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1)
        fine = size > 1e-3
        centres[some[fine]] = sums[fine] / size[fine, None]
    return centres


def grouped(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, centre, cosine) of rows by their nearest of about one centre to ``TILE_ROWS`` rows, and the centres."""
    n = len(rows)
    k = -(-n // TILE_ROWS)
    fit = rows.take(np.arange(min(n, FIT_ROWS * k)) * n // min(n, FIT_ROWS * k))
    centres = fitted_centres(fit.near(), k)
    cell, own = (np.concatenate(p) for p in zip(*(nearest_centres(rows.take(slice(s, s + VISIT_ROWS)).near(), centres) for s in range(0, n, VISIT_ROWS))))
    order = np.lexsort((own, cell))
    return order, cell[order], own[order].astype(np.float64), centres


class Unit:
    """A chunk of rows, compared with itself (in call 0) and with its visitors.

    The chunk is sorted into tiles around centres. Where a row x of a tile at angle a
    from its centre and a visitor at angle b reach the cosine, a and b differ by at most
    the cosine's angle, so each tile is compared only with visitors in its range of angles.
    Those meet in products of short vectors that are never below the true ones; what
    passes is compared by codes. A code's error bound tells whether a pair is surely a link, surely
    none, or neither: the rows of such pairs come back as flagged (``row`` is set), to be
    compared by their vectors in a second pass (``exact``), which looks at these pairs only.
    """

    def __init__(self, key: tuple[int, int, int], threshold: float, basis: np.ndarray, exact: bool) -> None:
        self.key, self.threshold, self.basis, self.exact = key, threshold, basis.astype(np.float32), exact
        self.angle = math.acos(max(-1.0, min(1.0, threshold)))
        self.parts: list[Rows] = []
        self.guests: list[Rows] = []
        self.left: Rows | None = None
        self.out: list[list[np.ndarray]] = []

    def add(self, rows: Rows, visitor: bool) -> None:
        (self.guests if visitor else self.parts).append(rows)
        if visitor and sum(map(len, self.guests)) >= VISIT_ROWS:
            self.meet()

    def meet(self) -> None:
        if self.left is None:
            self.prepare()
        if self.guests and self.left:
            guests, self.guests = Rows.joined(self.guests), []
            for s in range(0, len(guests), VISIT_ROWS):
                self.compare(guests.take(slice(s, s + VISIT_ROWS)), None)
        self.guests = []

    def end(self) -> list[list[np.ndarray]]:
        """The found rows, as columns id, other, links, row, visitor."""
        self.meet()
        self.tell(self.left, self.links, self.flagged, False)
        return self.out

    def prepare(self) -> None:
        left, self.parts = Rows.joined(self.parts) if self.parts else None, []
        n = len(left) if left else 0
        self.left, self.links, self.flagged = left, np.zeros(n, np.int64), np.zeros(n, bool)
        if not n:
            return
        order, cell, own, self.centres = grouped(left)
        self.left = left = left.take(order)
        self.short = np.concatenate([short(left.take(slice(s, s + VISIT_ROWS)).near(), self.basis) for s in range(0, n, VISIT_ROWS)])
        sizes = np.bincount(cell, minlength=len(self.centres))
        pieces = np.where(sizes > 0, np.maximum(1, (sizes + TILE_ROWS // 2) // TILE_ROWS), 0)
        of = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + piece * sizes[of] // pieces[of]
        self.of, self.bounds = of, np.append(starts, n)
        self.tile_err = np.maximum.reduceat(left.err, starts)
        low = np.clip(np.minimum.reduceat(own - left.err, starts) - SLACK, -1, 1)
        high = np.clip(np.maximum.reduceat(own + left.err, starts) + SLACK, -1, 1)
        self.least = np.where(np.arccos(low) + self.angle < math.pi, np.cos(np.minimum(math.pi, np.arccos(low) + self.angle)), -2.0)
        self.most = np.where(np.arccos(high) > self.angle, np.cos(np.maximum(0, np.arccos(high) - self.angle)), 2.0)
        if self.key[2] == 0 and n > 1:
            for s in range(0, n, VISIT_ROWS):
                self.compare(left.take(slice(s, s + VISIT_ROWS)), s)

    def compare(self, y: Rows, own_from: int | None) -> None:
        """The chunk with ``y``: visitors, or its own rows from place ``own_from``, each pair once."""
        n, ny = len(self.left), len(y)
        near = y.near()
        shorts, codes = short(near, self.basis), y.code.astype(np.float32)
        err = float(y.err.max())
        base = n if own_from is None else own_from  # number of y's first row as a node of the links' graph
        self.graph: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.edges = 0
        links, flagged = np.zeros(ny, np.int64), np.zeros(ny, bool)
        left, kept, held = self.left, [], 0

        def settle(i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> None:
            self.settle(y, i, j, dot, own_from, base, links, flagged)

        def gathered() -> None:
            nonlocal held
            if kept:
                i, j = (np.concatenate(p) for p in zip(*kept))
                settle(i, j, np.einsum("ij,ij->i", left.code[i].astype(np.float32), codes[j]))
                kept.clear()
                held = 0

        room = np.empty(WIDE * int(np.diff(self.bounds).max()), np.float32)
        tiles = len(self.of) if own_from is None else int(np.searchsorted(self.bounds, own_from + ny))
        for t0 in range(0, tiles, TILES):
            t1 = min(t0 + TILES, tiles)
            c0 = self.of[t0]
            cos = self.centres[c0 : self.of[t1 - 1] + 1] @ near.T
            for t in range(t0, t1):
                s, e = self.bounds[t], self.bounds[t + 1]
                skip = 0 if own_from is None else max(0, s - own_from)
                c = cos[self.of[t] - c0, skip:]
                some = np.flatnonzero((c >= np.float32(self.least[t] - err - SLACK)) & (c <= np.float32(self.most[t] + err + SLACK))) + skip
                if not len(some):
                    continue
                x_err = self.tile_err[t]
                bar = np.float32(self.threshold - (x_err + err + x_err * err) - SLACK)
                a, b = self.short[s:e].T, shorts[some]
                for w in range(0, len(some), WIDE):
                    part = b[w : w + WIDE]
                    product = np.matmul(part, a, out=room[: len(part) * (e - s)].reshape(len(part), e - s))
                    if product.max() < bar:
                        continue
                    at = np.flatnonzero(product >= bar)
                    j, i = np.divmod(at, e - s)
                    if len(at) > product.size // 16:
                        dot = (codes[some[w : w + WIDE]] @ left.code[s:e].astype(np.float32).T).ravel()[at]
                        settle(i + s, some[w + j], dot)
                    else:
                        kept.append((i + s, some[w + j]))
                        held += len(at)
                if held > HELD:
                    gathered()
        gathered()
        if own_from is not None:
            self.links[own_from : own_from + ny] += links
            self.flagged[own_from : own_from + ny] |= flagged
        else:
            self.tell(y, links, flagged, True)
        if self.graph[0]:
            ids = np.concatenate([left.id, y.id]) if own_from is None else left.id
            low, tied = self.forest(len(ids))
            self.out.append([ids[tied], ids[low[tied]], np.zeros(len(tied), np.int64), np.full(len(tied), -1), np.zeros(len(tied), bool)])

    def settle(self, y: Rows, i: np.ndarray, j: np.ndarray, dot: np.ndarray, own_from: int | None, base: int, links: np.ndarray, flagged: np.ndarray) -> None:
        """Counts the links among the pairs of rows i and rows j of y, whose codes have the products ``dot``."""
        x = self.left
        cosine = dot.astype(np.float64) * (x.scale[i] * y.scale[j])
        slack = (x.err[i] + y.err[j]) + x.err[i] * y.err[j] + 1e-6
        keep = (cosine + slack >= self.threshold) & (x.id[i] != y.id[j])
        if own_from is not None:
            keep &= j + own_from > i
        i, j, sure = i[keep], j[keep], (cosine - slack >= self.threshold)[keep]
        if self.exact:
            i, j = i[~sure], j[~sure]
            sure = np.einsum("ij,ij->i", x.units(i), y.units(j)) >= self.threshold
        else:
            self.flagged[i[~sure]] = True
            flagged[j[~sure]] = True
        i, j = i[sure], j[sure]
        if not len(i):
            return
        np.add.at(self.links, i, y.m[j])
        np.add.at(links, j, x.m[i])
        a, b = self.graph
        a.append(i)
        b.append(j + base)
        self.edges += len(i)
        if self.edges > EDGES:
            low, tied = self.forest(len(x) + (len(y) if own_from is None else 0))
            self.graph, self.edges = ([tied], [low[tied]]), 0

    def forest(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = local_components(n, np.concatenate(self.graph[0]), np.concatenate(self.graph[1]))
        return low, np.flatnonzero(low != np.arange(n))

    def tell(self, rows: Rows | None, links: np.ndarray, flagged: np.ndarray, visitor: bool) -> None:
        some, again = np.flatnonzero(links), np.flatnonzero(flagged)
        if len(some):
            self.out.append([rows.id[some], rows.id[some], links[some], np.full(len(some), -1), np.zeros(len(some), bool)])
        if len(again):
            self.out.append([rows.id[again], rows.id[again], np.zeros(len(again), np.int64), rows.row[again], np.full(len(again), visitor)])


def compared(batches: Iterator[pa.RecordBatch], threshold: float, basis: np.ndarray, vec: np.dtype | None = None) -> Iterator[pa.RecordBatch]:
    """``FOUND`` rows of batches sorted by (label, chunk, call, visitor), where a chunk's own rows come before its visitors.

    With ``vec``, the type of a row's vector, pairs are compared by their vectors. Rows with
    a ``row`` are the flagged ones; the others hold links of ``id``, or tie it to ``other``.
    """
    dim = len(basis)
    unit: Unit | None = None
    done: list[tuple[tuple[int, int, int], list[np.ndarray]]] = []

    def told() -> Iterator[pa.RecordBatch]:
        if done:
            cols = [np.concatenate([c[k] for _, c in done]) for k in range(5)]
            key = [np.repeat([k[x] for k, _ in done], [len(c[0]) for _, c in done]) for x in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], mask=cols[3] < 0), pa.array(key[0], pa.int64()), pa.array(key[1], pa.int32()), pa.array(key[2], pa.int32()), pa.array(cols[4])],
                schema=FOUND_ARROW,
            )
            done.clear()

    for b in batches:
        if not b.num_rows:
            continue
        if vec is None:
            rows = Rows(unpacked(b.column("data"), record(dim)))
        else:
            x = unpacked(b.column("vec"), vec, dim).reshape(b.num_rows, dim)
            records = np.zeros(b.num_rows, record(dim))
            records["code"], records["scale"], records["err"] = coded(x.astype(np.float64))
            for c in ("row", "id", "m"):
                records[c] = b.column(c).to_numpy()
            rows = Rows(records, x)
        keys = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "chunk", "call", "visitor")]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            key = (int(keys[0][s]), int(keys[1][s]), int(keys[2][s]))
            if unit is None or unit.key != key:
                if unit:
                    done += [(unit.key, c) for c in unit.end()]
                unit = Unit(key, threshold, basis, vec is not None)
            unit.add(rows.take(slice(s, e)), bool(keys[3][s]))
        if unit and unit.out:
            done += [(unit.key, c) for c in unit.out]
            unit.out = []
        yield from told()
    if unit:
        done += [(unit.key, c) for c in unit.end()]
    yield from told()
