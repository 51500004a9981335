"""Exact cosine search among sparse vectors in Arrow batches: one side is streamed in blocks from the shared folder, the best of each row are kept meanwhile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pa_fs

#: The commonest grams are multiplied as dense columns, all others by their postings.
DENSE = 256
#: From this floor on, the dense columns are ``SPARED`` times as many and multiplied only for pairs that the other grams leave open.
OPEN, SPARED = 0.6, 2
#: Rows of a left block, of a right block, and of the strip of a left block whose scores are held at once.
LEFT, RIGHT, STRIP = 4096, 2048, 256
#: Products of postings, and rows returned, that are held at once.
HELD = 4_000_000


def blocks(uri: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table written by Spark, in its order."""
    fs, root = pa_fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    for path in sorted(f.path for f in fs.get_file_info(pa_fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


class Grams:
    """Grams by falling count, with their inverse document frequencies."""

    def __init__(self, uri: str, total: int) -> None:
        found = list(blocks(uri, ["g", "df"], 1 << 16))
        df = np.concatenate([b.column("df").to_numpy() for b in found])
        order = np.argsort(-df, kind="stable")
        self.names = pa.concat_arrays([b.column("g") for b in found]).take(pa.array(order))
        self.idf = np.log((1 + total) / (1 + df[order])) + 1

    def vectors(self, lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
        """Numbers and weights of each row's grams, packed as int32 and float64; unit length."""
        n, m = len(lists), max(len(self.names), 1)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        code = pc.index_in(pc.list_flatten(lists), value_set=self.names).to_numpy()
        key, tf = np.unique(row * m + code, return_counts=True)
        row, code = key // m, key % m
        w = tf * self.idf[code]
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        pack = lambda x: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
        return pack(code.astype(np.int32)), pack(w)


def weigh(uri: str, total: int):
    """For ``mapInArrow``: the last column's grams become ``g`` and ``w``, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = None
        for b in batches:
            grams = grams or Grams(uri, total)
            packed = grams.vectors(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *packed], names=[*b.schema.names[:-1], "g", "w"])

    return run


class Block:
    """Rows as a dense part, and the rest as entries in order of rows."""

    def __init__(self, b: pa.RecordBatch, dense: int) -> None:
        self.n, self.batch = b.num_rows, b
        ends, g = self.unpack(b.column("g"), np.int32)
        _, w = self.unpack(b.column("w"), np.float64)
        row = np.repeat(np.arange(self.n), np.diff(ends))
        hot = g < dense
        self.dense = np.zeros((self.n, dense))
        self.dense[row[hot], g[hot]] = w[hot]
        self.norm = np.sqrt(np.bincount(row[hot], w[hot] ** 2, self.n))
        self.row, self.g, self.w = row[~hot], g[~hot], w[~hot]

    @staticmethod
    def unpack(c: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        c = c.cast(pa.binary())
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        data = c.buffers()[2]
        if data is None:
            return np.zeros(len(c) + 1, np.int32), np.zeros(0, kind)
        size = np.dtype(kind).itemsize
        return (ends - ends[0]) // size, np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0])

    def postings(self) -> None:
        """Entries in order of grams, with where each gram's begin."""
        order = np.argsort(self.g, kind="stable")
        self.row, self.w = self.row[order], self.w[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.g, minlength=1))])


def rest(left: Block, right: Block, at: int) -> np.ndarray:
    """What the grams that aren't dense add to the cosines of a strip of left rows with all rows of the right block."""
    n_left = min(STRIP, left.n - at)
    s = None
    a, b = np.searchsorted(left.row, (at, at + STRIP))
    row, g, w = left.row[a:b] - at, left.g[a:b], left.w[a:b]
    known = g < len(right.begin) - 1
    row, g, w = row[known], g[known], w[known]
    lo = right.begin[g]
    n = right.begin[g + 1] - lo
    total, done = np.cumsum(n), 0
    while done < len(n):
        base = total[done - 1] if done else 0
        to = max(int(np.searchsorted(total, base + HELD, "right")), done + 1)
        part = n[done:to]
        at_right = np.repeat(lo[done:to] - (total[done:to] - part - base), part) + np.arange(total[to - 1] - base)
        cell = np.repeat(row[done:to] * right.n, part) + right.row[at_right]
        # Of no products, bincount gives integers.
        more = np.bincount(cell, np.repeat(w[done:to], part) * right.w[at_right], n_left * right.n).astype(np.float64, copy=False)
        s = more if s is None else s + more
        done = to
    return (np.zeros(n_left * right.n) if s is None else s).reshape(n_left, right.n)


def hits(left: Block, right: Block, at: int, least: np.ndarray, spared: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the strip, rows of the right block and their cosines over all grams, where these are ``least`` at least.

    ``spared``: the dense part is at most the product of both rows' norms in it; what can't reach ``least`` even so is not multiplied.
    """
    s, strip = rest(left, right, at), slice(at, at + STRIP)
    if not spared:
        s += left.dense[strip] @ right.dense.T
        i, j = np.nonzero(s >= least[:, None])
        return i, j, s[i, j]
    most = left.norm[strip]
    low = least - most * right.norm.max(initial=0) - 1e-9
    i, j = np.divmod(np.flatnonzero((s >= low[:, None]).ravel()), max(right.n, 1))
    near = s[i, j] + most[i] * right.norm[j] >= least[i] - 1e-9
    i, j = i[near], j[near]
    x = s[i, j]
    if len(i) > s.size // 16:
        x += (left.dense[strip] @ right.dense.T)[i, j]
    else:
        for k in range(0, len(i), 1000):
            x[k : k + 1000] += np.einsum("ij,ij->i", left.dense[i[k : k + 1000] + at], right.dense[j[k : k + 1000]])
    found = x >= least[i]
    return i[found], j[found], x[found]


class Best:
    """Per left row the ``k`` best groups of right rows seen so far, each by its best row; ties: the earlier group, the earlier row."""

    def __init__(self, n: int, k: int, floor: float, digits: int | None) -> None:
        self.k, self.digits, self.least = k, digits, np.full(n, floor)
        self.kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.n_new = 0

    def add(self, row: np.ndarray, group: np.ndarray, pos: np.ndarray, score: np.ndarray) -> None:
        self.new.append((row, group, pos, score))
        self.n_new += len(row)
        if self.n_new > max(200_000, len(self.kept[0])):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        row, group, pos, score = (np.concatenate(x) for x in zip(self.kept, *self.new))
        self.new, self.n_new = [], 0
        key = score if self.digits is None else np.floor(score * 10.0**self.digits + 0.5)
        order = np.lexsort((pos, -key, group, row))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(row[order]) != 0) | (np.diff(group[order]) != 0)
        order = order[first]
        order = order[np.lexsort((group[order], -key[order], row[order]))]
        r = row[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        order, r = order[rank < self.k], r[rank < self.k]
        self.kept = row[order], group[order], pos[order], score[order]
        full = rank[rank < self.k] == self.k - 1
        # A row below the last that counts can't be one; rounded scores may hide a little.
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        self.least[r[full]] = np.maximum(self.least[r[full]], score[order][full] - slack)
        return self.kept


def search(uri: str, floor: float, k: int | None, scope: str | None, group: str | None, digits: int | None):
    """For ``mapInArrow``: ``left_id, right_id, score`` of the rows given against all rows of the table at ``uri``."""
    columns = ["id", "g", "w", *[c for c in (scope, group) if c]]
    spared = floor >= OPEN
    dense = DENSE * SPARED if spared else DENSE

    def rows(b: pa.RecordBatch, ids: pa.ChunkedArray, row: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(row), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[j])), ids[j].combine_chunks(), pa.array(score[j])], names=["left_id", "right_id", "score"])

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left = Block(b, dense)
        codes: dict = {}
        if scope:
            lscope = np.array([-1 if v is None else codes.setdefault(v, len(codes)) for v in b.column(scope).to_pylist()])
        best, seen, last, n_groups = k and Best(left.n, k, floor, digits), 0, None, 0
        for rb in blocks(uri, columns, RIGHT):
            if scope:
                rscope = np.array([codes.get(v, -2) for v in rb.column(scope).to_pylist()])
                if not np.isin(rscope, lscope).any():
                    seen += rb.num_rows
                    continue
            right = Block(rb, dense)
            right.postings()
            pos = seen + np.arange(right.n)
            of = pos
            if group:
                values = rb.column(group).to_pylist()
                new = [n_groups == 0 or values[0] != last, *[x != y for x, y in zip(values[1:], values)]]
                of = n_groups + np.cumsum(new)
                last, n_groups = values[-1], int(of[-1])
            for at in range(0, left.n, STRIP):
                if scope and not np.isin(rscope, lscope[at : at + STRIP]).any():
                    continue
                i, j, score = hits(left, right, at, best.least[at : at + STRIP] if best else np.full(min(STRIP, left.n - at), floor), spared)
                if scope:
                    same = lscope[i + at] == rscope[j]
                    i, j, score = i[same], j[same], score[same]
                if best:
                    best.add(i + at, of[j], pos[j], score)
                elif len(i):
                    yield from rows(b, pa.chunked_array([rb.column("id").take(pa.array(j))]), i + at, score)
            seen += right.n
        if best:
            row, _, pos, score = best.cut()
            order = np.argsort(pos, kind="stable")
            row, pos, score, ids, seen = row[order], pos[order], score[order], [], 0
            for rb in blocks(uri, ["id"], 1 << 16):
                a, z = np.searchsorted(pos, (seen, seen + rb.num_rows))
                if z > a:
                    ids.append(rb.column("id").take(pa.array(pos[a:z] - seen)))
                seen += rb.num_rows
            if ids:
                yield from rows(b, pa.chunked_array(ids), row, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def all_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.combine_chunks().to_batches(LEFT):
                yield from one(b)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= LEFT:
                t, held = pa.Table.from_batches(held), []
                yield from all_of(t)
        if held:
            yield from all_of(pa.Table.from_batches(held))

    return run
