"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 128 bits: the signs of the sums of the hashes of a text's distinct words. Two documents are near
copies if their fingerprints differ in at most ``TAU`` bits. The bits are cut into ``SEGMENTS`` segments in a ring.
If the differences add up to at most TAU, some segment begins a chain in which, for every length l, the first l
segments differ in at most l * TAU / SEGMENTS bits together. With 19 bits in 10 segments the first one differs in at most
one bit, so pairs meet by a segment that is equal or one flip away; those whose chain leaves its budget are pruned,
and the rest get the full Hamming check. No pair within TAU is missed. Only distinct fingerprints are searched, so
copies cost nothing; groups are the connected components.

For the search each distinct fingerprint is sent by segment and the segment's high bits (its cell), and also to each
cell that one of its zero high bits would lead to if it were one. Each pair that differs in a bit there has the zero
on one side only, so it meets once. Inside a cell the first two links of the chain together are the join key: they
differ in at most three bits, so an index over the first link and a half of the second finds them. A pair is
given by the segment at which its first good chain begins, hence once. In dense groups the pairs grow as the square of
the table, so they are compared in blocks, and ``groups`` only counts them: a cell gives for each of its fingerprints
the number of its links there and one step toward the rest of its group.

The result has a row for each document: (doc_id, group_id, is_duplicate, n_links); group_id is the least doc_id of the
group and the document that stays, n_links the number of other fingerprints near the document's own.

Cases: a text without words (null, empty, only signs) has no fingerprint and is a group of its own. Documents of a null
id are groups of their own, too, with a null group_id. Rows that repeat a doc_id are one document if their texts
are near copies; else the id is in two groups, and the least group_id and the greatest n_links are given. Ties of the sums are zeros. Texts of any
length are taken whole. An empty table gives an empty one. Columns besides id and text are ignored; ``keep_first``
keeps them, and of rows that repeat a doc_id that stays it keeps each.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordIndex, components, csr_take, durable, map_texts, union, words_of

TAU, SEGMENTS, BITS = 19, 10, 128
#: First bit of each segment, and of none: eight segments of 13 bits, two of 12.
_CUTS = [0, 13, 26, 39, 52, 65, 78, 91, 104, 116, 128]
_CELL_BITS = 8
#: High bits of the next segment; the rest are its low bits.
_HIGH = 6
#: So many rows ask at a time, and about so many pairs are compared at a time; the result is the same.
_ASKS, _HITS = 1 << 15, 1 << 19
#: About so many fingerprints are sent to their cells by a task.
_SPREAD = 20_000
#: So few pairs of a cell are compared without an index; the result is the same.
_FEW = 4096


class Fingerprints:
    def __init__(self, keep: int = 150_000):
        self.reset()
        self.index = WordIndex(self._add, self.reset, keep)

    def reset(self) -> None:
        self.hashes = array("Q")

    def _add(self, word: str) -> None:
        import xxhash

        x = xxhash.xxh128_intdigest(word.encode("utf-8", "surrogatepass"))
        self.hashes.append(x & 0xFFFFFFFFFFFFFFFF)
        self.hashes.append(x >> 64)

    def texts(self, texts: list[str | None]) -> list[tuple[int, int] | None]:
        """(low, high) halves as signed longs."""
        each = [list(set(words_of(t.lower()))) if t else [] for t in texts]
        rows = self.index.rows([w for ws in each for w in ws])
        table = np.frombuffer(self.hashes, np.uint8).reshape(-1, 16)
        out, at = [], 0
        for ws in each:
            if not ws:
                out.append(None)
                continue
            n = len(ws)
            ones = np.zeros(BITS, np.int64)
            for a in range(at, at + n, 4096):
                ones += np.unpackbits(table[rows[a : min(a + 4096, at + n)]], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            at += n
            out.append(tuple(np.packbits(2 * ones > n, bitorder="little").view(np.int64).tolist()))
        return out


def _segment(lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """The segment's bits, as a number."""
    a, b = _CUTS[k], _CUTS[k + 1]
    if b <= 64:
        x = lo >> np.uint64(a)
    elif a >= 64:
        x = hi >> np.uint64(a - 64)
    else:
        x = (lo >> np.uint64(a)) | (hi << np.uint64(64 - a))
    return x & np.uint64((1 << (b - a)) - 1)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, lo, hi) rows: place is 2 * cell for a fingerprint at home in a cell of each segment, 2 * cell + 1 for its visits to cells one flip up."""
    for batch in batches:
        signed = [batch.column(i).to_numpy() for i in (0, 1)]
        lo, hi = (np.ascontiguousarray(x).view(np.uint64) for x in signed)
        everyone = np.arange(len(lo))
        for k in range(SEGMENTS):
            places, which = [], []
            cell = (_segment(lo, hi, k) >> np.uint64(_CUTS[k + 1] - _CUTS[k] - _CELL_BITS)).astype(np.int32)
            places.append(((k << _CELL_BITS) + cell) * 2)
            which.append(everyone)
            for b in range(_CELL_BITS):
                zero = np.flatnonzero((cell >> b) & 1 == 0)
                places.append(((k << _CELL_BITS) + (cell[zero] | (1 << b))) * 2 + 1)
                which.append(zero)
            w = np.concatenate(which)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(signed[0][w]), pa.array(signed[1][w])], names=["place", "lo", "hi"])


def _first_chain(x: np.ndarray, y: np.ndarray, k: int, tau: int) -> np.ndarray:
    """Of differences (low, high halves) within ``tau``: whether segment ``k`` is the first at which a chain begins that keeps all its budgets."""
    each = [np.bitwise_count(_segment(x, y, s)) for s in range(SEGMENTS)]

    def good(begin: int) -> np.ndarray:
        upto, ok = np.zeros(len(x), np.uint8), np.ones(len(x), bool)
        for links in range(1, SEGMENTS):
            upto += each[(begin + links - 1) % SEGMENTS]
            ok &= upto <= links * tau // SEGMENTS
        return ok

    out = good(k)
    for begin in range(k):
        out &= ~good(begin)
    return out


def _table(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order of their key, where each key's rows begin)."""
    return np.argsort(key, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(key, minlength=size))])


def _hits(table: tuple[np.ndarray, np.ndarray], rows: np.ndarray, keys: np.ndarray, limit: int = _HITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the table, asking row) of equal keys, so many at a time."""
    order, begin = table
    n = begin[keys + 1] - begin[keys]
    some = np.flatnonzero(n)
    rows, first, n = rows[some], begin[keys[some]], n[some]
    ends = np.cumsum(n)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield csr_take(order, first[a:b], n[a:b]), np.repeat(rows[a:b], n[a:b])
        a = b


class _Cell:
    """The fingerprints at home in a cell, by the segment's low bits together with the high or the low bits of the next segment.

    A chain's first two links differ in at most 3 bits together. So beside a flip in the first segment, the next one has
    equal high bits or at most one flip in its low bits; beside none, at most one flip in its high or in its low bits.
    """

    def __init__(self, cell: int, lo: np.ndarray, hi: np.ndarray, tau: int):
        self.k, self.lo, self.hi, self.tau = cell >> _CELL_BITS, lo, hi, tau
        self.next = (self.k + 1) % SEGMENTS
        self.low = _CUTS[self.k + 1] - _CUTS[self.k] - _CELL_BITS
        self.rest = _CUTS[self.next + 1] - _CUTS[self.next] - _HIGH
        self.two, self.sub, self.a, self.b = self._bits(lo, hi)

    @cached_property
    def by_a(self):
        return _table((self.sub << _HIGH) | self.a, 1 << (self.low + _HIGH))

    @cached_property
    def by_b(self):
        return _table((self.sub << self.rest) | self.b, 1 << (self.low + self.rest))

    def _bits(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        first, second = _segment(lo, hi, self.k).astype(np.int32), _segment(lo, hi, self.next).astype(np.int32)
        return (first << 13) | second, first & ((1 << self.low) - 1), second >> self.rest, second & ((1 << self.rest) - 1)

    def _flipped(self, two, rows, sub, a, b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (home row, asking row) that differ in one bit of the segment; ``sub`` holds the low bits to look under."""
        flips = np.array([0, *(1 << x for x in range(self.rest))], np.int32)
        for i, j in _hits(self.by_a, rows, (sub << _HIGH) | a):
            yield self._near(two, i, j)
        for i, j in _hits(self.by_b, np.repeat(rows, len(flips)), (((sub << self.rest) | b)[:, None] ^ flips).ravel()):
            yield self._near(two, i, j, 1)

    def _near(self, two, i, j, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Those that keep the budget of two links and differ in at least so many of the next segment's high bits; the others were found by those bits."""
        x = self.two[i] ^ two[j]
        good = np.bitwise_count(x) * SEGMENTS <= 2 * self.tau
        if least:
            good &= np.bitwise_count((x & 0x1FFF) >> self.rest) >= least
        return i[good], j[good]

    def _check(self, lo, hi, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs those within tau whose first good chain begins here."""
        for i, j in found:
            for a in range(0, len(i), 1 << 16):
                p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                x, y = self.lo[p] ^ lo[q], self.hi[p] ^ hi[q]
                full = np.flatnonzero(np.bitwise_count(x) + np.bitwise_count(y) <= self.tau)
                if len(full) and len(full := full[_first_chain(x[full], y[full], self.k, self.tau)]):
                    yield p[full], q[full]

    def guests(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (home row, guest row), each once, with fingerprints that are here by a flip of the segment's high bits."""
        two, sub, a, b = self._bits(lo, hi)
        if len(self.lo) * len(lo) <= _FEW:
            yield from self._check(lo, hi, [self._near(two, np.repeat(np.arange(len(self.lo)), len(lo)), np.tile(np.arange(len(lo)), len(self.lo)))])
            return
        for s in range(0, len(lo), _ASKS):
            w = np.arange(s, min(s + _ASKS, len(lo)))
            yield from self._check(lo, hi, self._flipped(two, w, sub[w], a[w], b[w]))

    def homes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows at home here, each once."""
        n = len(self.lo)
        if n * n <= _FEW:
            found = [self._near(self.two, *np.triu_indices(n, 1))]
        else:
            found = (x for s in range(0, n, _ASKS) for x in self._among(np.arange(s, min(s + _ASKS, n))))
        yield from self._check(self.lo, self.hi, found)

    def _among(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the rows ``w`` find among the rows at home."""
        at, bit = np.nonzero((self.sub[w, None] >> np.arange(self.low)) & 1 == 0)
        rows = w[at]
        yield from self._flipped(self.two, rows, self.sub[rows] | (1 << bit).astype(np.int32), self.a[rows], self.b[rows])
        for table, part, bits, least in ((self.by_a, self.a, _HIGH, 0), (self.by_b, self.b, self.rest, 2)):
            key = (self.sub[w] << bits) | part[w]
            for i, j in _hits(table, w, key):
                once = i < j
                yield self._near(self.two, i[once], j[once], least)
            at, bit = np.nonzero((part[w, None] >> np.arange(bits)) & 1 == 0)
            for i, j in _hits(table, w[at], key[at] | (1 << bit)):
                yield self._near(self.two, i, j, least)


def _cells(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[tuple[_Cell, tuple[np.ndarray, np.ndarray] | None]]:
    """From rows in order of their place: each cell, and then with each batch of its guests. Only the fingerprints at home in one cell are held; guests pass by."""
    at, held, cell = -1, [], None
    for batch in batches:
        place, lo, hi = (batch.column(i).to_numpy() for i in range(3))
        lo, hi = (np.ascontiguousarray(x).view(np.uint64) for x in (lo, hi))
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            now, guest = divmod(int(place[a]), 2)
            if now != at or guest:
                if held:
                    cell = _Cell(at, *(np.concatenate(x) for x in zip(*held)), tau)
                    held = []
                    yield cell, None
                if now != at:
                    at, cell = now, None
            if not guest:
                held.append((lo[a:b], hi[a:b]))
            elif cell is not None:
                yield cell, (lo[a:b], hi[a:b])
    if held:
        yield _Cell(at, *(np.concatenate(x) for x in zip(*held)), tau), None


def _search(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Pairs of fingerprints, from rows in order of their place."""
    for cell, guests in _cells(batches, tau):
        lo, hi = guests or (cell.lo, cell.hi)
        for i, j in cell.guests(lo, hi) if guests else cell.homes():
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (cell.lo[i], cell.hi[i], lo[j], hi[j])], names=["alo", "ahi", "blo", "bhi"])


class _Links:
    """The numbers of links of a cell's fingerprints, and which of them hang together."""

    def __init__(self, cell: _Cell):
        self.cell, self.n, self.root = cell, np.zeros(len(cell.lo), np.int64), np.arange(len(cell.lo))

    def homes(self) -> None:
        for i, j in self.cell.homes():
            self.n += np.bincount(i, minlength=len(self.n)) + np.bincount(j, minlength=len(self.n))
            union(self.root, i, j)

    def guests(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        here = len(self.n)
        n, root = np.zeros(len(lo), np.int64), np.concatenate([self.root, here + np.arange(len(lo))])
        for i, j in self.cell.guests(lo, hi):
            self.n += np.bincount(i, minlength=here)
            n += np.bincount(j, minlength=len(lo))
            union(root, i, here + j)
        self.root = root[:here]  # a root is the least of its rows, so none of these is a guest
        yield from self._rows(lo, hi, n, root[here:])

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from self._rows(self.cell.lo, self.cell.hi, self.n, self.root)

    def _rows(self, lo, hi, n, root) -> Iterator[pa.RecordBatch]:
        w = np.flatnonzero(n)
        if len(w):
            to = root[w]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (lo[w], hi[w], n[w], self.cell.lo[to], self.cell.hi[to])], names=["lo", "hi", "n", "rlo", "rhi"])


def _count(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints by cell, from rows in order of their place; the pairs are counted as they are found and never held."""
    links = None
    for cell, guests in _cells(batches, tau):
        if guests:
            yield from links.guests(*guests)
            continue
        if links:
            yield from links.rows()
        links = _Links(cell)
        links.homes()
    if links:
        yield from links.rows()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lo, hi); null halves for a text without words."""

    def make():
        prints = Fingerprints()

        def work(ids, texts):
            f = prints.texts(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x and x[0] for x in f], pa.int64()), pa.array([x and x[1] for x in f], pa.int64())], names=["doc_id", "lo", "hi"])

        return work

    return map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], make, "doc_id long, lo long, hi long")


def near_pairs(distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """(alo, ahi, blo, bhi) of the pairs of distinct fingerprints (lo, hi) within ``tau`` bits, each pair once."""
    if tau >= 2 * SEGMENTS:
        raise ValueError(f"tau must be below {2 * SEGMENTS}")
    return _spread_out(distinct).mapInArrow(lambda b: _search(b, tau), "alo long, ahi long, blo long, bhi long")


def near_links(distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """Of the same pairs (lo, hi, n, rlo, rhi), not a row each: the n of a fingerprint add up to its number of pairs, and what hangs together by the pairs does by the steps from a row's fingerprint to (rlo, rhi)."""
    if tau >= 2 * SEGMENTS:
        raise ValueError(f"tau must be below {2 * SEGMENTS}")
    return _spread_out(distinct).mapInArrow(lambda b: _count(b, tau), "lo long, hi long, n long, rlo long, rhi long")


def _spread_out(distinct: DataFrame) -> DataFrame:
    # a fingerprint becomes some 50 rows, and a file of millions of them would be one task's
    parts = max(1, -(-distinct.count() // _SPREAD))
    spread = distinct.select("lo", "hi").repartition(parts, "lo", "hi").mapInArrow(_spread, "place int, lo long, hi long")
    return spread.repartition(F.shiftright("place", 1)).sortWithinPartitions("place")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(doc_id, group_id, is_duplicate, n_links) of every document."""
    prints = durable(fingerprints(docs, id_col, text_col))
    heads = durable(prints.where("doc_id is not null and lo is not null").groupBy("lo", "hi").agg(F.min("doc_id").alias("head")))
    # an id that has two fingerprints may head both; the components join them only if they are near
    found = durable(near_links(heads, tau))
    one = heads.select("lo", "hi", F.col("head").alias("a"))
    two = heads.select(F.col("lo").alias("rlo"), F.col("hi").alias("rhi"), F.col("head").alias("b"))
    steps = found.where("lo != rlo or hi != rhi").select("lo", "hi", "rlo", "rhi").distinct()
    roots = components(steps.join(one, ["lo", "hi"]).join(two, ["rlo", "rhi"]).select("a", "b"))
    links = found.groupBy("lo", "hi").agg(F.sum("n").alias("n"))
    named = heads.join(links, ["lo", "hi"], "left").join(roots, heads["head"] == roots["node"], "left").select("lo", "hi", F.coalesce("root", "head").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = prints.where("doc_id is not null and lo is not null").join(named, ["lo", "hi"])
    least = rows.groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.max("n").alias("n_links"))
    alone = prints.where("doc_id is null or lo is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return least.union(alone).select("doc_id", "group_id", F.coalesce(F.col("group_id") != F.col("doc_id"), F.lit(False)).alias("is_duplicate"), "n_links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """The documents, all columns, but the one of least id of each group only."""
    gone = durable(groups(docs, id_col, text_col, tau).where("is_duplicate").select(F.col("doc_id").alias("_gl_gone")))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gl_gone"], "left_anti")
