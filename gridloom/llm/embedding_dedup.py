"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are scaled to length 1, rotated at random (from a fixed seed) and cut into blocks of ``BLOCK`` dimensions. If
two are within squared distance T, then in some block of w of the d dimensions they are within T * w / d. Each block is
range-joined under that budget: its first two dimensions lay a grid of cells twice as wide as the block's radius, and a
vector also visits those later cells that its radius reaches, so a pair meets once a block. Inside a cell vectors are
in the order of the third dimension and meet those within the radius of it; of these the block's distances are
computed. The blocks' candidates are united and verified exactly, on the original vectors.

A vector travels as bytes, one a dimension, and its block as 16-bit numbers. What the rounding may change is added to
every bound before the exact check, so no pair within T is missed. Only distinct vectors are searched; copies follow
theirs.

The result has a row for each row of the input: (vec_id, group_id, is_duplicate, n_links), group_id the least vec_id of
the connected component of pairs with a cosine of at least ``COSINE``, n_links the number of other distinct vectors
that are so near to it.

Cases: vectors that are null, empty, zero, or hold a null or a value that isn't finite are alone, as are those of
a null id (with a null group_id). Vectors of different lengths are never near. An id that repeats is one vector if its
vectors are near; else the least group_id and the greatest n_links are given. An empty table gives an empty one. Columns besides id and vector
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, durable

COSINE, BLOCK, SEED = 0.95, 8, 7
_STEP, _FINE = 1 / 127, 1 / 32767
#: Vectors of a cell whose distances to others are computed together.
_TILE = 256


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[tuple[int, int]]:
    n = max(1, d // BLOCK)
    cuts = [d * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _bound(t: float, w: int, d: int, step: float) -> float:
    """Radius of a block, with what rounding to ``step`` may add for two vectors."""
    return math.sqrt(t * w / d) + step * math.sqrt(w) + 1e-9


def _spread(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """(key, guest, id, block, whole): key names the dimensions, the block and the cell; guest is 0 in a vector's own cell, else 1."""
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        size = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
        flat = lists.flatten().to_numpy().astype(float)
        begin = np.cumsum(size) - size
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            turns.setdefault(d, rotation(d))
            x = flat[begin[at][:, None] + np.arange(d)]
            x = x / np.linalg.norm(x, axis=1)[:, None] @ turns[d]
            whole = np.rint(x / _STEP).astype(np.int8).view(f"V{d}").ravel()
            fine = np.rint(x / _FINE).astype(np.int16)
            for k, (a, b) in enumerate(blocks(d)):
                r = _bound(t, b - a, d, _FINE)
                block = np.ascontiguousarray(fine[:, a:b])
                plane = block[:, :2].astype(float) * _FINE
                if plane.shape[1] < 2:
                    plane = np.concatenate([plane, np.zeros((len(x), 2 - plane.shape[1]))], axis=1)
                block = block.view(f"V{2 * (b - a)}").ravel()
                cell = np.floor(plane / (2 * r)).astype(np.int64)
                within = plane - cell * 2 * r
                for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
                    go = np.ones(len(x), bool)
                    for axis, step in ((0, dx), (1, dy)):
                        if step:
                            go &= (within[:, axis] >= r - 1e-9) if step > 0 else (within[:, axis] <= r + 1e-9)
                    w = np.flatnonzero(go)
                    if len(w):
                        c = cell[w] + (dx, dy)
                        key = ((d * 4096 + k) << 32) + ((c[:, 0] + 32768) << 16) + (c[:, 1] + 32768)
                        guest = np.full(len(w), int((dx, dy) != (0, 0)), np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(guest), pa.array(ids[at][w]), _binary(block[w]), _binary(whole[w])], names=["key", "guest", "id", "block", "whole"])


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal size as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _numbers(column: pa.Array, kind: type, width: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return raw.view(kind).reshape(-1, width)


class _Cell:
    """The vectors at home in a cell, in the order of the block's third dimension."""

    def __init__(self, key: int, ids: np.ndarray, block: np.ndarray, whole: np.ndarray, t: float):
        d, k = divmod(key >> 32, 4096)
        w = block.shape[1]
        self.axis, self.r, self.far = min(2, w - 1), _bound(t, w, d, _FINE), _bound(t, d, d, _STEP) ** 2 + 1e-5
        self.near = self.r * self.r + 1e-5
        self.at, self.ids, self.whole, block = self._sorted(ids, block, whole)
        self.right = np.ascontiguousarray(np.concatenate([-2 * block, np.ones((len(block), 1)), (block * block).sum(axis=1)[:, None]], axis=1, dtype=np.float32).T)
        self.left = self._left(block)

    def _sorted(self, ids, block, whole):
        order = np.argsort(block[:, self.axis], kind="stable")
        return block[order, self.axis], ids[order], whole[order], block[order]

    @staticmethod
    def _left(block: np.ndarray) -> np.ndarray:
        return np.concatenate([block, (block * block).sum(axis=1)[:, None], np.ones((len(block), 1))], axis=1, dtype=np.float32)

    def pairs(self, ids=None, block=None, whole=None) -> Iterator[pa.RecordBatch]:
        """Candidates among the vectors at home here, or between them and guests."""
        mine = ids is None
        if mine:
            at, ids, whole, left = self.at, self.ids, self.whole, self.left
        else:
            at, ids, whole, block = self._sorted(ids, block, whole)
            left = self._left(block)
        for a in range(0, len(at), _TILE):
            b = min(len(at), a + _TILE)
            lo = a if mine else int(np.searchsorted(self.at, at[a] - self.r, "left"))
            hi = int(np.searchsorted(self.at, at[b - 1] + self.r, "right"))
            if lo >= hi:
                continue
            hit = np.flatnonzero((left[a:b] @ self.right[:, lo:hi]).ravel() <= self.near)
            i, j = np.divmod(hit, hi - lo)
            i, j = i + a, j + lo
            if mine:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 100_000):
                x, y = i[s : s + 100_000], j[s : s + 100_000]
                e = (whole[x].astype(np.int32) - self.whole[y]).astype(np.float32)
                good = (e * e).sum(axis=1) * np.float32(_STEP * _STEP) <= self.far
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x[good]]), pa.array(self.ids[y[good]])], names=["a", "b"])


def _search(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs, from rows in order of cell and guest. Only the vectors at home in one cell are held; guests pass by in batches."""
    at, held, cell = None, [], None

    def home() -> _Cell:
        return _Cell(at, *(np.concatenate(x) for x in zip(*held)), t)

    for batch in batches:
        key, guest, ids = (batch.column(i).to_numpy() for i in range(3))
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(guest) != 0)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            now = int(key[a])
            if held and (now != at or guest[a]):
                cell, held = home(), []
                yield from cell.pairs()
            if now != at:
                at, cell = now, None
            d, k = divmod(now >> 32, 4096)
            w = int(np.diff(blocks(d)[k])[0])
            rows = (ids[a:b], _numbers(batch.column(3).slice(a, b - a), np.int16, w).astype(np.float64) * _FINE, _numbers(batch.column(4).slice(a, b - a), np.int8, d))
            if not guest[a]:
                held.append(rows)
            elif cell is not None:
                yield from cell.pairs(*rows)
    if held:
        yield from home().pairs()


def near_pairs(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b) ids, a < b, of the rows (id, v: array<double>) of nonzero vectors whose cosine is at least ``cosine``."""
    t = 2 - 2 * cosine
    spread = vectors.select("id", "v").mapInArrow(lambda x: _spread(x, t), "key long, guest byte, id long, block binary, whole binary")
    found = spread.repartition("key").sortWithinPartitions("key", "guest").mapInArrow(lambda x: _search(x, t), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = vectors.select(F.col("id").alias("a"), F.col("v").alias("x")), vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), lambda s, z: s + z)
    return found.join(one, "a").join(two, "b").where(dot(F.col("x"), F.col("y")) >= F.lit(cosine) * F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))).select("a", "b")


def groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, group_id, is_duplicate, n_links) of every row."""
    base = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    base = base.withColumn("ok", fine & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    # the vectors' own hash names them: an id may have several vectors, and copies one
    heads = durable(base.where("ok").groupBy("v").agg(F.min("vec_id").alias("head")).withColumn("id", F.xxhash64("v")))
    edges = durable(near_pairs(heads, cosine))
    names = heads.select("id", "head")
    roots = components(edges.join(names.withColumnsRenamed({"id": "a", "head": "p"}), "a").join(names.withColumnsRenamed({"id": "b", "head": "q"}), "b").select(F.col("p").alias("a"), F.col("q").alias("b")))
    links = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    named = heads.join(links, "id", "left").join(roots, heads["head"] == roots["node"], "left").select("v", F.coalesce("root", "head").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = base.where("ok").join(named, "v")
    least = rows.groupBy("vec_id").agg(F.min("group_id").alias("group_id"), F.max("n").alias("n_links"))
    copies = base.where("ok").select("vec_id").join(least, "vec_id")
    alone = base.where("not ok").select("vec_id", F.col("vec_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return copies.union(alone).select("vec_id", "group_id", F.coalesce(F.col("group_id") != F.col("vec_id"), F.lit(False)).alias("is_duplicate"), "n_links")
