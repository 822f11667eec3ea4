"""Benchmark decontamination by spaced seeds.

A mask names the word positions of a short span that are hashed; the others may differ. Hashes of the benchmark's
words under each mask are looked up in those of the documents. Around a hit the item is laid beside the document at
the hit's offset, and windows of ``WINDOW`` words (or the whole item, if that is shorter) count as an overlap where at
least ``MATCH`` of their words agree. So passages with substituted words are found. Items of fewer than ``SHORT`` words
are cut into one piece more than words may differ in them: one piece of a copy is whole, so all their copies are found.

The result has one row for each document and item that overlap: (doc_id, item_id, n_covered, item_words, doc_start).
n_covered counts the item's words inside such windows; doc_start is the document's word where the first one begins.
Words are runs of letters, digits and underscores of the lower-cased text.

The hashed benchmark goes to each task while it is small; a larger one is cut into parts of ``PART_BYTES`` and the
documents are read once for each, so no side that is sent grows without bound. The rows are the same.

Cases: null or empty texts, on either side, overlap nothing, nor do items without a word.
Documents or items that repeat have rows each; a null id stays null. Texts of any length are taken whole. An empty
table on either side gives an empty one. Columns besides id and text are ignored, and kept by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordHashes, csr_take, filter_texts, map_texts

MASKS = ((0, 1, 3, 4, 6, 7), (0, 2, 3, 6, 7, 8), (0, 1, 2, 4, 6, 9), (0, 1, 4, 6, 9, 10))
WINDOW, MATCH, SHORT = 16, 0.8, 15
PART_BYTES = 8 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_BITS = 20
_HITS = 4_000_000


def _seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(h) - mask[-1])
    out = np.zeros(n, np.uint64)
    for c, k in zip(_MULT, mask):
        out += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(32))) * c
    return out ^ (out >> np.uint64(31))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct columns of an array of three rows."""
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (np.diff(rows, axis=1) != 0).any(axis=0)
    return rows[:, new]


def _pieces(starts: np.ndarray, window: int, match: float) -> dict[int, np.ndarray]:
    """First words of the pieces of short items, by the number of words of a piece."""
    out: dict[int, list[int]] = {}
    for a, n in zip(starts[:-1].tolist(), np.diff(starts).tolist()):
        if 0 < n < min(SHORT, window + 1):
            k = min(n, n - math.ceil(match * n - 1e-9) + 1)
            cuts = [a + n * j // k for j in range(k + 1)]
            for b, c in zip(cuts, cuts[1:]):
                out.setdefault(min(c - b, len(_MULT)), []).append(b)
    return {m: np.array(at, np.int64) for m, at in out.items()}


class Seeds:
    """The benchmark's words by item, and its seeds."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW, match: float = MATCH):
        self.ids, self.window, self.match = [i for i, _ in items], window, match
        self.words, self.starts = WordHashes().texts([t for _, t in items])
        item = np.repeat(np.arange(len(items)), np.diff(self.starts))
        self.index = []
        spaced = [(mask, None) for mask in MASKS]
        for mask, at in spaced + [(tuple(range(m)), at) for m, at in _pieces(self.starts, window, match).items()]:
            s = _seeds(self.words, mask)
            if at is None:
                at = np.flatnonzero(item[: len(s)] == item[mask[-1] :]) if len(s) else np.zeros(0, np.int64)
            at = at[np.argsort(s[at], kind="stable")]
            first = np.zeros(1 << _BITS, bool)
            first[(s[at] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.index.append((mask, s[at], at, first))
        self.item = item

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item, offset of the document's words from the item's)."""
        found = []
        for mask, keys, at, first in self.index:
            s = _seeds(h, mask)
            if not len(s) or not len(keys):
                continue
            p = np.flatnonzero(first[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
            p = p[doc[p] == doc[p + mask[-1]]]
            lo, hi = np.searchsorted(keys, s[p], "left"), np.searchsorted(keys, s[p], "right")
            n = hi - lo
            ends = np.cumsum(n)
            a = 0
            while a < len(p):  # repetitive texts hit often; so many hits at a time, and each offset once
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HITS, "right")))
                at_doc, at_item = np.repeat(p[a:b], n[a:b]), csr_take(at, lo[a:b], n[a:b])
                found.append(_distinct(np.stack([doc[at_doc], self.item[at_item], at_doc - at_item])))
                a = b
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(_distinct(np.concatenate(found, axis=1)))

    def overlaps(self, h: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (words covered, first word of the document)."""
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        seen: dict[tuple[int, int], list] = {}
        for d, i, o in zip(*(x.tolist() for x in self.candidates(h, doc))):
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            w = min(self.window, b - a)
            lo, hi = max(a, int(starts[d]) - o), min(b, int(starts[d + 1]) - o)
            if hi - lo < w:
                continue
            same = np.cumsum(np.concatenate([[0], self.words[lo:hi] == h[lo + o : hi + o]]))
            good = np.flatnonzero(same[w:] - same[:-w] >= math.ceil(self.match * w - 1e-9))
            if len(good):
                cover, first = seen.setdefault((d, i), [np.zeros(b - a, bool), lo + o + int(good[0]) - int(starts[d])])
                for k in good.tolist():
                    cover[lo - a + k : lo - a + k + w] = True
                seen[d, i][1] = min(first, lo + o + int(good[0]) - int(starts[d]))
        return {k: (int(c.sum()), f) for k, (c, f) in seen.items()}


def _parts(bench: DataFrame, id_col: str, text_col: str, part_bytes: int) -> list[list[tuple[int | None, str]]]:
    items = bench.select(bench[id_col].cast("long").alias("i"), bench[text_col].alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // part_bytes))
    return [[(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n)]


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, match: float = MATCH, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, n_covered, item_words, doc_start) of the overlaps."""
    out = None
    for part in _parts(bench, item_col, item_text_col, part_bytes):

        def make(part=part) -> Callable:
            seeds, hashes = Seeds(part, window, match), WordHashes()

            def work(ids, texts):
                found = seeds.overlaps(*hashes.texts(texts))
                rows = [(ids[d], seeds.ids[i], n, int(seeds.starts[i + 1] - seeds.starts[i]), first) for (d, i), (n, first) in found.items()]
                cols = list(zip(*rows)) if rows else [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "n_covered", "item_words", "doc_start"])

            return work

        found = map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], make, "doc_id long, item_id long, n_covered int, item_words int, doc_start int")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, match: float = MATCH, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that overlap no item."""
    for part in _parts(bench, item_col, item_text_col, part_bytes):

        def make(part=part) -> Callable:
            seeds, hashes = Seeds(part, window, match), WordHashes()

            def keep(texts):
                hit = {d for d, _ in seeds.overlaps(*hashes.texts(texts))}
                return [k not in hit for k in range(len(texts))]

            return keep

        docs = filter_texts(docs, text_col, make)
    return docs
