"""Suffix-array dedup: the suffixes are ordered only through ``depth`` words, by most-significant-digit passes.

Suffixes that are equal through the depth are exactly the repeated windows. The sort is spread over the cluster by the
least hash of the 8-word grams in each window: equal windows have equal least grams, so they meet in one partition,
and a window whose least gram occurs once in the corpus is alone and leaves the sort before any of its words are sent.
What is left is sorted in place, a digit of up to eight words a pass; suffixes that are alone in their group leave
after each pass. A gram that more than ``HOT`` stretches share, such as that of a notice on a third of all documents,
isn't sent to one task: its windows are told apart by one digit over the whole depth, 128 bits of all their words, in
a grouping that adds up before the shuffle. The rows are the same.

Words are runs of letters, digits and underscores of the lower-cased text. The result has one row for each stretch
of a document in which every window of ``depth`` words occurs elsewhere too and its first occurrence (least doc_id,
then least position) moves along: (doc_id, start, n_words, first_doc_id, first_start, is_first). Positions count
words from 0. The rows that are not first are the text to drop.

Cases: documents of a null id or a null text, or of fewer words than the depth, have no rows. A row that repeats
another's id and text counts once; a row that shares only its id is another document. Windows that repeat within one
document count. Of ties the least position is first. Texts of any length are taken whole. An empty table gives an
empty one. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WordHashes, durable, map_texts

#: Words that two passages must share in a row.
DEPTH = 50
#: Stretches of one least gram that one task sorts.
HOT = 50_000
_GRAM = 8
_MULT = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) | 1 for k in range(64)], np.uint64)
_TOKEN_BYTES = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of g[i:i + width]: the least value, its first and its last place."""
    v, lo = g, np.arange(len(g), dtype=np.int32)
    hi, have = lo, 1
    while have < width:
        step = min(have, width - have)
        a, b = v[:-step], v[step:]
        left, right = a <= b, b <= a
        v, lo, hi = np.where(left, a, b), np.where(left, lo[:-step], lo[step:]), np.where(right, hi[step:], hi[:-step])
        have += step
    return v, lo, hi


def _runs(h: np.ndarray, starts: np.ndarray, depth: int):
    """Stretches of windows with one least gram: (document, first window, windows, gram hash, whether it may meet itself)."""
    gram = min(_GRAM, depth)
    width = depth - gram + 1
    if len(h) < depth:
        return None
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        g += h[k : k + len(g)] * _MULT[k]
    v, lo, hi = _least(_mix(g), width)
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    good = doc[: len(v)] == doc[depth - 1 :]  # windows within one document
    at = np.flatnonzero(good)
    if not len(at):
        return None
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (v[at[1:]] != v[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    cut = np.flatnonzero(first)
    n = np.diff(np.append(cut, len(at)))
    again = np.maximum.reduceat((lo != hi)[at], cut) | (n > width)
    begin = at[cut]
    d = doc[begin]
    return d, (begin - starts[d]).astype(np.int32), n.astype(np.int32), v[begin].view(np.int64), again


def _ranks(t: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Order-preserving names of the words from each place on, for widths 1, 2, 4 and 8 as the depth needs them."""
    out, w = {1: t}, 1
    while w < 8 and 2 * w <= depth:
        a = out[w]
        pad = np.zeros(len(a), np.int64)
        pad[:-w or None] = a[w:]
        out[2 * w] = np.unique((a << 32) | pad, return_inverse=True)[1]
        w *= 2
    return out


def _sort(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Most-significant-digit passes over the suffixes of one partition."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    table = table.combine_chunks()
    doc, fp, start = (table.column(i).to_numpy().astype(np.int64) for i in range(3))
    words = table.column(3).combine_chunks()
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _TOKEN_BYTES)
    t = np.unique(raw.view(np.int64).ravel(), return_inverse=True)[1]
    begin = (offsets[:-1] - offsets[0]) // _TOKEN_BYTES
    n = (np.diff(offsets) // _TOKEN_BYTES) - depth + 1
    digits = _ranks(t, depth)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((start[row] + within, fp[row], doc[row]))
    row, within = row[order], within[order]
    pos = start[row] + within
    fresh = np.ones(len(row), bool)
    fresh[1:] = (doc[row[1:]] != doc[row[:-1]]) | (fp[row[1:]] != fp[row[:-1]]) | (pos[1:] != pos[:-1])
    row, within, pos = row[fresh], within[fresh], pos[fresh]  # repeated rows count once
    at, group, used = begin[row] + within, np.zeros(len(row), np.int64), 0
    alive = np.arange(len(row))
    while used < depth and len(alive):
        w = max(x for x in digits if x <= depth - used)
        _, group, count = np.unique((group << 32) | digits[w][at[alive] + used], return_inverse=True, return_counts=True)
        keep = count[group] > 1
        alive, group, used = alive[keep], group[keep], used + w
    if not len(alive):
        return
    # alive is in order of (doc, fp, place), so the first of a group is its first occurrence
    _, where, inverse = np.unique(group, return_index=True, return_inverse=True)
    rep = alive[where][inverse]
    d, f, p, r = doc[row[alive]], fp[row[alive]], pos[alive], rep
    rd, rp = doc[row[r]], pos[r]
    new = np.ones(len(alive), bool)
    new[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (p[1:] != p[:-1] + 1) | (rd[1:] != rd[:-1]) | (rp[1:] != rp[:-1] + 1)
    cut = np.flatnonzero(new)
    size = np.diff(np.append(cut, len(alive)))
    for a in range(0, len(cut), 100_000):
        c = cut[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d[c], f[c], p[c], size[a : a + 100_000], rd[c], rp[c])], names=["doc_id", "fp", "start", "n", "first_doc_id", "first_start"])


def _windows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, start, k1, k2): each window with 128 bits of its words."""
    for batch in batches:
        for i, f, start, words in zip(*(batch.column(k).to_pylist() for k in range(4))):
            t = np.frombuffer(words, np.uint64)
            n = len(t) - depth + 1
            keys = []
            for turn in (1, 2):
                g, x = np.zeros(n, np.uint64), _mix(t * np.uint64(2 * turn + 1))
                for k in range(depth):
                    g = g * _MULT[turn] + x[k : k + n]
                keys.append(pa.array(_mix(g).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.full(n, f)), pa.array(start + np.arange(n, dtype=np.int64)), *keys], names=["doc_id", "fp", "start", "k1", "k2"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, first_start, is_first) of all passages that repeat."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null and text is not null").withColumn("fp", F.xxhash64("text"))

    def find():
        hashes = WordHashes()

        def work(ids, fps, texts):
            h, starts = hashes.texts(texts)
            found = _runs(h, starts, depth)
            if found is None:
                return None
            d, begin, n, gram, again = found
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[d]), pa.array(np.array(fps, np.int64)[d]), pa.array(begin), pa.array(n), pa.array(gram), pa.array(again)], names=["doc_id", "fp", "start", "n", "gram", "again"])

        return work

    runs = durable(map_texts(base, ["doc_id", "fp", "text"], find, "doc_id long, fp long, start int, n int, gram long, again boolean"))
    grams = durable(runs.groupBy("gram").agg(F.count("*").alias("c"), F.max("again").alias("s")).where("c > 1 or s"))

    def words():
        hashes = WordHashes()

        def work(ids, fps, runs, texts):
            h, starts = hashes.texts(texts)
            raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES]
            out = ([], [], [], [], [])
            for k, (i, f, rs) in enumerate(zip(ids, fps, runs)):
                for r in rs:
                    a = int(starts[k]) + r["start"]
                    for to, x in zip(out, (i, f, r["start"], raw[a : a + r["n"] + depth - 1].tobytes(), r["gram"])):
                        to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "fp", "start", "words", "gram"])

        return work

    def sent(shared: DataFrame) -> DataFrame:
        """(doc_id, fp, start, words, gram) of the stretches whose gram is among ``shared``."""
        wanted = runs.join(shared.select("gram"), "gram").groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "n", "gram")).alias("runs"))
        return map_texts(base.join(wanted, ["doc_id", "fp"]), ["doc_id", "fp", "runs", "text"], words, "doc_id long, fp long, start int, words binary, gram long")

    pieces = sent(grams.where(F.col("c") <= hot)).repartition("gram").select("doc_id", "fp", "start", "words").mapInArrow(lambda b: _sort(b, depth), "doc_id long, fp long, start long, n long, first_doc_id long, first_start long")
    if not (many := grams.where(F.col("c") > hot)).isEmpty():
        each = durable(sent(many).select("doc_id", "fp", "start", "words").mapInArrow(lambda b: _windows(b, depth), "doc_id long, fp long, start long, k1 long, k2 long").distinct())
        first = each.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "fp", "start")).alias("m"), F.count("*").alias("c")).where("c > 1")
        pieces = pieces.union(each.join(first, ["k1", "k2"]).select("doc_id", "fp", "start", F.lit(1).cast("long").alias("n"), F.col("m.doc_id").alias("first_doc_id"), F.col("m.start").alias("first_start")))
    line = Window.partitionBy("doc_id", "fp", "first_doc_id", F.col("first_start") - F.col("start")).orderBy("start")
    joined = pieces.withColumn("new", (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("n")).over(line), F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(line))
    return (
        joined.groupBy("doc_id", "fp", "first_doc_id", (F.col("first_start") - F.col("start")).alias("shift"), "island")
        .agg(F.min("start").alias("start"), (F.sum("n") + F.lit(depth - 1)).alias("n_words"), F.min("first_start").alias("first_start"))
        .select("doc_id", "start", "n_words", "first_doc_id", "first_start", ((F.col("doc_id") == F.col("first_doc_id")) & (F.col("start") == F.col("first_start"))).alias("is_first"))
    )
