"""Token-id output by Re-Pair grammar compression.

Documents are encoded to the ids of a public byte-level tokenizer and gathered into shards of about ``SHARD_IDS`` ids, in the order of the scan. In
each shard the most frequent pairs of neighbouring ids are replaced by nonterminals, again and again, until no pair is
frequent. A round counts all pairs and replaces those that occur at least ``SHARE`` times as often as the most
frequent one; of overlapping occurrences the more frequent pair goes first, then the left one. No pair crosses from
a document to the next.

A shard's row holds doc_ids, n_tokens (by document), doc_ends (end of each document in the symbols), the rules
(left and right id of each nonterminal, which are ids from ``base`` on), the expansion length of each nonterminal, and
the symbols, as little-endian integers of ``width`` bytes. The lengths let a reader find and decode any range of a
document's tokens without expanding what is before it (``decode_range``).

Cases: a null text has null n_tokens and no symbols, an empty one 0. Repeated rows and null ids are kept as they are.
A document is never split, however long, so a shard may be larger. Which documents share a shard follows the splits of
the scan; the shards together always decode to all documents. An empty table gives no shards. Columns besides id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm.common import csr_take, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_IDS, MIN_COUNT, SHARE = 1 << 21, 8, 0.25
SCHEMA = "shard long, doc_ids array<long>, n_tokens array<int>, doc_ends array<int>, base int, width int, rules binary, lengths binary, symbols binary"


def tokenizer(vocabulary: str = VOCABULARY):
    """The tokenizer of a file of ranks; special tokens are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _choose(at: np.ndarray, after: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the occurrences at the sorted places ``at``, whose second symbols are at ``after``, to replace, so that none shares a symbol: low rank first, then left.

    Along a chain of overlapping ones, each second one from a low to the next high is taken, going either way.
    """
    touch = after[:-1] == at[1:]
    rises, falls = np.zeros(len(at), bool), np.zeros(len(at), bool)
    rises[1:] = touch & (rank[:-1] <= rank[1:])
    falls[:-1] = touch & (rank[1:] < rank[:-1])
    k = np.arange(len(at), dtype=np.int32)
    low_left = np.maximum.accumulate(np.where(rises, np.int32(0), k))
    low_right = np.minimum.accumulate(np.where(falls, np.int32(len(at)), k)[::-1])[::-1]
    return np.flatnonzero(((k - low_left) | (low_right - k)) & 1 == 0)


class _Places:
    """The places of each frequent pair, by the pair's number; a pair's places stand in the pool in a row, also those that have lost it."""

    def __init__(self, seq: np.ndarray, after: np.ndarray, min_count: int):
        self.seq, self.after, self.n, self.min_count = seq, after, len(seq), min_count
        self.of = np.full(self.n + 1, -1, np.int32)  # number of the pair that begins at a place; -1 for none and for rare ones
        self.pool, self.used = np.empty(3 * self.n + 1, np.int32), 0  # a replacement brings two places at most and takes a symbol
        self.keys, self.count, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def enter(self, at: np.ndarray, ids: int) -> None:
        """Number the frequent ones of the pairs at the places ``at``; none of them may occur elsewhere. Ids are below ``ids``."""
        at = at[self.after[at] < self.n]
        if len(at) < self.min_count:
            return
        wide, bits = (ids - 1).bit_length(), self.n.bit_length()
        left, right = self.seq[at].astype(np.uint64), self.seq[self.after[at]]
        if 2 * wide + bits <= 64:
            left <<= np.uint64(wide)
            left |= right.astype(np.uint64)
            left <<= np.uint64(bits)
            left |= at.astype(np.uint64)
            left.sort()
            at = (left & np.uint64((1 << bits) - 1)).astype(np.int32)
            left >>= np.uint64(bits)
        else:
            left = (left << np.uint64(32)) | right.astype(np.uint64)
            order = np.argsort(left, kind="stable")
            at, left = at[order], left[order]
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        size = np.diff(np.append(first, len(left)))
        frequent = size >= self.min_count
        at, first, size = at[np.repeat(frequent, size)], first[frequent], size[frequent]
        if not len(size):
            return
        begin = np.cumsum(size) - size
        heads = at[begin]
        self.of[at] = np.repeat(np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32), size)
        self.pool[self.used : self.used + len(at)] = at
        self.keys = np.concatenate([self.keys, (self.seq[heads].astype(np.uint64) << np.uint64(32)) | self.seq[self.after[heads]].astype(np.uint64)])
        self.count, self.first, self.size = np.concatenate([self.count, size]), np.concatenate([self.first, self.used + begin]), np.concatenate([self.size, size])
        self.used += len(at)

    def leave(self, at: np.ndarray) -> None:
        """The distinct places ``at`` lose their pairs."""
        lost = self.of[at]
        self.count -= np.bincount(lost[lost >= 0], minlength=len(self.count))
        self.of[at] = -1

    def places(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the pairs ``pick``, in order, which of ``pick`` each begins)."""
        at, rank = csr_take(self.pool, self.first[pick], self.size[pick]), np.repeat(np.arange(len(pick)), self.size[pick])
        now = self.of[at] == pick[rank]
        both = np.sort((at[now].astype(np.int64) << 32) | rank[now])
        return (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)


def compress(seq: np.ndarray, ends: np.ndarray, base: int, min_count: int = MIN_COUNT, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document ends, rules [n, 2], expansion lengths) of ids below ``base``.

    A replacement makes new pairs only beside its nonterminal, which no earlier pair holds, and no old pair more frequent.
    So counts are kept, and a round visits no places but those of the pairs it replaces and those beside them.
    """
    seq, ends, n = seq.astype(np.int32), ends.astype(np.int64), len(seq)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    made, floor = 0, 1 << 62
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # neighbours; n is none
    starts = np.append(0, ends[ends < n])
    before[starts], after[ends[ends > 0] - 1] = n, n
    keep = np.ones(n, bool)
    pairs = _Places(seq, after, min_count)
    pairs.enter(np.arange(n, dtype=np.int32), max(base, int(seq.max(initial=0)) + 1))
    while True:
        most = int(pairs.count.max(initial=0))
        if most < min_count:
            break
        floor = max(min_count, share * min(floor, most))
        pick = np.flatnonzero(pairs.count >= floor)
        pick = pick[np.lexsort((pairs.keys[pick], -pairs.count[pick]))]
        keys = pairs.keys[pick]
        put, rank = pairs.places(pick)
        chosen = _choose(put, after[put], rank)
        put, rank = put[chosen], rank[chosen]
        uses = np.bincount(rank, minlength=len(keys))
        good = uses >= min(3, min_count)
        if not good.any():
            if floor == min_count:
                break
            continue
        name = np.full(len(keys), -1, np.int32)
        name[good] = base + made + np.arange(good.sum(), dtype=np.int32)
        put, rank = put[good[rank]], rank[good[rank]]
        fresh = np.stack([(keys[good] >> np.uint64(32)).astype(np.int32), (keys[good] & np.uint64(0xFFFFFFFF)).astype(np.int32)], axis=1)
        size = [np.where(x < base, 1, lengths[np.maximum(x - base, 0)] if len(lengths) else 1) for x in fresh.T]
        rules.append(fresh)
        lengths = np.concatenate([lengths, size[0] + size[1]])
        made += len(fresh)
        gone, left = after[put], before[put]
        pairs.leave(np.concatenate([put, gone, left[1:][left[1:] != gone[:-1]], left[:1]]))
        seq[put] = name[rank]
        keep[gone] = False
        after[put] = after[gone]
        before[after[put]] = put
        left = before[put]
        left = np.concatenate([left[1:][left[1:] != put[:-1]], left[:1]])
        pairs.enter(np.concatenate([put, left[left < n]]), base + made)
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    return seq[keep], ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.int32), lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while len(symbols) and symbols.max() >= base:
        big = symbols >= base
        start = np.cumsum(1 + big) - (1 + big)
        out = np.empty(len(symbols) + int(big.sum()), np.int32)
        out[start[~big]] = symbols[~big]
        pairs = rules[symbols[big] - base]
        out[start[big]], out[start[big] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols


def _pack(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<i4").ravel()


def _shard(number: int, ids: list, counts: list, flats: list[np.ndarray], base: int) -> pa.RecordBatch:
    seq = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    symbols, ends, rules, lengths = compress(seq, np.cumsum([c or 0 for c in counts]), base)
    width = max(1, (int(base + len(rules)).bit_length() + 7) // 8)
    row = (number, ids, counts, ends.tolist(), base, width, _pack(rules.ravel(), width), _pack(lengths, 4), _pack(symbols, width))
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards' rows, as ``SCHEMA`` names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(vocabulary)
        base, part, k = codec.n_vocab, TaskContext.get().partitionId(), 0
        ids, counts, flats, held = [], [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                coded = [None if t is None else codec.encode_ordinary(t) for t in texts[a:b]]
                ids += keys[a:b]
                counts += [None if c is None else len(c) for c in coded]
                flats.append(np.fromiter(chain.from_iterable(c for c in coded if c), np.int32))
                held += len(flats[-1])
                if held >= shard_ids:
                    yield _shard((part << 32) + k, ids, counts, flats, base)
                    ids, counts, flats, held, k = [], [], [], 0, k + 1
        if ids:
            yield _shard((part << 32) + k, ids, counts, flats, base)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


class Shard:
    """Reads a shard's row."""

    def __init__(self, row):
        self.base, self.ids, self.counts, self.ends = row["base"], row["doc_ids"], row["n_tokens"], [0, *row["doc_ends"]]
        self.rules = _unpack(row["rules"], row["width"]).reshape(-1, 2)
        self.lengths, self.symbols = _unpack(row["lengths"], 4), _unpack(row["symbols"], row["width"])

    def decode_range(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard's document number ``doc``."""
        s = self.symbols[self.ends[doc] : self.ends[doc + 1]]
        size = np.ones(len(s), np.int64)
        size[s >= self.base] = self.lengths[s[s >= self.base] - self.base]
        total = np.cumsum(size)
        a = int(np.searchsorted(total, start, "right"))
        b = int(np.searchsorted(total, stop, "left")) + 1
        skip = int(total[a - 1]) if a else 0
        return expand(s[a:b], self.rules, self.base)[start - skip : max(start, stop) - skip]

    def decode(self, doc: int) -> list[int] | None:
        return None if self.counts[doc] is None else expand(self.symbols[self.ends[doc] : self.ends[doc + 1]], self.rules, self.base).tolist()


def read(rows: DataFrame) -> DataFrame:
    """(doc_id, token_ids) of all documents of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array([shard.decode(k) for k in range(len(shard.ids))], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return rows.mapInArrow(run, "doc_id long, token_ids array<int>")
