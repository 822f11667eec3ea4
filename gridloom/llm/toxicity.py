"""Toxicity by a counterfactually regularised logistic classifier.

A document's features are its words and their prefixes of 4 to 8 letters; a feature's value is its share of the
document's words, times ``RATE``, at most 1. The fit minimises the logistic loss over labelled documents, a ridge
term, and for each labelled document that names an identity group the squared change of its score when the group's
term is swapped for another of the same kind. So a score doesn't hang on which group a text mentions, and neutral
mentions are rejected less often.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, those of least hash of the id) with all features
that they have. Tasks make the documents' features, as hashes; one task solves. Scoring reads all documents.

The result has a row for each row of the input: (doc_id, score, toxic). score is the log odds, to six digits.

Cases: a null text has a null score and isn't toxic; one without words has the intercept. Labels that are null, of
other values than 0 and 1, or of no document are left out; labels that repeat count each. Without labelled documents
of both classes every score is 0 and nothing is toxic. Texts of any length are taken whole; an empty table gives an
empty one; other columns are ignored, and kept by ``keep_clean``.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordIndex, csr_take, filter_texts, map_texts, words_of

SAMPLE = 10_000
_CHUNK = 1 << 20
RIDGE, FAIR, ROUNDS, RATE = 1e-4, 5.0, 30, 50.0
#: Terms of a row stand for groups of one kind; a swap takes the next of the row.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "hispanic"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("transgender", "cisgender"),
    ("immigrant", "citizen", "refugee", "foreigner"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("german", "french", "spanish", "english", "american", "mexican", "chinese", "russian", "turkish", "polish"),
)
SWAP = {w: row[(k + 1) % len(row)] for row in IDENTITY for k, w in enumerate(row)}
#: Intercept, hashes of the features in order, and their weights.
Model = tuple[float, np.ndarray, np.ndarray]
NOTHING: Model = (0.0, np.zeros(0, np.int64), np.zeros(0))


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(4, 9) if len(word) > k)]


def swapped(words: dict[str, int]) -> dict[str, int]:
    out: Counter = Counter()
    for w, c in words.items():
        out[SWAP.get(w, w)] += c
    return out


class Features:
    """Hashes of words' features, kept by word."""

    def __init__(self, keep: int = 400_000):
        self.reset()
        self.index = WordIndex(self._add, self.reset, keep)

    def reset(self) -> None:
        self.pool, self.ends = array("q"), array("q", [0])

    def _add(self, word: str) -> None:
        import xxhash

        self.pool.frombytes(b"".join(xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for f in features_of(word)))
        self.ends.append(len(self.pool))

    def values(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's features and their values, from its distinct words and how often they occur."""
        rows = self.index.rows(words)
        ends = np.frombuffer(self.ends, np.int64)
        size = ends[rows + 1] - ends[rows]
        found, at = np.unique(csr_take(np.frombuffer(self.pool, np.int64), ends[rows], size), return_inverse=True)
        return found, np.minimum(1.0, RATE * np.bincount(at, np.repeat(times, size), len(found)) / times.sum())


class _Matrix:
    """Rows of (columns, values)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray):
        self.n, self.width = len(rows), len(vocabulary)
        self.size = np.array([len(f) for f, _ in rows], np.int64)
        self.full = np.flatnonzero(self.size)
        self.begin = (np.cumsum(self.size) - self.size)[self.full]
        # row by row, so that nothing but the rows and their narrow columns is held
        self.col, self.val = np.empty(int(self.size.sum()), np.int32), np.empty(int(self.size.sum()))
        at = 0
        for f, v in rows:
            self.col[at : at + len(f)], self.val[at : at + len(f)] = np.searchsorted(vocabulary, f), v
            at += len(f)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(self.val * w[self.col], self.begin)
        return out

    def back(self, r: np.ndarray, square: bool = False) -> np.ndarray:
        """The transpose times r, or that of the squares."""
        v = self.val * np.repeat(r, self.size)
        return np.bincount(self.col, v * self.val if square else v, self.width)

    def take(self, columns: np.ndarray, name: np.ndarray) -> None:
        """Keep only these columns, under their new names."""
        here = np.zeros(self.width, bool)
        here[columns] = True
        stay = here[self.col]
        self.size = np.bincount(np.repeat(np.arange(self.n), self.size)[stay], minlength=self.n)
        self.full = np.flatnonzero(self.size)
        self.begin = (np.cumsum(self.size) - self.size)[self.full]
        self.col, self.val, self.width = name[self.col[stay]], self.val[stay], len(columns)


def _alike(parts: list[_Matrix]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names by column, equal for columns of equal rows and values in all parts (by 128 bits); a column and the number of columns of each name."""
    sums = np.zeros((2, parts[0].width), np.uint64)
    for k, m in enumerate(parts):
        ends = np.cumsum(m.size)
        for a in range(0, len(m.col), _CHUNK):
            col, val = m.col[a : a + _CHUNK], m.val[a : a + _CHUNK].view(np.uint64)
            row = np.searchsorted(ends, np.arange(a, a + len(col)), "right").astype(np.uint64) + np.uint64(k << 32)
            for total, (p, q) in zip(sums, ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))):
                z = (row + np.uint64(1)) * np.uint64(p) ^ val * np.uint64(q)
                z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                np.add.at(total, col, z ^ (z >> np.uint64(29)))
    _, first, alike, many = np.unique(np.stack(sums, axis=1).view("u8,u8").ravel(), return_index=True, return_inverse=True, return_counts=True)
    return alike, first, many


def solve(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, change: list[tuple[np.ndarray, np.ndarray]], fair: float = FAIR, ridge: float = RIDGE) -> Model:
    """The least loss, by Newton's method with conjugate gradients. ``change``: what swaps take from and add to documents that name a group."""
    if not len(y) or y.min() == y.max():
        return NOTHING
    features = np.zeros(0, np.int64)
    for a in range(0, len(rows) + len(change), 500):
        features = np.union1d(features, np.concatenate([f for f, _ in (rows + change)[a : a + 500]]))
    x, d, n = _Matrix(rows, features), _Matrix(change, features), len(y)
    push = 2 * fair / max(1, len(change))
    # features that are alike in all documents, as rare words and their prefixes are, share one weight: the loss is that of its equal shares
    alike, vocabulary, many = _alike([x, d])
    x.take(vocabulary, alike)
    d.take(vocabulary, alike)
    ridge = ridge / many

    def join(b: float, w: np.ndarray) -> np.ndarray:
        return np.concatenate([[b], w])

    def extra(v: np.ndarray) -> np.ndarray:
        return join(1e-9 * v[0], ridge * v[1:] + (push * d.back(d @ v[1:]) if len(change) else 0))

    w, first = np.zeros(len(vocabulary) + 1), None
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
        e, s = (p - y) / n, p * (1 - p) / n
        g = join(e.sum(), x.back(e)) + extra(w)
        first = first or np.abs(g).max()
        if np.abs(g).max() <= 1e-3 * first:
            break
        scale = join(s.sum() + 1e-9, x.back(s, True) + ridge + (push * d.back(np.ones(len(change)), True) if len(change) else 0)) + 1e-12

        def curve(v: np.ndarray) -> np.ndarray:
            t = s * (v[0] + x @ v[1:])
            return join(t.sum(), x.back(t)) + extra(v)

        step, r = np.zeros(len(w)), g.copy()
        z = r / scale
        q, rz = z.copy(), r @ z
        goal = 0.01 * rz
        for _ in range(20):
            h = curve(q)
            a = rz / (q @ h)
            step += a * q
            r -= a * h
            z = r / scale
            rz, old = r @ z, rz
            if rz < goal:
                break
            q = z + (rz / old) * q
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
    return float(w[0]), features, (w[1:] / many)[alike]


def of_words(words: dict[str, int], make: Features) -> tuple[np.ndarray, np.ndarray]:
    return make.values(list(words), np.array(list(words.values()), np.int64)) if words else (np.zeros(0, np.int64), np.zeros(0))


def change_of(words: dict[str, int], make: Features) -> tuple[np.ndarray, np.ndarray] | None:
    """Values that a swap of the identity terms takes away, less those that it adds; None without any such term."""
    if SWAP.keys().isdisjoint(words):
        return None
    (f, v), (g, u) = of_words(words, make), of_words(swapped(words), make)
    found, at = np.unique(np.concatenate([f, g]), return_inverse=True)
    diff = np.bincount(at, np.concatenate([v, -u]), len(found))
    return found[diff != 0], diff[diff != 0]


def train(rows: list[tuple[dict[str, int], int]], fair: float = FAIR, ridge: float = RIDGE) -> Model:
    """The model of (word counts, label) rows."""
    make = Features()
    return solve([of_words(ws, make) for ws, _ in rows], np.array([t for _, t in rows], float), [c for ws, _ in rows if (c := change_of(ws, make)) is not None], fair, ridge)


class Scorer:
    """Scores batches of texts; keeps the features of the words seen."""

    def __init__(self, model: Model, keep: int = 400_000):
        self.intercept, self.hashes, self.weights = model
        self.make = Features()
        self.reset()
        self.index = WordIndex(self._add, self.reset, keep)

    def reset(self) -> None:
        self.pool, self.ends = array("i"), array("q", [0])

    def _add(self, word: str) -> None:
        self.make.reset()
        self.make._add(word)
        h = np.frombuffer(self.make.pool, np.int64)
        at = np.searchsorted(self.hashes, h)
        at = at[at < len(self.hashes)] if not len(self.hashes) else at[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)]
        self.pool.extend(at.tolist())
        self.ends.append(len(self.pool))

    def texts(self, texts: list[str | None]) -> list[float | None]:
        each = [words_of(t.lower()) if t else [] for t in texts]
        rows = self.index.rows([w for ws in each for w in ws])
        n = np.array([len(ws) for ws in each], np.int64)
        total = np.full(len(texts), self.intercept)
        if len(rows) and len(self.weights) and len(self.pool):
            ends = np.frombuffer(self.ends, np.int64)
            size = ends[rows + 1] - ends[rows]
            some = np.flatnonzero(size)
            found = csr_take(np.frombuffer(self.pool, np.int32), ends[rows[some]], size[some]).astype(np.int64)
            doc = np.repeat(np.repeat(np.arange(len(texts)), n)[some], size[some])
            key, count = np.unique(doc * len(self.weights) + found, return_counts=True)
            doc, found = np.divmod(key, len(self.weights))
            total += np.bincount(doc, np.minimum(1.0, RATE * count / n[doc]) * self.weights[found], len(texts))
        return [None if t is None else round(s, 6) for t, s in zip(texts, total.tolist())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, fair: float = FAIR) -> Model:
    """The model of at most ``sample`` labelled rows."""
    marked = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("y")).where("i is not null and y in (0, 1)").orderBy(F.xxhash64("i"), "i", "y").limit(sample)
    # the sample is bounded; adaptive execution sends it to the documents
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("text")).where("text is not null").join(F.broadcast(marked), "i")

    def split():
        made = Features()

        def work(ys, ids, texts):
            counts = [Counter(words_of(t.lower())) for t in texts]
            full, change = [of_words(c, made) for c in counts], [change_of(c, made) for c in counts]
            cols = [pa.array([f for f, _ in full], pa.list_(pa.int64())), pa.array([v for _, v in full], pa.list_(pa.float64())), pa.array([c and c[0] for c in change], pa.list_(pa.int64())), pa.array([c and c[1] for c in change], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(ys, pa.int32()), pa.array(ids, pa.int64())], names=["f", "v", "cf", "cv", "y", "i"])

        return work

    sets = map_texts(rows, ["y", F.col("i").cast("long").alias("i"), "text"], split, "f array<long>, v array<double>, cf array<long>, cv array<double>, y int, i long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            lists = [[np.asarray(x.values) if x.is_valid else None for x in b.column(k)] for k in range(4)]
            seen += zip(b.column(5).to_pylist(), b.column(4).to_pylist(), *lists)
        seen.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2])))
        intercept, features, weights = solve([(r[2], r[3]) for r in seen], np.array([r[1] for r in seen], float), [(r[4], r[5]) for r in seen if r[4] is not None], fair)
        yield pa.RecordBatch.from_arrays([pa.array([None, *features.tolist()], pa.int64()), pa.array([intercept, *weights.tolist()], pa.float64())], names=["feature", "weight"])

    # repartition, so that the features are made by many tasks and only the solving is one
    got = sets.repartition(1).mapInArrow(run, "feature long, weight double").toArrow()
    if not got.num_rows:
        return NOTHING
    return got.column(1)[0].as_py(), got.column(0).slice(1).to_numpy(), got.column(1).slice(1).to_numpy()


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) of every row."""

    def make():
        scorer = Scorer(model)

        def work(ids, texts):
            s = scorer.texts(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array([x is not None and x > 0 for x in s], pa.bool_())], names=["doc_id", "score", "toxic"])

        return work

    return map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], make, "doc_id long, score double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that aren't toxic."""

    def make():
        scorer = Scorer(model)
        return lambda texts: [s is None or s <= 0 for s in scorer.texts(texts)]

    return filter_texts(docs, text_col, make)
