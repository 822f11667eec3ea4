"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows scores each language by the log of the word's frequency there. An unseen word falls back
to its 4-grams, then 3-, 2- and 1-grams: the longest length of which any gram is known gives the mean log frequency of
those grams. A document's score is the sum over its words, repeats included. The model holds the counts of all words and
n-grams of a sample of labelled rows: a share of the distinct texts, drawn by their hash, such that ``SAMPLE`` rows are
expected (all, if there are no more).

The result has a row for each row of the input: (doc_id, predicted, n_words, n_known, margin). margin is the lead over
the next language, a word.

Cases: a null text gives a null language and null counts; a text without known words or grams gives 'und', as does a
model without labelled rows. Of equal scores the language that sorts first wins. Texts of any length are taken whole;
repeated rows are scored each, and count once in the fit; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordIndex, map_texts

#: Labelled rows that the model is fitted on.
SAMPLE = 10_000
SMOOTH = 0.5
letters_of = re.compile(r"[^\W\d_]+").findall


def grams(word: str, n: int) -> list[str]:
    w = f" {word} " if n > 1 else word
    return [w[k : k + n] for k in range(len(w) - n + 1)]


def grams_of(words: Iterator[tuple[str, str, int]]) -> Counter:
    """Counts by (kind, language, key) of counted (language, word) pairs; kind 'w' for the word, or the n-gram's length."""
    out: Counter = Counter()
    for lang, w, c in words:
        out["w", lang, w] += c
        for n in range(1, 5):
            for x in grams(w, n):
                out[str(n), lang, x] += c
    return out


def count(pairs: Iterator[tuple[str, str]]) -> list[tuple[str, str, str, int]]:
    """(kind, language, key, count) rows of the model from (language, text) pairs."""
    seen: Counter = Counter()
    for lang, text in pairs:
        seen.update((lang, w) for w in letters_of(text.lower()))
    return sorted((*k, c) for k, c in grams_of((lang, w, c) for (lang, w), c in seen.items()).items())


class Model:
    """(kind, language, key, count) rows in order, held as one Arrow table: a whole sample's n-grams are too many for tuples on the driver."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([(c, "ascending") for c in ("kind", "lang", "key")]).combine_chunks()

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str, int]]) -> Model:
        cols = list(zip(*rows)) or [()] * 4
        return cls(pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "lang", "key", "n"), cols, (pa.string(),) * 3 + (pa.int64(),))}))

    def __iter__(self) -> Iterator[tuple[str, str, str, int]]:
        return zip(*(c.to_pylist() for c in self.table.columns))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Iterable) and list(self) == list(other)


class _Logs:
    """Log shares by language of each key, as rows of one matrix."""

    def __init__(self, rows: pa.Table, langs: list[str]):
        keys = rows["key"].combine_chunks().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
        lang = np.searchsorted(np.array(langs), rows["lang"].to_numpy(zero_copy_only=False).astype(str)) if len(rows) else np.zeros(0, np.int64)
        counts = np.zeros((len(keys.dictionary), len(langs)))
        np.add.at(counts, (keys.indices.to_numpy(), lang), rows["n"].to_numpy())
        self.rows = {k: i for i, k in enumerate(keys.dictionary.to_pylist())}
        self.logs = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (len(counts) + 1)))

    def __contains__(self, key: str) -> bool:
        return key in self.rows

    def __getitem__(self, key: str) -> list[float]:
        return self.logs[self.rows[key]].tolist()


class Scorer:
    def __init__(self, rows: Iterable[tuple[str, str, str, int]], keep: int = 300_000):
        table = (rows if isinstance(rows, Model) else Model.of(rows)).table
        self.langs = sorted(set(table["lang"].unique().to_pylist()))
        self.tables = {kind: _Logs(table.filter(pc.equal(table["kind"], kind)), self.langs) for kind in ("w", "1", "2", "3", "4")}
        self.reset()
        self.index = WordIndex(self._add, self.reset, keep)

    def word(self, w: str) -> tuple[list[float], bool]:
        """A word's scores by language; whether it is a known word."""
        if w in self.tables["w"]:
            return self.tables["w"][w], True
        for n in range(4, 0, -1):
            table = self.tables[str(n)]
            if hit := [table.rows[g] for g in grams(w, n) if g in table]:
                return (table.logs[hit].sum(axis=0) / len(hit)).tolist(), False
        return [0.0] * len(self.langs), False

    def reset(self) -> None:
        self.pool, self.known = array("d"), array("b")

    def _add(self, w: str) -> None:
        score, known = self.word(w)
        self.pool.extend(score)
        self.known.append(known)

    def texts(self, texts: list[str | None]) -> list[tuple[str | None, int | None, int | None, float | None]]:
        each = [letters_of(t.lower()) if t else [] for t in texts]
        rows = self.index.rows([w for ws in each for w in ws])
        lens = np.array([len(ws) for ws in each], np.int64)
        total = np.zeros((len(texts), max(1, len(self.langs))))
        known = np.zeros(len(texts), np.int64)
        if len(rows) and self.langs:
            full = np.flatnonzero(lens)
            begin = (np.cumsum(lens) - lens)[full]
            total[full] = np.add.reduceat(np.frombuffer(self.pool, float).reshape(-1, len(self.langs))[rows], begin, axis=0)
            known[full] = np.add.reduceat(np.frombuffer(self.known, np.int8)[rows].astype(np.int64), begin)
        out = []
        for t, n, k, s in zip(texts, lens.tolist(), known.tolist(), total):
            if t is None:
                out.append((None, None, None, None))
            elif not s.any():
                out.append(("und", n, k, 0.0))
            else:
                best = int(np.argmax(s))
                rest = np.delete(s, best)
                out.append((self.langs[best], n, k, round(float(s[best] - rest.max()) / n, 6) if len(rest) else 0.0))
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Model rows from a sample of the labelled rows, ``sample`` as expected. Spark counts; only the bounded model comes here."""
    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null")
    if n := rows.count():
        share = min(1.0, sample / n)
        rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 31)) < int(share * (1 << 31)) + (share == 1))

    def words():
        def work(langs, texts):
            seen: Counter = Counter()
            for lang, text in zip(langs, texts):
                seen.update((lang, w) for w in letters_of(text.lower()))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

        return work

    counts = map_texts(rows.distinct(), ["lang", "text"], words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = grams_of(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.string()) for i in range(3)), pa.array(list(found.values()), pa.int64())], names=["kind", "lang", "key", "n"])

    model = counts.mapInArrow(pieces, "kind string, lang string, key string, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    return Model(model.toArrow())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, predicted, n_words, n_known, margin) of every row. The model is that of a bounded sample."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def work(ids, texts):
            cols = list(zip(*scorer.texts(texts)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *cols], (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "predicted", "n_words", "n_known", "margin"])

        return work

    return map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], make, "doc_id long, predicted string, n_words int, n_known int, margin double")
