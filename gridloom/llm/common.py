"""Shared pieces of the training-data operators: durable checkpoints, checked broadcasts, text batches, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side joined by broadcast holds at most so many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Texts are tokenised in slices of about so many characters, which bounds a Python worker's memory.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where none is set and the session is local."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new name in that folder, for tables of one run."""
    return f"{checkpoint_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of our own in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into [start, end) ranges of about ``chars`` characters; no text is ever split."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, columns: list[str | Column], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Run ``make()`` once a task; the function it returns maps lists of the columns' values to an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for a, b in slices(cols[-1]):
                out = work(*(c[a:b] for c in cols))
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


class WordIndex(dict):
    """Word -> row of a growing table; ``add(word)`` makes the row. Cleared when full, which changes no result."""

    def __init__(self, add: Callable[[str], None], reset: Callable[[], None], limit: int):
        super().__init__()
        self.add, self.reset, self.limit = add, reset, limit

    def __missing__(self, word: str) -> int:
        self.add(word)
        self[word] = n = len(self)
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the words; call before using the table, and use it before the next call."""
        if len(self) > self.limit:
            self.clear()
            self.reset()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


#: Words, as most operators here count them: runs of letters, digits and underscores of the lower-cased text.
words_of = re.compile(r"\w+").findall


class WordHashes:
    """64-bit hashes of words, kept by word."""

    def __init__(self, keep: int = 400_000):
        self.reset()
        self.index = WordIndex(self._add, self.reset, keep)

    def reset(self) -> None:
        self.values = array("Q")

    def _add(self, word: str) -> None:
        import xxhash

        self.values.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))

    def __call__(self, words: list[str]) -> np.ndarray:
        rows = self.index.rows(words)
        return np.frombuffer(self.values, np.uint64)[rows] if len(rows) else np.zeros(0, np.uint64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in a row, where each text begins, with the end)."""
        each = [words_of(t.lower()) if t else [] for t in texts]
        return self([w for ws in each for w in ws]), np.cumsum([0] + [len(ws) for ws in each])


def csr_take(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate pool[starts[i]:starts[i] + lens[i]] over i."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return pool[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


def union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of rows i[k] and j[k], in place; root[x] is the least row of x's set, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, one_task_edges: int = 2_000_000) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node, root the least node of its component.

    Up to ``one_task_edges`` counted edges run through one union-find task; beyond it, large-star and small-star
    rounds over checkpointed edges do, until no edge changes. Both give the same rows. No edges give no rows.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    n = edges.count()
    if n <= one_task_edges:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, root long")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"), "a", "m")
        edges = durable(small.select("a", F.col("m").alias("b")).union(small.select("x", "y")).where("a != b").distinct())
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def filter_texts(df: DataFrame, text_col: str, make: Callable[[], Callable]) -> DataFrame:
    """The rows of ``df``, all columns, for whose text the function that ``make()`` returns gives a true value."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            flags = [bool(x) for a, b in slices(texts) for x in keep(texts[a:b])]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return df.mapInArrow(run, df.schema)
