"""A training corpus from ``documents``: toxic documents go, boilerplate lines go, near copies go, benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents, and extra ones as they are. n_chars follows the text. The classifier is fitted
on the labelled rows of sf_dir. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_dedup, simhash, sptok, toxicity
from gridloom.llm.common import remove, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. A null text stays; null labels count for nothing; without labels of both classes nothing goes."""
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that are boilerplate on their source. A null text stays null, with a null n_chars; a text whose lines all go stays as an empty one."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least doc_id; a repeated row of it stays too. Texts without a word and rows of a null id stay."""
    return simhash.keep_first(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap an item. Null and empty texts stay; null and empty items overlap nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row: null for a null text, no ids for an empty one."""
    return sptok.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("SentencePiece encoding", encode_pieces),
]

#: Logistic regression, pigeonring search and automata are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written as Parquet in the shared folder and read again, and go when the next are there."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/stage-{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
