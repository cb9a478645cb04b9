"""From raw documents to packed training sequences.

Each stage takes what the one before kept and returns the columns of ``documents``, whatever
others there are and however they are named; the last returns the pieces of the packed
sequences.  Between stages the table is written as Parquet and read again.

In every stage null, empty and blank texts are clean and stay (they make no line, group or
match), very long texts are taken whole, repeated rows are judged alike and stay until
near-duplicates go, of which rows of one id stay or go together; rows with a null id stay
through the near-duplicate stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm import decontamination, line_dedup, near_dup, packing, toxicity
from inkgrove.llm.common import bound_batches, stored, table


def _aside(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns named like an operator's results renamed, and how to name them back."""
    taken = {c: f"__own_{c}" for c in docs.columns if c in results}
    return docs.withColumnsRenamed(taken), [F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those predicted toxic."""
    bound_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    own, back = _aside(docs, ("score", "predicted", "offending"))
    return toxicity.score(own, model).where("predicted = 0").select(*back)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten of them share; ``n_chars``, if there, follows the text."""
    bound_batches(spark)
    own, back = _aside(docs, ("n_lines", "n_dropped"))
    kept = line_dedup.line_dedup(own, min_docs=10)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("bigint"))
    return kept.select(*back)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    bound_batches(spark)
    groups = near_dup.near_duplicates(docs, near_dup.Similarity(words=5, over=80, under=100))
    dropped = groups.where("NOT kept").select("doc_id")
    return docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark passage."""
    bound_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of 4096 tokens."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores, sketches and tokens have no SQL counterpart; ``tests/llm/test_pipeline.py``
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
