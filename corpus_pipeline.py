"""From raw documents to packed training sequences, in stages that are each written and read again.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of
``documents``, other columns included, whatever their names. In every stage a null text counts as an
empty one and is kept as it is, an empty table gives an empty one, and rows that repeat an id and a
text share one decision. Documents without an id are never rejected, since no decision names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.llm import lines, minhash, packing, simhash
from trailmesh.llm.queries import quality_of, table
from trailmesh.session import checkpointed


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the ids in ``rejected``; rows without an id stay.

    What is rejected grows with the corpus, so it is never broadcast, whatever its size.
    """
    return docs.join(rejected.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return without(docs, quality_of(docs, table(spark, sf_dir, "labels")).filter("not kept"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; a document that consists of them goes."""
    # The other columns travel inside a struct: any of them may be called like those that are added.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    cleaned = lines.without_repeated_lines(docs.select("doc_id", "text", F.struct(*others).alias("_row")))
    changed = F.col("n_removed") > 0
    kept = cleaned.filter(~F.coalesce(changed & (F.col("text") == ""), F.lit(False)))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"),
           "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return kept.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five words, similarity 0.8."""
    return without(docs, minhash.near_duplicates(docs, shingle=5, percent=80).filter("not kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return without(docs, simhash.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 4096 ids."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Token ids come from a tokenizer, which SQL cannot state; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
