"""A corpus from documents to a mix: toxic documents go, of near-duplicates one stays, repeated passages
are cut, contaminated documents go, and the sources are mixed to their weights.

Every stage takes the columns of documents, further ones and any names included, and all but the last
return them. Null, empty and blank texts are documents without words: no stage but the third, which drops
what it has emptied, removes them for that. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regionlake.llm import common, dartminhash, decontaminate, mixing, suffix_tree, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score reaches their language's threshold. Repeated rows share their fate;
    texts without words get the score of no words. Without labels of both classes nothing tells documents
    apart, and all stay unless the base rate itself reaches 0.5."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that with the least doc_id, null being the least; rows that share an id are
    rows of their own, and of equal rows one stays. Rows without words all stay."""
    return dartminhash.clean(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of 13-word windows that stand in a smaller doc_id, null being the smallest;
    documents that are emptied by it go, those that had no words stay."""
    return suffix_tree.clean(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a benchmark item's window occurs; an empty benchmark removes none."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document that is left; null sources are
    one source, repeated rows documents of their own."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", contaminated),
    ("mixing", mixture),
]

#: The classifier is no SQL; tests/llm/test_pipeline.py holds the rows of every stage against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; a stage's
    folder goes when the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
