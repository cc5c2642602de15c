"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its predecessor kept.
Stages that drop rows return the columns of their input. `run` writes each stage's rows under the
checkpoint folder and reads them for the next.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshness.llm import decontaminate, jaccard_join, packing, quality_knn, quality_rules
from freshness.llm.queries import read, tokenizer
from freshness.llm.text import fold
from freshness.session import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote does not reject. Null and empty texts and repeated rows are judged like all others."""
    model = quality_knn.fit_neighbours(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=fold("__id", 5) != 0)
    return quality_knn.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list. Null and empty texts fail the base rules; repeated rows share their verdict."""
    rules = quality_rules.fit_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=fold("__id", 5) != 0)
    return quality_rules.judge(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: one with the smallest id, of repeated rows one. Documents without words stay."""
    return jaccard_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null texts have none and stay; items without words have no windows."""
    name = "scan"
    clear = decontaminate.scan(docs.select(F.struct(*docs.columns).alias("row"), "text"), read(spark, sf_dir, "benchmark"))
    return clear.where(F.col(name)["n_hit"] == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 4096 tokens. A null text is its end id alone; a very long one has many pieces."""
    pieces = packing.token_pieces(docs, tokenizer("word_bpe_49k.json"), end_id=2)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


BATCH_ROWS = 400  # whole rows that go to a Python worker at once; the stages carry every text, and many texts are long


def in_small_batches(apply):
    """The stage with Arrow batches of `BATCH_ROWS`; they bound what the JVM and the workers of an executor hold, and change no row."""

    @functools.wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return apply(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, in_small_batches(apply)) for name, apply in (
        ("quality classifier", quality_classifier),
        ("quality rules", quality_rules_stage),
        ("n-gram Jaccard join", near_duplicates),
        ("benchmark decontamination", decontamination),
        ("packing", pack),
    )
]

ORACLE_SQL = None  # the classifier, the learned rules and the tokenizer have no SQL form; tests compare with brute force


ROW_GROUP = 16 << 20  # bytes of a Parquet row group of whole texts that a task holds while it writes


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES, 1):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stage(docs, **{"parquet.block.size": ROW_GROUP})
    return docs
