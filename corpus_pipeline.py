"""A training corpus from raw documents: five stages, each written and read again before the next.

Null texts count as empty; empty texts are clean, have no near duplicates and stay. Rows are judged as rows: equal ids with different texts, and null ids,
are documents of their own. Of rows with the same id and text one stays. An empty table gives an empty result. Columns other than those of documents pass
through all stages but the last, which gives those of the codec.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import decontaminate, near_join, pieces, pii, queries, toxicity
from asofkit.llm._common import small_batches
from asofkit.shared import forgotten, mark, new_folder, released

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    small_batches(spark)
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, queries.REJECT)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    small_batches(spark)
    return near_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its error budget go."""
    small_batches(spark)
    return decontaminate.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the text."""
    return pii.pseudonymised(docs, queries.PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as ids of pieces, with the digest of what they decode to."""
    small_batches(spark)
    return pieces.encoded_and_decoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", pieces_stage),
]

#: Fitted models, edit distances and keyed digests have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, which reads what the one before it wrote. Tables of earlier stages, and those that their operators wrote, go as soon as the next stage
    is written; `asofkit.shared.released(spark)` deletes the rest once the result is stored."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "corpus")
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        released(spark, since)
        if before:
            forgotten(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
