"""Corpus preparation in five stages over the documents table; each stage's result is written and read again.

Filtering stages keep clean documents as they are; the secrets stage keeps every document and removes the secrets from
its text; the last one returns the documents that the mix takes, with their number of copies.

All stages: columns other than those of documents are left out; null and empty texts are clean, differ from all other
texts and hold no secrets, so they pass every stage but the mix, which takes texts by their words; repeated rows are
copies, of which one stays; an empty table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesprism.llm.common import discard, written
from salesprism.llm.decontamination import drop_contaminated
from salesprism.llm.mixing import take_mix
from salesprism.llm.neardup import keep_one
from salesprism.llm.secrets import redact_secrets
from salesprism.llm.toxicity import drop_toxic, train_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets removed."""
    return redact_secrets(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, their size in words and the words taken.

    Rows that are equal in all columns share what they get.
    """
    return take_mix(docs.select(*COLUMNS)).withColumnsRenamed({"mix_copies": "copies", "mix_size": "size", "mix_taken": "taken"})


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: A trained classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
