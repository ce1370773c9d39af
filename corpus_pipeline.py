"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir), works on all documents that it is given and returns a DataFrame; ``run``
writes each as Parquet in the shared folder and reads it again as the next stage's documents. All but the last return
the columns of documents:

1. quality: documents that the quality classifier rejects go;
2. near_duplicates: of each SimHash group the document with the smallest id stays;
3. decontaminate: documents with a window of any benchmark item go;
4. personal_data: spans of personal data are replaced by their kind in angle brackets, n_chars is renewed;
5. tokens: texts become token ids.

Defined cases: null and empty texts are documents like others (one of them stays in stage 2; without tokens in stage 5).
A row whose id is null is judged by its text in stages 1 and 3 and is never a duplicate in stage 2. Rows with one id and
different texts are judged by their own texts; of rows equal in id and text, or in one group with one id, one stays.
An empty table gives an empty table. Further columns are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arrayloom.llm import bpe, decontaminate, pii, quality, simhash
from arrayloom.llm.session import documents, write_table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("personal_data", stage_personal_data),
    ("tokens", stage_tokens),
]

#: Learned models and byte-pair merges cannot be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
