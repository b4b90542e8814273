"""A training corpus from raw documents, in five stages; each is written as Parquet and read again for the next.

1. quality: rows that the quality classifier (trained on ``labels``) rejects go; unlabelled and empty rows have a score too.
2. near_duplicates: one row of each SimHash component stays, that of the smallest doc_id.
3. secrets: every secret found in a text becomes ``<secret>``; no row goes.
4. mixing: documents are repeated, cut or left out so that each source meets its target of words.
5. packing: the tokens of the mix in sequences of 2048, one row for each piece.

All stages but the last return the columns of ``documents``. Rows with nulls, empty texts, repeated rows and empty
tables pass through as the operators' own docstrings define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.llm.common import documents, materialise, tokenizer_path
from concord.llm.mixing import mixed_documents
from concord.llm.packing import pack
from concord.llm.quality import keep_good
from concord.llm.secret_scan import redact_secrets
from concord.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Boosted trees, SimHash components and tokens are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
