"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes what a stage returns as Parquet in the shared folder and rereads it for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, jaccard_join, mixing, quality, token_orc
from quillon.llm.common import fresh_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document of the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and their digests read back."""
    path = fresh_dir(spark, "pipeline-tokens")
    token_orc.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.digests(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", clean),
    ("source_mixing", mixed),
    ("token_orc", tokens),
]

#: SQL cannot run the tokenizer of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
