"""The corpus pipeline: documents in, token files out.

Each stage is a function of (spark, docs, sf_dir) that works on all that the one
before it kept and returns a DataFrame, written as Parquet in the shared folder
and read again as the next one's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linespan.llm.binary import stage_token_files
from linespan.llm.decontaminate import stage_decontaminate
from linespan.llm.langid import stage_language
from linespan.llm.mixing import mix
from linespan.llm.ngram_join import stage_near_duplicates
from linespan.llm.scratch import Scratch


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of its source ask for."""
    return mix(docs, Scratch(spark, "pipeline-mix"))


STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("token_files", stage_token_files),
]

#: Language, similarity, retrieval and token ids can't be had from SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, n_tokens and ids_crc32 of every written document."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop_all_but(name)
    return docs
