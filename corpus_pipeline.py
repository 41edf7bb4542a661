"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes the documents that the one before kept, as a table it can read again, and works on all of them. All but
the last return the columns of documents: rejected documents are gone after the first stage, one document of each group of near
duplicates stays after the second, contaminated ones are gone after the third, and after the fourth each document has as
many rows as the mix takes it. The last writes the token files and returns what reading them back gives.

What a stage gets is a written table, so the tables that the stage before staged for itself are deleted when a stage begins, and the folder
holds those of one stage at a time. A result of a stage that is not written by then cannot be read any more.

Null and empty texts fail the quality rules; an empty table stays empty through all stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import common, decontam, mixing, quality_rules, simhash_dedup, token_output


_scope = common.Scope()


def _stage(work):
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scope.clear(spark)
        with _scope:
            return work(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.tokenized(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Hashes, samples and file formats of the stages are not SQL's; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
