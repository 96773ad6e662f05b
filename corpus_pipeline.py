"""A training-data pipeline over documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, language, mixing, simhash, sstable
from tidewright.llm.common import drop_since, scratch_mark, stash


# A stage takes null texts, ids and sources, empty tables, repeated rows and columns of any name; its operator's docstring says
# what becomes of each.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_alike(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # tables keep no order of rows, so places in the mix, which depend on nothing but the rows, are counted again
    placed = mixing.mixed(docs.select("doc_id", "text", "source"))
    return sstable.token_table(placed, public_tokenizers.path("word_bpe_49k.json"), order="_position")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix", mix),
    ("tokens", write_tokens),
]

#: The stages hash, train and align; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = stash(stage(spark, docs, sf_dir), name)
        drop_since(spark, mark, [docs])
    return STAGES[-1][1](spark, docs, sf_dir)
