"""A training corpus from raw documents: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage gets what the one before it kept, written and read again, so a lost executor costs one
stage at most. All stages but the last return the columns of documents.

Quality rules judge null texts as empty and drop them; of near duplicates the least id stays;
passages that an earlier document holds are cut out; mixing takes whole documents, some twice; the
last stage gives a row of token digests for each document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratigraph.llm.mixing import mixed
from stratigraph.llm.ngram_join import first_of_groups
from stratigraph.llm.passages import cut_repeats
from stratigraph.llm.piece_bpe import encode_documents
from stratigraph.llm.quality import POLICIES, keep_good
from stratigraph.llm.queries import tokenizer_path
from stratigraph.llm.storage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, POLICIES["v1"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: chained passages and merge rounds can't be put as SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
        scratch.release()
    return docs
