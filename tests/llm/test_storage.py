"""Scratch tables: what a write leaves behind."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from stratigraph.llm.storage import CLEANUP, Scratch


def _shuffle_files(spark) -> int:
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    return sum(f.startswith("shuffle_") for _, _, files in os.walk(folder) for f in files)


def test_a_kept_table_leaves_no_shuffles_and_the_setting_as_it_was(spark):
    before = spark.conf.get(CLEANUP)
    scratch, was = Scratch(spark, "storage-test"), _shuffle_files(spark)
    kept = scratch.keep(spark.range(10_000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "counts")
    assert _shuffle_files(spark) <= was
    assert sorted(tuple(r) for r in kept.collect())[0] == (0, 1429)
    assert spark.conf.get(CLEANUP) == before
    scratch.drop_all()


def test_a_failed_write_restores_the_setting(spark):
    before = spark.conf.get(CLEANUP)
    bad = spark.range(3).select(F.raise_error(F.lit("planted")).alias("x"))
    with pytest.raises(Exception, match="planted"):
        Scratch(spark, "storage-test").keep(bad, "bad")
    assert spark.conf.get(CLEANUP) == before


def test_a_table_may_be_kept_twice(spark):
    scratch = Scratch(spark, "storage-test")
    df = spark.range(100).repartition(4, "id").groupBy((F.col("id") % 3).alias("k")).count()
    assert scratch.keep(df, "one").count() == scratch.keep(df, "two").count() == df.count() == 3
    scratch.drop_all()
