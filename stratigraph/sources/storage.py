"""Checkpoints and sinks."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder on a single machine, as in tests, and an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratigraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and cut off from its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: bytes of files for one part; with parts of a size a task doesn't grow with the table
PART_BYTES = 4 << 20


def parts_of(spark: SparkSession, path: str, size: int = PART_BYTES) -> int:
    """Into how many parts the files of a path are dealt out: one for each size bytes, at least one a core."""
    fs, where = hadoop_path(spark, path)
    return max(spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(where).getLength() // size))


def write_sarif(results: DataFrame, path: str) -> None:
    """SARIF result objects as lines of JSON; the frame of the document is the header of a consumer."""
    results.select("json").write.mode("overwrite").text(path)


def sarif_frame(version: str = "2.1.0") -> str:
    return json.dumps({"version": version, "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})
