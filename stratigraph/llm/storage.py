"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder on a single machine, as in tests, and an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratigraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def lean(run):
    """An Arrow function that gives freed memory back to the system at its end: idle workers wait beside the executor's heap."""

    def lean_run(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return lean_run


#: Spark deletes a query's shuffle files at its end; runtime setting of a session
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once and read again: lineage ends here, so a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", set()
        atexit.register(self.drop_all)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again; the shuffles of the write are deleted at its end, not when the driver next collects garbage."""
        path = f"{self.folder}/{name}"
        self.names.add(name)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.folder}/{name}")
        self.names -= set(names)

    def keep_only(self, name: str) -> None:
        self.drop(*sorted(self.names - {name}))

    def drop_all(self) -> None:
        with contextlib.suppress(Exception):  # at exit the session may be gone
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of tables that are written by now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined to right by a sort-merge join at every size: one plan, which Spark can split where a key is hot."""
    return left.join(right.hint("merge"), on, how)
