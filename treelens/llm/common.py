"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` bound to ``x``: evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and no other letter; texts of one byte a letter take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The maximal runs of characters outside SPACE."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster (spark.checkpoint.dir).

    Only where that setting is absent and the master is local, as in tests, a
    folder of this machine is made and set for the session's checkpoints; on a
    cluster it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Scratch:
    """Tables that one run of an operator writes into the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of one
    step, not those before it.  ``drop`` frees a table that is no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_dir(spark)

    def write(self, df: DataFrame, name: str, slim: bool = False) -> DataFrame:
        """The table, read back; one of slim rows goes into fewer files."""
        if slim:
            df = df.coalesce(few(self.spark))
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in names:
            path = hadoop.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(spark: SparkSession) -> int:
    """Tasks for tables of slim rows: a quarter of the shuffle partitions, which grow with the data, but three a core at least."""
    return max(1, 3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that no one refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
