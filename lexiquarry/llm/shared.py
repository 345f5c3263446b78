"""What the operators share: scratch tables in the cluster's shared folder, keys, hot-key joins."""

from __future__ import annotations

import atexit
import gc
import math
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space bytes 0x20 and 0x09-0x0D, and the ASCII letters.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session, whose tasks run in the driver's own
    process, may go without; it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lq_scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark._lq_scratch = tempfile.mkdtemp(prefix="lexiquarry-")
        atexit.register(shutil.rmtree, root, True)
    return root


class Scratch:
    """Tables of one operator call, written to the shared folder so that they outlive any executor. The result may
    read them, so they stay until the driver ends, which removes what is left of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/lexiquarry-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        path, files = self._path("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes df under a fresh path and reads it back, which cuts the lineage."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str, by: Sequence[str] = (), dealt: bool = False) -> DataFrame:
        """The same as a table with a file for each bucket of the key, in the key's order: joins on the key and groups
        by it read it without an exchange. by: partition columns. dealt: df is dealt by the key in this way already."""
        table = f"{os.path.basename(self.root)}-{name}".replace("-", "_")
        writer = (df if dealt else df.repartition(buckets, key)).write.option("compression", "zstd").option("path", f"{self.root}/{name}")
        (writer.partitionBy(*by) if by else writer).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path, files = self._path(name)
            files.delete(path, True)

    def release(self) -> None:
        """Lets Spark remove shuffle files of finished steps now instead of at the driver's next collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same on pure ASCII and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns; rows equal in all of them share the key and every decision."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", hot_keys: int = 512) -> DataFrame:
    """Joins facts (one row per key, with the key's row count in `weight`) to rows without sending a hot key to one task.

    A key is hot with at least total / hot_keys rows, so at most `hot_keys` keys are hot whatever the
    size of the data; these are broadcast. All others hold under 1 / hot_keys of the rows each and
    meet in an ordinary shuffled join. total: the sum of the weights."""
    least = max(2, math.ceil(total / hot_keys))
    hot, rest = facts.filter(F.col(weight) >= least), facts.filter(F.col(weight) < least)
    marked = rows.join(F.broadcast(hot.select(*on).withColumn("__lq_hot", F.lit(True))), on, "left")
    in_hot = marked.filter("__lq_hot").drop("__lq_hot").join(F.broadcast(hot), on, "inner")
    in_rest = marked.filter("__lq_hot is null").drop("__lq_hot").join(rest.hint("merge"), on, how)
    return in_hot.unionByName(in_rest)
