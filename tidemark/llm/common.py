"""Helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Scratch:
    """Tables written to the shared folder, without their lineage, for the length of one computation, and dropped as soon as they are of no more use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.made = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}", {}, 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        path, self.made = f"{self.folder}/{self.made}", self.made + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def keep_till_exit(self, df: DataFrame) -> DataFrame:
        """The same for a table that a caller reads later: deleted when the driver ends."""
        out = self.keep(df)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        return out

    def drop(self, df: DataFrame) -> None:
        """Nothing may read df after this."""
        delete(self.spark, self.paths.pop(id(df))[0])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null ids are in fold crc32('')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def within(rows: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """Of each group, the rows of lowest h whose sizes add up to ``budget`` at most, and the first in any case. For bounded samples."""
    order = Window.partitionBy(group).orderBy("h")
    running = rows.withColumn("__sum", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.row_number().over(order))
    return running.where((F.col("__sum") <= budget) | (F.col("__at") == 1)).drop("__sum", "__at")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: once for each application, unless it is on their path anyway."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()] * sc.master.startswith("local")
    if sc.applicationId in _shipped or root in {Path(p).resolve() for p in known}:
        return
    package = Path(tempfile.mkdtemp(prefix="tidemark-")).resolve() / "tidemark.zip"
    with zipfile.ZipFile(package, "w") as out:
        for f in sorted((root / "tidemark").rglob("*.py")):
            out.write(f, f.relative_to(root))
    sc.addPyFile(str(package))
    _shipped.add(sc.applicationId)
