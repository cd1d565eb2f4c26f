"""Parquet tables under one folder.

Facts are partitioned by month (txn_month, YYYYMM) and staged rows by load date, so date filters prune files. Partitions are written by as many
tasks as their bytes need (rebalanced, a large month split). An unpartitioned table is replaced by writing a new
version beside the old one and then naming it in the table's CURRENT file; readers see the one or the other. Partitions of a fact are replaced by
dynamic partition overwrite from a stored copy, never from a plan that reads the files it replaces.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import month_key
from ..schemas import TABLES, Table, align


class Warehouse(dict):
    """Tables by name; a missing one reads as empty."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __getitem__(self, name: str) -> DataFrame:
        path = self._at(name)
        if path is None:
            return self.spark.createDataFrame([], self._stored(TABLES[name]))
        stored = self._stored(TABLES[name])
        return self.spark.read.schema(stored).parquet(path).select(*stored.names)

    def _stored(self, table: Table) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType) for f in table.schema.fields]
        return T.StructType(fields + [T.StructField("txn_month", T.IntegerType())] * bool(table.month_of))

    def _at(self, name: str) -> str | None:
        if TABLES[name].month_of or not TABLES[name].key:
            path = f"{self.folder}/{name}/data"
            return path if self._fs.exists(self._path(path)) else None
        found = sorted(str(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.folder}/{name}")) if str(s.getPath().getName()).startswith("v")) if self._fs.exists(self._path(f"{self.folder}/{name}")) else []
        found = [v for v in found if self._fs.exists(self._path(f"{self.folder}/{name}/{v}/_SUCCESS"))]
        return f"{self.folder}/{name}/{found[-1]}" if found else None

    def _ready(self, df: DataFrame, table: Table, run_ts: Column | None) -> DataFrame:
        df = align(df, table, run_ts)
        return df.withColumn("txn_month", month_key(F.col(table.month_of))) if table.month_of else df

    def append(self, name: str, df: DataFrame, run_ts: Column | None = None) -> None:
        table = TABLES[name]
        if table.key and not table.month_of:
            return self.replace(name, self[name].unionByName(align(df, table, run_ts)), run_ts)
        out, parts = self._ready(df, table, run_ts), ["txn_month"] if table.month_of else [table.by] if table.by else []
        out = out.hint("rebalance", *[F.col(p) for p in parts]) if parts else out
        out.write.mode("append").partitionBy(*parts).parquet(f"{self.folder}/{name}/data")
        return None

    def replace(self, name: str, df: DataFrame, run_ts: Column | None = None) -> None:
        """All of an unpartitioned table."""
        table, old = TABLES[name], self._at(name)
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self._ready(df, table, run_ts).write.parquet(f"{self.folder}/{name}/{version}")
        if old:
            for s in self._fs.listStatus(self._path(f"{self.folder}/{name}")):
                if str(s.getPath().getName()) not in (version, old.rpartition("/")[2]):
                    self._fs.delete(s.getPath(), True)

    def replace_months(self, name: str, df: DataFrame, run_ts: Column | None = None) -> None:
        """The months that df has, whole. They are written beside the table first, as df may read the files that are replaced."""
        copy = f"{self.folder}/.staged-{uuid.uuid4().hex}"
        self._ready(df, TABLES[name], run_ts).write.parquet(copy)
        staged = self.spark.read.parquet(copy)
        staged.hint("rebalance", F.col("txn_month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("txn_month").parquet(f"{self.folder}/{name}/data")
        self._fs.delete(self._path(copy), True)


    def publish(self, statistics: bool = False) -> None:
        """Make every stored table usable from SQL by its name; statistics: as external tables with row counts and column figures for the optimizer.

        Tables with statistics belong to the session's current database and name the files of this moment; call it again after a load."""
        for name, table in TABLES.items():
            path = self._at(name)
            if not statistics or path is None:
                self[name].createOrReplaceTempView(name)
                continue
            self.spark.catalog.dropTempView(name)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            parts = "PARTITIONED BY (txn_month)" if table.month_of else f"PARTITIONED BY ({table.by})" if table.by else ""
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._stored(table).fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} LOCATION '{path}'")
            if parts:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            columns = ", ".join(table.key or [table.by or table.schema.names[0]])
            self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {columns}")


def export_csv(df: DataFrame, path: str) -> None:
    """Pipe-separated text with a header."""
    df.write.mode("overwrite").csv(path, sep="|", header=True)


#: How many characters a column of each type takes in a report; text without a width of its own takes 30.
_WIDTHS = {"tinyint": 4, "smallint": 6, "int": 11, "bigint": 20, "date": 10, "timestamp_ntz": 26, "string": 30}


def export_report(df: DataFrame, path: str, separator: str = "  ", width: int | None = None, titles: bool = True) -> None:
    """Fixed-width lines, in the order of df, under a line of titles and one of dashes. Part files in the order of their names make the report.

    A column is as wide as its title or its ``width`` in the field's metadata, else as its type needs. Null is blank and moves no other column. Longer
    values are kept whole; only ``width`` cuts lines, if given."""
    cells, heads = [], []
    for f in df.schema.fields:
        kind = f.dataType
        room = f.metadata.get("width") or (kind.precision + 2 if isinstance(kind, T.DecimalType) else _WIDTHS.get(kind.simpleString(), 30))
        room = max(room, len(f.name))
        value, number = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")), isinstance(kind, T.NumericType)
        padded = F.lpad(value, room, " ") if number else F.rpad(value, room, " ")
        cells.append(F.when(F.char_length(value) > room, value).otherwise(padded))
        heads.append((f.name.rjust(room) if number else f.name.ljust(room), "-" * room))
    lines = df.select(F.concat_ws(separator, *cells).alias("value"))
    if titles:
        top = df.sparkSession.createDataFrame([(separator.join(line),) for line in zip(*heads, strict=True)], "value string").coalesce(1)
        lines = top.unionByName(lines)
    if width:
        lines = lines.select(F.substring("value", 1, width).alias("value"))
    lines.write.mode("overwrite").text(path)
