"""Keyed sinks on Parquet: versions of a table, of which the newest complete one is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom.operators.survivorship import upsert


class VersionedTable:
    """A Parquet table that is replaced as a whole: a version counts once its success marker is there, so a job that dies leaves the old one current."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self) -> list[int]:
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def current(self) -> DataFrame:
        v = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        v = self.versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{(v[-1] if v else 0) + 1}")

    def merge(self, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> None:
        """Puts rows in by key; keys of new must be unique."""
        self.replace(upsert(self.current(), new.select(*self.schema.names), keys, keep_if_null))

    def merge_guarded(self, new: DataFrame, keys: list[str], rank: str) -> None:
        """Replaces a row only by one whose rank is not lower."""
        old = self.current().select(*keys, F.col(rank).alias("_old"))
        better = new.join(old, keys, "left").where(F.col("_old").isNull() | (F.col(rank) >= F.col("_old"))).drop("_old")
        self.merge(better, keys)

    def delete(self, keys: DataFrame) -> None:
        self.replace(self.current().join(keys, keys.columns, "left_anti"))


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df holds; rows are dealt by partition first, so each gets few files."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
