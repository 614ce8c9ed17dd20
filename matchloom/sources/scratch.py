"""Folders that driver and executors share, and tables kept there within a query."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one in local tests where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="matchloom-")
    return f"{base.rstrip('/')}/matchloom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to a new shared folder and read from there, for what uses it more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of code of a method beyond which the JVM only interprets it.
METHOD_BYTES = 8000


@contextmanager
def small_methods(spark: SparkSession):
    """What runs inside is compiled in methods that the JVM compiles too; the session's own setting comes back afterwards."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)
