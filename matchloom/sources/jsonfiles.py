"""JSON as a source: files of lines with a fixed schema, and cached bodies under keys of the form player:variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType, _parse_datatype_string

MATCH = StructType([
    StructField("uid", LongType()), StructField("game_id", LongType()), StructField("slot", IntegerType()), StructField("part_id", LongType()), StructField("source_id", LongType()),
    StructField("kills", LongType()), StructField("damage", DoubleType()), StructField("played_at", TimestampType()),
])

BUCKETS = 64


def write_lines(lines: DataFrame, path: str, by: list[str]) -> None:
    """One folder per value of by; each line of text (column value) is one record."""
    lines.write.partitionBy(*by).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType, folders: str) -> DataFrame:
    """Records with the given schema, the columns of their folders, and corrupt: the whole line where it is no JSON object of that schema.

    Nothing is inferred, so the files are read once; only the folders that a filter leaves are opened. Lines are parsed as text, since the
    JSON reader checks only the fields that a query asks for. Fields beyond the schema are ignored; empty lines are no records."""
    by = _parse_datatype_string(folders)
    lines = spark.read.schema(StructType([StructField("value", StringType()), *by.fields])).text(path).where("trim(value) <> ''")
    record = F.from_json("value", StructType([*schema.fields, StructField("corrupt", StringType())]), {"columnNameOfCorruptRecord": "corrupt"})
    return lines.select(*by.names, record.alias("record")).select("record.*", *by.names)


def _bucket(uid: Column) -> Column:
    return F.crc32(uid) % BUCKETS


def keyed_bodies(cache: DataFrame, path: str) -> None:
    """Stores id (player:variant), data (JSON) and cached_at in folders by a hash of the player, so a player's keys are in one folder.

    The cluster takes a row to its folder by hash of the whole id, so one player's many keys spread over tasks."""
    rows = cache.withColumn("uid", F.substring_index("id", ":", 1)).withColumn("bucket", _bucket(F.col("uid")))
    rows.repartition("bucket", F.crc32("id") % 4).write.partitionBy("bucket").parquet(path)


def cached_bodies(spark: SparkSession, path: str, body: str, uid: str | None = None) -> DataFrame:
    """uid, id, cached_at and the parsed body; bodies that are null or no JSON of that schema are left out. One player reads one folder."""
    rows = spark.read.parquet(path)
    if uid is not None:
        bucket = spark.range(1).select(_bucket(F.lit(uid))).first()[0]
        rows = rows.where((F.col("bucket") == bucket) & F.col("id").startswith(f"{uid}:"))
    parsed = F.from_json("data", body + ", corrupt string", {"columnNameOfCorruptRecord": "corrupt"})
    return rows.withColumn("body", parsed).where("body is not null and body.corrupt is null").select("uid", "id", "cached_at", "body")
