"""Season totals kept from batch to batch: each batch of fresh matches rewrites only the partitions it touches, in any order, and may be repeated."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.sinks import overwrite_partitions

PARTS = ["season", "bucket"]


def skip_reason(season: Column, uid: Column, game: Column, named: Column) -> Column:
    """Why a fresh match is not stored: no key, no season, or raw data that names another account; null if it is."""
    return F.when(uid.isNull() | game.isNull(), "no-key").when(season.isNull(), "no-season").when(named.isNotNull() & (F.trim(named) != "") & (named != uid.cast("string")), "foreign-owner")


def latest(rows: DataFrame, values: list[str], order: list[str]) -> DataFrame:
    """The last version of each match; order and then the values settle it, so batches may come in any order and twice."""
    pick = F.max(F.struct(*order, *(v for v in values if v not in order)))
    return rows.groupBy(*PARTS, "uid", "game_id").agg(pick.alias("_r")).select(*PARTS, "uid", "game_id", *(F.col("_r")[c].alias(c) for c in dict.fromkeys([*order, *values])))


def totals(rows: DataFrame) -> DataFrame:
    """A row per player and season from the last versions; a player's many matches meet as partial sums only."""
    return rows.groupBy(*PARTS, "uid").agg(
        F.count(F.lit(1)).alias("games"), F.sum("kills").alias("kills"), F.count_if(F.col("placement") == 1).alias("wins"), F.min("placement").alias("best"), F.sum("placement").alias("places"),
        F.max("updated_at").alias("updated_at"),
    )


def put_batch(spark: SparkSession, fresh: DataFrame, folder: str, batch: str, values: list[str], order: list[str], buckets: int = 16, files: int = 8) -> None:
    """Stores a batch's matches and brings the totals of the seasons and buckets of players that it touches up to date.

    fresh: season, uid, game_id, named (the account that raw data names, or null), values, order. A batch is one folder of rows, replaced
    as a whole when it is repeated; the batch that held a partition before is never rewritten. Totals are derived: if a job dies between
    the two writes, repeating the batch rebuilds them. A partition's rows are dealt out to `files` files by match, so that a hot player's are in several and the
    last versions are found without a shuffle; the first batch settles how many. The touched partitions reach the scan as a run-time filter on folders; there are at
    most seasons times buckets of them. A match that moves to another season is another match."""
    why = skip_reason(F.col("season"), F.col("uid"), F.col("game_id"), F.col("named"))
    columns = ["season", "uid", "game_id", *dict.fromkeys([*order, *values])]
    good = fresh.where(why.isNull()).select(*columns, (F.crc32(F.col("uid").cast("string")) % buckets).alias("bucket"))
    files = dealt(spark, folder, files)
    new = latest(good.repartition(files, "uid", "game_id"), values, order).select(*columns[1:], *PARTS)
    with stored(spark, new, folder, files) as table:
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = '{name}', season, bucket) SELECT * FROM {{new}}", new=new)
        rows = spark.table(table)
        touched = rows.where(F.col("batch") == F.lit(batch)).select(*PARTS).distinct()
        overwrite_partitions(totals(latest(rows.join(F.broadcast(touched), PARTS, "left_semi"), values, order)), f"{folder}/totals", PARTS)


def dealt(spark: SparkSession, folder: str, files: int) -> int:
    """Into how many files by match the folder's partitions are dealt: as it was made, or so many from now on."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    found = next((int(n[5:]) for n in names if n.startswith("rows-")), None)
    if found is None:
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path, f"rows-{files}"))
    return found or files


@contextmanager
def stored(spark: SparkSession, like: DataFrame, folder: str, files: int) -> Iterator[str]:
    """All batches' rows as a bucketed table over their folder, known to the catalog while it is in use; like has their columns, as a batch may have no rows at all."""
    table = f"matchloom_rows_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name not in PARTS)
    spark.sql(
        f"CREATE TABLE {table} ({columns}, batch string, season int, bucket bigint) USING parquet PARTITIONED BY (batch, season, bucket) "
        f"CLUSTERED BY (uid, game_id) INTO {files} BUCKETS LOCATION '{folder}/rows-{files}'"
    )
    try:
        spark.sql(f"MSCK REPAIR TABLE {table}")
        yield table
    finally:
        spark.sql(f"DROP TABLE {table}")
