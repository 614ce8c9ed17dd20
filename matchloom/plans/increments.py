"""Season totals from batches of fresh matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.increments import put_batch, skip_reason
from matchloom.sources.facts import PM, player_match, tasks
from matchloom.sources.scratch import shared_folder

from .registry import query

VALUES, ORDER = ["kills", "placement"], ["updated_at", "slot", "part_id", "source_id"]


def fresh_matches(spark, sf_dir) -> DataFrame:
    """Matches as they come in by year, with later corrections of one in five, some without season and some whose raw data names another."""
    pm = player_match(spark, sf_dir)
    c = F.col
    versions = F.array(F.struct(c("kills"), c("updated_at")), F.when(c("game_id") % 5 == 0, F.struct((c("kills") + 1).alias("kills"), (c("updated_at") + F.expr("INTERVAL 400 DAYS")).alias("updated_at"))))
    x = pm.select(
        F.when(c("part_id") % 29 != 0, c("season")).alias("season"), "uid", "game_id", "slot", "part_id", "source_id", "placement",
        F.when(c("source_id") % 31 == 0, F.concat(F.lit("x"), "uid")).when(c("source_id") % 2 == 0, c("uid").cast("string")).alias("named"), F.explode(versions).alias("v"),
    ).where("v is not null")
    return x.select("*", "v.kills", "v.updated_at", F.year("v.updated_at").cast("string").alias("batch")).drop("v")


FRESH = f"""{PM}, v AS (SELECT CASE WHEN part_id % 29 <> 0 THEN season END season, uid, game_id, slot, part_id, source_id, placement, CASE WHEN source_id % 31 = 0 THEN 'x' || uid WHEN source_id % 2 = 0 THEN CAST(uid AS VARCHAR) END named, kills, updated_at FROM pm),
f AS (SELECT * FROM v UNION ALL SELECT * REPLACE (kills + 1 AS kills, updated_at + INTERVAL 400 DAY AS updated_at) FROM v WHERE game_id % 5 = 0),
w AS (SELECT *, CASE WHEN season IS NULL THEN 'no-season' WHEN named <> CAST(uid AS VARCHAR) THEN 'foreign-owner' END why FROM f)"""


@query(f"""WITH {FRESH}, r AS (SELECT *, row_number() OVER (PARTITION BY season, uid, game_id ORDER BY updated_at DESC, slot DESC, part_id DESC, source_id DESC, kills DESC, placement DESC) r FROM w WHERE why IS NULL)
SELECT season, uid, count(*) games, CAST(sum(kills) AS BIGINT) kills, count(*) FILTER (placement = 1) wins, min(placement) best, CAST(sum(placement) AS BIGINT) places, max(updated_at) updated_at FROM r WHERE r = 1 GROUP BY 1, 2""")
def season_increments(spark, sf_dir):
    """Totals after all batches, which come in out of order and one of them twice; equal to totals over all rows at once."""
    fresh, folder, files = fresh_matches(spark, sf_dir), shared_folder(spark), max(8, (tasks(spark, sf_dir) or 0) // 8)
    fresh.write.partitionBy("batch").parquet(f"{folder}/incoming")
    incoming = spark.read.schema(fresh.schema).parquet(f"{folder}/incoming")
    years = sorted(r[0] for r in incoming.select("batch").distinct().collect())
    for batch in [*years[1::2], *years[::2], *years[1:2]]:
        put_batch(spark, incoming.where(F.col("batch") == batch), f"{folder}/kept", batch, VALUES, ORDER, buckets=2, files=files)
    if not years:
        put_batch(spark, incoming, f"{folder}/kept", "none", VALUES, ORDER, buckets=2, files=files)
    return spark.read.parquet(f"{folder}/kept/totals").drop("bucket")


@query(f"WITH {FRESH} SELECT CAST(year(updated_at) AS VARCHAR) batch, count(*) FILTER (why IS NULL) upserted, count(why) skipped, count(*) FILTER (why = 'no-season') no_season, count(*) FILTER (why = 'foreign-owner') foreign_owner FROM w GROUP BY 1")
def fresh_match_outcomes(spark, sf_dir):
    """How many of each batch's matches are stored, and why the others are not."""
    x = fresh_matches(spark, sf_dir).withColumn("why", skip_reason(F.col("season"), F.col("uid"), F.col("game_id"), F.col("named")))
    n = lambda reason: F.count_if(F.col("why") == reason)
    return x.groupBy("batch").agg(F.count_if(F.col("why").isNull()).alias("upserted"), F.count("why").alias("skipped"), n("no-season").alias("no_season"), n("foreign-owner").alias("foreign_owner"))
