"""Curves over match length and their holdout: games, a season and the most active players left out, all from one table of counted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.core import bracketed, js_round, string_hash
from matchloom.functions.fixed import HOLDOUT, LEAST_SECONDS
from matchloom.operators.counted import by_range, quantile, ranked
from matchloom.operators.curves import as_points, bucket, time_curves
from matchloom.sources.facts import PM, player_match, rank_only, spread, tasks
from matchloom.sources.scratch import written

from .registry import query

LEFT_OUT_SEASON, TOP_PLAYERS = 1996, 5
FLAGS = ["held", "in_season", "top"]


def cells(pm: DataFrame, season: int = LEFT_OUT_SEASON, players: int = TOP_PLAYERS, sf_dir: str | None = None) -> DataFrame:
    """Rank matches by role, length, metric and value, with whether their game is held out, their season left out, their player one of the most active.

    One scan, and one of the players' names; everything else works on these counts. Null values have no row. With sf_dir large tables are counted in as many tasks as their size asks for."""
    rank = rank_only(pm)
    top = rank.groupBy("uid").agg(F.count(F.lit(1)).alias("games")).orderBy(F.desc("games"), "uid").limit(players).select("uid", F.lit(True).alias("top"))
    held = string_hash(F.col("game_id").cast("string")) % HOLDOUT == 0
    x = rank.select("uid", "role", "tier", "duration", held.alias("held"), (F.col("season") == season).alias("in_season"), "damage", "kills").join(F.broadcast(top), "uid", "left")
    metric = lambda name, v: F.struct(F.lit(name).alias("metric"), F.col(v).cast("double").alias("value"))
    m = x.select("role", "duration", "held", "in_season", F.coalesce("top", F.lit(False)).alias("top"), F.explode(F.array(metric("damage", "damage"), metric("kills", "kills"))).alias("m"))
    m = m.select("*", "m.*").where("value is not null").drop("m")
    m = spread(m, sf_dir, "role", "duration", "metric", "value") if sf_dir else m
    return m.groupBy("role", "duration", *FLAGS, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


#: What each scenario leaves out.
LEFT_OUT = {"all": None, "train": "held", "without season": "in_season", "without top players": "top"}


def scenarios(c: DataFrame, wanted: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """role, metric, bucket, value, range and a count for each scenario: all matches, or those without what the scenario leaves out. Short matches train no curve.

    Dealt out by metric and value: a range holds so many rows, whatever curves they belong to, and all of a value. Cells are counted, so no value has many."""
    kept = lambda s: F.when(~F.col(f), F.col("n")).otherwise(0) if (f := LEFT_OUT[s]) else F.col("n")
    x = c.where((F.col("duration") >= LEAST_SECONDS) & (F.col("value") >= 0)).select("role", "metric", bucket(F.col("duration")).alias("bucket"), "value", *(kept(s).alias(s) for s in wanted))
    x = by_range(x, ["metric", "value"], parts).withColumn("range", F.spark_partition_id())
    return x.groupBy("role", "metric", "bucket", "value", "range").agg(*(F.sum(f"`{s}`").alias(s.replace(" ", "_")) for s in wanted))


def curves(c: DataFrame, wanted: tuple[str, ...] = tuple(LEFT_OUT), k: float | None = None, parts: int | None = None) -> DataFrame:
    """The scenarios' counts are written, as curves read them half a dozen times; a row has them all and is taken apart where it is read."""
    s = written(scenarios(c, wanted, parts), "scenarios")
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("scenario"), F.col(w.replace(" ", "_")).alias("n")) for w in wanted)))
    counts = s.select("role", "metric", "bucket", "value", "range", each.alias("s")).select("s.scenario", "role", "metric", "bucket", "value", "range", "s.n").where("n > 0")
    return time_curves(counts, c.select("role").distinct(), k=k)


def normalized(points: DataFrame, c: DataFrame) -> DataFrame:
    """points with multiplier: the expected value over its mean on the role's own matches."""
    keys = ["role", "metric"]
    lengths = c.where(F.col("duration") >= LEAST_SECONDS).groupBy(*keys, "duration").agg(F.sum("n").alias("n"))
    expected = bracketed(F.col("duration") / F.lit(60.0), F.col("minutes"), F.col("values"))
    mean = lengths.join(as_points(points, keys), keys).groupBy(*keys).agg((F.sum(F.greatest(F.lit(0.0), expected) * F.col("n")) / F.sum("n")).alias("mean"))
    last = points.where("minute = 30").select(*keys, F.greatest(F.lit(1.0), "expected").alias("last"))
    by = F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.col("last"))
    return points.join(mean, keys, "left").join(last, keys).select(points["*"], by.alias("normalizer"), (F.col("expected") / by).alias("multiplier"))


def ratios(c: DataFrame, points: DataFrame) -> DataFrame:
    """scope, key, metric, n and the median of value over expected value of held-out matches, by role (eight minutes at least) and by length."""
    x = c.where(F.col("held") & (F.col("duration") > 0)).groupBy("role", "duration", "metric", "value").agg(F.sum("n").alias("n"))
    expected = bracketed(F.col("duration") / F.lit(60.0), F.col("minutes"), F.col("values"))
    x = x.join(as_points(points, ["role", "metric"]), ["role", "metric"]).withColumn("expected", expected).where("expected > 0").withColumn("ratio", F.col("value") / F.col("expected"))
    scope = lambda name, key: F.struct(F.lit(name).alias("scope"), key.cast("string").alias("key"))
    both = F.array(F.when(F.col("duration") >= LEAST_SECONDS, scope("role", F.col("role"))), scope("length", bucket(F.col("duration"))))
    keys = ["scope", "key", "metric"]
    y = x.select("metric", "ratio", "n", F.explode(both).alias("s")).where("s is not null").select("s.*", "metric", "ratio", "n").groupBy(*keys, "ratio").agg(F.sum("n").alias("n"))
    return ranked(y, keys, "ratio").groupBy(*keys).agg(F.sum("n").alias("n"), quantile("ratio", 0.5).alias("median"))


def changes(points: DataFrame) -> DataFrame:
    """scenario and the largest relative change of a point against the curves of all matches."""
    base = points.where("scenario = 'all'").select("role", "metric", "minute", F.col("expected").alias("base"))
    off = F.abs(F.col("expected") - F.col("base")) / F.greatest(F.lit(1.0), F.abs("base"))
    return points.where("scenario <> 'all'").join(base, ["role", "metric", "minute"]).groupBy("scenario").agg(F.max(off).alias("largest_change"))


@query(None)
def time_curve_points(spark, sf_dir):
    """The curve of each role and metric: observed, fallback and expected value, sample counts, weight, source and multiplier of each minute. Tested against a plain loop."""
    c = written(cells(player_match(spark, sf_dir), sf_dir=sf_dir), "cells")
    points = normalized(written(curves(c, ("all",), parts=tasks(spark, sf_dir)), "curves"), c)
    r = lambda x: js_round(F.col(x), 6).alias(x)
    return points.select("role", "metric", "minute", r("raw"), r("fallback"), "samples", "all_samples", r("weight"), "source", "k", r("expected"), r("normalizer"), r("multiplier"))


@query(None)
def holdout_ratios(spark, sf_dir):
    """How held-out games compare with curves fitted without them. Tested against a plain loop."""
    c = written(cells(player_match(spark, sf_dir), sf_dir=sf_dir), "cells")
    found = ratios(c, written(curves(c, ("train",), parts=tasks(spark, sf_dir)), "curves"))
    return found.select("scope", "key", "metric", "n", js_round(F.col("median"), 6).alias("median"))


@query(None)
def holdout_changes(spark, sf_dir):
    """How far curves move without the held-out games, a season or the most active players. Tested against a plain loop."""
    c = written(cells(player_match(spark, sf_dir), sf_dir=sf_dir), "cells")
    removed = c.where("metric = 'kills'").agg(*(F.sum(F.when(F.col(f), F.col("n")).otherwise(0)).alias(s) for f, s in zip(FLAGS, ("train", "without season", "without top players"))))
    removed = removed.select(F.explode(F.create_map(*(x for s in removed.columns for x in (F.lit(s), F.col(f"`{s}`"))))).alias("scenario", "removed_rows"))
    return changes(written(curves(c, parts=tasks(spark, sf_dir)), "curves")).join(F.broadcast(removed), "scenario").select("scenario", "removed_rows", js_round(F.col("largest_change"), 6).alias("largest_change"))


@query(f"""WITH {PM}, g AS (SELECT game_id, CAST(game_id AS VARCHAR) s, count(*) n, count(*) FILTER (tier IN ('iron', 'bronze', 'silver', 'gold', 'platinum')) low FROM pm WHERE game_mode = 'rank' GROUP BY 1),
h AS (SELECT *, list_reduce(list_transform(string_split(s, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, b: xor(a, b) * 16777619 % 4294967296, CAST(2166136261 AS BIGINT)) h FROM g)
SELECT CASE WHEN h % 5 = 0 THEN 'validation' ELSE 'train' END part, count(*) games, CAST(sum(n) AS BIGINT) matches, CAST(sum(low) AS BIGINT) low_tier_matches, min(h) least, max(h) greatest FROM h GROUP BY 1""")
def holdout_split(spark, sf_dir):
    """Games by the hash of their id, a fifth held out: no game is in both parts."""
    low = F.col("tier").isin("iron", "bronze", "silver", "gold", "platinum")
    g = rank_only(player_match(spark, sf_dir)).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low"))
    h = g.withColumn("h", string_hash(F.col("game_id").cast("string")))
    part = F.when(F.col("h") % HOLDOUT == 0, "validation").otherwise("train")
    return h.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("games"), F.sum("n").alias("matches"), F.sum("low").alias("low_tier_matches"), F.min("h").alias("least"), F.max("h").alias("greatest"))
