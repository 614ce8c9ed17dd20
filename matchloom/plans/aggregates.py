"""Grouped aggregates, audits and distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.core import clamp, duration_bucket, js_round, placement_bucket, safe_kda, shrink
from matchloom.operators.counted import counted, quantile, ranked
from matchloom.operators.statistics import winsorized_mean
from matchloom.sources.facts import PM, player_match, rank_only, table

from .registry import query

R2, R4 = "floor(({0}) * 100 + 0.5) / 100", "floor(({0}) * 10000 + 0.5) / 10000"


@query(f"""WITH {PM} SELECT uid, season, count(*) games, count(*) FILTER (victory) wins, CAST(sum(kills) AS BIGINT) kills, {R4.format("avg(placement)")} avg_place, {R4.format("avg(damage)")} avg_damage,
CAST(sum(rp_delta) AS BIGINT) rp_change, {R2.format("CASE WHEN sum(deaths) <= 0 THEN sum(kills) + sum(assists) ELSE (sum(kills) + sum(assists)) / CAST(sum(deaths) AS DOUBLE) END")} kda FROM pm WHERE game_mode = 'rank' GROUP BY 1, 2""")
def season_player_summary(spark, sf_dir):
    """A player's season: averages skip nulls, and the RP change is null if no delta is known."""
    return rank_only(player_match(spark, sf_dir)).groupBy("uid", "season").agg(
        F.count(F.lit(1)).alias("games"), F.count_if("victory").alias("wins"), F.sum("kills").alias("kills"), js_round(F.avg("placement"), 4).alias("avg_place"),
        js_round(F.avg("damage"), 4).alias("avg_damage"), F.sum("rp_delta").alias("rp_change"), safe_kda(F.sum("kills"), F.sum("assists"), F.sum("deaths")).alias("kda"),
    )


@query(f"""WITH {PM} SELECT uid, character_num, count(*) games, {R4.format("avg(CASE WHEN victory THEN 100.0 ELSE 0 END)")} win_rate, {R4.format("100.0 * count(*) FILTER (placement <= 3) / count(*)")} top3_rate, CAST(sum(rp_delta) AS BIGINT) rp_change,
min(played_at) first_at, max(played_at) last_at FROM pm GROUP BY 1, 2""")
def character_aggregates(spark, sf_dir):
    return player_match(spark, sf_dir).groupBy("uid", "character_num").agg(
        F.count(F.lit(1)).alias("games"), js_round(F.avg(F.when(F.col("victory"), 100.0).otherwise(0.0)), 4).alias("win_rate"),
        js_round(F.lit(100.0) * F.count_if(F.col("placement") <= 3) / F.count(F.lit(1)), 4).alias("top3_rate"), F.sum("rp_delta").alias("rp_change"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"),
    )


@query(f"""WITH {PM}, c AS (SELECT o_custkey uid, count(*) expected FROM orders GROUP BY 1), s AS (SELECT uid, count(DISTINCT game_id) collected FROM pm WHERE game_mode = 'rank' GROUP BY 1)
SELECT uid, expected, coalesce(collected, 0) collected, {R2.format("least(coalesce(collected, 0) / CAST(expected AS DOUBLE), 1.0)")} coverage, CASE WHEN coalesce(collected, 0) >= 0.9 * expected THEN 'ready' ELSE 'partial' END status FROM c LEFT JOIN s USING (uid)""")
def season_coverage(spark, sf_dir):
    s = rank_only(player_match(spark, sf_dir)).groupBy("uid").agg(F.countDistinct("game_id").alias("c"))
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.count(F.lit(1)).alias("expected"))
    c = F.coalesce("c", F.lit(0)).cast("long")
    return e.join(s, "uid", "left").select("uid", "expected", c.alias("collected"), js_round(F.least(c / F.col("expected"), F.lit(1.0)), 2).alias("coverage"), F.when(c >= F.lit(0.9) * F.col("expected"), "ready").otherwise("partial").alias("status"))


@query(f"""WITH {PM} SELECT character_num, weapon, count(*) games, count(damage) with_damage, CASE WHEN count(damage) >= 20 AND count(damage) >= 0.9 * count(*) THEN {R4.format("avg(damage)")} END gated_damage FROM pm GROUP BY 1, 2""")
def weapon_group_stats(spark, sf_dir):
    """The mean of a metric only where enough rows have it."""
    n, k = F.count(F.lit(1)), F.count("damage")
    return player_match(spark, sf_dir).groupBy("character_num", "weapon").agg(n.alias("games"), k.alias("with_damage"), F.when((k >= 20) & (k >= F.lit(0.9) * n), js_round(F.avg("damage"), 4)).alias("gated_damage"))


@query(f"""WITH {PM} SELECT tier, role, character_num, count(*) n, count(DISTINCT uid) users, count(*) - count(damage) null_damage FROM pm GROUP BY GROUPING SETS ((tier), (role), (tier, role), (character_num), ())""")
def readiness_audit(spark, sf_dir):
    """Five groupings in one pass over the scan."""
    pm = player_match(spark, sf_dir)
    return pm.groupingSets([["tier"], ["role"], ["tier", "role"], ["character_num"], []], "tier", "role", "character_num").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("users"), (F.count(F.lit(1)) - F.count("damage")).alias("null_damage")
    )


@query(f"""WITH {PM}, c AS (SELECT uid, role, count(*) n FROM pm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, role) r, sum(n) OVER (PARTITION BY uid) t FROM c)
SELECT uid, role, {R4.format("n / CAST(t AS DOUBLE)")} share, n / CAST(t AS DOUBLE) < 0.45 mixed FROM r WHERE r = 1""")
def primary_role(spark, sf_dir):
    """The most played role, ties by the fixed order of roles; mixed under 45 %."""
    c = player_match(spark, sf_dir).groupBy("uid", "role").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("uid")
    share = F.col("n") / F.sum("n").over(w)
    c = c.withColumns({"share": share, "r": F.row_number().over(w.orderBy(F.desc("n"), "role"))}).where("r = 1")
    return c.select("uid", "role", js_round(F.col("share"), 4).alias("share"), (F.col("share") < 0.45).alias("mixed"))


@query(f"""WITH {PM} SELECT role, tier, {R4.format("median(kills)")} kills, {R4.format("median(damage)")} damage, {R4.format("median(rp_delta)")} rp FROM pm GROUP BY 1, 2""")
def cohort_medians(spark, sf_dir):
    """The medians of three measures from one table of counted values."""
    measures = F.explode(F.array(*(F.struct(F.lit(b).alias("measure"), F.col(a).cast("double").alias("v")) for a, b in (("kills", "kills"), ("damage", "damage"), ("rp_delta", "rp"))))).alias("m")
    keys = ["role", "tier", "measure"]
    m = ranked(counted(player_match(spark, sf_dir).select("role", "tier", measures).select("role", "tier", "m.*"), keys, "v"), keys, "v").groupBy(*keys).agg(quantile("v", 0.5).alias("v"))
    return m.groupBy("role", "tier").agg(*(js_round(F.max(F.when(F.col("measure") == b, F.col("v"))), 4).alias(b) for b in ("kills", "damage", "rp")))


@query(f"""WITH {PM}, u AS (SELECT uid, character_num, count(*) n, avg(kills) k FROM pm GROUP BY 1, 2) SELECT uid, {R4.format("sum(k * n) / sum(n)")} weighted, CAST(sum(n) AS BIGINT) games FROM u GROUP BY 1""")
def weighted_character_mean(spark, sf_dir):
    u = player_match(spark, sf_dir).groupBy("uid", "character_num").agg(F.count(F.lit(1)).alias("n"), F.avg("kills").alias("k"))
    return u.groupBy("uid").agg(js_round(F.sum(F.col("k") * F.col("n")) / F.sum("n"), 4).alias("weighted"), F.sum("n").alias("games"))


@query(f"""WITH {PM}, r AS (SELECT uid, kills, row_number() OVER (PARTITION BY uid ORDER BY kills, game_id, slot, part_id, source_id) r, count(*) OVER (PARTITION BY uid) n FROM pm),
w AS (SELECT uid, kills, n, CASE WHEN r <= ceil(n * 0.1) THEN 0.15 WHEN r > n - ceil(n * 0.1) THEN 0.75 ELSE 1.0 END w FROM r) SELECT uid, max(n) n, {R4.format("sum(kills * w) / sum(w)")} robust FROM w WHERE n >= 10 GROUP BY 1""")
def robust_weighted_mean(spark, sf_dir):
    """The lowest tenth counts 0.15, the highest 0.75."""
    w = Window.partitionBy("uid")
    r, n = F.row_number().over(w.orderBy("kills", "game_id", "slot", "part_id", "source_id")), F.count(F.lit(1)).over(w)
    x = player_match(spark, sf_dir).select("uid", "kills", r.alias("r"), n.alias("n")).where("n >= 10")
    tail = F.ceil(F.col("n") * F.lit(0.1))
    weight = F.when(F.col("r") <= tail, 0.15).when(F.col("r") > F.col("n") - tail, 0.75).otherwise(1.0)
    return x.withColumn("w", weight).groupBy("uid").agg(F.max("n").alias("n"), js_round(F.sum(F.col("kills") * F.col("w")) / F.sum("w"), 4).alias("robust"))


@query(f"""WITH {PM} SELECT uid, count(*) n, {R4.format("CASE WHEN count(*) >= 2 THEN greatest(least(100 - 2 * stddev_pop(kills), 100), 0) END")} consistency FROM pm GROUP BY 1""")
def consistency_score(spark, sf_dir):
    return player_match(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), js_round(F.when(F.count(F.lit(1)) >= 2, clamp(F.lit(100.0) - F.lit(2.0) * F.stddev_pop("kills"), 0, 100)), 4).alias("consistency"))


@query(f"""WITH {PM} SELECT tier, role, count(*) n, count(*) - count(damage) nulls, count(*) FILTER (kills = 0) zeros, count(*) FILTER (kills > 0) positives, {R4.format("avg(damage)")} mean, {R4.format("stddev_pop(damage)")} sd,
{R4.format("quantile_cont(damage, 0.1)")} p10, {R4.format("quantile_cont(damage, 0.5)")} p50, {R4.format("quantile_cont(damage, 0.95)")} p95 FROM pm GROUP BY 1, 2""")
def baseline_stat_block(spark, sf_dir):
    """All figures from the counted values of each tier and role."""
    keys, n, d = ["tier", "role"], F.col("n"), F.col("damage")
    c = counted(player_match(spark, sf_dir), keys, "damage", F.count_if(F.col("kills") == 0).alias("zeros"), F.count_if(F.col("kills") > 0).alias("positives"))
    some = F.sum(F.when(d.isNotNull(), n))
    mean = F.sum(d * n) / some
    q = lambda p: js_round(quantile("damage", p), 4)
    return ranked(c, keys, "damage").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(d.isNull(), n).otherwise(0)).alias("nulls"), F.sum("zeros").alias("zeros"), F.sum("positives").alias("positives"), js_round(mean, 4).alias("mean"),
        js_round(F.sqrt(F.greatest(F.sum(d * d * n) / some - mean * mean, F.lit(0.0))), 4).alias("sd"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.95).alias("p95"),
    )


@query(f"""WITH {PM}, q AS (SELECT tier, quantile_cont(damage, 0.25) a, quantile_cont(damage, 0.75) b FROM pm GROUP BY 1) SELECT tier, count(*) FILTER (damage < a - 1.5 * (b - a) OR damage > b + 1.5 * (b - a)) outliers, count(damage) n FROM pm JOIN q USING (tier) GROUP BY 1""")
def iqr_outliers(spark, sf_dir):
    c = ranked(counted(player_match(spark, sf_dir), ["tier"], "damage"), ["tier"], "damage")
    q = c.groupBy("tier").agg(quantile("damage", 0.25).alias("a"), quantile("damage", 0.75).alias("b"))
    far = (F.col("damage") < F.col("a") - F.lit(1.5) * (F.col("b") - F.col("a"))) | (F.col("damage") > F.col("b") + F.lit(1.5) * (F.col("b") - F.col("a")))
    return c.join(q, "tier").groupBy("tier").agg(F.sum(F.when(far, F.col("n")).otherwise(0)).alias("outliers"), F.sum(F.when(F.col("damage").isNotNull(), F.col("n")).otherwise(0)).alias("n"))


def _winsor_sql(f: str) -> str:
    return f"WITH {PM}, c AS (SELECT character_num, {f}(damage, 0.95) cap FROM pm GROUP BY 1) SELECT character_num, {R4.format('avg(least(damage, cap)) FILTER (damage IS NOT NULL)')} winsorized FROM pm JOIN c USING (character_num) GROUP BY 1"


@query(_winsor_sql("quantile_disc"))
def winsorized_nearest(spark, sf_dir):
    x = winsorized_mean(player_match(spark, sf_dir).where("damage is not null"), ["character_num"], "damage", 0.95, False)
    return x.select("character_num", js_round(F.col("winsorized"), 4).alias("winsorized"))


@query(_winsor_sql("quantile_cont"))
def winsorized_interpolated(spark, sf_dir):
    x = winsorized_mean(player_match(spark, sf_dir).where("damage is not null"), ["character_num"], "damage", 0.95, True)
    return x.select("character_num", js_round(F.col("winsorized"), 4).alias("winsorized"))


@query(f"""WITH {PM} SELECT CASE WHEN duration / 60.0 >= 30 THEN '30+' WHEN duration / 60.0 >= 25 THEN '25-30' WHEN duration / 60.0 >= 20 THEN '20-25' WHEN duration / 60.0 >= 15 THEN '15-20' ELSE '<15' END bucket,
CASE WHEN placement <= 1 THEN '1' WHEN placement <= 3 THEN '2-3' WHEN placement <= 6 THEN '4-6' ELSE '7+' END place, count(*) n, {R4.format("avg(CASE WHEN damage IS NULL THEN 1.0 ELSE 0 END)")} missing FROM pm GROUP BY 1, 2""")
def missing_bias(spark, sf_dir):
    """The missing rate by duration and placement."""
    return player_match(spark, sf_dir).groupBy(duration_bucket(F.col("duration")).alias("bucket"), placement_bucket(F.col("placement")).alias("place")).agg(F.count(F.lit(1)).alias("n"), js_round(F.avg(F.col("damage").isNull().cast("double")), 4).alias("missing"))


@query(f"""WITH {PM}, g AS (SELECT game_id, team_number, count(DISTINCT team_kills) d, count(*) n FROM pm GROUP BY 1, 2) SELECT n, count(*) teams, {R4.format("avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0 END)")} uniform FROM g GROUP BY 1""")
def team_uniformity(spark, sf_dir):
    g = player_match(spark, sf_dir).groupBy("game_id", "team_number").agg(F.countDistinct("team_kills").alias("d"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("teams"), js_round(F.avg((F.col("d") <= 1).cast("double")), 4).alias("uniform"))


@query("""WITH k AS (SELECT event_type, unnest(json_keys(props)) path, props FROM events) SELECT event_type, path, count(*) n, count(DISTINCT json_extract_string(props, '$.' || path)) "values", min(CAST(json_extract_string(props, '$.' || path) AS BIGINT)) low, max(CAST(json_extract_string(props, '$.' || path) AS BIGINT)) high FROM k GROUP BY 1, 2""")
def json_field_inventory(spark, sf_dir):
    """Paths of a JSON column with counts and ranges: the object is read as a map and exploded."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("path", "v"))
    return e.groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("values"), F.min(F.col("v").cast("long")).alias("low"), F.max(F.col("v").cast("long")).alias("high"))


@query(f"""WITH {PM}, g AS (SELECT uid, season, CASE WHEN avg(kills) >= 7 THEN 'A' WHEN avg(kills) >= 6 THEN 'B' ELSE 'C' END g FROM pm GROUP BY 1, 2)
SELECT a.g AS before, b.g AS after, count(*) n FROM g a JOIN g b ON a.uid = b.uid AND b.season = a.season + 1 GROUP BY 1, 2""")
def grade_transitions(spark, sf_dir):
    """From each season to the next: a lead over the player's seasons."""
    k = F.avg("kills")
    g = player_match(spark, sf_dir).groupBy("uid", "season").agg(F.when(k >= 7, "A").when(k >= 6, "B").otherwise("C").alias("before"))
    w = Window.partitionBy("uid").orderBy("season")
    g = g.withColumns({"after": F.lead("before").over(w), "next": F.lead("season").over(w)}).where("next = season + 1")
    return g.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PM} SELECT least(CAST(floor(damage / 10000) AS BIGINT), 9) bin, count(*) n FROM pm WHERE damage IS NOT NULL GROUP BY 1""")
def damage_histogram(spark, sf_dir):
    return player_match(spark, sf_dir).where("damage is not null").groupBy(F.least(F.floor(F.col("damage") / 10000), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PM}, u AS (SELECT uid, count(*) n FROM pm GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, uid) r FROM u) SELECT CAST(sum(n) AS BIGINT) total, CAST(sum(n) FILTER (r <= 10) AS BIGINT) top10, {R4.format("sum(n) FILTER (r <= 10) / CAST(sum(n) AS DOUBLE)")} share FROM r""")
def top10_concentration(spark, sf_dir):
    u = player_match(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    top = u.orderBy(F.desc("n"), "uid").limit(10).agg(F.sum("n").alias("top10"))
    return u.agg(F.sum("n").alias("total")).crossJoin(F.broadcast(top)).select("total", "top10", js_round(F.col("top10") / F.col("total"), 4).alias("share"))


@query(f"""WITH {PM}, g AS (SELECT game_id FROM pm GROUP BY 1 HAVING count(*) >= 3) SELECT count(*) completable FROM g""")
def completable_games(spark, sf_dir):
    return player_match(spark, sf_dir).groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").agg(F.count(F.lit(1)).alias("completable"))


@query(f"""WITH {PM}, u AS (SELECT uid, avg(kills) m, count(*) n FROM pm GROUP BY 1), p AS (SELECT avg(kills) pm FROM pm) SELECT uid, n, {R4.format("CASE WHEN n >= 20 THEN m ELSE n / (n + 15.0) * m + (1 - n / (n + 15.0)) * pm END")} adjusted, CASE WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END confidence FROM u, p""")
def sample_adjusted_score(spark, sf_dir):
    """Raw from 20 samples on, else shrunk to the overall mean."""
    pm = player_match(spark, sf_dir)
    u = pm.groupBy("uid").agg(F.avg("kills").alias("m"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(pm.agg(F.avg("kills").alias("prior"))))
    adjusted = F.when(F.col("n") >= 20, F.col("m")).otherwise(shrink(F.col("m"), F.col("prior"), F.col("n"), 15))
    return u.select("uid", "n", js_round(adjusted, 4).alias("adjusted"), F.when(F.col("n") >= 20, "high").when(F.col("n") >= 10, "medium").otherwise("low").alias("confidence"))
