"""Merged histories, metrics of a player's set of matches, and summaries over scored matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.core import js_round, safe_kda, steps
from matchloom.functions.fixed import FINE_GRADES, LOWEST
from matchloom.operators.counted import counted, quantile, ranked
from matchloom.operators.survivorship import first_by, merge_by_priority
from matchloom.sources.facts import PM, player_match, rank_only, spread

from .registry import query
from .scores import CHAIN, GRADE, match_grade_rows, role_score_rows

R4 = "floor(({0}) * 10000 + 0.5) / 10000"
ORDER = "slot, part_id, source_id, kills, updated_at"


@query(f"""WITH {PM}, a AS (SELECT uid, game_id, kills, 'page' AS source FROM (SELECT *, row_number() OVER (PARTITION BY uid, game_id ORDER BY {ORDER}) r FROM pm WHERE season >= 1998) WHERE r = 1),
b AS (SELECT uid, game_id, kills, 'archive' AS source FROM (SELECT *, row_number() OVER (PARTITION BY uid, game_id ORDER BY {ORDER}) r FROM pm WHERE game_mode = 'rank') WHERE r = 1)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.uid = a.uid AND b.game_id = a.game_id)""")
def merged_history(spark, sf_dir):
    """Pages of recent games and an archive of rank games, one row a game: the archive, which is read last, wins."""
    pm, order = player_match(spark, sf_dir), [F.col(c) for c in ORDER.split(", ")]
    one = lambda df, name: first_by(df, ["uid", "game_id"], *order).select("uid", "game_id", "kills", F.lit(name).alias("source"))
    return merge_by_priority([one(rank_only(pm), "archive"), one(pm.where("season >= 1998"), "page")], ["uid", "game_id"], F.col("kills")).drop("_source")


@query(f"""WITH {PM}, s AS (SELECT uid, season, count(*) FILTER (game_mode = 'rank') r, count(*) n, CAST(sum(kills) FILTER (game_mode = 'rank') AS BIGINT) rk, CAST(sum(kills) AS BIGINT) k FROM pm GROUP BY 1, 2)
SELECT uid, season, CASE WHEN r > 0 THEN 'rank' ELSE 'merged' END AS source, CASE WHEN r > 0 THEN r ELSE n END games, CASE WHEN r > 0 THEN rk ELSE k END kills FROM s""")
def fallback_history(spark, sf_dir):
    """A player's season from the rank matches if there is one, else from all."""
    rank = F.col("game_mode") == "rank"
    s = player_match(spark, sf_dir).groupBy("uid", "season").agg(
        F.count_if(rank).alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.when(rank, F.col("kills"))).alias("rk"), F.sum("kills").alias("k")
    )
    has = F.col("r") > 0
    return s.select("uid", "season", F.when(has, "rank").otherwise("merged").alias("source"), F.when(has, F.col("r")).otherwise(F.col("n")).alias("games"), F.when(has, F.col("rk")).otherwise(F.col("k")).alias("kills"))


SET = f"""{PM}, o AS (SELECT uid, placement, kills, assists, deaths, floor(CASE WHEN deaths <= 0 THEN kills + assists ELSE (kills + assists) / CAST(deaths AS DOUBLE) END * 100 + 0.5) / 100 kda,
 row_number() OVER (PARTITION BY uid ORDER BY played_at DESC, game_id DESC, {ORDER}) i, count(*) OVER (PARTITION BY uid) n FROM pm),
m AS (SELECT uid, count(*) n, avg(placement) place, stddev_pop(placement) place_sd, avg(kda) kda, stddev_pop(kda) kda_sd, avg(placement) FILTER (i <= ceil(n / 2.0)) recent, avg(placement) FILTER (i > ceil(n / 2.0)) older, avg(deaths) deaths FROM o GROUP BY 1)"""


def match_sets(spark, sf_dir):
    """Per player: means and spreads of placement and KDA, and the placement of the newer half of the matches against the older."""
    w = Window.partitionBy("uid")
    x = player_match(spark, sf_dir).withColumns({
        "kda": safe_kda(F.col("kills"), F.col("assists"), F.col("deaths")), "n": F.count(F.lit(1)).over(w),
        "i": F.row_number().over(w.orderBy(F.desc("played_at"), F.desc("game_id"), *ORDER.split(", "))),
    })
    new = F.col("i") <= F.ceil(F.col("n") / 2)
    return x.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("placement").alias("place"), F.stddev_pop("placement").alias("place_sd"), F.avg("kda").alias("kda"), F.stddev_pop("kda").alias("kda_sd"),
        F.avg(F.when(new, F.col("placement"))).alias("recent"), F.avg(F.when(~new, F.col("placement"))).alias("older"), F.avg("deaths").alias("deaths"),
    )


@query(f"WITH {SET} SELECT uid, n, {R4.format('place')} place, {R4.format('place_sd')} place_sd, {R4.format('kda')} kda, {R4.format('CASE WHEN kda > 0 THEN kda_sd / kda END')} kda_cv, {R4.format('older - recent')} gain FROM m")
def match_set_metrics(spark, sf_dir):
    m = match_sets(spark, sf_dir)
    return m.select("uid", "n", *(js_round(F.col(c), 4).alias(c) for c in ("place", "place_sd", "kda")), js_round(F.when(F.col("kda") > 0, F.col("kda_sd") / F.col("kda")), 4).alias("kda_cv"), js_round(F.col("older") - F.col("recent"), 4).alias("gain"))


@query(f"WITH {SET} SELECT count(*) players, {R4.format('avg(place)')} place, {R4.format('avg(kda)')} kda, {R4.format('avg(deaths)')} deaths, min(n) least FROM m WHERE n >= 10")
def population_metrics(spark, sf_dir):
    """The mean player among those with ten matches or more; every player counts once."""
    m = match_sets(spark, sf_dir).where("n >= 10")
    return m.agg(F.count(F.lit(1)).alias("players"), *(js_round(F.avg(c), 4).alias(c) for c in ("place", "kda", "deaths")), F.min("n").alias("least"))


@query(f"WITH {CHAIN}, g AS (SELECT uid, {GRADE.format('match_score')} grade FROM mg) SELECT uid, count(*) matches, count(*) FILTER (grade IN ('S+', 'S', 'S-')) highlights, count(*) FILTER (grade IS NULL) ungraded FROM g GROUP BY 1")
def match_highlights(spark, sf_dir):
    """Matches of a player and those with a grade of the S group."""
    grade = steps(F.col("match_score"), FINE_GRADES, LOWEST)
    g = match_grade_rows(spark, sf_dir).select("uid", grade.alias("grade"))
    return g.groupBy("uid").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("grade").isin("S+", "S", "S-")).alias("highlights"), F.count_if(F.col("grade").isNull()).alias("ungraded"))


@query(f"""WITH {CHAIN}, d AS (SELECT role, role_score - raw_role_score delta, {GRADE.format("raw_role_score")} a, {GRADE.format("role_score")} b FROM sc)
SELECT role, count(*) pairs, {R4.format("avg(delta)")} mean_delta, {R4.format("median(floor(delta * 10000 + 0.5) / 10000)")} median_delta, {R4.format("max(abs(delta))")} largest, {R4.format("avg(CASE WHEN a <> b THEN 1.0 ELSE 0 END)")} changed, {R4.format("avg(CASE WHEN left(a, 1) <> left(b, 1) THEN 1.0 ELSE 0 END)")} changed_letter FROM d GROUP BY 1""")
def grade_change_summary(spark, sf_dir):
    """What the adjustment of metric scores changes, by role: mean, median and largest difference, and how many grades and letters change."""
    before, after = (steps(F.col(c), FINE_GRADES, LOWEST) for c in ("raw_role_score", "role_score"))
    d = role_score_rows(spark, sf_dir).select("role", (F.col("role_score") - F.col("raw_role_score")).alias("delta"), before.alias("a"), after.alias("b"))
    c = counted(d.withColumn("v", js_round(F.col("delta"), 4)), ["role"], "v", F.sum("delta").alias("sum"), F.max(F.abs("delta")).alias("far"), F.count_if(F.col("a") != F.col("b")).alias("grades"), F.count_if(F.substring("a", 1, 1) != F.substring("b", 1, 1)).alias("letters"))
    rate = lambda x: js_round(F.sum(x) / F.sum("n"), 4)
    return ranked(c, ["role"], "v").groupBy("role").agg(
        F.sum("n").alias("pairs"), js_round(F.sum("sum") / F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), 4).alias("mean_delta"), js_round(quantile("v", 0.5), 4).alias("median_delta"), js_round(F.max("far"), 4).alias("largest"),
        rate("grades").alias("changed"), rate("letters").alias("changed_letter"),
    )


@query(f"""WITH {PM}, c AS (SELECT part_id % 7 AS role7, count(*) n FROM pm WHERE game_mode = 'rank' GROUP BY 1) SELECT greatest(30, CAST(floor(median(n) + 0.5) AS BIGINT)) k, count(*) roles FROM c""")
def shrinkage_constant(spark, sf_dir):
    """The weight of a prior: the median of the roles' sample counts, 30 at least."""
    c = rank_only(player_match(spark, sf_dir)).groupBy((F.col("part_id") % 7).alias("role7")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.greatest(F.lit(30).cast("long"), js_round(F.median("n")).cast("long")).alias("k"), F.count(F.lit(1)).alias("roles"))


@query(f"""WITH {PM}, a AS (SELECT CASE WHEN duration / 60.0 < 10 OR duration / 60.0 >= 25 THEN NULL WHEN duration / 60.0 <= 12.5 THEN 10 WHEN duration / 60.0 <= 17.5 THEN 15 WHEN duration / 60.0 <= 22.5 THEN 20 ELSE 25 END anchor, damage FROM pm WHERE game_mode = 'rank')
SELECT CAST(anchor AS INTEGER) anchor, count(*) n, count(damage) with_damage, {R4.format("avg(damage)")} damage FROM a GROUP BY 1""")
def anchor_minutes(spark, sf_dir):
    """Rank matches by the nearest of four minutes, the earlier one at equal distance; none outside 10 to 25."""
    minute = F.col("duration") / F.lit(60.0)
    near = F.array_min(F.array(*(F.struct(F.abs(minute - a).alias("far"), F.lit(a).alias("anchor")) for a in (10, 15, 20, 25))))["anchor"]
    a = rank_only(player_match(spark, sf_dir)).select(F.when((minute >= 10) & (minute < 25), near).alias("anchor"), "damage")
    return a.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count("damage").alias("with_damage"), js_round(F.avg("damage"), 4).alias("damage"))


@query(f"""WITH {PM}, s AS (SELECT uid, rp_after, row_number() OVER (PARTITION BY uid ORDER BY played_at DESC, game_id DESC, {ORDER}) r FROM pm WHERE rp_after BETWEEN 1 AND 3599) SELECT uid, rp_after FROM s WHERE r = 1 ORDER BY rp_after, uid LIMIT 100""")
def low_tier_queue(spark, sf_dir):
    """A queue's next hundred players of the lower tiers, by the points of each one's latest match there."""
    low = player_match(spark, sf_dir).where("rp_after between 1 and 3599")
    return first_by(low, ["uid"], F.desc("played_at"), F.desc("game_id"), *(F.col(c) for c in ORDER.split(", "))).select("uid", "rp_after").orderBy("rp_after", "uid").limit(100)


@query(f"""WITH {PM}, c AS (SELECT uid, character_num, count(DISTINCT game_id) games FROM pm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY games DESC, character_num) i, lead(games) OVER (PARTITION BY uid ORDER BY games DESC, character_num) next_games FROM c)
SELECT uid, character_num, games FROM r WHERE i = 1 AND games >= 2 AND games IS DISTINCT FROM next_games""")
def clear_winners(spark, sf_dir):
    """A player's character with the most games, two at least, unless another has as many."""
    games = player_match(spark, sf_dir).select("uid", "character_num", "game_id").distinct()
    c = spread(games, sf_dir, "uid", "character_num").groupBy("uid", "character_num").agg(F.count("game_id").alias("games"))
    w = Window.partitionBy("uid").orderBy(F.desc("games"), "character_num")
    r = spread(c, sf_dir, "uid").withColumns({"i": F.row_number().over(w), "next_games": F.lead("games").over(w)})
    return r.where((F.col("i") == 1) & (F.col("games") >= 2) & ~F.col("games").eqNullSafe(F.col("next_games"))).select("uid", "character_num", "games")
