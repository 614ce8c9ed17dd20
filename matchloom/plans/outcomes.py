"""Grades that weigh the outcome of matches, and audits of what a field means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.core import clamp, finite, js_round, steps
from matchloom.functions.fixed import FINE_GRADES, LOWEST, OUTCOME_POINTS, OVERALL_GRADES, S_PLUS_OUTCOME_GATE, S_PLUS_ROLE_GATE, S_ROLE_GATE
from matchloom.sources.facts import PM, player_match, rank_only

from .registry import query
from .scores import CHAIN, KEY, match_grade_rows

R2, R4 = "floor(({0}) * 100 + 0.5) / 100", "floor(({0}) * 10000 + 0.5) / 10000"
KEYS = ", ".join(KEY)


def fine_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {b} THEN '{g}'" for b, g in FINE_GRADES) + f" WHEN {c} IS NOT NULL THEN '{LOWEST}' END"


def outcome_score(points: Column, role_score: Column) -> Column:
    """The role score with a candidate's points, between 0 and 100; null where either is missing or not finite."""
    return F.when(points.isNotNull() & finite(role_score), js_round(clamp(role_score + points, 0, 100), 2))


def gated(score: Column, role_score: Column, top_open: Column, placement: Column | None = None) -> Column:
    """The score held under a grade whose gate is shut: S+ by top_open, then A- for places from 7 on where placement is given, then S- by the role score."""
    held = F.when((score >= 95) & ~F.coalesce(top_open, F.lit(False)), 94.99).otherwise(score)
    if placement is not None:
        held = F.when((placement >= 7) & (held >= 72), 71.99).otherwise(held)
    return F.when((held >= 84) & (role_score < S_ROLE_GATE), 83.99).otherwise(held)


def outcome_rows(df: DataFrame) -> DataFrame:
    """df (role_score, placement, outcome_score and more) once for each candidate, with its points, score, and grades under both gates.

    Rows whose place is not 1 to 8 or whose role score is missing have null scores and grades."""
    points = F.array(*(F.struct(F.lit(k).alias("candidate"), F.get(F.array(*map(F.lit, p)), F.col("placement").cast("int") - 1).alias("points")) for k, p in OUTCOME_POINTS.items()))
    x = df.select("*", F.explode(points).alias("_c")).select("*", "_c.*").drop("_c")
    x = x.withColumn("score", outcome_score(F.col("points"), F.col("role_score")))
    role, score = F.col("role_score"), F.col("score")
    production = gated(score, role, (role >= S_PLUS_ROLE_GATE) & (F.col("outcome_score") >= S_PLUS_OUTCOME_GATE))
    guarded = gated(score, role, (role >= S_PLUS_ROLE_GATE) & (F.col("placement") <= 3), F.col("placement"))
    # As columns of their own they are computed once, not once for each cut of the grades.
    x = x.withColumns({"production_grade": production, "guarded_grade": guarded})
    return x.withColumns({g: steps(F.col(g), FINE_GRADES, LOWEST) for g in ("production_grade", "guarded_grade")})


OUTCOME_SQL = "CASE WHEN source_id % 11 <> 0 THEN 100 - placement * 6.0 END"
CANDIDATES_SQL = ", ".join(f"('{k}', {i + 1}, {v}::DOUBLE)" for k, p in OUTCOME_POINTS.items() for i, v in enumerate(p))


@query(f"""WITH {CHAIN}, c(candidate, place, points) AS (VALUES {CANDIDATES_SQL}), k AS (SELECT DISTINCT candidate FROM c), s AS (SELECT {KEYS}, placement, role_score, {OUTCOME_SQL} outcome_score FROM mg),
a AS (SELECT s.*, k.candidate, c.points pts, CASE WHEN c.points IS NOT NULL THEN {R2.format('least(greatest(role_score + c.points, 0), 100)')} END score FROM s CROSS JOIN k LEFT JOIN c ON c.candidate = k.candidate AND c.place = s.placement),
b AS (SELECT *, CASE WHEN score >= 95 AND (role_score < 96 OR outcome_score IS NULL OR outcome_score < 88) THEN 94.99 ELSE score END p, CASE WHEN score >= 95 AND (role_score < 96 OR placement > 3) THEN 94.99 ELSE score END g FROM a),
d AS (SELECT *, CASE WHEN placement >= 7 AND g >= 72 THEN 71.99 ELSE g END h FROM b),
e AS (SELECT *, CASE WHEN p >= 84 AND role_score < 84 THEN 83.99 ELSE p END pp, CASE WHEN h >= 84 AND role_score < 84 THEN 83.99 ELSE h END hh FROM d)
SELECT {KEYS}, candidate, CASE WHEN score IS NOT NULL THEN pts END points, score, {fine_sql('pp')} production_grade, {fine_sql('hh')} guarded_grade FROM e""")
def outcome_capped_grades(spark, sf_dir):
    """The three candidates of outcome-weighted grades for every rank match, under the production gate and under the placement guard."""
    x = match_grade_rows(spark, sf_dir).withColumn("outcome_score", F.when(F.col("source_id") % 11 != 0, 100 - F.col("placement") * 6.0))
    x = outcome_rows(x.select(*KEY, "placement", "role_score", "outcome_score"))
    return x.select(*KEY, "candidate", F.when(F.col("score").isNotNull(), F.col("points")).alias("points"), "score", "production_grade", "guarded_grade")


def hybrid(df: DataFrame) -> DataFrame:
    """df (base, matches, outcome, consistency, mode, label) with the overall score of season: base with bounded steps for outcome and consistency.

    The base alone counts outside rank mode, under 20 matches, without either component or with an insufficient label. No base: no score."""
    c = F.col
    enough = (c("mode") == "rank") & (c("matches") >= 20)
    whole = enough & finite(c("outcome")) & finite(c("consistency")) & ~c("label").eqNullSafe("insufficient")
    use = F.coalesce(whole, F.lit(False))
    up, steady = clamp((c("outcome") - 65) * 0.2, -4, 4), clamp((c("consistency") - 65) * 0.1, -2, 2)
    final = F.when(use, clamp(c("base") + up + steady, 0, 100)).otherwise(c("base"))
    real = finite(c("base"))
    kept = lambda x: F.when(real, x)
    return df.select(
        "*", kept(js_round(final, 2)).alias("score"), kept(steps(final, OVERALL_GRADES, "D")).alias("grade"),
        kept(F.when(use, "overall-v2-hybrid").otherwise("character-grade-weighted-average-fallback")).alias("source"),
        kept(F.when(use, js_round(up, 2)).otherwise(0.0)).alias("outcome_modifier"), kept(F.when(use, js_round(steady, 2)).otherwise(0.0)).alias("consistency_modifier"), kept(js_round(final - c("base"), 2)).alias("total_modifier"),
        kept(F.when(~F.coalesce(enough, F.lit(False)), "insufficient").otherwise(F.coalesce("label", F.lit("insufficient")))).alias("confidence_label"),
    )


HYBRID_SQL = f"""WITH {CHAIN}, g AS (SELECT uid, character_num, count(match_score) k, CAST(sum(CAST(match_score AS DECIMAL(12, 2))) AS DOUBLE) s, count(*) FILTER (placement <= 3) top, CAST(sum(placement) AS BIGINT) p, CAST(sum(placement * placement) AS BIGINT) pp, count(*) n FROM mg GROUP BY 1, 2),
c AS (SELECT *, {R2.format("s / k")} score FROM g), u AS (SELECT uid, CAST(sum(n) AS BIGINT) n, CAST(sum(k) AS BIGINT) matches, count(*) FILTER (k > 0) characters, {R2.format("CAST(sum(CAST(score AS DECIMAL(12, 2)) * k) AS DOUBLE) / sum(k)")} base,
 CAST(sum(top) AS BIGINT) top, CAST(sum(p) AS BIGINT) p, CAST(sum(pp) AS BIGINT) pp FROM c GROUP BY 1),
v AS (SELECT uid, matches, characters, base, CASE WHEN uid % 7 <> 0 THEN {R2.format("40 + 60.0::DOUBLE * top / n")} END outcome, CASE WHEN n >= 2 THEN {R2.format("greatest(100 - 15 * sqrt(CAST(n * pp - p * p AS DOUBLE)) / n, 0)")} END consistency,
 CASE WHEN uid % 5 = 0 THEN 'cobalt' ELSE 'rank' END AS mode, CASE WHEN matches >= 40 THEN 'high' WHEN matches >= 20 THEN 'medium' WHEN matches >= 5 THEN 'low' ELSE 'insufficient' END AS label FROM u),
wh AS (SELECT *, coalesce(mode = 'rank' AND matches >= 20 AND outcome IS NOT NULL AND consistency IS NOT NULL AND label <> 'insufficient', false) use FROM v),
f AS (SELECT *, CASE WHEN use THEN least(greatest((outcome - 65) * 0.2::DOUBLE, -4), 4) ELSE 0 END up, CASE WHEN use THEN least(greatest((consistency - 65) * 0.1::DOUBLE, -2), 2) ELSE 0 END steady FROM wh WHERE base IS NOT NULL),
z AS (SELECT *, CASE WHEN use THEN least(greatest(base + up + steady, 0), 100) ELSE base END final FROM f)
SELECT uid, matches, characters, base, {R2.format("final")} score, CASE WHEN final >= 88 THEN 'S' WHEN final >= 72 THEN 'A' WHEN final >= 56 THEN 'B' WHEN final >= 38 THEN 'C' ELSE 'D' END grade, CASE WHEN use THEN 'overall-v2-hybrid' ELSE 'character-grade-weighted-average-fallback' END AS source,
 {R2.format("up")} outcome_modifier, {R2.format("steady")} consistency_modifier, {R2.format("final - base")} total_modifier, CASE WHEN mode <> 'rank' OR matches < 20 THEN 'insufficient' ELSE label END confidence_label FROM z"""


@query(HYBRID_SQL)
def overall_hybrid_grades(spark, sf_dir):
    """A player's overall grade: the mean of character scores by matches, moved by outcome and consistency. Some players are taken to play another mode."""
    c = F.col
    g = match_grade_rows(spark, sf_dir).groupBy("uid", "character_num").agg(
        F.count("match_score").alias("k"), F.sum(c("match_score").cast("decimal(12,2)")).cast("double").alias("s"), F.count_if(c("placement") <= 3).alias("top"),
        F.sum("placement").alias("p"), F.sum(c("placement") * c("placement")).alias("pp"), F.count(F.lit(1)).alias("n"),
    )
    score = js_round(c("s") / c("k"), 2).cast("decimal(12,2)")
    u = g.groupBy("uid").agg(
        F.sum("n").alias("n"), F.sum("k").alias("matches"), F.count_if(c("k") > 0).alias("characters"), js_round(F.sum(score * c("k")).cast("double") / F.sum("k"), 2).alias("base"),
        F.sum("top").alias("top"), F.sum("p").alias("p"), F.sum("pp").alias("pp"),
    )
    spread = F.sqrt((c("n") * c("pp") - c("p") * c("p")).cast("double"))
    u = u.withColumns({
        "outcome": F.when(c("uid") % 7 != 0, js_round(F.lit(40) + F.lit(60.0) * c("top") / c("n"), 2)), "consistency": F.when(c("n") >= 2, js_round(F.greatest(F.lit(100) - F.lit(15) * spread / c("n"), F.lit(0.0)), 2)),
        "mode": F.when(c("uid") % 5 == 0, "cobalt").otherwise("rank"), "label": F.when(c("matches") >= 40, "high").when(c("matches") >= 20, "medium").when(c("matches") >= 5, "low").otherwise("insufficient"),
    })
    return hybrid(u).where(c("base").isNotNull()).select("uid", "matches", "characters", "base", "score", "grade", "source", "outcome_modifier", "consistency_modifier", "total_modifier", "confidence_label")


@query(f"""WITH {PM}, t AS (SELECT game_id, team_number, count(DISTINCT team_kills) d, min(team_kills) a, count(*) n, count(*) FILTER (team_kills = kills + assists) e FROM pm GROUP BY 1, 2), g AS (SELECT game_id, count(*) teams, count(DISTINCT a) different FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM t) team_groups, (SELECT count(*) FILTER (d = 1) FROM t) uniform_teams, {R4.format("(SELECT avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END) FROM t)")} uniform_ratio, (SELECT count(*) FILTER (teams > 1) FROM g) comparable_games, (SELECT count(*) FILTER (teams > 1 AND different > 1) FROM g) different_games,
 {R4.format("(SELECT avg(CASE WHEN different > 1 THEN 1.0 ELSE 0 END) FROM g WHERE teams > 1)")} different_ratio, (SELECT CAST(sum(e) AS BIGINT) FROM t) equal_rows, {R4.format("(SELECT sum(e) / sum(n) FROM t)")} equal_ratio""")
def team_kill_meaning(spark, sf_dir):
    """Whether team kills are a team's: the same for all of a team, different between teams, and how often just kills and assists of the player."""
    t = player_match(spark, sf_dir).groupBy("game_id", "team_number").agg((F.min("team_kills") == F.max("team_kills")).alias("same"), F.min("team_kills").alias("a"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("team_kills") == F.col("kills") + F.col("assists")).alias("e"))
    g = t.groupBy("game_id").agg(F.count(F.lit(1)).alias("teams"), F.count_if("same").alias("same"), (F.min("a") != F.max("a")).alias("apart"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    s = g.agg(
        F.coalesce(F.sum("teams"), F.lit(0)).alias("team_groups"), F.coalesce(F.sum("same"), F.lit(0)).alias("uniform_teams"), F.count_if(F.col("teams") > 1).alias("comparable_games"), F.count_if((F.col("teams") > 1) & F.col("apart")).alias("different_games"),
        F.sum("e").alias("equal_rows"), F.sum("n").alias("n"),
    )
    part = lambda a, b: js_round(F.try_divide(F.col(a), F.col(b)), 4)
    return s.select("team_groups", "uniform_teams", part("uniform_teams", "team_groups").alias("uniform_ratio"), "comparable_games", "different_games", part("different_games", "comparable_games").alias("different_ratio"), "equal_rows", part("equal_rows", "n").alias("equal_ratio"))


PLAYED = "CASE WHEN source_id % 10 = 0 THEN duration - 40 WHEN part_id % 37 <> 0 THEN duration END"


@query(f"""WITH {PM}, r AS (SELECT game_id, victory, {PLAYED} d FROM pm WHERE game_mode = 'rank'), g AS (SELECT game_id, count(*) n, count(DISTINCT d) k, count(*) FILTER (victory) w, list_sort(list_distinct(list(d) FILTER (victory))) a, list_sort(list_distinct(list(d) FILTER (NOT victory))) b FROM r WHERE d IS NOT NULL GROUP BY 1)
SELECT count(*) games, count(*) FILTER (n > 1) several, count(*) FILTER (n > 1 AND k = 1) same, count(*) FILTER (n > 1 AND k > 1) different, count(*) FILTER (n > 1 AND w BETWEEN 1 AND n - 1) both_sides, count(*) FILTER (n > 1 AND w BETWEEN 1 AND n - 1 AND a <> b) sides_differ FROM g""")
def duration_meaning(spark, sf_dir):
    """Whether a length is the game's or the player's: games whose rows agree, and games whose winners have other lengths than the others. Some players leave early."""
    c = F.col
    d = F.when(c("source_id") % 10 == 0, c("duration") - 40).when(c("part_id") % 37 != 0, c("duration"))
    r = rank_only(player_match(spark, sf_dir)).select("game_id", "victory", d.alias("d")).where("d is not null")
    sides = [F.sort_array(F.collect_set(F.when(won, c("d")))) for won in (c("victory"), ~c("victory"))]
    g = r.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), (F.min("d") == F.max("d")).alias("same"), F.count_if("victory").alias("w"), *(x.alias(k) for x, k in zip(sides, "ab")))
    many = c("n") > 1
    both = many & c("w").between(1, c("n") - 1)
    return g.agg(F.count(F.lit(1)).alias("games"), F.count_if(many).alias("several"), F.count_if(many & c("same")).alias("same"), F.count_if(many & ~c("same")).alias("different"), F.count_if(both).alias("both_sides"), F.count_if(both & (c("a") != c("b"))).alias("sides_differ"))
