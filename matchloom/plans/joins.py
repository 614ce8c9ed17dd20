"""Lookups with fallback, self-joins and overlaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.core import js_round, relative_score
from matchloom.functions.fixed import LEAST_BASELINE, TIER_KEYS, chosen
from matchloom.operators.lookups import first_level, shrunk_levels
from matchloom.sources.facts import PM, player_match, rank_only, spread, table
from matchloom.sources.scratch import shared_folder

from .registry import query

R4 = "floor(({0}) * 10000 + 0.5) / 10000"


@query(f"""WITH {PM}, b AS (SELECT tier, character_num, weapon, count(*) n, avg(kills) m FROM pm GROUP BY 1, 2, 3)
SELECT pm.tier, character_num, weapon, count(*) games, count(b.m) FILTER (b.n >= 30) found, {R4.format("avg(kills - b.m) FILTER (b.n >= 30)")} diff FROM pm LEFT JOIN b USING (tier, character_num, weapon) WHERE game_mode = 'rank' GROUP BY 1, 2, 3""")
def baseline_lookup(spark, sf_dir):
    """Exact lookup by tier, character and weapon; cells under 30 samples are treated as absent."""
    pm = player_match(spark, sf_dir)
    b = pm.groupBy("tier", "character_num", "weapon").agg(F.count(F.lit(1)).alias("n"), F.avg("kills").alias("m")).where("n >= 30").drop("n")
    j = rank_only(pm).join(b, ["tier", "character_num", "weapon"], "left")
    return j.groupBy("tier", "character_num", "weapon").agg(F.count(F.lit(1)).alias("games"), F.count("m").alias("found"), js_round(F.avg(F.col("kills") - F.col("m")), 4).alias("diff"))


LEVELS = [["tier", "character_num", "weapon"], ["tier", "character_num"], ["tier", "role"], []]
LEVEL_SQL = """l0 AS (SELECT tier, character_num, weapon, avg(kills) m0, count(kills) n0 FROM pm GROUP BY 1, 2, 3), l1 AS (SELECT tier, character_num, avg(kills) m1, count(kills) n1 FROM pm GROUP BY 1, 2),
l2 AS (SELECT tier, role, avg(kills) m2, count(kills) n2 FROM pm GROUP BY 1, 2), l3 AS (SELECT avg(kills) m3, count(kills) n3 FROM pm)"""


@query(f"""WITH {PM}, s AS (SELECT * FROM pm WHERE game_mode = 'rank' AND victory), l0 AS (SELECT tier, character_num, weapon, avg(kills) m0 FROM s GROUP BY 1, 2, 3 HAVING count(kills) >= 30), l1 AS (SELECT tier, character_num, avg(kills) m1 FROM s GROUP BY 1, 2),
l2 AS (SELECT tier, role, avg(kills) m2 FROM s GROUP BY 1, 2), l3 AS (SELECT tier, avg(kills) m3 FROM s GROUP BY 1),
x AS (SELECT pm.*, coalesce(m0, m1, m2, m3) e, CASE WHEN m0 IS NOT NULL THEN 0 WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 WHEN m3 IS NOT NULL THEN 3 END lvl
FROM pm LEFT JOIN l0 ON l0.tier = pm.tier AND l0.character_num = pm.character_num AND l0.weapon = pm.weapon AND pm.weapon > 0 LEFT JOIN l1 ON l1.tier = pm.tier AND l1.character_num = pm.character_num LEFT JOIN l2 ON l2.tier = pm.tier AND l2.role = pm.role LEFT JOIN l3 ON l3.tier = pm.tier)
SELECT tier, lvl AS level, count(*) n, {R4.format("avg(kills - e)")} mean_diff FROM x GROUP BY 1, 2""")
def hierarchical_baseline(spark, sf_dir):
    """Every match against the won rank matches: exact with 30 samples and a known weapon, else the first of tier-character, tier-role and tier that exists."""
    pm = player_match(spark, sf_dir)
    x = first_level(pm, rank_only(pm).where("victory"), [["tier", "character_num", "weapon"], ["tier", "character_num"], ["tier", "role"], ["tier"]], [F.avg("kills").alias("expected")], (LEAST_BASELINE,), F.col("weapon") > 0)
    return x.groupBy("tier", "level").agg(F.count(F.lit(1)).alias("n"), js_round(F.avg(F.col("kills") - F.col("expected")), 4).alias("mean_diff"))


@query(f"""WITH {PM}, {LEVEL_SQL}, x AS (SELECT pm.tier, pm.character_num, n2 / (n2 + 30.0) * m2 + 30 / (n2 + 30.0) * m3 e2, n1, m1, n0, m0 FROM pm JOIN l0 USING (tier, character_num, weapon) JOIN l1 USING (tier, character_num) JOIN l2 USING (tier, role), l3),
y AS (SELECT *, n1 / (n1 + 30.0) * m1 + 30 / (n1 + 30.0) * e2 e1 FROM x) SELECT tier, character_num, {R4.format("avg(n0 / (n0 + 30.0) * m0 + 30 / (n0 + 30.0) * e1)")} expected FROM y GROUP BY 1, 2""")
def shrunk_baseline(spark, sf_dir):
    """Each level shrunk to the coarser one by n / (n + 30). The matches are counted once, by the keys of all levels, and written; all else works on these cells."""
    keys = list(dict.fromkeys(k for level in LEVELS for k in level))
    cells = player_match(spark, sf_dir).groupBy(*keys).agg(F.sum("kills").alias("kills"), F.count("kills").alias("with_kills"), F.count(F.lit(1)).alias("matches"))
    path = f"{shared_folder(spark)}/cells"
    cells.write.parquet(path)
    cells = spark.read.schema(cells.schema).parquet(path)
    x = shrunk_levels(cells, cells, LEVELS, "kills", 30, "with_kills")
    known = F.when(F.col("expected").isNotNull(), F.col("matches"))
    return x.groupBy("tier", "character_num").agg(js_round(F.sum(F.col("expected") * known) / F.sum(known), 4).alias("expected"))


TIER_NO = "CASE tier WHEN 'iron' THEN 0 WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2 WHEN 'gold' THEN 3 WHEN 'platinum' THEN 4 WHEN 'diamond_plus' THEN 5 WHEN 'meteorite_plus' THEN 6 ELSE 7 END"


@query(f"""WITH {PM}, t AS (SELECT {TIER_NO} t, character_num, kills FROM pm), b AS (SELECT t, character_num, count(*) n, avg(kills) m FROM t GROUP BY 1, 2), q AS (SELECT DISTINCT t, character_num FROM t),
r AS (SELECT q.t, q.character_num, b.t bt, b.n, b.m, row_number() OVER (PARTITION BY q.t, q.character_num ORDER BY abs(b.t - q.t), b.t) r FROM q JOIN b ON b.character_num = q.character_num AND b.n >= 30)
SELECT t AS tier_no, character_num, bt AS used_tier, n, {R4.format("m")} mean FROM r WHERE r = 1""")
def nearest_tier_baseline(spark, sf_dir):
    """The nearest tier with 30 samples, the lower one at equal distance."""
    order = chosen(F.col("tier"), {k: i for i, k in enumerate(TIER_KEYS)})
    t = player_match(spark, sf_dir).select(order.alias("tier_no"), "character_num", "kills")
    b = t.groupBy("tier_no", "character_num").agg(F.count(F.lit(1)).alias("n"), F.avg("kills").alias("m"))
    j = b.select("tier_no", "character_num").join(b.where(F.col("n") >= LEAST_BASELINE).withColumnRenamed("tier_no", "used_tier"), "character_num")
    w = Window.partitionBy("tier_no", "character_num").orderBy(F.abs(F.col("used_tier") - F.col("tier_no")), "used_tier")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("tier_no", "character_num", "used_tier", "n", js_round(F.col("m"), 4).alias("mean"))


@query(f"""WITH {PM}, t AS (SELECT game_id, team_number, sum(kills) k, count(*) n FROM pm GROUP BY 1, 2)
SELECT pm.game_id, pm.team_number, slot, part_id, source_id, kills, n - 1 mates, {R4.format("CASE WHEN n > 1 THEN (k - kills) / (n - 1.0) END")} mates_mean, {R4.format("CASE WHEN n > 1 THEN kills - (k - kills) / (n - 1.0) END")} carry FROM pm JOIN t USING (game_id, team_number) WHERE game_mode = 'rank'""")
def team_relative(spark, sf_dir):
    """A player against the mean of the teammates: a window over the team, not a self-join."""
    w = Window.partitionBy("game_id", "team_number")
    mates = F.count(F.lit(1)).over(w) - 1
    mean = F.when(mates > 0, (F.sum("kills").over(w) - F.col("kills")) / mates)
    x = player_match(spark, sf_dir).withColumns({"mates": mates, "mean": mean})
    return rank_only(x).select("game_id", "team_number", "slot", "part_id", "source_id", "kills", "mates", js_round(F.col("mean"), 4).alias("mates_mean"), js_round(F.col("kills") - F.col("mean"), 4).alias("carry"))


@query(f"""WITH {PM}, u AS (SELECT uid, character_num, tier, sum(kills) k, count(*) n FROM pm GROUP BY 1, 2, 3), c AS (SELECT character_num, tier, sum(k) k, sum(n) n, count(*) users FROM u GROUP BY 1, 2)
SELECT uid, character_num, tier, users - 1 others, {R4.format("CASE WHEN c.n > u.n THEN (c.k - u.k) / CAST(c.n - u.n AS DOUBLE) END")} others_mean FROM u JOIN c USING (character_num, tier)""")
def leave_one_out_cohort(spark, sf_dir):
    """The cohort without the player, by subtraction from the cohort's sums."""
    u = player_match(spark, sf_dir).groupBy("uid", "character_num", "tier").agg(F.sum("kills").alias("k"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("character_num", "tier")
    k, n = F.sum("k").over(w) - F.col("k"), F.sum("n").over(w) - F.col("n")
    return u.select("uid", "character_num", "tier", (F.count(F.lit(1)).over(w) - 1).alias("others"), js_round(F.when(n > 0, k / n), 4).alias("others_mean"))


@query(f"""WITH {PM}, a AS (SELECT character_num, count(*) games, sum(kills) kills FROM pm WHERE season < 1998 AND character_num < 40 GROUP BY 1), b AS (SELECT character_num, count(*) games, max(damage) top FROM pm WHERE season >= 1998 AND character_num > 10 GROUP BY 1)
SELECT character_num, greatest(coalesce(a.games, 0), coalesce(b.games, 0)) games, CAST(a.kills AS BIGINT) kills, b.top, CASE WHEN a.games IS NULL THEN 'match' WHEN b.games IS NULL THEN 'official' ELSE 'both' END origin FROM a FULL JOIN b USING (character_num)""")
def merge_character_sources(spark, sf_dir):
    pm = player_match(spark, sf_dir)
    a = pm.where("season < 1998 and character_num < 40").groupBy("character_num").agg(F.count(F.lit(1)).alias("ga"), F.sum("kills").alias("kills"))
    b = pm.where("season >= 1998 and character_num > 10").groupBy("character_num").agg(F.count(F.lit(1)).alias("gb"), F.max("damage").alias("top"))
    origin = F.when(F.col("ga").isNull(), "match").when(F.col("gb").isNull(), "official").otherwise("both")
    zero = F.lit(0).cast("long")
    return a.join(b, "character_num", "full_outer").select("character_num", F.greatest(F.coalesce("ga", zero), F.coalesce("gb", zero)).alias("games"), "kills", "top", origin.alias("origin"))


@query(f"""WITH {PM}, g AS (SELECT DISTINCT source_id, game_id FROM pm)
SELECT a.source_id a, b.source_id b, count(*) shared FROM g a JOIN g b ON a.game_id = b.game_id AND a.source_id < b.source_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_games(spark, sf_dir):
    """Players that share two games or more: a join on the game, whose size is bounded by its participants."""
    g = player_match(spark, sf_dir).select("source_id", "game_id").distinct()
    a, b = g.withColumnRenamed("source_id", "a"), g.withColumnRenamed("source_id", "b")
    pairs = spread(a.join(b, "game_id").where("a < b").select("a", "b"), sf_dir, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@query(f"""WITH {PM}, e AS (SELECT DISTINCT game_id FROM pm WHERE source_id = 7) SELECT source_id, count(DISTINCT game_id) overlap FROM pm JOIN e USING (game_id) WHERE source_id <> 7 GROUP BY 1 HAVING count(DISTINCT game_id) >= 2""")
def overlap_candidates(spark, sf_dir):
    pm = player_match(spark, sf_dir)
    e = pm.where("source_id = 7").select("game_id").distinct()
    return pm.where("source_id <> 7").join(e, "game_id", "left_semi").groupBy("source_id").agg(F.countDistinct("game_id").alias("overlap")).where("overlap >= 2")


@query(f"""WITH {PM} SELECT DISTINCT uid FROM pm WHERE uid NOT IN (SELECT uid FROM pm WHERE game_mode = 'rank' AND season >= 1999)""")
def seeds_without_detail(spark, sf_dir):
    """Players without a rank match since 1999, as seeds of a queue."""
    pm = player_match(spark, sf_dir)
    return pm.select("uid").distinct().join(rank_only(pm).where("season >= 1999").select("uid"), "uid", "left_anti")


@query(f"""WITH {PM}, e AS (SELECT role, placement, avg(kills) m, count(*) n FROM pm GROUP BY 1, 2), r AS (SELECT role, avg(kills) m, count(*) n FROM pm GROUP BY 1)
SELECT r.role, placement, e.n, {R4.format("e.m - r.m")} effect FROM e JOIN r USING (role)""")
def placement_effects(spark, sf_dir):
    pm = player_match(spark, sf_dir)
    e = pm.groupBy("role", "placement").agg(F.avg("kills").alias("m"), F.count(F.lit(1)).alias("n"))
    r = pm.groupBy("role").agg(F.avg("kills").alias("base"))
    return e.join(r, "role").select("role", "placement", "n", js_round(F.col("m") - F.col("base"), 4).alias("effect"))


@query(f"""WITH {PM}, u AS (SELECT uid, character_num, avg(kills) k FROM pm GROUP BY 1, 2), c AS (SELECT character_num, avg(kills) m FROM pm GROUP BY 1)
SELECT uid, character_num, {R4.format("least(greatest(65 + 45 * ((k - m) / greatest(abs(m), 1e-6)), 20), 100)")} score FROM u JOIN c USING (character_num)""")
def relative_scores(spark, sf_dir):
    pm = player_match(spark, sf_dir)
    u = pm.groupBy("uid", "character_num").agg(F.avg("kills").alias("k"))
    c = pm.groupBy("character_num").agg(F.avg("kills").alias("m"))
    return u.join(c, "character_num").select("uid", "character_num", relative_score(F.col("k"), F.col("m")).alias("score"))
