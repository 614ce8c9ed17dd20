"""Percentiles, ranks, grades and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.core import js_round, steps
from matchloom.functions.fixed import COMBO_FACTOR, COMBO_ROLES, COMBO_WEIGHTS, FINE_GRADES, LOWEST, PERCENTILE_GRADES, PERCENTILE_POINTS, ROLES
from matchloom.operators.counted import counted, index_midrank, midrank, nearest_quantile, numbered, quantile, ranked, with_ranks
from matchloom.operators.statistics import isotonic, pearson
from matchloom.operators.survivorship import first_by, first_n_by
from matchloom.sources.facts import PM, player_match, rank_only
from matchloom.sources.scratch import shared_folder

from .registry import query

R4 = "floor(({0}) * 10000 + 0.5) / 10000"
USERS = "u AS (SELECT uid, tier, round(avg(kills), 6) k, count(*) n FROM pm GROUP BY 1, 2)"


def _users(spark, sf_dir):
    return player_match(spark, sf_dir).groupBy("uid", "tier").agg(F.round(F.avg("kills"), 6).alias("k"), F.count(F.lit(1)).alias("n"))


def _ranked_users(spark, sf_dir):
    """The means of a tier's players, counted."""
    return ranked(counted(_users(spark, sf_dir), ["tier"], "k"), ["tier"], "k")


@query(f"""WITH {PM}, {USERS} SELECT a.uid, a.tier, {R4.format("100 * (count(*) FILTER (b.k < a.k) + count(*) FILTER (b.k = a.k) / 2.0) / count(*)")} percentile FROM u a JOIN u b ON a.tier = b.tier GROUP BY 1, 2, a.k""")
def midrank_percentiles(spark, sf_dir):
    return with_ranks(_users(spark, sf_dir).select("uid", "tier", "k"), ["tier"], "k").select("uid", "tier", js_round(midrank(F.col("before"), F.col("n"), F.col("total")), 4).alias("percentile"))


@query(f"""WITH {PM}, {USERS} SELECT a.uid, a.tier, {R4.format("CASE WHEN count(*) = 1 THEN 0.5 ELSE (count(*) FILTER (b.k < a.k) + (count(*) FILTER (b.k = a.k) - 1) / 2.0) / (count(*) - 1) END")} pos FROM u a JOIN u b ON a.tier = b.tier GROUP BY 1, 2, a.k""")
def index_midranks(spark, sf_dir):
    """The other definition: over n - 1, with 0.5 for a single value."""
    return with_ranks(_users(spark, sf_dir).select("uid", "tier", "k"), ["tier"], "k").select("uid", "tier", js_round(index_midrank(F.col("before"), F.col("n"), F.col("total")), 4).alias("pos"))


SQL_POINTS = "0.01 0.05 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8 0.9 0.95 0.99".split()


@query(f"WITH {PM}, {USERS} " + " UNION ALL ".join(f"SELECT tier, CAST({p} AS DOUBLE) p, {R4.format(f'quantile_cont(k, {p})')} v FROM u GROUP BY 1" for p in SQL_POINTS))
def percentile_table(spark, sf_dir):
    """A thirteen-point quantile table per cohort: one aggregate with an array of points."""
    q = _ranked_users(spark, sf_dir).groupBy("tier").agg(F.array(*(quantile("k", p) for p in PERCENTILE_POINTS)).alias("q"))
    pairs = q.select("tier", F.explode(F.arrays_zip(F.array(*map(F.lit, PERCENTILE_POINTS)).alias("p"), F.col("q").alias("q"))).alias("x"))
    return pairs.select("tier", F.col("x")["p"].alias("p"), js_round(F.col("x")["q"], 4).alias("v"))


@query(f"""WITH {PM}, {USERS} SELECT tier, {R4.format("quantile_disc(k, 0.9)")} p90, {R4.format("quantile_disc(k, 0.1)")} p10, max(k) top FROM u GROUP BY 1""")
def nearest_rank_boundaries(spark, sf_dir):
    q = lambda p: js_round(nearest_quantile("k", p), 4)
    return _ranked_users(spark, sf_dir).groupBy("tier").agg(q(0.9).alias("p90"), q(0.1).alias("p10"), F.max("k").alias("top"))


@query(f"""WITH {PM}, r AS (SELECT uid, season, rp_after, row_number() OVER (PARTITION BY uid, season ORDER BY rp_after) - 1 i, count(*) OVER (PARTITION BY uid, season) n FROM pm WHERE rp_after > 0) SELECT uid, season, rp_after upper_median FROM r WHERE i = n // 2""")
def upper_median_rp(spark, sf_dir):
    """The upper median: element floor(n / 2) of the sorted values."""
    pm = player_match(spark, sf_dir).where("rp_after > 0")
    w = Window.partitionBy("uid", "season")
    r = pm.select("uid", "season", "rp_after", (F.row_number().over(w.orderBy("rp_after")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where("i = n div 2").select("uid", "season", F.col("rp_after").alias("upper_median"))


@query(f"""WITH {PM}, {USERS}, c AS (SELECT uid, tier, cume_dist() OVER (PARTITION BY tier ORDER BY k) d FROM u) SELECT uid, tier, {R4.format("20 + 80 * d")} score FROM c""")
def cume_dist_scores(spark, sf_dir):
    r = with_ranks(_users(spark, sf_dir).select("uid", "tier", "k"), ["tier"], "k")
    return r.select("uid", "tier", js_round(F.lit(20) + F.lit(80) * ((F.col("before") + F.col("n")) / F.col("total")), 4).alias("score"))


@query(f"""WITH {PM}, {USERS}, m AS (SELECT tier, min(k) a, max(k) b FROM u WHERE n >= 3 GROUP BY 1) SELECT uid, tier, {R4.format("CASE WHEN b > a THEN 100 * (k - a) / (b - a) ELSE 50 END")} score FROM u JOIN m USING (tier) WHERE n >= 3""")
def minmax_scores(spark, sf_dir):
    u = _users(spark, sf_dir).where("n >= 3")
    a, b = F.col("a"), F.col("b")
    return u.join(u.groupBy("tier").agg(F.min("k").alias("a"), F.max("k").alias("b")), "tier").select("uid", "tier", js_round(F.when(b > a, F.lit(100) * (F.col("k") - a) / (b - a)).otherwise(F.lit(50.0)), 4).alias("score"))


@query(f"""WITH {PM}, {USERS}, p AS (SELECT tier, 100 * percent_rank() OVER (PARTITION BY tier ORDER BY k) p FROM u) SELECT tier, CASE WHEN p >= 90 THEN 'S' WHEN p >= 75 THEN 'A' WHEN p >= 50 THEN 'B' WHEN p >= 25 THEN 'C' ELSE 'D' END grade, count(*) n FROM p GROUP BY 1, 2""")
def percentile_grades(spark, sf_dir):
    p = F.lit(100) * F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0)
    return _ranked_users(spark, sf_dir).select("tier", steps(p, PERCENTILE_GRADES, "D").alias("grade"), "n").groupBy("tier", "grade").agg(F.sum("n").alias("n"))


FINE_SQL = (
    "CASE WHEN s >= 95 THEN 'S+' WHEN s >= 88 THEN 'S' WHEN s >= 84 THEN 'S-' WHEN s >= 80 THEN 'A+' WHEN s >= 76 THEN 'A' WHEN s >= 72 THEN 'A-' WHEN s >= 68 THEN 'B+' WHEN s >= 62 THEN 'B' "
    "WHEN s >= 56 THEN 'B-' WHEN s >= 50 THEN 'C+' WHEN s >= 44 THEN 'C' WHEN s >= 38 THEN 'C-' WHEN s >= 32 THEN 'D+' WHEN s >= 24 THEN 'D' ELSE 'D-' END"
)


@query(f"""WITH {PM}, x AS (SELECT {R4.format("least(greatest(40 + 8 * avg(kills) - 2 * avg(deaths), 0), 100)")} s FROM pm GROUP BY uid) SELECT {FINE_SQL} grade, count(*) n FROM x GROUP BY 1""")
def fine_grades(spark, sf_dir):
    s = js_round(F.least(F.greatest(F.lit(40) + F.lit(8) * F.avg("kills") - F.lit(2) * F.avg("deaths"), F.lit(0.0)), F.lit(100.0)), 4)
    x = player_match(spark, sf_dir).groupBy("uid").agg(s.alias("s"))
    return x.select(steps(F.col("s"), FINE_GRADES, LOWEST).alias("grade")).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PM}, q AS (SELECT tier, median(kills) m FROM pm GROUP BY 1), d AS (SELECT tier, m, median(abs(kills - m)) mad FROM pm JOIN q USING (tier) GROUP BY 1, 2), u AS (SELECT uid, tier, avg(kills) k FROM pm GROUP BY 1, 2)
SELECT uid, tier, {R4.format("least(greatest((k - m) / greatest(mad * 1.4826, 0.5), -3), 3)")} z FROM u JOIN d USING (tier)""")
def robust_z(spark, sf_dir):
    """(x - median) / scaled MAD, within three."""
    pm = player_match(spark, sf_dir)
    c = ranked(counted(pm, ["tier"], "kills"), ["tier"], "kills")
    off = c.join(c.groupBy("tier").agg(quantile("kills", 0.5).alias("m")), "tier").groupBy("tier", "m", F.abs(F.col("kills") - F.col("m")).alias("off")).agg(F.sum("n").alias("n"))
    d = ranked(off, ["tier", "m"], "off").groupBy("tier", "m").agg(quantile("off", 0.5).alias("mad"))
    u = pm.groupBy("uid", "tier").agg(F.avg("kills").alias("k")).join(d, "tier")
    z = (F.col("k") - F.col("m")) / F.greatest(F.col("mad") * F.lit(1.4826), F.lit(0.5))
    return u.select("uid", "tier", js_round(F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0)), 4).alias("z"))


@query(f"""WITH {PM} SELECT character_num, {R4.format("CASE WHEN count(*) >= 2 AND stddev_pop(kills) * stddev_pop(placement) > 0 THEN covar_pop(kills, placement) / (stddev_pop(kills) * stddev_pop(placement)) END")} r FROM pm GROUP BY 1""")
def pearson_by_character(spark, sf_dir):
    x = player_match(spark, sf_dir).select("character_num", F.col("kills").cast("double").alias("x"), F.col("placement").cast("double").alias("y"))
    return x.groupBy("character_num").agg(js_round(pearson("x", "y"), 4).alias("r"))


@query(f"""WITH {PM}, r AS (SELECT role, CAST(row_number() OVER (PARTITION BY role ORDER BY kills, game_id, slot, part_id, source_id, updated_at) AS DOUBLE) x, CAST(row_number() OVER (PARTITION BY role ORDER BY placement, game_id, slot, part_id, source_id, updated_at) AS DOUBLE) y FROM pm)
SELECT role, {R4.format("covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))")} rho FROM r GROUP BY 1""")
def spearman_ordinal(spark, sf_dir):
    """Rank correlation with ties in a fixed order, not averaged."""
    ids, folder = ["game_id", "slot", "part_id", "source_id", "updated_at"], shared_folder(spark)
    x = numbered(player_match(spark, sf_dir).select("role", "kills", "placement", *ids), ["role"], ["kills", *ids], folder, "x").drop("kills", "total")
    xy = numbered(x, ["role"], ["placement", *ids], folder, "y").select("role", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return xy.groupBy("role").agg(js_round(pearson("x", "y"), 4).alias("rho"))


@query(f"""WITH {PM}, c AS (SELECT uid, character_num, count(*) n, avg(placement) p FROM pm GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p, character_num) r FROM c) SELECT uid, character_num, n, {R4.format("p")} place FROM r WHERE r = 1""")
def best_character(spark, sf_dir):
    """The lowest mean placement among characters with two games or more."""
    c = player_match(spark, sf_dir).groupBy("uid", "character_num").agg(F.count(F.lit(1)).alias("n"), F.avg("placement").alias("p")).where("n >= 2")
    return first_by(c, ["uid"], F.col("p"), F.col("character_num")).select("uid", "character_num", "n", js_round(F.col("p"), 4).alias("place"))


@query(f"""WITH {PM}, c AS (SELECT uid, role, sum(kills) s, count(*) n FROM pm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s DESC, n DESC, role) r FROM c) SELECT uid, string_agg(role, '>' ORDER BY r) roles FROM r WHERE r <= 2 GROUP BY 1""")
def top_two_roles(spark, sf_dir):
    c = player_match(spark, sf_dir).groupBy("uid", "role").agg(F.sum("kills").alias("s"), F.count(F.lit(1)).alias("n"))
    top = first_n_by(c, ["uid"], 2, F.desc("s"), F.desc("n"), F.col("role"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), (-F.col("n")).alias("n"), "role")))
    return top.groupBy("uid").agg(F.array_join(F.transform(ordered, lambda x: x["role"].cast("string")), ">").alias("roles"))


@query(f"""WITH {PM}, c AS (SELECT character_num, weapon, count(*) n FROM pm GROUP BY 1, 2) SELECT character_num, weapon, n, CASE WHEN n < 30 THEN 1000.0 WHEN n < 100 THEN 200.0 WHEN n < 300 THEN 50.0 ELSE 1.0 END * CASE WHEN (character_num + weapon) % 7 >= 5 THEN 1.5 ELSE 1 END w FROM c ORDER BY w DESC, n, character_num, weapon LIMIT 40""")
def rarest_combos(spark, sf_dir):
    """The forty combinations with most need of samples; tanks and supporters count more."""
    c = player_match(spark, sf_dir).groupBy("character_num", "weapon").agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("n") < COMBO_WEIGHTS[0][0], COMBO_WEIGHTS[0][1])
    for bound, w in COMBO_WEIGHTS[1:]:
        weight = weight.when(F.col("n") < bound, w)
    role = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("character_num") + F.col("weapon")) % 7 + 1).cast("int"))
    w = weight.otherwise(1.0) * F.when(role.isin(*COMBO_ROLES), COMBO_FACTOR).otherwise(1.0)
    return c.withColumn("w", w).orderBy(F.desc("w"), "n", "character_num", "weapon").limit(40)


@query(None)
def isotonic_curves(spark, sf_dir):
    """Kills by five-minute bucket made monotone per role; the groups are curves of a few points, not rows."""
    pm = rank_only(player_match(spark, sf_dir))
    points = pm.groupBy("role", F.floor(F.col("duration") / 300).alias("bucket")).agg(F.avg("kills").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    return isotonic(points, ["role"], "bucket", "mean", "n").select("role", "bucket", js_round(F.col("fitted"), 6).alias("fitted"))
