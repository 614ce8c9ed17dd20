"""Higher tiers as anchors of a metric's score, and grades by percentile of residual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.core import bound, clamp, js_round, last_not_above, steps
from matchloom.functions.fixed import (
    ELITE_GAP, ELITE_TIER, ELITE_TIERS, FINE_GRADES, LEAST_BASELINE, LOWEST, P4_POINTS, RELATIVE_GAINS, TIER_KEYS, chosen,
)
from matchloom.operators.counted import counted, ranked
from matchloom.operators.lookups import shrunk_levels
from matchloom.sources.facts import PM, player_match
from matchloom.sources.scratch import shared_folder

from .registry import query
from .scores import CHAIN, GRADE, KEY, KEYS, match_grade_rows

R2, R4, R6 = ("floor(({0}) * %s + 0.5) / %s" % (d, d) for d in (100, 10000, 1000000))
CELL = ["tier", "character_num", "weapon"]
#: Metrics and whether more is better.
ELITE_METRICS = {"kills": True, "assists": True, "damage": True, "deaths": False}


def tier_no(tier: Column) -> Column:
    return chosen(tier, {k: i for i, k in enumerate(TIER_KEYS)})


def cells(pm: DataFrame, least: int = LEAST_BASELINE) -> DataFrame:
    """Means of each tier, character and weapon with enough samples."""
    means = (F.avg(F.col(m).cast("decimal(14,2)").cast("double")).alias(m) for m in ELITE_METRICS)
    return pm.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *means).where(F.col("n") >= least)


def candidates(found: DataFrame) -> DataFrame:
    """tier, character, weapon and higher: the cells of all higher tiers in the fixed order, as one short array.

    Each cell is handed down to the tiers below it, so the lookup is an equal join on cells, never a comparison on facts."""
    order = chosen(F.col("tier"), {k: i for i, k in enumerate(ELITE_TIERS)})
    cell = F.struct(order.alias("place"), "tier", "n", *ELITE_METRICS)
    below = F.filter(F.array(*map(F.lit, TIER_KEYS)), lambda t: tier_no(t) < tier_no(F.col("tier")))
    handed = found.select("character_num", "weapon", cell.alias("cell"), F.explode(below).alias("below"))
    return handed.groupBy(F.col("below").alias("tier"), "character_num", "weapon").agg(F.sort_array(F.collect_list("cell")).alias("higher"))


def anchored(value: Column, own: Column, higher: Column, metric: str, more_is_better: bool) -> Column:
    """struct(score, mode): below the tier's own value by relative loss, above it by progress to the first higher cell that is far enough away, else to a fixed gain."""
    target, eps = RELATIVE_GAINS[metric], F.lit(1e-6)
    size = F.greatest(F.abs(own), eps)
    sign = F.lit(1.0 if more_is_better else -1.0)
    gain = sign * (value - own) / size
    far = lambda c: (sign * (c[metric] - own) > eps) & (sign * (c[metric] - own) / size >= F.lit(target * ELITE_GAP))
    first = F.get(F.filter(higher, far), F.lit(0))
    reach = F.coalesce(sign * (first[metric] - own) / size, F.lit(target))
    score = F.when(gain <= 0, clamp(F.lit(65.0) + F.lit(45.0) * gain, 20, 65)).otherwise(clamp(F.lit(65.0) + F.lit(23.0) * gain / reach, 65, 100))
    mode = F.when(score.isNull(), "missing").when((gain <= 0) | first.isNull(), "tier-only").when(first["tier"] == ELITE_TIER, "elite").otherwise("alternate-elite")
    return F.struct(js_round(score, 4).alias("score"), mode.alias("mode"))


_MEANS = ", ".join(f"avg(CAST(CAST({m} AS DECIMAL(14, 2)) AS DOUBLE)) {m}" for m in ELITE_METRICS)
_NO = "list_position(['iron', 'bronze', 'silver', 'gold', 'platinum', 'diamond_plus', 'meteorite_plus', 'mithril_plus'], {0})"
ELITE_SQL = f"""{PM}, b AS (SELECT tier, character_num, weapon, count(*) n, {_MEANS} FROM pm WHERE tier <> 'unranked' GROUP BY 1, 2, 3 HAVING count(*) >= 30),
l AS (SELECT a.tier, a.character_num, a.weapon, b.tier higher, b.n, b.kills, b.assists, b.damage, b.deaths, {_NO.format("b.tier")} AS up FROM (SELECT DISTINCT t.tier, character_num, weapon FROM b, (SELECT unnest({list(TIER_KEYS)}) AS tier) t) a JOIN b USING (character_num, weapon) WHERE {_NO.format("b.tier")} > {_NO.format("a.tier")})"""


@query(f"WITH {ELITE_SQL} SELECT tier, character_num, weapon, row_number() OVER (PARTITION BY tier, character_num, weapon ORDER BY up DESC) place, higher candidate, n, {R4.format('kills')} kills FROM l")
def elite_candidates(spark, sf_dir):
    """For every tier, character and weapon the cells of higher tiers with enough samples, best tier first."""
    c = candidates(cells(player_match(spark, sf_dir).where("tier <> 'unranked'")))
    x = c.select(*CELL, F.posexplode("higher").alias("i", "c"))
    return x.select(*CELL, (F.col("i") + 1).cast("long").alias("place"), F.col("c.tier").alias("candidate"), F.col("c.n").alias("n"), js_round(F.col("c.kills"), 4).alias("kills"))


def _anchored_sql(m: str, more: bool) -> str:
    s, t = "" if more else "-", RELATIVE_GAINS[m]
    gain, gap = f"{s}(u.{m} - o.{m}) / greatest(abs(o.{m}), 1e-6)", f"{s}(l.{m} - o.{m})"
    return f"""SELECT u.uid, u.tier, u.character_num, u.weapon, '{m}' metric, {gain} gain, arg_max({gap} / greatest(abs(o.{m}), 1e-6), l.up) FILTER ({gap} > 1e-6 AND {gap} / greatest(abs(o.{m}), 1e-6) >= {t} * 0.2) reach, {t} target
 FROM u LEFT JOIN b o USING (tier, character_num, weapon) LEFT JOIN l USING (tier, character_num, weapon) GROUP BY u.uid, u.tier, u.character_num, u.weapon, u.{m}, o.{m}"""


@query(
    f"WITH {ELITE_SQL}, u AS (SELECT uid, tier, character_num, weapon, {_MEANS} FROM pm WHERE tier <> 'unranked' GROUP BY 1, 2, 3, 4), x AS ("
    + " UNION ALL ".join(_anchored_sql(m, more) for m, more in ELITE_METRICS.items())
    + f") SELECT uid, tier, character_num, weapon, metric, {R4.format('CASE WHEN gain <= 0 THEN least(greatest(65 + 45 * gain, 20), 65) WHEN gain > 0 THEN least(greatest(65 + 23 * gain / coalesce(reach, target), 65), 100) END')} score, CASE WHEN gain IS NULL THEN 'missing' WHEN gain <= 0 OR reach IS NULL THEN 'tier-only' ELSE 'alternate-elite' END mode FROM x"
)
def elite_metric_scores(spark, sf_dir):
    """A player's means against the own tier's cell, with the first higher tier that is far enough ahead as the upper anchor."""
    pm = player_match(spark, sf_dir).where("tier <> 'unranked'")
    b = cells(pm)
    means = (F.avg(F.col(m).cast("decimal(14,2)").cast("double")).alias(f"u_{m}") for m in ELITE_METRICS)
    u = pm.groupBy("uid", *CELL).agg(*means).join(b, CELL, "left").join(candidates(b), CELL, "left")
    one = lambda m, more: F.struct(F.lit(m).alias("metric"), anchored(F.col(f"u_{m}"), F.col(m), F.col("higher"), m, more).alias("a"))
    x = u.select("uid", *CELL, F.explode(F.array(*(one(m, more) for m, more in ELITE_METRICS.items()))).alias("x"))
    return x.select("uid", *CELL, "x.metric", "x.a.score", "x.a.mode")


POINTS = 200
RESIDUAL_LEVELS, RESIDUAL_K = [["tier", "character_num", "weapon"], ["tier", "character_num"], ["tier", "role"], []], 30.0


def quantile_table(df: DataFrame, value: str, points: int = POINTS) -> DataFrame:
    """One row with the sorted array of points + 1 values, at equal steps of rank; of counted values."""
    c = ranked(counted(df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)), ["_all"], value), ["_all"], value)
    most = F.col("total") - 1
    upto = lambda rank: F.when(most > 0, F.floor((rank * points + most - 1) / most)).otherwise(F.when(rank > 0, points + 1).otherwise(0))
    low, high = upto(F.col("before")), F.least(upto(F.col("before") + F.col("n")), F.lit(points + 1)) - 1
    rows = c.select(value, F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))).alias("i"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value))), lambda x: x[value]).alias(f"{value}_points"))


def percentile_in(x: Column, points: Column) -> Column:
    """Where x lies among sorted points, 0 to 1: the middle of equal ones; 0.5 among a single one."""
    n = F.size(points)
    lower = lambda upper: F.when(F.get(points, upper - 1) == x, F.array_position(points, x).cast("int") - 1).otherwise(upper)
    middle = lambda upper, low: F.when(upper > low, (low + upper - 1) / F.lit(2.0)).otherwise(low.cast("double"))
    # Each is searched for once: all that uses it is inside bound().
    place = bound(last_not_above(x, points), lambda upper: bound(lower(upper), lambda low: bound(middle(upper, low), lambda m: clamp(m / (n - 1), 0, 1))))
    return F.when(n == 1, F.lit(0.5)).otherwise(place)


def value_at(p: Column, points: Column) -> Column:
    """The interpolated value at a percentile of sorted points."""
    index = (F.size(points) - 1) * p
    low, high = (F.get(points, f(index).cast("int")) for f in (F.floor, F.ceil))
    weight = index - F.floor(index)
    return F.when(low == high, low).otherwise(low * (1 - weight) + high * weight)


def gated(score: Column, percentile: Column, place: Column, family: Column, s: Column, plus: Column) -> Column:
    """The fine grade of a score, with the best grades kept for residuals beyond the gates and, at the top, the first three places."""
    a = F.when((score >= 95) & ((percentile < plus) | (place > 3)), 94.99).otherwise(score)
    b = F.when((a >= 88) & (percentile < s), 87.99).otherwise(a)
    return bound(F.when((b >= 84) & (percentile < family), 83.99).otherwise(b), lambda held: steps(held, FINE_GRADES, LOWEST))


P4_SQL = f"""{CHAIN}, gm AS (SELECT *, {GRADE.format("match_score")} AS old_grade FROM mg),
s0 AS (SELECT tier, character_num, weapon, avg(role_score) m0, count(role_score) n0 FROM gm GROUP BY 1, 2, 3), s1 AS (SELECT tier, character_num, avg(role_score) m1, count(role_score) n1 FROM gm GROUP BY 1, 2), s2 AS (SELECT tier, role, avg(role_score) m2, count(role_score) n2 FROM gm GROUP BY 1, 2), s3 AS (SELECT avg(role_score) m3 FROM gm),
y2 AS (SELECT {", ".join("gm." + c for c in KEY)}, gm.tier, gm.character_num, gm.weapon, gm.role, gm.placement, gm.duration, gm.role_score, gm.match_score, gm.old_grade, m0, n0, m1, n1, CASE WHEN n2 > 0 THEN n2 / (n2 + 30.0) * m2 + (1 - n2 / (n2 + 30.0)) * m3 ELSE m3 END e2 FROM gm LEFT JOIN s0 USING (tier, character_num, weapon) LEFT JOIN s1 USING (tier, character_num) LEFT JOIN s2 USING (tier, role), s3),
y1 AS (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 30.0) * m1 + (1 - n1 / (n1 + 30.0)) * e2 ELSE e2 END e1 FROM y2), y0 AS (SELECT *, CASE WHEN n0 > 0 THEN n0 / (n0 + 30.0) * m0 + (1 - n0 / (n0 + 30.0)) * e1 ELSE e1 END expected FROM y1),
rs AS (SELECT *, CASE WHEN weapon > 0 AND placement BETWEEN 1 AND 8 AND duration > 0 THEN {R4.format("role_score - expected")} END residual FROM y0),
sp AS (SELECT list(residual ORDER BY residual) FILTER (residual IS NOT NULL) r, list(match_score ORDER BY match_score) FILTER (match_score IS NOT NULL) s, count(match_score) n, count(*) FILTER (old_grade IN ('S+', 'S', 'S-')) f, count(*) FILTER (old_grade IN ('S+', 'S')) ss, count(*) FILTER (old_grade = 'S+') p FROM rs),
qt AS (SELECT [r[i * (len(r) - 1) // {POINTS} + 1] for i in range({POINTS + 1})] rp, [s[i * (len(s) - 1) // {POINTS} + 1] for i in range({POINTS + 1})] sq, {R6.format("1 - f / n")} gf, {R6.format("1 - ss / n")} gs, {R6.format("1 - p / n")} gp FROM sp),
pc AS (SELECT rs.*, qt.*, len([x for x in rp if x < residual]) lo, len([x for x in rp if x <= residual]) hi FROM rs, qt),
pp2 AS (SELECT *, CASE WHEN residual IS NOT NULL THEN least(greatest(CASE WHEN hi > lo THEN (lo + hi - 1) / 2.0 ELSE lo END / {POINTS}.0, 0), 1) END pct FROM pc),
ix AS (SELECT *, {POINTS} * pct AS idx FROM pp2),
bs AS (SELECT *, {R2.format("CASE WHEN floor(idx) = ceil(idx) THEN sq[CAST(idx AS INTEGER) + 1] ELSE sq[CAST(floor(idx) AS INTEGER) + 1] * (1 - (idx - floor(idx))) + sq[CAST(ceil(idx) AS INTEGER) + 1] * (idx - floor(idx)) END")} base FROM ix),
fs AS (SELECT *, {R2.format("CASE WHEN base IS NOT NULL THEN least(greatest(base + CASE placement WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 0.5 WHEN 5 THEN -0.5 WHEN 6 THEN -2 WHEN 7 THEN -3 WHEN 8 THEN -4 END, 0), 100) END")} score FROM bs),
g1 AS (SELECT *, CASE WHEN score >= 95 AND (pct < gp OR placement > 3) THEN 94.99 ELSE score END a FROM fs), g2 AS (SELECT *, CASE WHEN a >= 88 AND pct < gs THEN 87.99 ELSE a END b FROM g1), g3 AS (SELECT *, CASE WHEN b >= 84 AND pct < gf THEN 83.99 ELSE b END c FROM g2)"""


def percentile_grades_of(rows: DataFrame, folder: str) -> DataFrame:
    """rows (a match each, with role_score and match_score) with residual, percentile, base_score, score and grade; null where a match cannot be graded."""
    expected = shrunk_levels(rows, rows, RESIDUAL_LEVELS, "role_score", RESIDUAL_K)
    fit = (F.col("weapon") > 0) & F.col("placement").between(1, 8) & (F.col("duration") > 0)
    scored = expected.withColumn("residual", F.when(fit, js_round(F.col("role_score") - F.col("expected"), 4)))
    path = f"{folder}/residuals"
    scored.write.parquet(path)
    scored = rows.sparkSession.read.schema(scored.schema).parquet(path)
    old = steps(F.col("match_score"), FINE_GRADES, LOWEST)
    share = lambda *g: js_round(F.lit(1.0) - F.count_if(old.isin(*g)) / F.count("match_score"), 6)
    gates = scored.agg(share("S+", "S", "S-").alias("family"), share("S+", "S").alias("s"), share("S+").alias("plus"))
    tables = [quantile_table(scored, "residual"), quantile_table(scored.select("match_score"), "match_score"), gates]
    x = reduce(lambda df, t: df.crossJoin(F.broadcast(t)), tables, scored)  # one row each
    x = x.withColumn("percentile", percentile_in(F.col("residual"), F.col("residual_points")))
    x = x.withColumn("base_score", js_round(value_at(F.col("percentile"), F.col("match_score_points")), 2))
    x = x.withColumn("score", js_round(clamp(F.col("base_score") + chosen(F.col("placement"), P4_POINTS), 0, 100), 2))
    return x.withColumn("grade", gated(F.col("score"), F.col("percentile"), F.col("placement"), F.col("family"), F.col("s"), F.col("plus")))


@query(f"WITH {P4_SQL} SELECT {KEYS}, residual, {R6.format('pct')} percentile, base base_score, score, {GRADE.format('c')} grade FROM g3")
def percentile_match_grades(spark, sf_dir):
    """Match grades by where a match's residual lies among all residuals, carried over to the scores given so far, with placement points and gates."""
    folder = shared_folder(spark)
    rows = match_grade_rows(spark, sf_dir).select(*KEY, "tier", "character_num", "weapon", "role", "placement", "duration", "role_score", "match_score")
    rows.write.parquet(f"{folder}/scored")
    x = percentile_grades_of(spark.read.schema(rows.schema).parquet(f"{folder}/scored"), folder)
    return x.select(*KEY, "residual", js_round(F.col("percentile"), 6).alias("percentile"), "base_score", "score", "grade")
