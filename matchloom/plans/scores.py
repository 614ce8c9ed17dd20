"""The score chain: role scores of matches, match grades, adjusted contributions, aggregate grades, cohort comparisons, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.core import clamp, duration_bucket, interpolate, js_round, participation_capped, relative_score, steps
from matchloom.functions.fixed import (
    ADJACENT_BANDS, BANDS, COHORT_USERS, CONFIDENCE, DAMAGE_CURVE, DURATION_MIDPOINTS, EXCELLENCE_POINTS, FINE_GRADES, GLOBAL_PRIOR, LEAST_BASELINE, LEAST_COHORT, LOWEST,
    METRICS, PLACEMENT_POINTS, ROLE_PRIORS, ROLE_WEIGHTS, ROLES, SAMPLE_STATUS, SHADOW_GRADES, chosen, ladder_tier,
)
from matchloom.operators.counted import midrank, with_ranks
from matchloom.operators.lookups import first_level
from matchloom.sources.facts import PM, player_match, rank_only
from matchloom.sources.scratch import small_methods, written

from .registry import query

R2, R4, R6 = (f"floor(({{0}}) * {10**d} + 0.5) / {10**d}" for d in (2, 4, 6))
KEY = ["game_id", "slot", "part_id", "source_id", "kills"]
#: What is kept of a match beside its scores.
KEPT = ["uid", *KEY, "tier", "character_num", "weapon", "role", "placement", "duration", "level", "baseline_n"]


def scored(spark, sf_dir: str, unknown: bool = True) -> DataFrame:
    """Rank matches with a named role, vision (null for some), monsters, and, if wanted, some lengths unknown or zero."""
    duration = F.when(F.col("part_id") % 29 == 0, None).when(F.col("part_id") % 31 == 0, 0).otherwise(F.col("duration"))
    named = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("part_id") % 7 + 1).cast("int"))
    vision = F.when(F.col("source_id") % 13 != 0, (F.col("part_id") % 40).cast("double"))
    known = F.when(F.col("duration") > 0, duration_bucket(F.col("duration"))).otherwise("unknown")
    x = rank_only(player_match(spark, sf_dir)).withColumns({"role": named, "vision": vision, "monster": ((F.col("part_id") + F.col("source_id")) % 30).cast("double"), "duration": duration if unknown else F.col("duration")})
    return x.withColumn("bucket", known)


def expected_metrics(rows: DataFrame) -> DataFrame:
    """rows with the expected value of each metric: the first baseline level that exists, stretched by the match's length.

    Baselines are those of won matches. Length multipliers are a role's means in a length bucket over those of all matches; an
    unknown length and a bucket under 30 samples take the role's, and a role without one takes 1. Damage follows the minute
    curve between 10 and 20 minutes and fades to the bucket's multiplier from 8 and to 25; a match of unknown length is not
    stretched within its bucket. The rows are summed once by all keys, which are small dimensions; levels and multipliers are
    looked up for the cells of these sums, and the rows are joined with them once. The sums are written, as every level reads them."""
    measures = ("damage", "kills", "assists", "team_kills", "deaths", "vision", "monster")
    cells = rows.groupBy("tier", "character_num", "weapon", "role", "bucket", "victory").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("decimal(14,2)")).cast("double").alias(f"s_{c}") for c in measures), *(F.count(c).alias(f"c_{c}") for c in measures)
    )
    cells = written(cells, "score_cells")
    mean = lambda c: F.try_divide(F.sum(F.col(f"s_{c}").cast("decimal(24,2)")).cast("double"), F.sum(f"c_{c}"))
    levels = [["tier", "character_num", "weapon"], ["tier", "character_num"], ["tier", "role"], ["tier"]]
    keys = ["tier", "character_num", "weapon", "role", "bucket"]
    x = first_level(cells.select(*keys).distinct(), cells.where("victory"), levels, [mean(c).alias(f"b_{c}") for c in measures], (LEAST_BASELINE,), F.col("weapon") > 0, F.sum("n"))
    stretched = ("damage", "deaths", "vision", "monster")
    total = cells.agg(*(mean(c).alias(f"t_{c}") for c in stretched))

    def multipliers(keys: list[str], prefix: str) -> DataFrame:
        cell = cells.groupBy(*keys).agg(F.sum("n").alias(f"{prefix}n"), *(mean(c).alias(f"{prefix}{c}") for c in stretched)).crossJoin(F.broadcast(total))
        return cell.select(*keys, f"{prefix}n", *(js_round(F.col(f"{prefix}{c}") / F.col(f"t_{c}"), 4).alias(f"{prefix}{c}") for c in stretched))

    x = x.join(multipliers(["role", "bucket"], "d_").where((F.col("d_n") >= LEAST_BASELINE) & (F.col("bucket") != "unknown")), ["role", "bucket"], "left").join(multipliers(["role"], "r_"), "role", "left")
    at = lambda c: F.coalesce(F.col(f"d_{c}"), F.col(f"r_{c}"), F.lit(1.0))
    weights = (chosen(F.col("role"), {r: float(w[i]) for r, w in ROLE_WEIGHTS.items()}).alias(f"w_{m}") for i, m in enumerate(METRICS))
    x = x.select(*keys, "level", "baseline_n", *(f"b_{c}" for c in measures), *(at(c).alias(f"m_{c}") for c in stretched), chosen(F.col("bucket"), DURATION_MIDPOINTS).alias("midpoint"), *weights)
    x = rows.join(x, keys, "left")
    within = F.when(F.col("duration") > 0, clamp(F.col("duration") / F.col("midpoint"), 0.75, 1.25)).otherwise(1.0)
    at = lambda c: F.col(f"m_{c}")
    minute, legacy = F.col("duration") / F.lit(60.0), js_round(at("damage") * within, 6)
    curve = js_round(interpolate(minute, DAMAGE_CURVE), 6)
    early, late = (minute - 8) / 2, (F.lit(25) - minute) / 5
    stretch = F.when(minute.isNull() | (minute < 8) | (minute >= 25), legacy).when(minute < 10, js_round(legacy * (1 - early) + curve * early, 6)).when(minute <= 20, curve).otherwise(js_round(curve * late + legacy * (1 - late), 6))
    return x.withColumns({
        "e_damage": js_round(F.col("b_damage") * stretch, 4), "e_combat": js_round(participation_capped(F.col("b_kills"), F.col("b_assists"), F.col("b_team_kills")), 6),
        "e_survival": js_round(F.col("b_deaths") * at("deaths") * within, 4), "e_vision": js_round(F.col("b_vision") * at("vision") * within, 4),
        "e_monster": js_round(F.col("b_monster") * at("monster") * within, 4),
    })


def adjusted(raw: Column) -> Column:
    """Strengths count more, mild weaknesses less, severe ones in full; between 30 and 95."""
    low, mild = F.lit(65 - 15 * 0.75) + (raw - 50), F.lit(65) + (raw - 65) * 0.75
    strong, top = F.lit(65) + (raw - 65) * 1.2, F.lit(65 + 15 * 1.2) + (raw - 80) * 1.35
    return js_round(clamp(F.when(raw < 50, low).when(raw < 65, mild).when(raw <= 80, strong).otherwise(top), 30, 95), 4)


def policy(raw: Column) -> Column:
    """Which rule adjusted() took; the bounds of the result lie at 33.75 and 97.5 before the clamp, so both can be met."""
    low, top = F.lit(65 - 15 * 0.75) + (raw - 50), F.lit(65 + 15 * 1.2) + (raw - 80) * 1.35
    return (
        F.when(raw.isNull(), None).when((raw < 50) & (low < 30), "clamped-min-30").when(raw < 50, "severe-low-1.00").when(raw < 65, "mild-low-0.75").when(raw == 65, "neutral")
        .when(raw <= 80, "strength-1.20").when(top > 95, "clamped-max-95").otherwise("exceptional-strength-1.35")
    )


def weighted(columns: dict[str, Column]) -> Column:
    """The mean of the metrics that are there by the role's weights (w_ and the metric); null if none is."""
    zero = F.lit(0.0)
    top = sum((F.coalesce(columns[m] * F.col(f"w_{m}"), zero) for m in METRICS), zero)
    bottom = sum((F.when(columns[m].isNotNull(), F.col(f"w_{m}")).otherwise(0.0) for m in METRICS), zero)
    return js_round(F.when(bottom > 0, top / bottom), 4)


def role_score_rows(spark, sf_dir: str, metrics: bool = False) -> DataFrame:
    """Rank matches with the role score from raw and from adjusted metric scores, how many are missing, the baseline's level, and, if wanted, the metrics' own scores.

    They are written once, as what Spark compiles for them is run by several queries more than once, and too long a method for the JVM to
    compile unless it is cut."""
    with small_methods(spark):
        return written(_role_score_rows(spark, sf_dir, metrics), "role_scores")


def _role_score_rows(spark, sf_dir: str, metrics: bool) -> DataFrame:
    x = expected_metrics(scored(spark, sf_dir))
    actual = {"damage": F.col("damage"), "combat": js_round(participation_capped(F.col("kills"), F.col("assists"), F.col("team_kills")), 6), "survival": F.col("deaths"), "vision": F.col("vision"), "monster": F.col("monster")}
    x = x.withColumns({f"raw_{m}": relative_score(actual[m], F.col(f"e_{m}"), m != "survival") for m in METRICS})
    x = x.withColumns({f"adj_{m}": adjusted(F.col(f"raw_{m}")) for m in METRICS})
    x = x.withColumns({"role_score": weighted({m: F.col(f"adj_{m}") for m in METRICS}), "raw_role_score": weighted({m: F.col(f"raw_{m}") for m in METRICS})})
    missing = sum((F.col(f"adj_{m}").isNull().cast("int") for m in METRICS), F.lit(0))
    return x.select(*KEPT, *(f"{p}_{m}" for p in ("raw", "adj", "e") for m in METRICS if metrics), "role_score", "raw_role_score", missing.alias("missing"))


def placement_points(place: Column, score: Column) -> Column:
    """Points for a placement: good places count in full from a score of 65 on, with a bonus over 75; bad ones less for strong play."""
    base = chosen(place, PLACEMENT_POINTS)
    gate, best, strong = clamp((score - 45) / 20, 0, 1), clamp((score - 75) / 15, 0, 1), clamp((score - 60) / 25, 0, 1)
    up = base * (F.lit(0.2) + F.lit(0.8) * gate) + chosen(place, EXCELLENCE_POINTS, F.lit(0.0)) * best
    return js_round(F.when(base > 0, up).when(base < 0, base * (F.lit(1.0) - F.lit(0.75) * strong)), 4)


def match_grade_rows(spark, sf_dir: str) -> DataFrame:
    """Null scores stay: a filter on one would be computed from the scan on, apart from the score itself."""
    x = role_score_rows(spark, sf_dir).withColumn("placement_points", placement_points(F.col("placement"), F.col("role_score")))
    return x.withColumn("match_score", js_round(clamp(F.col("role_score") + F.col("placement_points"), 0, 100), 2))


# The same chain in SQL, with its numbers written out.

ROLE_LIST = "['평타 딜러', '스증 딜러', '암살자', '평타 브루저', '스증 브루저', '탱커', '서포터']"
SCORED = f"""r0 AS (SELECT * EXCLUDE (duration), CASE WHEN part_id % 29 = 0 THEN NULL WHEN part_id % 31 = 0 THEN 0 ELSE duration END AS duration FROM pm WHERE game_mode = 'rank'), rk AS (SELECT * EXCLUDE (role), {ROLE_LIST}[part_id % 7 + 1] AS role, CASE WHEN source_id % 13 <> 0 THEN CAST(part_id % 40 AS DOUBLE) END vision, CAST((part_id + source_id) % 30 AS DOUBLE) monster,
 CASE WHEN duration IS NULL OR duration <= 0 THEN 'unknown' WHEN duration / 60.0 >= 30 THEN '30+' WHEN duration / 60.0 >= 25 THEN '25-30' WHEN duration / 60.0 >= 20 THEN '20-25' WHEN duration / 60.0 >= 15 THEN '15-20' ELSE '<15' END bucket FROM r0)"""
DAMAGE = "CAST(sum(CAST(damage AS DECIMAL(14, 2))) AS DOUBLE) / count(damage)"
BASE = f"count(*) n, {DAMAGE} bd, avg(kills) bk, avg(assists) ba, avg(team_kills) bt, avg(deaths) bx, avg(vision) bv, avg(monster) bm"
MULT = f"count(*) n, {DAMAGE} d, avg(deaths) x, avg(vision) v, avg(monster) m"


def _relative(actual: str, expected: str, sign: str = "") -> str:
    return R4.format(f"CASE WHEN {actual} IS NOT NULL AND {expected} IS NOT NULL THEN least(greatest(65 + 45 * {sign}(({actual} - {expected}) / greatest(abs({expected}), 1e-6)), 20), 100) END")


def _adjusted(c: str) -> str:
    return R4.format(f"CASE WHEN {c} IS NOT NULL THEN least(greatest(CASE WHEN {c} < 50 THEN 53.75 + ({c} - 50) WHEN {c} < 65 THEN 65 + ({c} - 65) * 0.75 WHEN {c} <= 80 THEN 65 + ({c} - 65) * 1.2 ELSE 83 + ({c} - 80) * 1.35 END, 30), 95) END")


WEIGHTS_SQL = (
    "w(role, w1, w2, w3, w4, w5) AS (VALUES ('평타 딜러', 32, 24, 10, 18, 16), ('스증 딜러', 36, 25, 10, 18, 11), ('암살자', 30, 32, 10, 18, 10), ('평타 브루저', 27, 28, 15, 17, 13), "
    "('스증 브루저', 30, 29, 15, 17, 9), ('탱커', 12, 35, 20, 30, 3), ('서포터', 7, 38, 20, 33, 2))"
)


def _mean(p: str) -> str:
    both = [(f"{p}1", "w1"), (f"{p}2", "w2"), (f"{p}3", "w3"), (f"{p}4", "w4"), (f"{p}5", "w5")]
    top, bottom = (" + ".join(t.format(c, w) for c, w in both) for t in ("coalesce({0} * {1}, 0)", "CASE WHEN {0} IS NOT NULL THEN {1} ELSE 0 END"))
    return R4.format(f"({top}) / nullif(CAST({bottom} AS DOUBLE), 0)")


CHAIN = f"""{PM}, {SCORED}, {WEIGHTS_SQL},
l0 AS (SELECT tier, character_num, weapon, {BASE} FROM rk WHERE victory GROUP BY 1, 2, 3 HAVING count(*) >= 30), l1 AS (SELECT tier, character_num, {BASE} FROM rk WHERE victory GROUP BY 1, 2),
l2 AS (SELECT tier, role, {BASE} FROM rk WHERE victory GROUP BY 1, 2), l3 AS (SELECT tier, {BASE} FROM rk WHERE victory GROUP BY 1), tot AS (SELECT {MULT} FROM rk),
dm AS (SELECT c.role, c.bucket, {R4.format("c.d / tot.d")} d, {R4.format("c.x / tot.x")} x, {R4.format("c.v / tot.v")} v, {R4.format("c.m / tot.m")} m FROM (SELECT role, bucket, {MULT} FROM rk WHERE bucket <> 'unknown' GROUP BY 1, 2 HAVING count(*) >= 30) c, tot),
rm AS (SELECT c.role, {R4.format("c.d / tot.d")} d, {R4.format("c.x / tot.x")} x, {R4.format("c.v / tot.v")} v, {R4.format("c.m / tot.m")} m FROM (SELECT role, {MULT} FROM rk GROUP BY 1) c, tot),
lv AS (SELECT rk.*, CASE WHEN l0.n IS NOT NULL THEN 0 WHEN l1.n IS NOT NULL THEN 1 WHEN l2.n IS NOT NULL THEN 2 WHEN l3.n IS NOT NULL THEN 3 END AS lvl,
 {", ".join(f"CASE WHEN l0.n IS NOT NULL THEN l0.{c} WHEN l1.n IS NOT NULL THEN l1.{c} WHEN l2.n IS NOT NULL THEN l2.{c} ELSE l3.{c} END {c}" for c in ("n", "bd", "bk", "ba", "bt", "bx", "bv", "bm"))},
 coalesce(dm.d, rm.d, 1) md, coalesce(dm.x, rm.x, 1) mx, coalesce(dm.v, rm.v, 1) mv, coalesce(dm.m, rm.m, 1) mm,
 CASE WHEN rk.bucket = 'unknown' THEN 1.0 ELSE least(greatest(duration / CASE rk.bucket WHEN '<15' THEN 750.0 WHEN '15-20' THEN 1050.0 WHEN '20-25' THEN 1350.0 WHEN '25-30' THEN 1650.0 ELSE 1950.0 END, 0.75), 1.25) END inside, CASE WHEN duration > 0 THEN duration / 60.0 END mi
 FROM rk LEFT JOIN l0 ON l0.tier = rk.tier AND l0.character_num = rk.character_num AND l0.weapon = rk.weapon AND rk.weapon > 0 LEFT JOIN l1 ON l1.tier = rk.tier AND l1.character_num = rk.character_num
 LEFT JOIN l2 ON l2.tier = rk.tier AND l2.role = rk.role LEFT JOIN l3 ON l3.tier = rk.tier LEFT JOIN dm ON dm.role = rk.role AND dm.bucket = rk.bucket LEFT JOIN rm ON rm.role = rk.role),
st AS (SELECT *, {R6.format("md * inside")} old, {R6.format("CASE WHEN mi <= 10 THEN 0.518732 WHEN mi <= 15 THEN 0.518732 + (mi - 10) * ((0.807183 - 0.518732) / 5) WHEN mi <= 20 THEN 0.807183 + (mi - 15) * ((1.079121 - 0.807183) / 5) WHEN mi <= 25 THEN 1.079121 + (mi - 20) * ((1.328282 - 1.079121) / 5) WHEN mi > 25 THEN 1.328282 END")} cur FROM lv),
ex AS (SELECT *, {R4.format(f"bd * CASE WHEN mi IS NULL OR mi < 8 OR mi >= 25 THEN old WHEN mi < 10 THEN {R6.format('old * (1 - (mi - 8) / 2) + cur * ((mi - 8) / 2)')} WHEN mi <= 20 THEN cur ELSE {R6.format('cur * ((25 - mi) / 5) + old * (1 - (25 - mi) / 5)')} END")} e1,
 {R6.format("CASE WHEN bt > 0 THEN least((bk + 0.7 * ba) / bt, 1.0) END")} e2, {R4.format("bx * mx * inside")} e3, {R4.format("bv * mv * inside")} e4, {R4.format("bm * mm * inside")} e5,
 {R6.format("CASE WHEN team_kills > 0 THEN least((kills + 0.7 * assists) / team_kills, 1.0) END")} combat FROM st),
rw AS (SELECT *, {_relative("damage", "e1")} q1, {_relative("combat", "e2")} q2, {_relative("deaths", "e3", "-")} q3, {_relative("vision", "e4")} q4, {_relative("monster", "e5")} q5 FROM ex),
ad AS (SELECT *, {", ".join(f"{_adjusted(f'q{i}')} a{i}" for i in range(1, 6))} FROM rw),
sc AS (SELECT ad.*, {_mean("a")} role_score, {_mean("q")} raw_role_score FROM ad JOIN w USING (role)),
pp AS (SELECT *, CASE placement WHEN 1 THEN 6.0 WHEN 2 THEN 4.0 WHEN 3 THEN 2.0 WHEN 4 THEN 1.0 WHEN 5 THEN -1.0 WHEN 6 THEN -2.0 WHEN 7 THEN -4.0 WHEN 8 THEN -6.0 END bp FROM sc),
pl AS (SELECT *, {R4.format("CASE WHEN role_score IS NULL THEN NULL WHEN bp > 0 THEN bp * (0.2 + 0.8 * least(greatest((role_score - 45) / 20, 0), 1)) + CASE placement WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 WHEN 3 THEN 1.0 ELSE 0 END * least(greatest((role_score - 75) / 15, 0), 1) WHEN bp < 0 THEN bp * (1 - 0.75 * least(greatest((role_score - 60) / 25, 0), 1)) END")} points FROM pp),
mg AS (SELECT *, {R2.format("least(greatest(role_score + points, 0), 100)")} match_score FROM pl)"""
KEYS = ", ".join(KEY)
GRADE = (
    "CASE WHEN {0} >= 95 THEN 'S+' WHEN {0} >= 88 THEN 'S' WHEN {0} >= 84 THEN 'S-' WHEN {0} >= 80 THEN 'A+' WHEN {0} >= 76 THEN 'A' WHEN {0} >= 72 THEN 'A-' WHEN {0} >= 68 THEN 'B+' WHEN {0} >= 62 THEN 'B' "
    "WHEN {0} >= 56 THEN 'B-' WHEN {0} >= 50 THEN 'C+' WHEN {0} >= 44 THEN 'C' WHEN {0} >= 38 THEN 'C-' WHEN {0} >= 32 THEN 'D+' WHEN {0} >= 24 THEN 'D' WHEN {0} IS NOT NULL THEN 'D-' END"
)


@query(f"WITH {CHAIN} SELECT {KEYS}, lvl AS baseline_level, n baseline_n, role_score, raw_role_score, CASE WHEN a1 IS NULL THEN 1 ELSE 0 END + CASE WHEN a2 IS NULL THEN 1 ELSE 0 END + CASE WHEN a3 IS NULL THEN 1 ELSE 0 END + CASE WHEN a4 IS NULL THEN 1 ELSE 0 END + CASE WHEN a5 IS NULL THEN 1 ELSE 0 END missing FROM sc")
def role_scores(spark, sf_dir):
    """Every rank match's role score: metrics against the baseline, adjusted, weighed by role; missing metrics take no weight."""
    return role_score_rows(spark, sf_dir).select(*KEY, F.col("level").alias("baseline_level"), "baseline_n", "role_score", "raw_role_score", "missing")


@query(
    f"WITH {CHAIN}, d AS ("
    + " UNION ALL ".join(f"SELECT {KEYS}, '{m}' metric, q{i} q, a{i} a, w{i} w, e{i} e FROM ad JOIN w USING (role)" for i, m in enumerate(METRICS, 1))
    + f") SELECT {KEYS}, metric, q AS raw, a AS adjusted, {R4.format('a * w / 100.0')} contribution, e AS expected, CASE WHEN q < 50 AND 53.75 + (q - 50) < 30 THEN 'clamped-min-30' WHEN q < 50 THEN 'severe-low-1.00' WHEN q < 65 THEN 'mild-low-0.75' WHEN q = 65 THEN 'neutral' WHEN q <= 80 THEN 'strength-1.20' WHEN 83 + (q - 80) * 1.35 > 95 THEN 'clamped-max-95' ELSE 'exceptional-strength-1.35' END AS policy FROM d WHERE q IS NOT NULL"
)
def role_score_details(spark, sf_dir):
    """One row per match and metric that is there: raw and adjusted score, the rule of the adjustment and the contribution."""
    weight = lambda i: chosen(F.col("role"), {r: float(w[i]) for r, w in ROLE_WEIGHTS.items()})
    one = lambda i, m: F.struct(F.lit(m).alias("metric"), F.col(f"raw_{m}").alias("raw"), F.col(f"adj_{m}").alias("adjusted"), js_round(F.col(f"adj_{m}") * weight(i) / 100, 4).alias("contribution"), F.col(f"e_{m}").alias("expected"), policy(F.col(f"raw_{m}")).alias("policy"))
    x = role_score_rows(spark, sf_dir, metrics=True).select(*KEY, F.explode(F.array(*(one(i, m) for i, m in enumerate(METRICS)))).alias("d"))
    return x.where("d.raw is not null").select(*KEY, "d.*")


@query(f"WITH {CHAIN} SELECT {KEYS}, role_score, points placement_points, match_score, {GRADE.format('match_score')} grade FROM mg")
def match_grades(spark, sf_dir):
    """Role score, placement points and fine grade of every rank match that has them."""
    return match_grade_rows(spark, sf_dir).select(*KEY, "role_score", "placement_points", "match_score", steps(F.col("match_score"), FINE_GRADES, LOWEST).alias("grade"))


@query(f"""WITH {CHAIN}, c AS (SELECT avg(raw_role_score) m FROM sc), r AS (SELECT role, count(raw_role_score) n FROM sc GROUP BY 1), e AS (SELECT role, placement, count(raw_role_score) n, {R4.format("avg(raw_role_score) - any_value(c.m)")} effect FROM sc, c GROUP BY 1, 2 HAVING count(raw_role_score) >= 30)
SELECT {KEYS}, coalesce(e.effect, 0) placement_effect, coalesce(e.n, r.n) effect_n, CASE WHEN e.n IS NOT NULL THEN 'role-placement' ELSE 'role-global' END effect_level, {R4.format("raw_role_score - coalesce(e.effect, 0)")} adjusted_contribution
FROM sc LEFT JOIN e ON e.role = sc.role AND e.placement = sc.placement JOIN r ON r.role = sc.role""")
def adjusted_contributions(spark, sf_dir):
    """The role score without the usual effect of the placement; cells under 30 samples have none. Effects are a table of roles by places."""
    x = role_score_rows(spark, sf_dir)
    center = x.agg(F.avg("raw_role_score").alias("center"))
    by_role = x.groupBy("role").agg(F.count("raw_role_score").alias("role_n"))
    e = x.groupBy("role", "placement").agg(F.count("raw_role_score").alias("cell_n"), F.avg("raw_role_score").alias("mean")).where(F.col("cell_n") >= LEAST_BASELINE).crossJoin(F.broadcast(center))
    e = e.select("role", "placement", "cell_n", js_round(F.col("mean") - F.col("center"), 4).alias("effect"))
    x = x.join(F.broadcast(e), ["role", "placement"], "left").join(F.broadcast(by_role), "role")
    effect = F.coalesce("effect", F.lit(0.0))
    return x.select(*KEY, effect.alias("placement_effect"), F.coalesce("cell_n", "role_n").alias("effect_n"), F.when(F.col("cell_n").isNotNull(), "role-placement").otherwise("role-global").alias("effect_level"), js_round(F.col("raw_role_score") - effect, 4).alias("adjusted_contribution"))


def exact_sum(c: Column, digits: int) -> Column:
    """The sum of numbers with so many decimals, the same in any order, so that means on a rounding edge do not depend on partitions."""
    return F.sum(c.cast(f"decimal(12,{digits})")).cast("double")


def aggregate_grade(n: Column, raw: Column, prior: Column, robust: Column | None) -> Column:
    """Up to 9 matches the mean, shrunk to the prior by n / (n + 1); from 10 on the robust mean where there is one, else as before up to 19."""
    shrunk = F.when(n >= 20, raw).otherwise(prior + n / (n + F.lit(1.0)) * (raw - prior))
    return shrunk if robust is None else F.when(n >= 10, robust).otherwise(shrunk)


CONFIDENCE_SQL = "CASE WHEN n >= 10 THEN 1.0 ELSE n / (n + 1.0) END"
PRIORS_SQL = "pr(role, prior) AS (VALUES ('평타 딜러', 63.3829), ('스증 딜러', 64.4096), ('암살자', 67.6605), ('평타 브루저', 65.1303), ('스증 브루저', 63.5631), ('탱커', 63.7992), ('서포터', 63.6047))"


@query(f"""WITH {CHAIN}, {PRIORS_SQL}, o AS (SELECT uid, character_num, match_score, prior, row_number() OVER (PARTITION BY uid, character_num ORDER BY match_score, {KEYS}) i, count(*) OVER (PARTITION BY uid, character_num) n FROM mg JOIN pr USING (role) WHERE match_score IS NOT NULL),
t AS (SELECT *, CASE WHEN i <= ceil(n * 0.1) THEN 0.15 WHEN i > n - ceil(n * 0.1) THEN 0.75 ELSE 1.0 END wt FROM o), g AS (SELECT uid, character_num, count(*) n, CAST(sum(CAST(match_score AS DECIMAL(12, 2))) AS DOUBLE) / count(*) raw, CAST(sum(CAST(prior AS DECIMAL(12, 4))) AS DOUBLE) / count(*) prior, CAST(sum(CAST(match_score AS DECIMAL(12, 2)) * CAST(wt AS DECIMAL(3, 2))) AS DOUBLE) / CAST(sum(CAST(wt AS DECIMAL(3, 2))) AS DOUBLE) robust FROM t GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN n >= 10 THEN robust ELSE prior + n / (n + 1.0) * (raw - prior) END final FROM g)
SELECT uid, character_num, n, {R2.format("raw")} raw, {R2.format("prior")} prior, {R2.format("final")} score, {R4.format(CONFIDENCE_SQL)} confidence, CASE WHEN n >= 10 THEN 'robust-weighted-10pct' ELSE 'plain-mean-k1' END AS policy, {GRADE.format("final")} grade FROM f""")
def character_aggregate_grades(spark, sf_dir):
    """A player's grade on a character: from ten matches on the lowest and highest tenth weigh less, below that the mean is shrunk to the roles' prior."""
    w = Window.partitionBy("uid", "character_num")
    x = match_grade_rows(spark, sf_dir).select("uid", "character_num", "match_score", chosen(F.col("role"), ROLE_PRIORS, F.lit(GLOBAL_PRIOR)).alias("prior"), *(c for c in KEY))
    x = x.withColumns({"i": F.row_number().over(w.orderBy(F.asc_nulls_last("match_score"), *KEY)), "n": F.count("match_score").over(w)}).where("i <= n")
    tail = F.ceil(F.col("n") * 0.1)
    wt = F.when(F.col("i") <= tail, 0.15).when(F.col("i") > F.col("n") - tail, 0.75).otherwise(1.0)
    g = x.groupBy("uid", "character_num").agg(F.count(F.lit(1)).alias("n"), (exact_sum(F.col("match_score"), 2) / F.count(F.lit(1))).alias("raw"), (exact_sum(F.col("prior"), 4) / F.count(F.lit(1))).alias("prior"), (F.sum(F.col("match_score").cast("decimal(12,2)") * wt.cast("decimal(3,2)")).cast("double") / exact_sum(wt, 2)).alias("robust"))
    g = g.withColumn("final", aggregate_grade(F.col("n"), F.col("raw"), F.col("prior"), F.col("robust")))
    confidence = F.when(F.col("n") >= 10, 1.0).otherwise(F.col("n") / (F.col("n") + 1.0))
    return g.select(
        "uid", "character_num", "n", js_round(F.col("raw"), 2).alias("raw"), js_round(F.col("prior"), 2).alias("prior"), js_round(F.col("final"), 2).alias("score"), js_round(confidence, 4).alias("confidence"),
        F.when(F.col("n") >= 10, "robust-weighted-10pct").otherwise("plain-mean-k1").alias("policy"), steps(F.col("final"), FINE_GRADES, LOWEST).alias("grade"),
    )


@query(f"""WITH {CHAIN}, g AS (SELECT uid, count(*) n, count(DISTINCT character_num) characters, CAST(sum(CAST(match_score AS DECIMAL(12, 2))) AS DOUBLE) / count(*) raw FROM mg WHERE match_score IS NOT NULL GROUP BY 1), f AS (SELECT *, CASE WHEN n >= 20 THEN raw ELSE 64.0065 + n / (n + 1.0) * (raw - 64.0065) END final FROM g)
SELECT uid, n, characters, {R2.format("raw")} raw, {R2.format("final")} score, {R2.format("final - raw")} modifier, {R4.format(CONFIDENCE_SQL)} confidence, CASE WHEN n >= 40 THEN 'high' WHEN n >= 20 THEN 'medium' WHEN n >= 5 THEN 'low' ELSE 'insufficient' END label, {GRADE.format("final")} grade FROM f""")
def overall_aggregate_grades(spark, sf_dir):
    """A player's grade over all characters, shrunk to the global prior under twenty matches."""
    g = match_grade_rows(spark, sf_dir).groupBy("uid", "character_num").agg(F.count("match_score").alias("k"), F.sum(F.col("match_score").cast("decimal(12,2)")).alias("s"))
    g = g.where("k > 0").groupBy("uid").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("characters"), (F.sum("s").cast("double") / F.sum("k")).alias("raw"))
    g = g.withColumn("final", aggregate_grade(F.col("n"), F.col("raw"), F.lit(GLOBAL_PRIOR), None))
    n = F.col("n")
    return g.select(
        "uid", "n", "characters", js_round(F.col("raw"), 2).alias("raw"), js_round(F.col("final"), 2).alias("score"), js_round(F.col("final") - F.col("raw"), 2).alias("modifier"),
        js_round(F.when(n >= 10, 1.0).otherwise(n / (n + 1.0)), 4).alias("confidence"), F.when(n >= 40, "high").when(n >= 20, "medium").when(n >= 5, "low").otherwise("insufficient").alias("label"),
        steps(F.col("final"), FINE_GRADES, LOWEST).alias("grade"),
    )


SNAP = f"""{PM}, rl AS (SELECT *, {ROLE_LIST}[part_id % 7 + 1] AS role7 FROM pm WHERE game_mode = 'rank'), rc AS (SELECT uid, character_num, role7, count(*) c FROM rl WHERE weapon > 0 GROUP BY 1, 2, 3), pr7 AS (SELECT uid, character_num, arg_max(role7, (c, role7)) primary_role FROM rc GROUP BY 1, 2),
md AS (SELECT uid, character_num, rp_after FROM (SELECT uid, character_num, rp_after, row_number() OVER (PARTITION BY uid, character_num ORDER BY rp_after) - 1 i, count(*) OVER (PARTITION BY uid, character_num) n FROM rl WHERE rp_after > 0) WHERE i = n // 2),
bn AS (SELECT uid, character_num, rp_after, CASE WHEN rp_after >= 7600 THEN 'mithril' WHEN rp_after >= 6400 THEN 'meteorite' WHEN rp_after >= 5000 THEN 'diamond' WHEN rp_after >= 3600 THEN 'platinum' WHEN rp_after >= 1400 THEN 'silver_gold' ELSE 'iron_bronze' END band FROM md),
sn AS (SELECT uid, character_num, count(*) matches, {R2.format("avg(placement)")} average_placement, {R2.format("100.0 * count(*) FILTER (victory) / count(*)")} win_rate, {R2.format("100.0 * count(*) FILTER (placement <= 3) / count(*)")} top3_rate,
 {R2.format("avg(kills)")} average_kills, {R2.format("avg(deaths)")} average_deaths, {R2.format("100 * (CAST(sum(CAST(" + R6.format("CASE WHEN team_kills > 0 THEN least((kills + 0.7 * assists) / team_kills, 1.0) END") + " AS DECIMAL(12, 6))) AS DOUBLE) / nullif(count(*) FILTER (team_kills > 0), 0))")} participation, {R2.format("CAST(sum(CAST(damage / (duration / 60.0) AS DECIMAL(24, 6))) AS DOUBLE) / count(damage)")} damage_per_minute, {R2.format("avg(duration)")} survival_time,
 min(played_at) window_start, max(played_at) window_end FROM rl GROUP BY 1, 2)"""


def snapshots(spark, sf_dir: str) -> DataFrame:
    """One row per player and character: means, rates, primary role, tier band of the upper median of rank points, and the sample's status."""
    x = scored(spark, sf_dir, unknown=False)
    w = Window.partitionBy("uid", "character_num")
    roles = x.where("weapon > 0").groupBy("uid", "character_num", "role").agg(F.count(F.lit(1)).alias("c"))
    primary = roles.groupBy("uid", "character_num").agg(F.max_by("role", F.struct("c", "role")).alias("primary_role"))
    ordered = x.where("rp_after > 0").select("uid", "character_num", "rp_after", (F.row_number().over(w.orderBy("rp_after")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("k"))
    median = ordered.where("i = k div 2").select("uid", "character_num", F.col("rp_after").alias("median_rp"))
    # Six digits of each match are summed exactly, so that means on a rounding edge do not depend on the order.
    rate = lambda c: F.when(F.col("duration") > 0, F.col(c) / (F.col("duration") / F.lit(60.0)))
    per = lambda c: F.try_divide(F.sum(rate(c).cast("decimal(24,6)")).cast("double"), F.count(rate(c)))
    ratio = js_round(participation_capped(F.col("kills"), F.col("assists"), F.col("team_kills")), 6)
    r2 = lambda c: js_round(c, 2)
    s = x.groupBy("uid", "character_num").agg(
        F.count(F.lit(1)).alias("matches"), r2(F.avg("placement")).alias("average_placement"), r2(F.lit(100.0) * F.count_if("victory") / F.count(F.lit(1))).alias("win_rate"),
        r2(F.lit(100.0) * F.count_if(F.col("placement") <= 3) / F.count(F.lit(1))).alias("top3_rate"), r2(F.avg("kills")).alias("average_kills"), r2(F.avg("deaths")).alias("average_deaths"),
        r2(F.lit(100) * F.try_divide(exact_sum(ratio, 6), F.count(ratio))).alias("participation"), r2(per("damage")).alias("damage_per_minute"), r2(F.avg("duration")).alias("survival_time"),
        F.min("played_at").alias("window_start"), F.max("played_at").alias("window_end"),
    )
    s = s.join(primary, ["uid", "character_num"], "left").join(median, ["uid", "character_num"], "left")
    from matchloom.functions.core import tier_of

    return s.withColumns({"band": chosen(tier_of(F.col("median_rp")), BANDS, F.lit("unranked")), "status": steps(F.col("matches").cast("double"), SAMPLE_STATUS, "exploratory")})


STATUS = "CASE WHEN matches >= 20 THEN 'benchmarkEligible' WHEN matches >= 10 THEN 'provisional' ELSE 'exploratory' END"


@query(f"WITH {SNAP} SELECT uid, character_num, matches, average_placement, win_rate, top3_rate, average_kills, average_deaths, participation, damage_per_minute, survival_time, window_start, window_end, primary_role, rp_after median_rp, coalesce(band, 'unranked') band, {STATUS} status FROM sn LEFT JOIN pr7 USING (uid, character_num) LEFT JOIN bn USING (uid, character_num)")
def player_character_snapshots(spark, sf_dir):
    return snapshots(spark, sf_dir)


ADJACENT_SQL = (
    "adj(band, near) AS (VALUES ('iron_bronze', 'iron_bronze'), ('iron_bronze', 'silver_gold'), ('silver_gold', 'iron_bronze'), ('silver_gold', 'silver_gold'), ('silver_gold', 'platinum'), ('platinum', 'silver_gold'), ('platinum', 'platinum'), ('platinum', 'diamond'), "
    "('diamond', 'platinum'), ('diamond', 'diamond'), ('diamond', 'meteorite'), ('meteorite', 'diamond'), ('meteorite', 'meteorite'), ('meteorite', 'mithril'), ('mithril', 'meteorite'), ('mithril', 'mithril'))"
)


def near_sums(cells: DataFrame, key: str, n: str, to: str) -> DataFrame:
    """Counts of a key's cells summed over the bands next to each band. cells: key, band, n; a band has three neighbours at most."""
    bands = F.explode(F.array(*(F.struct(F.lit(a).alias("near"), F.lit(b).alias("band")) for a, bs in ADJACENT_BANDS.items() for b in bs)))
    pairs = cells.sparkSession.range(1).select(bands.alias("p")).select("p.*")
    return cells.join(F.broadcast(pairs), "band").groupBy(key, "near").agg(F.sum(n).alias(to)).withColumnRenamed("near", "band")


@query(f"""WITH {SNAP}, {ADJACENT_SQL}, s AS (SELECT uid, character_num, coalesce(band, 'unranked') band, primary_role FROM sn LEFT JOIN pr7 USING (uid, character_num) LEFT JOIN bn USING (uid, character_num)),
c1 AS (SELECT character_num, band, count(*) n FROM s GROUP BY 1, 2), c2 AS (SELECT character_num, adj.band, sum(n) n FROM c1 JOIN adj ON adj.near = c1.band GROUP BY 1, 2), r1 AS (SELECT primary_role, band, count(*) n, count(DISTINCT uid) users FROM s WHERE primary_role IS NOT NULL GROUP BY 1, 2), r2 AS (SELECT primary_role, adj.band, sum(n) n FROM r1 JOIN adj ON adj.near = r1.band GROUP BY 1, 2),
x AS (SELECT s.character_num, s.band, s.primary_role, CASE WHEN c1.n >= 30 THEN 'character-tier' WHEN c2.n >= 30 THEN 'character-tier-adjacent' WHEN r1.n >= 30 THEN 'role-tier' WHEN r2.n >= 30 THEN 'role-tier-adjacent' ELSE 'unavailable' END AS comparison,
 CASE WHEN c1.n >= 30 THEN c1.n WHEN c2.n >= 30 THEN c2.n WHEN r1.n >= 30 THEN r1.users WHEN r2.n >= 30 THEN r2.n ELSE c1.n END samples
 FROM (SELECT DISTINCT character_num, band, primary_role FROM s) s LEFT JOIN c1 USING (character_num, band) LEFT JOIN c2 USING (character_num, band) LEFT JOIN r1 USING (primary_role, band) LEFT JOIN r2 USING (primary_role, band))
SELECT character_num, band, primary_role, comparison, CAST(samples AS BIGINT) samples, comparison <> 'unavailable' AND samples >= 30 matched FROM x""")
def character_comparisons(spark, sf_dir):
    """Which cohort a character of a band is compared with: its own with 30 players, the neighbouring bands', the role's, or the role's neighbours'."""
    s = snapshots(spark, sf_dir).select("uid", "character_num", "band", "primary_role")
    c1 = s.groupBy("character_num", "band").agg(F.count(F.lit(1)).alias("c1"))
    r1 = s.where("primary_role is not null").groupBy("primary_role", "band").agg(F.count(F.lit(1)).alias("r1"), F.countDistinct("uid").alias("users"))
    x = s.select("character_num", "band", "primary_role").distinct().join(c1, ["character_num", "band"], "left").join(near_sums(c1, "character_num", "c1", "c2"), ["character_num", "band"], "left")
    x = x.join(r1, ["primary_role", "band"], "left").join(near_sums(r1, "primary_role", "r1", "r2"), ["primary_role", "band"], "left")
    enough = [(F.col(c) >= LEAST_COHORT, label, F.col(n)) for c, label, n in (("c1", "character-tier", "c1"), ("c2", "character-tier-adjacent", "c2"), ("r1", "role-tier", "users"), ("r2", "role-tier-adjacent", "r2"))]
    kind, samples = F.when(enough[0][0], enough[0][1]), F.when(enough[0][0], enough[0][2])
    for ok, label, n in enough[1:]:
        kind, samples = kind.when(ok, label), samples.when(ok, n)
    x = x.withColumns({"comparison": kind.otherwise("unavailable"), "samples": samples.otherwise(F.col("c1"))})
    return x.select("character_num", "band", "primary_role", "comparison", "samples", ((F.col("comparison") != "unavailable") & (F.col("samples") >= LEAST_COHORT)).alias("matched"))


@query(f"""WITH {SNAP}, {ADJACENT_SQL}, s AS (SELECT uid, coalesce(band, 'unranked') band, primary_role FROM sn LEFT JOIN pr7 USING (uid, character_num) LEFT JOIN bn USING (uid, character_num)),
r1 AS (SELECT primary_role, band, count(*) n, count(DISTINCT uid) users FROM s WHERE primary_role IS NOT NULL GROUP BY 1, 2), r2 AS (SELECT primary_role, adj.band, sum(n) n FROM r1 JOIN adj ON adj.near = r1.band GROUP BY 1, 2)
SELECT r1.primary_role, r1.band, CASE WHEN r1.n >= 30 THEN 'role-tier' WHEN r2.n >= 30 THEN 'role-tier-adjacent' ELSE 'unavailable' END AS comparison, CAST(CASE WHEN r1.n >= 30 THEN r1.users WHEN r2.n >= 30 THEN r2.n ELSE r1.n END AS BIGINT) samples FROM r1 LEFT JOIN r2 USING (primary_role, band)
UNION ALL SELECT DISTINCT NULL, band, 'unavailable', CAST(0 AS BIGINT) FROM s WHERE primary_role IS NULL""")
def overall_comparisons(spark, sf_dir):
    """The cohort of a role and band: its own with 30 rows, else its neighbours', else none; without a role none, of no players."""
    every = snapshots(spark, sf_dir)
    s = every.where("primary_role is not null")
    r1 = s.groupBy("primary_role", "band").agg(F.count(F.lit(1)).alias("r1"), F.countDistinct("uid").alias("users"))
    x = r1.join(near_sums(r1, "primary_role", "r1", "r2"), ["primary_role", "band"], "left")
    own, near = F.col("r1") >= LEAST_COHORT, F.col("r2") >= LEAST_COHORT
    known = x.select("primary_role", "band", F.when(own, "role-tier").when(near, "role-tier-adjacent").otherwise("unavailable").alias("comparison"), F.when(own, F.col("users")).when(near, F.col("r2")).otherwise(F.col("r1")).alias("samples"))
    none = every.where("primary_role is null").select("primary_role", "band").distinct()
    return known.unionByName(none.withColumns({"comparison": F.lit("unavailable"), "samples": F.lit(0).cast("long")}))


SHADOW = (
    "CASE WHEN p >= 99 THEN 'S+' WHEN p >= 95 THEN 'S' WHEN p >= 90 THEN 'S-' WHEN p >= 82 THEN 'A+' WHEN p >= 72 THEN 'A' WHEN p >= 60 THEN 'A-' WHEN p >= 48 THEN 'B+' WHEN p >= 36 THEN 'B' WHEN p >= 26 THEN 'B-' "
    "WHEN p >= 18 THEN 'C+' WHEN p >= 12 THEN 'C' WHEN p >= 7 THEN 'C-' WHEN p >= 4 THEN 'D+' WHEN p >= 2 THEN 'D' ELSE 'D-' END"
)


@query(f"""WITH {SNAP}, s AS (SELECT uid, character_num, win_rate, damage_per_minute v FROM sn), k AS (SELECT character_num, v, count(*) e FROM s WHERE v IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, sum(e) OVER (PARTITION BY character_num ORDER BY v) - e below, sum(e) OVER (PARTITION BY character_num) n FROM k),
x AS (SELECT character_num, v, n, e, 100.0 * (below + e / 2.0) / n p FROM b) SELECT character_num, {SHADOW} grade, CAST(sum(e) AS BIGINT) users, CAST(max(n) AS BIGINT) cohort, CASE WHEN max(n) >= 300 THEN 'high-confidence' WHEN max(n) >= 100 THEN 'full-percent' WHEN max(n) >= 50 THEN 'decile' WHEN max(n) >= 30 THEN 'tercile-only' ELSE 'disabled' END capability, min(v) lowest FROM x GROUP BY 1, 2""")
def shadow_grades(spark, sf_dir):
    """Grades by mid-rank percentile of damage per minute within a character, with what the cohort's size allows.

    Equal values are counted first, so a window runs over the distinct values of a character."""
    k = snapshots(spark, sf_dir).where("damage_per_minute is not null").groupBy("character_num", F.col("damage_per_minute").alias("v")).agg(F.count(F.lit(1)).alias("e"))
    w = Window.partitionBy("character_num")
    n = F.sum("e").over(w)
    p = F.lit(100.0) * (F.sum("e").over(w.orderBy("v")) - F.col("e") + F.col("e") / 2) / n
    x = k.select("character_num", "v", "e", n.alias("n"), steps(p, SHADOW_GRADES, LOWEST).alias("grade"))
    return x.groupBy("character_num", "grade").agg(F.sum("e").alias("users"), F.max("n").alias("cohort"), steps(F.max("n").cast("double"), COHORT_USERS, "disabled").alias("capability"), F.min("v").alias("lowest"))


@query(f"""WITH {PM}, s AS (SELECT uid, season - 1990 display_season, max(rp_after) rp FROM pm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY display_season ORDER BY rp DESC, uid) rank FROM s), k AS (SELECT *,
 CASE WHEN display_season <= 5 THEN 6800 WHEN display_season = 6 THEN 7000 WHEN display_season <= 8 THEN 7100 WHEN display_season = 9 THEN 7200 WHEN display_season = 10 THEN 7400 ELSE 7600 END mithril, CASE WHEN display_season <= 5 THEN 7500 WHEN display_season = 6 THEN 7700 WHEN display_season <= 8 THEN 7800 WHEN display_season = 9 THEN 7900 WHEN display_season = 10 THEN 0 ELSE 8300 END least_rp,
 CASE WHEN display_season <= 5 THEN 200 ELSE 300 END eternity, CASE WHEN display_season <= 5 THEN 201 WHEN display_season <= 9 THEN 301 ELSE 1 END demi_first, CASE WHEN display_season <= 5 THEN 700 ELSE 1000 END demigod FROM r),
m AS (SELECT *, rp >= mithril AND rp >= least_rp AND rank <= eternity e, rp >= mithril AND rp >= least_rp AND rank BETWEEN demi_first AND demigod d FROM k),
t AS (SELECT *, CASE WHEN e THEN 'Eternity' WHEN d THEN 'Demigod' WHEN rp >= mithril THEN 'Mithril' WHEN rp >= 6400 THEN 'Meteorite' WHEN rp >= 5000 THEN 'Diamond' WHEN rp >= 3600 THEN 'Platinum' WHEN rp >= 2400 THEN 'Gold' WHEN rp >= 1400 THEN 'Silver' WHEN rp >= 600 THEN 'Bronze' ELSE 'Iron' END tier FROM m)
SELECT uid, display_season, rp, rank, tier, e OR d AS leaderboard, CAST(CASE tier WHEN 'Meteorite' THEN CASE WHEN display_season = 10 THEN 4 - floor((rp - 6400) / 250) WHEN display_season >= 11 THEN 4 - floor((rp - 6400) / 300) END WHEN 'Diamond' THEN 4 - floor((rp - 5000) / 350) WHEN 'Platinum' THEN 4 - floor((rp - 3600) / 350) WHEN 'Gold' THEN 4 - floor((rp - 2400) / 300)
 WHEN 'Silver' THEN 4 - floor((rp - 1400) / 250) WHEN 'Bronze' THEN 4 - floor((rp - 600) / 200) WHEN 'Iron' THEN 4 - floor(rp / 150) END AS INTEGER) division FROM t""")
def season_tiers(spark, sf_dir):
    """Every player's tier of a season by that season's ladder, with the leaderboard's tiers by rank among its players.

    The rank of a player counts the players of the season with more points; points are aggregated first, and a window
    runs over the distinct points of a season only."""
    s = player_match(spark, sf_dir).groupBy("uid", (F.col("season") - 1990).alias("display_season")).agg(F.max("rp_after").alias("rp"))
    points = s.groupBy("display_season", "rp").agg(F.count(F.lit(1)).alias("n"))
    above = points.select("display_season", "rp", (F.sum("n").over(Window.partitionBy("display_season").orderBy(F.desc("rp"))) - F.col("n")).alias("above"))
    s = s.join(above, ["display_season", "rp"]).withColumn("rank", F.col("above") + F.row_number().over(Window.partitionBy("display_season", "rp").orderBy("uid")))
    return s.select("uid", "display_season", "rp", "rank", ladder_tier(F.col("rp"), F.col("display_season"), F.col("rank")).alias("t")).select("uid", "display_season", "rp", "rank", "t.*")


@query(f"""WITH {PM}, g AS (SELECT uid, count(*) n, avg(kills) * 8 + 20 raw FROM pm WHERE game_mode = 'rank' GROUP BY 1)
SELECT uid, n, CASE WHEN n >= 40 THEN 'high' WHEN n >= 20 THEN 'medium' WHEN n >= 10 THEN 'low' WHEN n >= 5 THEN 'provisional' ELSE 'insufficient' END confidence, {R4.format("65 + (raw - 65) * CASE WHEN n >= 20 THEN 1 ELSE n / (n + 1.0) END")} score FROM g""")
def confidence_scores(spark, sf_dir):
    """A raw score pulled to 65 by n / (n + 1) under twenty matches, and the label of the sample."""
    n = F.col("n")
    g = rank_only(player_match(spark, sf_dir)).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), (F.avg("kills") * 8 + 20).alias("raw"))
    return g.select("uid", "n", steps(n.cast("double"), CONFIDENCE, "insufficient").alias("confidence"), js_round(F.lit(65) + (F.col("raw") - 65) * F.when(n >= 20, 1.0).otherwise(n / (n + 1.0)), 4).alias("score"))


@query(f"""WITH {SNAP}, s AS (SELECT uid, character_num, average_placement v FROM sn), k AS (SELECT a.uid, a.character_num, 100.0 * (count(*) FILTER (b.v > a.v) + count(*) FILTER (b.v = a.v) / 2.0) / count(*) p, count(*) n FROM s a JOIN s b ON a.character_num = b.character_num GROUP BY 1, 2, a.v) SELECT uid, character_num, {R4.format("p")} percentile, n FROM k""")
def directed_percentiles(spark, sf_dir):
    """Percentiles of a measure of which less is better: the mid-rank of its negative."""
    s = snapshots(spark, sf_dir).select("uid", "character_num", (-F.col("average_placement")).alias("v"))
    r = with_ranks(s, ["character_num"], "v").select("uid", "character_num", "v", F.col("before"), F.col("n").alias("same"), F.col("total").alias("n"))
    return r.select("uid", "character_num", js_round(midrank(F.col("before"), F.col("same"), F.col("n")), 4).alias("percentile"), "n")
