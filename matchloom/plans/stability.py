"""Stability of baselines: bootstrap, train against validation, holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.core import js_round, steps
from matchloom.functions.fixed import (
    ANCHOR_CV, ANCHOR_GAP, ANCHOR_RATE, BASELINE_CV, BASELINE_DRIFT, BOOTSTRAP_ITERATIONS, BOOTSTRAP_SEED, LEAST_MEAN, LEAST_VALIDATION, P90_DRIFT, POSITIVE_READINESS, RANGE_RATIO,
    READINESS, TRAIN_SHARE,
)
from matchloom.operators.counted import counted, numbered, quantile, ranked
from matchloom.operators.resampling import replicates
from matchloom.sources.facts import PM, player_match
from matchloom.sources.scratch import shared_folder

from .registry import query

R6 = "floor(({0}) * 1000000 + 0.5) / 1000000"
GROUP = ["tier", "role", "metric"]
TIME = ["played_at", "game_id", "slot", "part_id", "source_id", "kills", "updated_at"]


def tanking_efficiency(taken: Column, deaths: Column) -> Column:
    """Damage taken for each life: null without either."""
    return F.when(deaths.isNotNull(), taken / (F.lit(1.0) + F.greatest(F.lit(0), deaths)))


def measures(rows: DataFrame) -> DataFrame:
    """A row per row and metric: one that is never zero, and one that mostly is."""
    metric = lambda name, v: F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value"))
    mostly_zero = F.when(F.col("kills") >= 9, F.col("kills") - 8).otherwise(0)
    both = F.explode(F.array(metric("tanking", tanking_efficiency(F.col("damage"), F.col("deaths"))), metric("recovery", mostly_zero))).alias("m")
    return rows.select(*(c for c in rows.columns if c not in ("damage", "deaths")), both).select("*", "m.metric", "m.value").drop("m")


def zero_heavy(metric: Column) -> Column:
    return metric == "recovery"


def readiness(n: Column, positives: Column, heavy: Column) -> Column:
    """unusable, experimental, provisional or ready, by samples and, for measures that are mostly zero, positive ones."""
    order = F.array(*(F.lit(x) for x in ("unusable", "experimental", "provisional", "ready")))
    place = lambda c, cuts: F.array_position(order, steps(c.cast("double"), cuts, "unusable"))
    least = F.least(place(n, READINESS), F.when(heavy, place(positives, POSITIVE_READINESS)).otherwise(F.lit(4)))
    return F.element_at(order, least.cast("int"))


def reasons(*named: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, in order, comma-joined; a null condition does not hold."""
    return F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in named))


def bootstrap(values: DataFrame, iterations: int = BOOTSTRAP_ITERATIONS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """A row per group of GROUP: what its replicates say of its mean and its 90 % point, and why it is not stable."""
    spread = replicates(values, GROUP, "value", iterations, seed)
    q = lambda c, p: F.percentile(c, F.lit(p))  # noqa: E731  of a group's replicates, whose number is fixed
    cv = lambda c: F.when(F.abs(F.avg(c)) > LEAST_MEAN, F.stddev_pop(c) / F.abs(F.avg(c)))
    per = spread.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("iterations"), F.avg("mean").alias("baseline_mean"), F.stddev_pop("mean").alias("baseline_sd"), cv("mean").alias("baseline_cv"), F.avg("anchor").alias("upper_mean"),
        F.stddev_pop("anchor").alias("upper_sd"), cv("anchor").alias("upper_cv"), (F.count_if(F.col("anchor") > F.col("mean") + F.lit(ANCHOR_GAP)) / F.lit(iterations)).alias("anchor_rate"),
        q("mean", 0.05).alias("baseline_p05"), q("mean", 0.95).alias("baseline_p95"), q("anchor", 0.05).alias("upper_p05"), q("anchor", 0.95).alias("upper_p95"),
    )
    real = values.where(F.col("value").isNotNull())
    counts = real.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("positives"))
    x = counts.join(per, GROUP)
    heavy, c = zero_heavy(F.col("metric")), F.col
    ready = readiness(c("n"), c("positives"), heavy)
    low_rate = c("anchor_rate") < ANCHOR_RATE
    why = reasons(
        ("readiness-insufficient", ~ready.isin("provisional", "ready")), ("sample-insufficient", c("n") < 30), ("bootstrap-incomplete", c("iterations") < iterations),
        ("positive-sample-insufficient", heavy & (c("positives") < 10)), ("baseline-cv-high", ~heavy & (c("baseline_cv") > BASELINE_CV)), ("upper-anchor-cv-high", ~heavy & (c("upper_cv") > ANCHOR_CV)),
        ("positive-anchor-rate-low", low_rate), ("baseline-range-invalid", heavy & ~(c("baseline_p95") > c("baseline_p05") + F.lit(ANCHOR_GAP))),
        ("upper-range-invalid", heavy & ~(c("upper_p95") > c("upper_p05") + F.lit(ANCHOR_GAP))), ("baseline-range-wide", ~heavy & (c("baseline_p05") > 0) & (c("baseline_p95") / c("baseline_p05") > RANGE_RATIO)),
    )
    return x.select("*", ready.alias("readiness"), why.alias("reasons")).withColumn("stable", F.col("reasons") == "")


def train_validation(parts: DataFrame) -> DataFrame:
    """A row per group: capped means and 90 % points of both parts (a column `part`: train or validation), and why they disagree."""
    keys = [*GROUP, "part"]
    counts = ranked(counted(parts.where(F.col("value").isNotNull()), keys, "value"), keys, "value")
    limits = counts.groupBy(*keys).agg(quantile("value", 0.95).alias("cap"), quantile("value", 0.9).alias("p90"))
    side = counts.join(limits, keys).groupBy(*keys).agg((F.sum(F.least("value", "cap") * F.col("n")) / F.sum("n")).alias("mean"), F.max("p90").alias("p90"), F.sum("n").alias("n"))
    of = lambda part, v: F.max(F.when(F.col("part") == part, F.col(v)))
    x = side.groupBy(*GROUP).agg(*(of(p, v).alias(f"{p}_{v}") for p in ("train", "validation") for v in ("mean", "p90", "n")))
    x = x.fillna(0, ["train_n", "validation_n"])
    c, gap = F.col, F.lit(ANCHOR_GAP)
    drift = lambda v: F.abs(c(f"train_{v}") - c(f"validation_{v}")) / F.greatest(F.abs(c(f"train_{v}")), gap)
    missing = c("train_mean").isNull() | c("validation_mean").isNull()
    why = reasons(
        ("validation-sample-insufficient", c("validation_n") < LEAST_VALIDATION), ("anchor-missing", missing), ("train-anchor-gap-invalid", ~missing & ~(c("train_p90") > c("train_mean") + gap)),
        ("validation-anchor-gap-invalid", ~missing & ~(c("validation_p90") > c("validation_mean") + gap)), ("baseline-drift-high", drift("mean") > BASELINE_DRIFT), ("p90-drift-high", drift("p90") > P90_DRIFT),
    )
    return x.select("*", drift("mean").alias("mean_drift"), drift("p90").alias("p90_drift"), why.alias("reasons")).withColumn("stable", F.col("reasons") == "")


def _facts(spark, sf_dir) -> DataFrame:
    return player_match(spark, sf_dir).select("tier", "role", "damage", "deaths", *TIME)


def _parts(spark, sf_dir) -> DataFrame:
    """The facts with their part: the first 70 % of a tier's and role's rows by time train."""
    rows = numbered(_facts(spark, sf_dir), ["tier", "role"], [*TIME, "deaths"], shared_folder(spark))
    part = F.when(F.col("number") <= F.floor(F.col("total") * F.lit(TRAIN_SHARE)), "train").otherwise("validation")
    return measures(rows.select("tier", "role", "damage", "deaths", "kills", part.alias("part")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(js_round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(None)
def metric_bootstrap(spark, sf_dir):
    """500 replicates of each tier's, role's and metric's values: how far its mean and its 90 % point vary. Tested against a plain loop with the same seed."""
    return _rounded(bootstrap(measures(_facts(spark, sf_dir).select("tier", "role", "damage", "deaths", "kills"))))


SPLIT_SQL = f"""{PM}, r AS (SELECT *, row_number() OVER (PARTITION BY tier, role ORDER BY {", ".join(TIME)}, deaths) i, count(*) OVER (PARTITION BY tier, role) total FROM pm),
v AS (SELECT tier, role, CASE WHEN i <= floor(total * 0.7) THEN 'train' ELSE 'validation' END part, unnest([{{'metric': 'tanking', 'value': damage / (1 + greatest(0, deaths))}}, {{'metric': 'recovery', 'value': CASE WHEN kills >= 9 THEN kills - 8.0 ELSE 0.0 END}}]) m FROM r),
w AS (SELECT tier, role, m.metric AS metric, part, CAST(m.value AS DOUBLE) AS value FROM v WHERE m.value IS NOT NULL),
q AS (SELECT tier, role, metric, part, quantile_cont(value, 0.95) cap, quantile_cont(value, 0.9) p90, count(*) n FROM w GROUP BY ALL),
s AS (SELECT tier, role, metric, part, avg(least(value, cap)) mean, max(p90) p90, max(n) n FROM w JOIN q USING (tier, role, metric, part) GROUP BY ALL),
x AS (SELECT tier, role, metric, max(mean) FILTER (part = 'train') tm, max(p90) FILTER (part = 'train') tp, coalesce(max(n) FILTER (part = 'train'), 0) tn, max(mean) FILTER (part = 'validation') vm, max(p90) FILTER (part = 'validation') vp, coalesce(max(n) FILTER (part = 'validation'), 0) vn FROM s GROUP BY ALL),
y AS (SELECT *, abs(tm - vm) / greatest(abs(tm), 1e-6) md, abs(tp - vp) / greatest(abs(tp), 1e-6) pd FROM x),
z AS (SELECT *, concat_ws(',', CASE WHEN vn < 30 THEN 'validation-sample-insufficient' END, CASE WHEN tm IS NULL OR vm IS NULL THEN 'anchor-missing' END, CASE WHEN tm IS NOT NULL AND vm IS NOT NULL AND NOT tp > tm + 1e-6 THEN 'train-anchor-gap-invalid' END,
 CASE WHEN tm IS NOT NULL AND vm IS NOT NULL AND NOT vp > vm + 1e-6 THEN 'validation-anchor-gap-invalid' END, CASE WHEN md > 0.25 THEN 'baseline-drift-high' END, CASE WHEN pd > 0.3 THEN 'p90-drift-high' END) reasons FROM y)"""


@query(
    f"WITH {SPLIT_SQL} SELECT tier, role, metric, {R6.format('tm')} train_mean, {R6.format('tp')} train_p90, CAST(tn AS BIGINT) train_n, {R6.format('vm')} validation_mean, {R6.format('vp')} validation_p90, CAST(vn AS BIGINT) validation_n, {R6.format('md')} mean_drift, {R6.format('pd')} p90_drift, reasons, reasons = '' stable FROM z"
)
def train_validation_stability(spark, sf_dir):
    """Do the first 70 % of a group's rows by time agree with the rest on its capped mean and 90 % point?"""
    return _rounded(train_validation(_parts(spark, sf_dir)))


@query(None)
def live_eligibility(spark, sf_dir):
    """Whether a group's metric may be used live: enough samples, a stable bootstrap, and agreement of train and validation. Tested with the bootstrap's loop."""
    parts = _parts(spark, sf_dir)
    a = bootstrap(parts).select(*GROUP, "readiness", F.col("stable").alias("bootstrap_stable"), F.col("reasons").alias("bootstrap_reasons"))
    b = train_validation(parts).select(*GROUP, F.col("stable").alias("split_stable"), F.col("reasons").alias("split_reasons"))
    return a.join(b, GROUP).withColumn("eligible", F.col("readiness").isin("provisional", "ready") & F.col("bootstrap_stable") & F.col("split_stable"))
