"""Curves over match length by role: capped means at fixed minutes, pulled to the curve of all roles, made monotone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.core import js_round
from matchloom.functions.fixed import CURVE_MINUTES

from .counted import quantile, ranked
from .statistics import isotonic

#: Values beyond this share of a group are cut to the value that reaches it.
SHARE = 0.95


def bucket(seconds: Column) -> Column:
    """Which five minutes a match ended in: 0 to 6, the last open; null without a length."""
    return F.when(seconds > 0, F.least(F.floor(seconds / F.lit(300.0)), F.lit(6)).cast("int"))


def capped(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean of the values up to the nearest-rank 95 % point, and count; counts: keys, value, n and range, which never falls as value rises.

    Ranges are summed first. Only the range that holds the point has its values put in order, so no task holds more of a group than one range."""
    r = ranked(counts.groupBy(*keys, "range").agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("sum")), keys, "range")
    r = r.withColumn("below", F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    edge = F.min(F.when(F.col("before") + F.col("n") >= F.col("total") * F.lit(SHARE), F.struct("range", F.col("before").alias("_before"), "below", F.col("total").alias("count"))))
    edges = r.groupBy(*keys).agg(edge.alias("_e")).select(*keys, "_e.*")
    inside = counts.join(F.broadcast(edges), [*keys, "range"]).groupBy(*keys, "value", "_before", "below", "count").agg(F.sum("n").alias("n"))
    c = ranked(inside, keys, "value")
    reached = F.when(F.col("_before") + F.col("before") + F.col("n") >= F.col("count") * F.lit(SHARE), F.col("value"))
    c = c.withColumn("top", F.min(reached).over(Window.partitionBy(*keys)))
    above = F.col("count") - F.col("_before") - F.sum("n")
    mean = (F.col("below") + F.sum(F.least("value", "top") * F.col("n")) + above * F.col("top")) / F.col("count")
    return c.groupBy(*keys, "top", "_before", "below", "count").agg(mean.alias("mean")).select(*keys, "mean", "count")


def shrink_constants(counts: DataFrame, keys: list[str]) -> DataFrame:
    """k of each scenario: between the 50 % and the 70 % point of the cells' sample counts, 30 at least."""
    cells = counts.groupBy(*keys, "role", "metric", "bucket").agg(F.sum("n").alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    k = ranked(cells, keys, "value").groupBy(*keys).agg(js_round((quantile("value", 0.5) + quantile("value", 0.7)) / 2).alias("k"))
    return k.withColumn("k", F.greatest(F.lit(30.0), F.col("k")))


def time_curves(counts: DataFrame, roles: DataFrame, scenario: str = "scenario", k: float | None = None) -> DataFrame:
    """A row per scenario, role, metric and minute. counts: scenario, role, metric, bucket, value, n, and range where values are dealt out by size; roles: the roles to have a curve.

    Works on counted values; what is joined or put in order has a row per curve and minute."""
    keys = [scenario, "metric", "minute"]
    at = counts.withColumn("minute", F.least(F.lit(30), (F.col("bucket") + 1) * 5))
    at = at if "range" in at.columns else at.withColumn("range", F.lit(0))
    own = capped(at, ["role", *keys]).select("role", *keys, F.col("mean").alias("raw"), F.col("count").alias("samples"))
    whole = capped(at, keys).select(*keys, F.col("mean").alias("all"), F.col("count").alias("all_samples"))
    minutes = F.explode(F.array(*map(F.lit, CURVE_MINUTES))).alias("minute")
    grid = counts.select(scenario, "metric").distinct().join(F.broadcast(roles), F.lit(True)).select(scenario, "metric", "role", minutes)
    constants = shrink_constants(counts, [scenario]) if k is None else counts.select(scenario).distinct().withColumn("k", F.lit(float(k)))
    p = grid.join(own, ["role", *keys], "left").join(whole, keys, "left").join(constants, scenario)
    zero = F.col("minute") == 0
    n, alln = (F.when(zero, 1).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in ("samples", "all_samples"))
    fallback = F.when(zero, 0.0).otherwise(F.coalesce(F.col("all"), F.lit(0.0)))
    weight = F.when(zero, 1.0).when(n == 0, 0.0).otherwise(n / (n + F.col("k")))
    source = F.when((F.col("minute") == 30) & (alln == 0), "extrapolated").when(zero, "observed").when(n == 0, "global-fallback").when(n < F.col("k"), "blended").otherwise("observed")
    raw = F.when(zero, 0.0).otherwise(F.col("raw"))
    p = p.select("role", *keys, raw.alias("raw"), fallback.alias("fallback"), n.alias("samples"), alln.alias("all_samples"), weight.alias("weight"), source.alias("source"), "k")
    p = p.withColumn("blended", F.coalesce("raw", "fallback") * F.col("weight") + F.col("fallback") * (1 - F.col("weight"))).withColumn("w", F.greatest(F.lit(1.0), (F.col("samples") + F.col("all_samples")).cast("double")))
    curve = [scenario, "role", "metric"]
    fitted = isotonic(p.select(*curve, "minute", "blended", "w"), curve, "minute", "blended", "w")
    before = fitted.select(*curve, (F.col("minute") + 5).alias("minute"), F.col("fitted").alias("previous"))
    out = p.join(fitted, [*curve, "minute"]).join(before, [*curve, "minute"], "left")
    return out.withColumn("expected", F.when(F.col("source") == "extrapolated", F.col("previous")).otherwise(F.col("fitted"))).drop("previous", "fitted", "w", "blended")


def as_points(curves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, minutes and values: each curve as two arrays."""
    points = F.sort_array(F.collect_list(F.struct(F.col("minute").cast("double").alias("x"), F.col("expected").alias("y"))))
    c = curves.groupBy(*keys).agg(points.alias("p"))
    return c.select(*keys, F.transform("p", lambda q: q["x"]).alias("minutes"), F.transform("p", lambda q: q["y"]).alias("values"))
