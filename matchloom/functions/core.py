"""Column functions with the null, finite and rounding rules of match statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HASH_FACTOR, HASH_OFFSET, TIERS


def finite(c: Column) -> Column:
    """Not null, not NaN and not infinite."""
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_round(c: Column, digits: int = 0) -> Column:
    """Half toward plus infinity."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def safe_kda(kills: Column, assists: Column, deaths: Column) -> Column:
    """(k + a) / d to two digits; k + a without deaths."""
    both = (kills + assists).cast("double")
    return js_round(F.when(deaths <= 0, both).otherwise(F.try_divide(both, deaths.cast("double"))), 2)


def per_minute(value: Column, seconds: Column) -> Column:
    return js_round(F.when(seconds > 0, value / (seconds / F.lit(60.0))), 6)


def deaths_per_10m(deaths: Column, seconds: Column) -> Column:
    return js_round(F.when(seconds > 0, deaths / (seconds / F.lit(600.0))), 6)


def steps(c: Column, cuts: list[tuple[float, str]], other: str) -> Column:
    """The label of the first cut that is not above c; null for null."""
    out = reduce(lambda acc, cut: acc.when(c >= F.lit(cut[0]), F.lit(cut[1])), cuts[1:], F.when(c >= F.lit(cuts[0][0]), F.lit(cuts[0][1])))
    return F.when(c.isNotNull(), out.otherwise(F.lit(other)))


def duration_bucket(seconds: Column) -> Column:
    return steps(seconds / F.lit(60.0), [(30.0, "30+"), (25.0, "25-30"), (20.0, "20-25"), (15.0, "15-20")], "<15")


def placement_bucket(place: Column) -> Column:
    return F.when(place <= 1, "1").when(place <= 3, "2-3").when(place <= 6, "4-6").when(place.isNotNull(), "7+")


def tier_of(rp: Column) -> Column:
    """Grading's key of the current season's tier; unranked without points."""
    return F.when(rp.isNull() | (rp <= 0), "unranked").otherwise(steps(rp, TIERS, "iron"))


def participation_capped(kills: Column, assists: Column, team: Column) -> Column:
    """(k + 0.7 a) / team kills, at most 1; null without team kills."""
    return F.when(team > 0, F.least((kills + F.lit(0.7) * assists) / team, F.lit(1.0)))


def participation_raw(kills: Column, assists: Column, team: Column) -> Column:
    return F.when(team > 0, (kills + assists) / team)


def shrink(value: Column, prior: Column, n: Column, k: float) -> Column:
    """n / (n + k) of the value, the rest of the prior."""
    w = n / (n + F.lit(float(k)))
    return w * value + (F.lit(1.0) - w) * prior


def relative_score(actual: Column, expected: Column, higher_better: bool = True) -> Column:
    """65 + 45 times the relative difference, between 20 and 100."""
    diff = (actual - expected) / F.greatest(F.abs(expected), F.lit(1e-6))
    return js_round(clamp(F.lit(65.0) + F.lit(45.0) * (diff if higher_better else -diff), 20, 100), 4)


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through sorted points, flat beyond the ends."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))


def kst_day(ts: Column) -> Column:
    """The day in Asia/Seoul of a UTC instant, as yyyy-MM-dd."""
    return F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")


def nickname(c: Column) -> Column:
    """Trimmed and lower-cased; null under two characters."""
    t = F.lower(F.trim(c))
    return F.when(F.length(t) >= 2, t)


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def string_hash(c: Column) -> Column:
    """The 32-bit hash of a string's UTF-16 units: exclusive or with each unit, then times a prime; as a long."""
    text = F.hex(F.encode(c, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(text) / 4 - 1).cast("int")), lambda i: F.conv(F.substring(text, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"))
    step = lambda h, u: h.bitwiseXOR(u) * F.lit(HASH_FACTOR).cast("long") % F.lit(1 << 32)
    return F.when(c == "", F.lit(HASH_OFFSET)).otherwise(F.aggregate(units, F.lit(HASH_OFFSET).cast("long"), step)).cast("long")


def last_not_above(x: Column, points: Column) -> Column:
    """The place, from 1, of the last element of a sorted array that is not above x (0: none), by binary search."""
    halve = lambda s, _: F.when(F.get(points, ((s["low"] + s["high"]) / 2).cast("int")) <= x, F.struct((F.floor((s["low"] + s["high"]) / 2) + 1).cast("int").alias("low"), s["high"].alias("high"))).otherwise(
        F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high"))
    )
    n = F.size(points)
    start = F.struct(F.lit(0).alias("low"), n.alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1.0)).cast("int"))
    return F.when(x.isNull() | points.isNull(), None).when(n == 0, 0).otherwise(F.aggregate(steps, start, lambda s, i: F.when(s["low"] < s["high"], halve(s, i)).otherwise(s), lambda s: s["low"]))


def bracketed(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear through the points of two arrays, xs rising and different; flat beyond the ends."""
    at = last_not_above(x, xs)
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    return F.when(at == 0, F.get(ys, F.lit(0))).when(at >= F.size(xs), F.get(ys, F.size(ys) - 1)).otherwise(y0 + (y1 - y0) * ((x - x0) / (x1 - x0)))
