"""Curves, their holdout and the lookups they need, against plain loops."""

import bisect
import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.core import bracketed, last_not_above, string_hash
from matchloom.operators.curves import time_curves
from matchloom.plans import registry

MINUTES = (0, 5, 10, 15, 20, 25, 30)


def fnv(text):
    h, raw = 2166136261, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2])) * 16777619 % 2**32
    return h


def line(points, x):
    if x <= points[0][0]:
        return points[0][1]
    for (a, y), (b, z) in zip(points, points[1:]):
        if x <= b:
            return y + (z - y) * (x - a) / (b - a)
    return points[-1][1]


def median(values):
    v, p = sorted(values), (len(values) - 1) / 2
    return (v[math.floor(p)] + v[math.ceil(p)]) / 2


def capped(values):
    cap = sorted(values)[math.ceil(len(values) * 0.95) - 1]
    return sum(min(v, cap) for v in values) / len(values)


def curves_by_loop(rows, roles, k=None):
    """rows: (role, seconds, metric, value); {(role, metric): [(minute, value)]}, with everything known of a point."""
    own, whole, cells = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for role, seconds, metric, v in rows:
        if seconds >= 480 and v >= 0:
            b = min(6, seconds // 300)
            own[role, metric, min(30, 5 * (b + 1))].append(v)
            whole[metric, min(30, 5 * (b + 1))].append(v)
            cells[role, metric, b] += 1
    counts = sorted(cells.values())
    q = lambda p: counts[math.floor(p)] + (counts[math.ceil(p)] - counts[math.floor(p)]) * (p - math.floor(p))
    k = k or max(30, math.floor((q((len(counts) - 1) * 0.5) + q((len(counts) - 1) * 0.7)) / 2 + 0.5))
    out, facts = {}, {}
    for role in roles:
        for metric in {m for m, _ in whole}:
            points = []
            for minute in MINUTES:
                a, b = own.get((role, metric, minute), []), whole.get((metric, minute), [])
                n, m, fallback = (1, 1, 0.0) if minute == 0 else (len(a), len(b), capped(b) if b else 0.0)
                w = 1.0 if minute == 0 else n / (n + k) if n else 0.0
                raw = 0.0 if minute == 0 else capped(a) if a else None
                source = "observed" if minute == 0 else "global-fallback" if not n else "blended" if n < k else "observed"
                source = "extrapolated" if minute == 30 and not m else source
                points.append(((fallback if raw is None else raw) * w + fallback * (1 - w), max(1, n + m), raw, fallback, n, m, w, source))
            mean = lambda i, j: sum(p[0] * p[1] for p in points[i : j + 1]) / sum(p[1] for p in points[i : j + 1])
            fit = [max(min(mean(i, j) for j in range(x, 7)) for i in range(x + 1)) for x in range(7)]
            fit[6] = fit[5] if points[6][-1] == "extrapolated" else fit[6]
            out[role, metric] = list(zip(MINUTES, fit))
            facts[role, metric] = [(*p[2:], k) for p in points]
    return out, facts


@pytest.fixture(scope="module")
def matches(spark, sf):
    from matchloom.sources.facts import player_match

    rows = player_match(spark, sf).where("game_mode = 'rank'").collect()
    games = collections.Counter(r.uid for r in rows)
    top = {u for u, _ in sorted(games.items(), key=lambda x: (-x[1], x[0]))[:5]}
    return [(r.role, r.duration, m, float(r[m]), fnv(str(r.game_id)) % 5 == 0, r.season == 1996, r.uid in top) for r in rows for m in ("damage", "kills") if r[m] is not None]


def test_time_curve_points_equal_a_loop(spark, sf, matches):
    fit, facts = curves_by_loop([m[:4] for m in matches], range(4))
    got = {(r.role, r.metric, r.minute): r for r in registry.queries()["time_curve_points"](spark, sf).collect()}
    assert len(got) == 4 * 2 * 7
    for (role, metric), points in fit.items():
        lengths = [max(0.0, line(points, s / 60)) for r, s, m, *_ in matches if r == role and m == metric and s >= 480]
        mean = sum(lengths) / len(lengths)
        for (minute, y), (raw, fallback, n, m, w, source, k) in zip(points, facts[role, metric]):
            r = got[role, metric, minute]
            assert (r.samples, r.all_samples, r.source, r.k) == (n, m, source, k)
            for a, b in ((r.raw, raw), (r.fallback, fallback), (r.weight, w), (r.expected, y), (r.normalizer, mean), (r.multiplier, y / mean)):
                assert a == b if b is None else a == pytest.approx(b, rel=1e-6, abs=2e-6)


def test_holdout_equals_a_loop(spark, sf, matches):
    roles = range(4)
    everything, _ = curves_by_loop([m[:4] for m in matches], roles)
    changes = {r.scenario: r for r in registry.queries()["holdout_changes"](spark, sf).collect()}
    for i, name in ((4, "train"), (5, "without season"), (6, "without top players")):
        kept, _ = curves_by_loop([m[:4] for m in matches if not m[i]], roles)
        wanted = max(abs(b - a) / max(1, abs(a)) for key in everything for (_, a), (_, b) in zip(everything[key], kept[key]))
        assert changes[name].largest_change == pytest.approx(wanted, abs=2e-6) and changes[name].removed_rows == sum(m[i] for m in matches if m[2] == "kills") > 0
    train, _ = curves_by_loop([m[:4] for m in matches if not m[4]], roles)
    ratios = collections.defaultdict(list)
    for role, s, metric, v, held, *_ in matches:
        if held and s > 0 and (e := line(train[role, metric], s / 60)) > 0:
            ratios["length", str(min(6, s // 300)), metric].append(v / e)
            if s >= 480:
                ratios["role", str(role), metric].append(v / e)
    got = {(r.scope, r.key, r.metric): r for r in registry.queries()["holdout_ratios"](spark, sf).collect()}
    assert set(got) == set(ratios)
    for k, v in ratios.items():
        assert got[k].n == len(v) and got[k].median == pytest.approx(median(v), rel=1e-6, abs=2e-6)


def test_curve_cases(spark):
    """No matches of thirty minutes: the last point is carried on; a role with few matches leans on all; one without takes theirs."""
    rows = [("all", "a", "d", m, float(100 * m + i), 1) for m in (1, 2, 3, 4) for i in range(60)] + [("all", "b", "d", 2, 900.0, 3)]
    c = spark.createDataFrame(rows, "scenario string, role string, metric string, bucket int, value double, n long")
    got = {(r.role, r.minute): r for r in time_curves(c, spark.createDataFrame([("a",), ("b",), ("z",)], "role string"), k=30.0).collect()}
    assert [got["a", m].source for m in MINUTES] == ["observed", "global-fallback", "observed", "observed", "observed", "observed", "extrapolated"]
    assert got["b", 15].source == "blended" and got["b", 15].weight == pytest.approx(3 / 33) and got["z", 15].source == "global-fallback" and got["z", 15].expected == pytest.approx(got["z", 15].fallback)
    for role in "abz":
        values = [got[role, m].expected for m in MINUTES]
        assert values == sorted(values) and values[6] == values[5] and all(map(math.isfinite, values))


def test_brackets_by_binary_search(spark):
    """One to many points; below, at, between and above them; nulls and no points."""
    rnd = random.Random(8)
    rows = []
    for n in (0, 1, 2, 3, 5, 8, 13, 200):
        xs = sorted(rnd.sample(range(1000), n))
        for x in [None, -1.0, 1000.0, *(rnd.choice(xs) + rnd.choice([0, 0.5]) for _ in range(20 if n else 0))]:
            rows.append((None if x is None else float(x), [float(v) for v in xs], [float(v * v % 97) for v in xs]))
    rows.append((1.0, None, None))
    df = spark.createDataFrame(rows, "x double, xs array<double>, ys array<double>")
    for r in df.select("*", last_not_above(F.col("x"), F.col("xs")).alias("at"), bracketed(F.col("x"), F.col("xs"), F.col("ys")).alias("y")).collect():
        if r.x is None or not r.xs:
            assert r.at == (0 if r.x is not None and r.xs == [] else None) and r.y is None
        else:
            assert r.at == bisect.bisect_right(r.xs, r.x) and r.y == pytest.approx(line(list(zip(r.xs, r.ys)), r.x))


def test_string_hash(spark):
    texts = ["", "a", "game-12", "1234567", "é漢😀\U0010ffff", "x" * 300, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", string_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [None if t is None else fnv(t) for t in texts]
