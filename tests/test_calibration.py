"""Anchors by higher tiers and grades by percentile: cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.plans import calibration as c


def anchored(spark, value, own, higher, more=True):
    cells = [(i, t, 30, v, v, v, v) for i, (t, v) in enumerate(higher)]
    df = spark.createDataFrame([(value, own, cells)], "value double, own double, higher array<struct<place int, tier string, n long, kills double, assists double, damage double, deaths double>>")
    r = df.select(c.anchored(F.col("value"), F.col("own"), F.col("higher"), "deaths" if not more else "kills", more).alias("a")).first().a
    return r.score, r["mode"]


def test_anchored_scores(spark):
    """Below the own tier; on the way to the first tier that is ahead; a tier too near is passed over; no tier ahead; fewer is better; nothing known."""
    assert anchored(spark, 4.0, 5.0, [("in1000", 8.0)]) == (56.0, "tier-only")
    assert anchored(spark, 5.0, 5.0, [("in1000", 8.0)]) == (65.0, "tier-only")
    assert anchored(spark, 6.5, 5.0, [("in1000", 8.0)]) == (76.5, "elite")
    assert anchored(spark, 8.0, 5.0, [("in1000", 8.0)]) == (88.0, "elite")
    assert anchored(spark, 6.0, 5.0, [("in1000", 5.2), ("mithril_plus", 7.0)]) == (76.5, "alternate-elite")
    assert anchored(spark, 5.75, 5.0, [("in1000", 4.0), ("mithril_plus", 5.1)]) == (76.5, "tier-only")
    assert anchored(spark, 5.75, 5.0, []) == (76.5, "tier-only") and anchored(spark, 50.0, 5.0, []) == (100.0, "tier-only")
    assert anchored(spark, 2.5, 3.0, [("mithril_plus", 2.0)], more=False) == (76.5, "alternate-elite")
    assert anchored(spark, 3.6, 3.0, [("mithril_plus", 2.0)], more=False) == (56.0, "tier-only")
    assert anchored(spark, None, 3.0, []) == (None, "missing") and anchored(spark, 1.0, None, []) == (None, "missing")


def test_candidates_are_higher_tiers_in_order(spark):
    rows = [("gold", 1, 2, 40), ("mithril_plus", 1, 2, 31), ("iron", 1, 2, 99), ("diamond_plus", 1, 2, 50), ("gold", 7, 7, 60)]
    found = spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 1.0) for r in rows], "tier string, character_num int, weapon int, n long, kills double, assists double, damage double, deaths double")
    got = {(r.tier, r.character_num): [x.tier for x in r.higher] for r in c.candidates(found).collect()}
    assert got["iron", 1] == ["mithril_plus", "diamond_plus", "gold"] and got["platinum", 1] == ["mithril_plus", "diamond_plus"] and got["diamond_plus", 1] == ["mithril_plus"]
    assert ("mithril_plus", 1) not in got and got["silver", 7] == ["gold"] and ("gold", 7) not in got


def test_percentile_and_back(spark):
    rnd = random.Random(3)
    rows = []
    for n in (1, 2, 5, 40):
        for _ in range(8):
            points = sorted(float(rnd.randrange(12)) for _ in range(n))
            rows.append((rnd.choice([*points, -1.0, 5.5, 99.0]), rnd.random(), points))
    df = spark.createDataFrame([*rows, (None, None, [1.0, 2.0])], "x double, p double, points array<double>")
    for r in df.select("*", c.percentile_in(F.col("x"), F.col("points")).alias("at"), c.value_at(F.col("p"), F.col("points")).alias("v")).collect():
        n = len(r.points)
        if r.x is None:
            assert r.at is None and r.v is None
            continue
        low, high = sum(v < r.x for v in r.points), sum(v <= r.x for v in r.points)
        assert r.at == pytest.approx(0.5 if n == 1 else min(max((low + high - 1) / 2 if high > low else low, 0), n - 1) / (n - 1))
        i = (n - 1) * r.p
        assert r.v == pytest.approx(r.points[int(i)] + (r.points[min(int(i) + 1, n - 1)] - r.points[int(i)]) * (i - int(i)))


@pytest.mark.parametrize("n", [1, 2, 7, 200, 201, 1000])
def test_quantile_table_is_of_equal_steps_of_rank(spark, n):
    rnd = random.Random(n)
    values = [float(rnd.randrange(50)) for _ in range(n)]
    got = c.quantile_table(spark.createDataFrame([*((v,) for v in values), (None,)], "v double"), "v", 20).first().v_points
    assert got == [sorted(values)[i * (n - 1) // 20] for i in range(21)]


def test_gates(spark):
    """The best grades need a residual beyond the gate, S+ also one of the first three places."""
    cases = [(96.0, 0.99, 1, "S+"), (96.0, 0.99, 4, "S"), (96.0, 0.97, 1, "S"), (96.0, 0.93, 1, "S-"), (96.0, 0.5, 1, "A+"), (90.0, 0.96, 8, "S"), (85.0, 0.91, 8, "S-"), (85.0, 0.89, 1, "A+"), (70.0, 0.1, 1, "B+"), (None, 0.5, 1, None)]
    df = spark.createDataFrame(cases, "score double, p double, place int, grade string")
    for r in df.select("*", c.gated(F.col("score"), F.col("p"), F.col("place"), F.lit(0.9), F.lit(0.95), F.lit(0.98)).alias("g")).collect():
        assert r.g == r.grade
