"""Bootstrap, train against validation and holdout against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import counted, resampling
from matchloom.plans import registry, stability


def generator(seed):
    state = seed
    while True:
        state = (1664525 * state + 1013904223) % 2**32
        yield state / 2**32


def at(values, p):
    pos = (len(values) - 1) * p
    low, high = math.floor(pos), math.ceil(pos)
    return values[low] if low == high else values[low] * (1 - (pos - low)) + values[high] * (pos - low)


def capped_mean(values):
    cap = at(sorted(values), 0.95)
    return sum(min(v, cap) for v in values) / len(values)


def by_loop(values, iterations, seed):
    values, rng, out = sorted(values), generator(seed), []
    for i in range(iterations):
        sample = [values[math.floor(next(rng) * len(values))] for _ in values]
        out.append((i, capped_mean(sample), at(sorted(sample), 0.9)))
    return out


def test_generator_jumps():
    rng = generator(99)
    plain = [math.floor(next(rng) * 1000) for _ in range(5000)]
    for first, count in ((0, 5000), (1, 10), (4321, 600)):
        assert resampling.draws(99, first, count, 1000).tolist() == plain[first : first + count]
    assert resampling.jump(5, 0) == 5


@pytest.mark.parametrize("block", [1 << 20, 64, 16])
def test_replicates_equal_a_loop(spark, monkeypatch, block):
    """Also when a group's values and draws are spread over many blocks; null keys, odd values, single values."""
    monkeypatch.setattr(resampling, "BLOCK", block)
    rnd = random.Random(2)
    groups = {("a", 1): [rnd.randrange(5) for _ in range(150)], ("b", 2): [rnd.gauss(0, 9) for _ in range(90)], (None, 3): [1.5], ("c", None): [0.0] * 40 + [7.0] * 5}
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("a", 1, None), ("a", 1, float("nan")), ("d", 4, float("inf")), ("e", 5, None)]
    rnd.shuffle(rows)
    got = {}
    for r in resampling.replicates(spark.createDataFrame(rows, "k string, j int, v double"), ["k", "j"], "v", 12, 42).collect():
        got.setdefault((r.k, r.j), []).append((r.iteration, r["mean"], r.anchor))
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for (i, m, a), (j, m2, a2) in zip(sorted(got[k]), by_loop(vs, 12, 42), strict=True):
            assert i == j and m == pytest.approx(m2, rel=1e-12, abs=1e-12) and a == pytest.approx(a2, rel=1e-12, abs=1e-12)


def test_metric_bootstrap_equals_a_loop(spark, sf):
    from matchloom.sources.facts import player_match

    values = {}
    for r in player_match(spark, sf).collect():
        if r.damage is not None:
            values.setdefault((r.tier, r.role, "tanking"), []).append(r.damage / (1 + r.deaths))
        values.setdefault((r.tier, r.role, "recovery"), []).append(max(r.kills - 8.0, 0.0))
    rows = {(r.tier, r.role, r.metric): r for r in registry.queries()["metric_bootstrap"](spark, sf).collect()}
    assert set(rows) == set(values)
    for key, vs in sorted(values.items())[::5]:
        r, loops = rows[key], by_loop(vs, 500, 391108)
        means, uppers = [m for _, m, _ in loops], [a for *_, a in loops]
        mean, upper = sum(means) / 500, sum(uppers) / 500
        sd = lambda xs, m: math.sqrt(sum((x - m) ** 2 for x in xs) / 500)
        cvs = [sd(x, m) / abs(m) if abs(m) > 1 else None for x, m in ((means, mean), (uppers, upper))]
        rate, positives = sum(a > m + 1e-6 for m, a in zip(means, uppers)) / 500, sum(v > 0 for v in vs)
        p = [at(sorted(x), q) for x in (means, uppers) for q in (0.05, 0.95)]
        level = 0 if len(vs) < 30 else 1 if len(vs) < 100 else 2 if len(vs) < 300 else 3
        why = []
        if key[2] == "recovery":
            level = min(level, 0 if positives < 10 else 1 if positives < 30 else 2 if positives < 100 else 3)
            why += ["positive-sample-insufficient"] * (positives < 10) + ["positive-anchor-rate-low"] * (rate < 0.95) + ["baseline-range-invalid"] * (not p[1] > p[0] + 1e-6) + ["upper-range-invalid"] * (not p[3] > p[2] + 1e-6)
        else:
            why += ["baseline-cv-high"] * bool(cvs[0] and cvs[0] > 0.15) + ["upper-anchor-cv-high"] * bool(cvs[1] and cvs[1] > 0.2) + ["positive-anchor-rate-low"] * (rate < 0.95) + ["baseline-range-wide"] * (p[0] > 0 and p[1] / p[0] > 10)
        why = ["readiness-insufficient"] * (level < 2) + ["sample-insufficient"] * (len(vs) < 30) + why
        assert (r.n, r.positives, r.iterations, r.readiness, r.reasons, r.stable) == (len(vs), positives, 500, ("unusable", "experimental", "provisional", "ready")[level], ",".join(why), not why)
        for got, wanted in zip((r.baseline_mean, r.baseline_sd, r.baseline_cv, r.upper_mean, r.upper_sd, r.upper_cv, r.anchor_rate, r.baseline_p05, r.baseline_p95, r.upper_p05, r.upper_p95), (mean, sd(means, mean), cvs[0], upper, sd(uppers, upper), cvs[1], rate, *p)):
            assert got == wanted if wanted is None else got == pytest.approx(wanted, rel=1e-6, abs=2e-6)


def test_live_eligibility_joins_both_verdicts(spark, sf):
    a = {(r.tier, r.role, r.metric): r for r in registry.queries()["metric_bootstrap"](spark, sf).collect()}
    b = {(r.tier, r.role, r.metric): r for r in registry.queries()["train_validation_stability"](spark, sf).collect()}
    rows = registry.queries()["live_eligibility"](spark, sf).collect()
    assert len(rows) == len(a) == len(b)
    for r in rows:
        key = r.tier, r.role, r.metric
        assert r.eligible == (a[key].readiness in ("provisional", "ready") and a[key].stable and b[key].stable)


def test_reference_cases(spark):
    """Tanking efficiency without deaths and with none known; a validation part that is too small; zeros with few positive values."""
    t = spark.createDataFrame([(12000.0, 0), (12000.0, None), (12000.0, 2)], "d double, n int").select(stability.tanking_efficiency(F.col("d"), F.col("n")).alias("t")).collect()
    assert [r.t for r in t] == [12000.0, None, 4000.0]
    rows = [("t", 1, "tanking", "train", float(i + 1)) for i in range(100)] + [("t", 1, "tanking", "validation", float(i + 1)) for i in range(10)]
    r = stability.train_validation(spark.createDataFrame(rows, "tier string, role int, metric string, part string, value double")).first()
    assert not r.stable and "validation-sample-insufficient" in r.reasons and "baseline-drift-high" in r.reasons
    rows = [("t", 1, "recovery", 0.0)] * 40 + [("t", 1, "recovery", 500.0)] * 20
    r = stability.bootstrap(spark.createDataFrame(rows, "tier string, role int, metric string, value double")).first()
    assert r.anchor_rate > 0 and r.positives == 20 and r.readiness == "experimental"
    ready = spark.createDataFrame([(n, p, h) for n in (29, 30, 99, 100, 299, 300) for p in (9, 10, 29, 30, 99, 100) for h in (False, True)], "n long, p long, h boolean")
    level = lambda x, cuts: sum(x >= c for c in cuts)
    for x in ready.select("*", stability.readiness(F.col("n"), F.col("p"), F.col("h")).alias("r")).collect():
        wanted = min(level(x.n, (30, 100, 300)), level(x.p, (10, 30, 100)) if x.h else 3)
        assert x.r == ("unusable", "experimental", "provisional", "ready")[wanted]


def test_numbers_of_many_ranges(spark, tmp_path):
    """One group holds most rows, a key is null, and the order has ties."""
    rnd = random.Random(1)
    rows = [("a" if rnd.random() < 0.8 else rnd.choice(["b", None]), rnd.randrange(300), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = counted.numbered(df, ["k"], ["v", "i"], f"file://{tmp_path}").collect()
        assert spark.read.parquet(f"file://{tmp_path}/number").where("k = 'a'").select("_range").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = {}
    for k in ("a", "b", None):
        own = sorted((v, i) for x, v, i in rows if x == k)
        wanted |= {i: (n, len(own)) for n, (_, i) in enumerate(own, 1)}
    assert {r.i: (r.number, r.total) for r in got} == wanted


def test_quantiles_of_counts(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("xyz"), rnd.choice([None, *range(9)])) for _ in range(200)] + [("n", None), ("o", 4)]
    df = spark.createDataFrame(rows, "k string, v int")
    c = counted.ranked(counted.counted(df, ["k"], "v"), ["k"], "v")
    got = {r.k: r for r in c.groupBy("k").agg(counted.quantile("v", 0.3).alias("a"), counted.nearest_quantile("v", 0.3).alias("b"), counted.quantile("v", 1.0).alias("top")).collect()}
    for k in "xyzno":
        own = sorted(v for x, v in rows if x == k and v is not None)
        assert got[k].a == (pytest.approx(at(own, 0.3)) if own else None) and got[k].top == (own[-1] if own else None)
        assert got[k].b == (own[math.ceil(0.3 * len(own)) - 1] if own else None)
    for r in counted.with_ranks(df, ["k"], "v").collect():
        own = [v for x, v in rows if x == r.k and v is not None]
        assert (r.before, r.n, r.total) == (sum(v < r.v for v in own), own.count(r.v), len(own))


def test_draws_of_large_groups_are_not_shuffled(spark, monkeypatch):
    """Groups of many blocks, one of them with values that repeat often; draws were once sent as arrays to the values' tasks."""
    monkeypatch.setattr(resampling, "BLOCK", 32)
    rnd = random.Random(8)
    groups = {"much": [float(rnd.randrange(20)) for _ in range(2000)], "fine": [rnd.random() for _ in range(300)], "few": [float(rnd.randrange(3)) for _ in range(500)]}
    df = resampling.replicates(spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double"), ["k"], "v", 40, 7)
    assert "_index" not in df._jdf.queryExecution().toString()
    got = {}
    for r in df.collect():
        got.setdefault(r.k, []).append((r.iteration, r["mean"], r.anchor))
    for k, vs in groups.items():
        for (i, m, a), (j, m2, a2) in zip(sorted(got[k]), by_loop(vs, 40, 7), strict=True):
            assert i == j and m == pytest.approx(m2, rel=1e-12) and a == pytest.approx(a2, rel=1e-12)
