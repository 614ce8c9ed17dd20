"""Every registered query outside the text operators against its own SQL in DuckDB."""

import math

import duckdb
import pytest

from matchloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        # Held against plain loops below, in test_stability.py, test_holdout.py and test_identity.py.
        assert name in ("isotonic_curves", "stream_mode_controller", "metric_bootstrap", "live_eligibility", "time_curve_points", "holdout_ratios", "holdout_changes", "identity_clusters", "collector_modes") and df.count() > 0
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)


def test_shared_games_of_all_players(spark, sf):
    from itertools import combinations

    from matchloom.sources.facts import player_match

    games = {}
    for r in player_match(spark, sf).select("source_id", "game_id").distinct().collect():
        games.setdefault(r.source_id, set()).add(r.game_id)
    brute = {(a, b): n for a, b in combinations(sorted(games), 2) if (n := len(games[a] & games[b])) >= 2}
    got = {(r.a, r.b): r.shared for r in registry.queries()["shared_games"](spark, sf).collect()}
    assert got == brute and any(a % 10 for a, _ in brute)


@pytest.mark.parametrize("name", ["match_scores", "duration_multiplier", "evidence_gates"])
def test_every_match_of_every_season_has_a_row(spark, sf, name):
    from matchloom.sources.facts import player_match

    got = registry.queries()[name](spark, sf).select("game_id", "slot", "part_id", "source_id").collect()
    assert sorted(got) == sorted(player_match(spark, sf).select("game_id", "slot", "part_id", "source_id").collect())


def test_isotonic_curves_equal_pooling_by_hand(spark, sf):
    """The monotone curve by its definition: the largest mean from the left of the least means to the right."""
    import collections

    from matchloom.sources.facts import player_match, rank_only

    sums = collections.defaultdict(lambda: [0.0, 0])
    for r in rank_only(player_match(spark, sf)).select("role", "duration", "kills").collect():
        cell = sums[r.role, r.duration // 300]
        cell[0], cell[1] = cell[0] + r.kills, cell[1] + 1
    got = {(r.role, r.bucket): r.fitted for r in registry.queries()["isotonic_curves"](spark, sf).collect()}
    assert set(got) == set(sums)
    for role in {k for k, _ in sums}:
        xs = sorted(b for k, b in sums if k == role)
        mean = lambda i, j: sum(sums[role, x][0] for x in xs[i : j + 1]) / sum(sums[role, x][1] for x in xs[i : j + 1])
        for n, x in enumerate(xs):
            wanted = max(min(mean(i, j) for j in range(n, len(xs))) for i in range(n + 1))
            assert got[role, x] == pytest.approx(wanted, abs=1e-5)


def test_stream_mode_controller_equals_a_plain_loop(spark, sf):
    state = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        mean, mode, calm, seen = state.get(r.user_id, (0.0, 0, 0, 0))
        mean, seen = (r.value if seen == 0 else 0.3 * r.value + 0.7 * mean), seen + 1
        want = 2 if mean > 75 else 1 if mean > 55 else 0
        if want >= mode:
            mode, calm = want, 0
        elif calm == 2:
            mode, calm = mode - 1, 0
        else:
            calm += 1
        state[r.user_id] = (mean, mode, calm, seen)
    rows = registry.queries()["stream_mode_controller"](spark, sf).collect()
    last = {}
    for r in rows:
        if r.user_id not in last or r.seen > last[r.user_id].seen:
            last[r.user_id] = r
    assert {u: (round(r["mean"], 4), r.mode, r.seen) for u, r in last.items()} == {u: (round(m, 4), ("normal", "soft", "hard")[k], n) for u, (m, k, _, n) in state.items()}


def test_season_ladders_of_all_seasons(spark):
    """Bounds of every ladder, from below and at the bound, and the leaderboard's rules."""
    from pyspark.sql import functions as F

    from matchloom.functions.fixed import ladder_tier

    cases = [
        (1, 999, None, "Unranked", None), (2, 1000, None, "Bronze", 4), (2, 5999, 1, "Diamond", 1), (2, 6000, None, "Mithril", None), (2, 6200, 200, "Eternity", None), (2, 6200, 201, "Demigod", None),
        (2, 6199, 1, "Mithril", None), (3, 6199, None, "Diamond", 1), (4, 6799, None, "Diamond", 1), (4, 7000, 700, "Demigod", None), (4, 7000, 701, "Mithril", None),
        (5, 6400, None, "Meteorite", None), (5, 1, None, "Iron", 4), (6, 7000, 5, "Mithril", None), (8, 7099, None, "Meteorite", None), (9, 7200, None, "Mithril", None),
        (10, 7399, 1, "Meteorite", 1), (10, 7400, 300, "Eternity", None), (10, 7400, 301, "Demigod", None), (11, 6699, None, "Meteorite", 4), (11, 8299, 1, "Mithril", None),
        (11, 8300, 1000, "Demigod", None), (11, 8300, 1001, "Mithril", None), (12, 7600, 0, "Mithril", None), (11, 0, 1, "Unranked", None), (11, None, 1, "Unranked", None),
    ]
    df = spark.createDataFrame(cases, "season int, rp int, rank int, tier string, division int")
    got = df.select("tier", "division", ladder_tier(F.col("rp"), F.col("season"), F.col("rank")).alias("t")).collect()
    assert [(r.t.tier, r.t.division) for r in got] == [(r.tier, r.division) for r in got]
