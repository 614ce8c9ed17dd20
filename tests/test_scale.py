"""Plans and results where the tables are large enough to be dealt out by size."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators.curves import capped
from matchloom.plans import holdout, registry
from matchloom.plans.calibration import percentile_in
from matchloom.plans.outcomes import outcome_rows
from matchloom.sources import facts
from matchloom.sources.scratch import written


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["team_uniformity", "clear_winners", "shared_games", "team_relative", "analysis_eligibility", "team_kill_meaning"])
def test_tasks_grow_with_the_table(spark, sf, monkeypatch, name):
    """No task holds more of a larger table: the last stage's partitions follow the input's size, and the rows are the same."""
    query = registry.queries()[name]
    wanted = rows(query(spark, sf))
    monkeypatch.setattr(facts, "TASK_BYTES", 5000)
    many = facts.tasks(spark, sf)
    assert many > int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = query(spark, sf)
    assert f", {many})" in df._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "") and rows(df) == wanted


def test_pairs_and_winners_are_counted_in_as_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(facts, "TASK_BYTES", 5000)
    for name, keys in (("shared_games", "a#"), ("clear_winners", "uid#"), ("analysis_eligibility", "bucket#")):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert any(f"hashpartitioning({keys}" in l and f", {facts.tasks(spark, sf)})" in l for l in plan.splitlines()), name


def test_shrunk_baseline_reads_the_matches_once(spark, sf):
    """All levels come from cells that are written once; the matches were joined once a level before."""
    df = registry.queries()["shrunk_baseline"](spark, sf)
    assert not any("lineitem" in f for f in df.inputFiles()) and df.count() > 0


@pytest.mark.parametrize("name", ["adjusted_contributions", "character_aggregate_grades", "outcome_capped_grades"])
def test_role_scores_are_computed_once(spark, sf, name):
    """The scores of matches come from a written table; the whole chain was run anew for each use of them before."""
    df = registry.queries()[name](spark, sf)
    assert not any("lineitem" in f for f in df.inputFiles()) and df.count() > 0


def test_places_and_gates_are_computed_once(spark):
    """The search for a percentile stood a dozen times in its expression, and a gated score once for each cut of the grades."""
    place = percentile_in(F.col("x"), F.col("points"))
    df = spark.createDataFrame([(2.0, [1.0, 2.0, 2.0, 4.0])], "x double, points array<double>").select(place.alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1 and df.first().p == 0.5
    df = spark.createDataFrame([(90.0, 3, 80.0)], "role_score double, placement long, outcome_score double")
    plan = outcome_rows(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("94.99") < 10


@pytest.mark.parametrize("name", ["radar_axes", "play_styles"])
def test_play_styles_read_written_players(spark, sf, name):
    """Axes and reports come from written players; matches were numbered and summed anew for each use of them before."""
    df = registry.queries()[name](spark, sf)
    assert all("style_players" in f or "style_axes" in f for f in df.inputFiles()) and df.count() > 0


def test_curves_read_written_counts(spark, sf):
    """The scenarios' counts are written once; curves built them anew from the cells for each use before."""
    c = holdout.cells(facts.player_match(spark, sf))
    files = holdout.curves(c.where("metric = 'kills'")).inputFiles()
    assert any("/scenarios/" in f for f in files)


def test_weapons_are_read_once_from_the_games_texts(spark, sf):
    """The entries of the games' texts are written once; every text was built and read for named and for nameless entries before."""
    df = registry.queries()["weapon_recovery"](spark, sf)
    assert any("weapon_entries" in f for f in df.inputFiles()) and df.count() > 0


def test_curves_put_no_whole_group_in_order(spark, sf, monkeypatch):
    """Only values of the range that holds a curve's 95 % point are put in order, and cells are counted in tasks that follow the size; a group met whole in one task before."""
    wanted = rows(registry.queries()["holdout_changes"](spark, sf))
    monkeypatch.setattr(facts, "TASK_BYTES", 5000)
    many = facts.tasks(spark, sf)
    c = written(holdout.cells(facts.player_match(spark, sf), sf_dir=sf), "cells")
    assert len(c.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = written(holdout.scenarios(c, tuple(holdout.LEFT_OUT), many), "scenarios")
    ranges = [tuple(r) for r in s.groupBy("range").agg(F.min(F.struct("metric", "value")), F.max(F.struct("metric", "value")), F.count(F.lit(1))).orderBy("range").collect()]
    assert len(ranges) > many / 2 and all(a[2] < b[1] for a, b in zip(ranges, ranges[1:])) and max(r[3] for r in ranges) < s.count() / 4
    x = s.where("metric = 'damage'").select("role", "bucket", "value", "range", F.col("all").alias("n"))
    whole = {r[0]: tuple(r[1:]) for r in capped(x.withColumn("range", F.lit(0)), ["bucket"]).collect()}
    found = {r[0]: tuple(r[1:]) for r in capped(x, ["bucket"]).collect()}
    assert set(found) == set(whole) and all(found[b][1] == n and abs(found[b][0] / mean - 1) < 1e-12 for b, (mean, n) in whole.items())
    assert rows(registry.queries()["holdout_changes"](spark, sf)) == wanted
