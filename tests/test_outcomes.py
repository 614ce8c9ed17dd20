"""Outcome-weighted grades and overall grades on fixed rows."""

from matchloom.functions.fixed import AXIS_MEASURES, OUTCOME_POINTS, STYLE_WEIGHTS
from matchloom.plans.outcomes import hybrid, outcome_rows
from matchloom.plans.playstyle import style_axes


def test_outcome_scores_of_fixed_rows(spark):
    nan = float("nan")
    rows = [(1, 70.0, 1, None), (2, 70.0, 8, None), (3, 98.0, 1, 100.0), (4, 3.0, 8, 50.0), (5, 78.0, 1, 100.0), (6, 100.0, 8, 20.0), (7, 70.0, 0, 50.0), (8, 70.0, 9, 50.0), (9, None, 1, 50.0), (10, nan, 1, 50.0), (11, 70.0, None, 50.0), (12, 97.0, 1, 87.0), (13, 97.0, 1, None)]
    df = outcome_rows(spark.createDataFrame(rows, "i int, role_score double, placement int, outcome_score double"))
    got = {(r.i, r.candidate): r for r in df.collect()}
    assert len(got) == 3 * len(rows)
    assert got[1, "A"].score == 76 and got[2, "A"].score == 64
    assert got[3, "C"].score == 100 and got[4, "C"].score == 0
    assert (got[5, "C"].score, got[5, "C"].guarded_grade) == (88, "A+") and got[5, "C"].production_grade == "A+"
    assert (got[6, "C"].score, got[6, "C"].guarded_grade) == (90, "B+")
    assert all(got[i, c].score is None and got[i, c].production_grade is None and got[i, c].guarded_grade is None for i in range(7, 12) for c in OUTCOME_POINTS)
    assert got[3, "A"].production_grade == "S+" and got[12, "A"].production_grade == "S" and got[13, "A"].production_grade == "S" and got[13, "A"].guarded_grade == "S+"


def test_overall_scores_of_fixed_rows(spark):
    rows = [
        (1, 70.0, 40, 65.0, 65.0, "rank", "high"), (2, 70.0, 40, 0.0, 65.0, "rank", "high"), (3, 70.0, 40, 100.0, 65.0, "rank", "high"), (4, 70.0, 40, 65.0, 0.0, "rank", "high"), (5, 70.0, 40, 65.0, 100.0, "rank", "high"),
        (6, 70.0, 40, 100.0, 100.0, "rank", "high"), (7, 3.0, 40, 0.0, 0.0, "rank", "high"), (8, 98.0, 40, 100.0, 100.0, "rank", "high"), (9, 70.0, 40, None, 65.0, "rank", "high"), (10, 70.0, 40, 65.0, 65.0, "rank", "insufficient"),
        (11, 70.0, 40, 100.0, 100.0, "cobalt", "high"), (12, 70.0, 19, 100.0, 100.0, "rank", "high"), (13, None, 40, 100.0, 100.0, "rank", "high"), (14, 70.0, 40, 100.0, 100.0, None, None), (15, 70.0, 40, 100.0, 100.0, "rank", None),
    ]
    df = hybrid(spark.createDataFrame(rows, "i int, base double, matches int, outcome double, consistency double, mode string, label string"))
    got = {r.i: r for r in df.collect()}
    assert [got[i].score for i in range(1, 16)] == [70, 66, 74, 68, 72, 76, 0, 100, 70, 70, 70, 70, None, 70, 76]
    assert got[2].outcome_modifier == -4 and got[3].outcome_modifier == 4 and got[4].consistency_modifier == -2 and got[5].consistency_modifier == 2 and got[6].total_modifier == 6
    assert {i for i in got if got[i].source == "character-grade-weighted-average-fallback"} == {9, 10, 11, 12, 14}
    assert [got[i].confidence_label for i in (1, 9, 10, 11, 12, 14, 15)] == ["high", "high", "insufficient", "insufficient", "insufficient", "insufficient", "insufficient"]
    assert [got[i].grade for i in (1, 3, 7, 8, 13)] == ["B", "A", "D", "S", None]


def test_axes_share_weights_of_missing_measures(spark):
    """Two players; one has no vision: support is then involvement alone. Weights of a role and of an axis sum to 100."""
    assert all(sum(w) == 100 for w in STYLE_WEIGHTS.values()) and all(sum(x.values()) == 100 for x in AXIS_MEASURES.values())
    measures = ["place", "deaths", "kills", "assists", "seconds", "damage", "items", "credit_rate", "monster_damage", "animal_kills", "vision", "involvement", "top3", "top2", "bottom", "wins", "place_sd", "kda_cv", "late", "half_gap"]
    first = {m: 1.0 for m in measures} | {"vision": None, "items": None, "credit_rate": None, "monster_damage": None, "damage": None, "kills": None, "assists": None}
    second = {m: 2.0 for m in measures} | {"damage": None, "kills": None, "assists": None}
    rows = [(u, n, "gold", *([0] * 6), *(x[m] for m in measures)) for u, n, x in ((1, 3, first), (2, 5, second), (3, 2, second))]
    schema = "uid long, n long, tier string, " + ", ".join(f"s{i} long" for i in range(6)) + ", " + ", ".join(f"{m} double" for m in measures)
    got = {r.uid: r for r in style_axes(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2}
    assert got[1].support == 25 and got[2].support == (75 * 50 + 25 * 75) / 100
    assert got[1].combat is None and got[1].consistency == 75 and got[2].consistency == 25
    assert got[1].survival == (75 * 35 + 25 * 30 + 75 * 20 + 75 * 15) / 100
    assert got[1].macro == 25 and got[2].macro == (50 * 30 + 50 * 30 + 75 * 25 + 50 * 15) / 100
