"""Totals kept from batch to batch against a plain loop, whatever the order and however often batches come."""

import random
from collections import defaultdict

import pytest

from matchloom.operators.increments import PARTS, latest, put_batch, stored

SCHEMA = "season int, uid string, game_id long, named string, kills long, placement int, updated_at timestamp_ntz, slot int"


def by_hand(batches):
    last = {}
    for rows in batches.values():
        for season, uid, game, named, kills, place, at, slot in rows:
            if None in (season, uid, game) or (named and named.strip() and named != uid):
                continue
            version = (at, slot, kills, place)
            key = season, uid, game
            last[key] = max(version, last.get(key, version))
    out = defaultdict(lambda: [0, 0, 0])
    for (season, uid, _), (_, _, kills, place) in last.items():
        t = out[season, uid]
        t[0], t[1], t[2] = t[0] + 1, t[1] + kills, t[2] + (place == 1)
    return {k: tuple(v) for k, v in out.items()}


def found(spark, folder):
    return {(r.season, r.uid): (r.games, r.kills, r.wins) for r in spark.read.parquet(f"{folder}/totals").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_repeats_of_batches(spark, tmp_path, seed):
    import datetime

    rnd = random.Random(seed)
    row = lambda: (rnd.choice([1, 2, 3, None]), rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([None, *range(12)]), rnd.choice([None, "", "hot", "a"]), rnd.randrange(9), rnd.choice([1, 2, 5]), datetime.datetime(2024, 1, rnd.randrange(1, 5)), rnd.randrange(3))
    batches = {f"b{i}": [row() for _ in range(60)] for i in range(4)} | {"empty": []}
    order = [*batches, rnd.choice(list(batches))]
    rnd.shuffle(order)
    folder = f"file://{tmp_path}/kept"
    seen = {}
    for name in order:
        put_batch(spark, spark.createDataFrame(batches[name], SCHEMA), folder, name, ["kills", "placement"], ["updated_at", "slot"], buckets=2)
        seen[name] = batches[name]
        if len(seen) == 3:
            assert found(spark, folder) == by_hand(seen)
    assert found(spark, folder) == by_hand(batches)


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path):
    import datetime
    import os

    at = datetime.datetime(2024, 1, 1)
    folder = f"file://{tmp_path}/kept"
    put_batch(spark, spark.createDataFrame([(s, u, 1, None, 1, 1, at, 1) for s in (1, 2) for u in "abcdef"], SCHEMA), folder, "x", ["kills", "placement"], ["updated_at", "slot"], buckets=2)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/kept/totals/season=1") for f in fs if f.endswith(".parquet")}
    before = files()
    put_batch(spark, spark.createDataFrame([(2, "a", 2, None, 5, 2, at, 1)], SCHEMA), folder, "y", ["kills", "placement"], ["updated_at", "slot"], buckets=2)
    assert before and files() == before
    assert found(spark, folder)[2, "a"] == (2, 6, 1) and found(spark, folder)[1, "a"] == (1, 1, 1)


def test_stored_rows_are_not_shuffled_again(spark, tmp_path):
    """Last versions are found where the rows lie, also where a batch names another number of files; every batch shuffled all rows of its seasons before."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    folder = f"file://{tmp_path}/kept"
    row = lambda game, kills, day: (1, "hot" if game % 2 else "a", game, None, kills, 1, at + datetime.timedelta(day), 1)
    first, second = [row(g, 1, 0) for g in range(50)], [row(g, 2, 1) for g in range(20, 70)]
    put_batch(spark, spark.createDataFrame(first, SCHEMA), folder, "it's", ["kills", "placement"], ["updated_at", "slot"], buckets=2, files=4)
    put_batch(spark, spark.createDataFrame(second, SCHEMA), folder, "y", ["kills", "placement"], ["updated_at", "slot"], buckets=2, files=3)
    assert found(spark, folder) == by_hand({"x": first, "y": second})
    like = spark.createDataFrame([], SCHEMA.replace("named string, ", "") + ", bucket long").select("uid", "game_id", "kills", "placement", "updated_at", "slot", *PARTS)
    with stored(spark, like, folder, 4) as table:
        plan = latest(spark.table(table), ["kills", "placement"], ["updated_at", "slot"])._jdf.queryExecution().executedPlan().toString()
        assert spark.table(table).count() == 100 and "Exchange" not in plan
    assert not spark.catalog.tableExists(table)
