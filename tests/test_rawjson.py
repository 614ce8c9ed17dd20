"""JSON of unknown nesting, weapon recovery and JSON sources against plain Python."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from matchloom.operators.variants import field_inventory, json_paths, recovered_weapons
from matchloom.sources.jsonfiles import MATCH, cached_bodies, keyed_bodies, read_json_lines, write_lines

HIDDEN = {"nickname", "usernum", "userid", "uid", "apikey", "x-api-key", "authorization", "token", "accesstoken", "refreshtoken"}


def once(pairs):
    if len(pairs) != len(dict(pairs)):
        raise ValueError("a key twice")
    return dict(pairs)


def loaded(text):
    try:
        return json.loads(text, object_pairs_hook=once), True
    except (TypeError, ValueError):
        return None, False


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def walk(v, path, found):
    if path != "":
        found.setdefault(path, []).append(v)
    if isinstance(v, list):
        for x in v:
            walk(x, path + "[]", found)
    elif isinstance(v, dict):
        for k, x in v.items():
            if k.lower() not in HIDDEN:
                walk(x, path + k if path in ("", "[]") else f"{path}.{k}", found)


def first(values):
    scalars = [v for v in values if not isinstance(v, (list, dict))]
    use = scalars or values
    return next((v for v in use if kind(v) == "number"), next((v for v in use if v is not None), None))


def by_hand(texts):
    out = Counter()
    for i, t in enumerate(texts):
        value, ok = loaded(t)
        if not ok:
            out[i, None, None, None] += 1
            continue
        found = {}
        walk(value, "", found)
        for path, values in found.items():
            v = first(values)
            out[i, path, kind(v), float(v) if kind(v) == "number" else None] += 1
    return out


def some_value(rnd, depth):
    roll = rnd.random()
    if depth and roll < 0.35:
        return {rnd.choice(["a", "b", "healAmount", "uid", "Token", "x.y", "쉴드"]): some_value(rnd, depth - 1) for _ in range(rnd.randrange(4))}
    if depth and roll < 0.6:
        return [some_value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return rnd.choice([None, True, 0, 3, -2.5, "7", "", 'br{[\\"ck', 10**12])


def test_paths_of_any_nesting_equal_a_plain_walk(spark):
    rnd = random.Random(5)
    texts = [json.dumps(some_value(rnd, 7)) for _ in range(300)]
    texts += [None, "", "{", '{"a":1', '{"a":1,"a":2}', "nul", "5", "[]", "{}", "[[[[1]],[[2]]]]", '[{"a":null},{"a":[1]},{"a":"s"},{"a":4}]', '[{"a":[1]},{"a":null}]', "[" * 14 + "1" + "]" * 14, '{"k":"' + "\\\\\\\"[" * 5000 + '"}']
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, raw string").repartition(3)
    got = Counter(tuple(r) for r in json_paths(docs, "raw", ["id"]).collect())
    assert got == by_hand(texts)
    assert sum(n for (_, p, _, _), n in got.items() if p is None) == 6
    assert max(p.count("[]") for _, p, _, _ in got if p) == 14
    unread = [r for r in field_inventory(json_paths(docs, "raw", [])).collect() if r.path is None]
    assert [(r.documents, r.keyword, r.kinds) for r in unread] == [(6, None, "")]


def test_paths_are_read_once_and_in_place(spark, monkeypatch):
    """One pass without a shuffle, which a first pass for the deepest text was not; output in several batches, odd keys and numbers."""
    from matchloom.operators import variants

    monkeypatch.setattr(variants, "ROWS", 7)
    texts = ['{"x.y":1,"x":{"y":2}}', '{"x":{"y":"s"},"x.y":true}', '{"":{"":3}}', '{"a":NaN}', '{"a":1} b', '{"a":1e400,"b":123456789012345678901234567890}', '{"\\ud800":1}'] * 9
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    docs, before = spark.createDataFrame(list(enumerate(texts)), "id long, raw string"), jobs()
    df = json_paths(docs, "raw", ["id"])
    assert jobs() == before and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in df.collect():
        got.setdefault(r.id, []).append((r.path, r.kind, r.number))
    unread = (None, None, None)
    wanted = [
        {("x.y", "number", 1.0), ("x", "object", None)}, {("x.y", "boolean", None), ("x", "object", None)}, None, {unread}, {unread}, {("a", "number", float("inf")), ("b", "number", 123456789012345678901234567890.0)}, {("?", "number", 1.0)},
    ]
    for i in range(len(texts)):
        assert wanted[i % 7] is None or set(got[i]) == wanted[i % 7]


def test_paths_of_an_empty_table_and_with_clashing_names(spark):
    assert json_paths(spark.createDataFrame([], "raw string"), "raw", []).count() == 0
    df = spark.createDataFrame([(1, '{"a":[1,"x"]}')], "`n.o` long, raw string").select(F.col("`n.o`").alias("kind_0"), "raw")
    assert sorted(map(tuple, json_paths(df, "raw", ["kind_0"]).collect())) == [(1, "a", "array", None), (1, "a[]", "number", 1.0)]


def test_meanings_of_paths(spark):
    paths = [("a.teamHealTotal", "object", None), ("damageTaken", "number", 1.0), ("shieldFromAlly", "number", 0.0), ("monsterDamage", "number", 2.0)]
    got = {r.path: (r.keyword, r.categories, r.meanings) for r in field_inventory(spark.createDataFrame(paths, "path string, kind string, number double")).collect()}
    assert got["a.teamHealTotal"] == (True, "heal", "allyHeal,totalHeal")
    assert got["damageTaken"] == (True, "", "")
    assert got["shieldFromAlly"] == (True, "shield", "allyHeal,totalHeal".split(",")[0])
    assert got["monsterDamage"] == (False, "", "monsterDamageTaken")


def owner(e):
    return next((e[k] for k in ("uid", "userId") if isinstance(e.get(k), str) and e[k].strip()), None)


def weapon_of(e):
    w = e.get("bestWeapon")
    return w if kind(w) == "number" and w > 0 else None


def test_recovered_weapons_equal_a_plain_loop(spark):
    rnd = random.Random(9)
    one = lambda: {k: v for k, v in {"uid": rnd.choice(["u1", "u2", " ", 5, None]), "userId": rnd.choice(["u1", None, 1]), "characterNum": rnd.choice([1, 2, "1"]), "bestWeapon": rnd.choice([1, 2, 2, 0, "2", None, 3.0])}.items() if rnd.random() < 0.9}
    games = {f"g{i}": rnd.choice([json.dumps([one() for _ in range(rnd.randrange(5))] + [4, None]), None, "[{", json.dumps(one())]) for i in range(120)}
    rows = [(i, f"g{rnd.randrange(125)}", rnd.choice(["u1", "u2", "u3"]), rnd.choice([1, 2]), rnd.choice([None, 0, -1, 4]), rnd.choice([None, None, json.dumps(one()), "{", "[]"])) for i in range(600)]
    rows += [(900, None, "u1", 1, None, None), (901, "g1", None, 1, None, None), (902, "g1", "u1", None, None, None)]
    listed = [(f"g{rnd.randrange(60)}", rnd.choice(["u1", "u2", None]), rnd.choice([1, 2]), rnd.choice([None, 0, 6, 7])) for _ in range(60)]
    best = {}
    for g, u, c, w in listed:
        if u is not None and w:
            best[g, u, c] = max(w, best.get((g, u, c), 0))
    wanted = set()
    for i, g, u, c, w, raw in rows:
        if w is not None and w > 0:
            continue
        own, ok = loaded(raw)
        hit = weapon_of(own) if ok and isinstance(own, dict) and u is not None and owner(own) in (None, u) and kind(own.get("characterNum")) == "number" and own["characterNum"] == c else None
        source = "player-match-raw-json"
        if hit is None:
            hit, source = best.get((g, u, c)), "match-participant"
        if hit is None and u is not None:
            entries, _ = loaded(games.get(g))
            es = [e for e in entries if isinstance(e, dict) and kind(e.get("characterNum")) == "number" and e["characterNum"] == c and owner(e) in (None, u)] if isinstance(entries, list) else []
            ws = {weapon_of(e) for e in es} - {None}
            hit, source = ws.pop() if len(ws) == 1 else None, "match-detail-raw-json"
        if hit is not None:
            wanted.add((i, int(hit), source, "missing-best-weapon" if w is None else "invalid-best-weapon"))
    got = recovered_weapons(
        spark.createDataFrame(rows, "row_id long, game string, uid string, character long, weapon long, raw string"),
        spark.createDataFrame(listed, "game string, uid string, character long, weapon long"), spark.createDataFrame(list(games.items()), "game string, raw string"),
    ).collect()
    assert len(got) == len({r.row_id for r in got})
    assert {(r.row_id, r.recovered, r.source, r.reason) for r in got} == wanted
    assert len({s for _, _, s, _ in wanted}) == 3


def test_json_lines_keep_malformed_rows_and_open_only_the_folders_asked_for(spark, tmp_path):
    lines = [(1, '{"uid":1,"kills":2}'), (1, '{"uid":1,"kil'), (2, '{"uid":2,"kills":"many"}'), (2, '{"uid":3,"kills":4,"beyond":{"x":[1]}}'), (3, '{"uid":null}')]
    path = f"file://{tmp_path}/lines"
    write_lines(spark.createDataFrame(lines, "season int, value string"), path, ["season"])
    x = read_json_lines(spark, path, MATCH, "season int")
    got = sorted((r.season, r.uid, r.kills, r.corrupt is not None) for r in x.where("season < 3").collect() if r.corrupt is None)
    assert got == [(1, 1, 2, False), (2, 3, 4, False)]
    assert sorted(r.corrupt for r in x.select("uid", "corrupt").collect() if r.corrupt) == ['{"uid":1,"kil', '{"uid":2,"kills":"many"}']
    plan = x.where("season = 2 and corrupt is null").select("uid", "corrupt")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def test_cached_bodies_of_one_player(spark, tmp_path):
    rows = [(f"p{i}:{k}", rnd, k) for i in range(30) for k, rnd in enumerate(['{"n":1}', '{"n":', None, '{"n":"x"}', '{"m":1}'])] + [("p1", '{"n":3}', 0), ("p10:x:y", '{"n":4}', 1)]
    path = f"file://{tmp_path}/bodies"
    keyed_bodies(spark.createDataFrame(rows, "id string, data string, cached_at long"), path)
    one = cached_bodies(spark, path, "n long", "p1")
    assert sorted((r.id, r.body.n) for r in one.collect()) == [("p1:0", 1), ("p1:4", None)]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert cached_bodies(spark, path, "n long").count() == 62
