"""Raw match JSON: an inventory of unknown paths, weapons read back from it, and JSON files as a source.

The JSON is derived from the order tables: a document per game, some cut short, some missing, some with an array as root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.core import js_round
from matchloom.functions.fixed import FIELD_CATEGORIES, FIELD_KEYWORDS, FIELD_MEANINGS, HIDDEN_KEYS
from matchloom.operators.variants import field_inventory, json_paths, recovered_weapons
from matchloom.sources.facts import PM, player_match
from matchloom.sources.jsonfiles import MATCH, cached_bodies, keyed_bodies, read_json_lines, write_lines
from matchloom.sources.scratch import shared_folder

from .registry import query

R4 = "floor(({0}) * 10000 + 0.5) / 10000"


def entry() -> Column:
    c = F.col
    stats = F.struct(c("damage").alias("damageFromPlayer"), c("kills").alias("healAmount"), c("team_kills").alias("teamKill"))
    items = F.array(F.array(c("slot").cast("long"), c("part_id") % 5), F.array(c("deaths")))
    uid = F.when(c("part_id") % 3 == 0, c("uid").cast("string")).when(c("part_id") % 3 == 2, F.concat(F.lit("x"), "uid"))
    return F.struct(uid.alias("uid"), (c("character_num") % 5).alias("characterNum"), c("weapon").alias("bestWeapon"), F.lit("secret").alias("token"), stats.alias("stats"), items.alias("items"))


def documents(spark, sf_dir) -> DataFrame:
    """game, role, list (the players as a JSON array), raw (null, cut short, that array, or an object around it)."""
    order = ["slot", "part_id", "source_id", "kills", "updated_at"]
    g = player_match(spark, sf_dir).groupBy("game_id").agg(F.first("duration").alias("duration"), F.sort_array(F.collect_list(F.struct(*order, entry().alias("e")))).alias("p"))
    every = {"ignoreNullFields": "false"}
    players = F.transform("p", lambda x: x["e"])
    n = F.col("game_id")
    whole = lambda length: F.to_json(F.struct(n.alias("gameId"), length.alias("duration"), F.lit("t").alias("Token"), F.lit(None).cast("string").alias("mode"), players.alias("participants")), every)
    raw = F.when(n % 23 == 0, F.to_json(players, every)).when(n % 19 == 0, whole(F.lit("n/a"))).otherwise(whole(F.col("duration")))
    g = g.select(n.alias("game"), (n % 4).alias("role"), F.to_json(players, every).alias("list"), raw.alias("raw"))
    return g.withColumn("raw", F.when(F.col("game") % 31 == 0, None).when(F.col("game") % 29 == 0, F.expr("left(raw, length(raw) - 3)")).otherwise(F.col("raw")))


DOCS = f"""{PM}, e AS (SELECT *, {{'uid': CASE part_id % 3 WHEN 0 THEN CAST(uid AS VARCHAR) WHEN 2 THEN 'x' || uid END, 'characterNum': character_num % 5, 'bestWeapon': weapon, 'token': 'secret',
 'stats': {{'damageFromPlayer': damage, 'healAmount': kills, 'teamKill': team_kills}}, 'items': [[CAST(slot AS BIGINT), part_id % 5], [deaths]]}} e FROM pm),
g AS (SELECT game_id game, any_value(duration) duration, list(e ORDER BY slot, part_id, source_id, kills, updated_at) p FROM e GROUP BY 1),
j AS (SELECT game, game % 4 AS role, CAST(to_json(p) AS VARCHAR) list, CASE WHEN game % 23 = 0 THEN CAST(to_json(p) AS VARCHAR) WHEN game % 19 = 0 THEN CAST(to_json({{'gameId': game, 'duration': 'n/a', 'Token': 't', 'mode': CAST(NULL AS VARCHAR), 'participants': p}}) AS VARCHAR)
 ELSE CAST(to_json({{'gameId': game, 'duration': duration, 'Token': 't', 'mode': CAST(NULL AS VARCHAR), 'participants': p}}) AS VARCHAR) END raw FROM g),
docs AS (SELECT game, role, list, CASE WHEN game % 31 = 0 THEN NULL WHEN game % 29 = 0 THEN left(raw, length(raw) - 3) ELSE raw END raw FROM j)"""

HIDDEN = "|".join(HIDDEN_KEYS)
PATHS = f"""{DOCS}, t AS (SELECT game, role, fullkey, type, atom FROM (SELECT game, role, raw FROM docs WHERE json_valid(raw)) d, json_tree(d.raw)),
u AS (SELECT game, role, regexp_replace(regexp_replace(regexp_replace(substr(fullkey, 2), '\\[[0-9]+\\]', '[]', 'g'), '^\\.', ''), '^\\[\\]\\.', '[]') path, CAST(regexp_extract_all(fullkey, '\\[([0-9]+)\\]', 1) AS INTEGER[]) places,
 CASE type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END kind,
 CASE WHEN type NOT IN ('NULL', 'BOOLEAN', 'VARCHAR', 'ARRAY', 'OBJECT') THEN CAST(CAST(atom AS VARCHAR) AS DOUBLE) END number FROM t WHERE NOT regexp_matches(lower(fullkey), '\\.({HIDDEN})(\\.|\\[|$)')),
paths AS (SELECT game, role, path, kind, number FROM (SELECT *, row_number() OVER (PARTITION BY game, path ORDER BY CASE kind WHEN 'number' THEN 0 WHEN 'null' THEN 2 WHEN 'array' THEN 3 WHEN 'object' THEN 3 ELSE 1 END, places) r FROM u WHERE path <> '') WHERE r = 1
 UNION ALL SELECT game, role, NULL, NULL, NULL FROM docs WHERE raw IS NULL OR NOT json_valid(raw))"""


def _tags_sql(rules) -> str:
    holds = lambda ps: " AND ".join(f"NOT regexp_matches(lower(path), '{p[1:]}')" if p.startswith("-") else f"regexp_matches(lower(path), '{p}')" for p in ps)
    return "CASE WHEN path IS NOT NULL THEN concat_ws(',', " + ", ".join(f"CASE WHEN {holds(ps)} THEN '{name}' END" for name, ps in rules.items()) + ") END"


KEYWORD = "CASE WHEN path IS NOT NULL THEN " + " OR ".join(f"contains(lower(path), '{k.lower()}')" for k in FIELD_KEYWORDS) + " END"


@query(f"""WITH {PATHS} SELECT path, count(*) documents, count(*) FILTER (kind <> 'null') filled, count(number) numbers, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') kinds, min(number) low, max(number) high,
{R4.format("avg(number)")} mean, {R4.format("avg(CASE WHEN number <> 0 THEN 1.0 WHEN number = 0 THEN 0.0 END)")} nonzero, {KEYWORD} keyword, {_tags_sql(FIELD_CATEGORIES)} categories, {_tags_sql(FIELD_MEANINGS)} meanings FROM paths GROUP BY path""")
def json_path_inventory(spark, sf_dir):
    """Every path of the games' raw JSON, however deep, with counts, kinds and ranges; the row without a path counts unreadable texts."""
    x = field_inventory(json_paths(documents(spark, sf_dir), "raw", ["role"]))
    return x.withColumns({"mean": js_round(F.col("mean"), 4), "nonzero": js_round(F.col("nonzero"), 4)})


@query(f"""WITH {PATHS} SELECT path, role, count(*) documents, {R4.format("avg(number)")} mean FROM paths WHERE number IS NOT NULL GROUP BY ALL""")
def json_path_role_means(spark, sf_dir):
    """The mean of every numeric path by role."""
    x = json_paths(documents(spark, sf_dir), "raw", ["role"]).where("number is not null")
    return x.groupBy("path", "role").agg(F.count(F.lit(1)).alias("documents"), js_round(F.avg("number"), 4).alias("mean"))


@query(f"""WITH {DOCS}, r AS (SELECT slot, part_id, source_id, game_id game, uid, character_num % 5 AS "character", CASE WHEN weapon = 3 THEN NULL WHEN weapon = 5 THEN 0 ELSE weapon END AS w, weapon, part_id % 7 = 0 AS listed FROM pm),
n AS (SELECT *, CASE WHEN source_id % 4 = 0 AND source_id % 8 <> 0 AND part_id % 5 <> 4 AND weapon > 0 THEN weapon END own FROM r WHERE w IS NULL OR w <= 0),
k AS (SELECT game, CAST(uid AS VARCHAR) uid, "character", max(weapon) known FROM r WHERE listed AND weapon > 0 GROUP BY ALL),
d AS (SELECT game, json_extract_string(x, '$.uid') uid, CAST(x->>'$.characterNum' AS BIGINT) "character", CAST(x->>'$.bestWeapon' AS BIGINT) w FROM (SELECT game, unnest(CAST(list AS JSON[])) x FROM docs)),
f AS (SELECT n.*, k.known, (SELECT CASE WHEN count(DISTINCT d.w) = 1 THEN max(d.w) END FROM d WHERE d.game = n.game AND d."character" = n."character" AND d.w > 0 AND (d.uid IS NULL OR d.uid = CAST(n.uid AS VARCHAR))) told
 FROM n LEFT JOIN k ON k.game = n.game AND k.uid = CAST(n.uid AS VARCHAR) AND k."character" = n."character")
SELECT slot, part_id, source_id, game, CAST(uid AS VARCHAR) uid, "character", w AS weapon, coalesce(own, known, told) recovered, CASE WHEN own IS NOT NULL THEN 'player-match-raw-json' WHEN known IS NOT NULL THEN 'match-participant' ELSE 'match-detail-raw-json' END AS source,
 CASE WHEN w IS NULL THEN 'missing-best-weapon' ELSE 'invalid-best-weapon' END reason FROM f WHERE coalesce(own, known, told) IS NOT NULL""")
def weapon_recovery(spark, sf_dir):
    """Weapons of rows without one, from their own raw JSON, the participants, or the game's raw JSON."""
    pm = player_match(spark, sf_dir).withColumn("character", F.col("character_num") % 5)
    part, source = F.col("part_id"), F.col("source_id")
    named = F.when(part % 5 == 4, F.concat(F.lit("y"), "uid")).when(part % 5 != 3, F.col("uid").cast("string"))
    raw = F.to_json(F.struct(named.alias("uid"), F.when(source % 8 == 0, F.col("character") + 9).otherwise(F.col("character")).alias("characterNum"), F.col("weapon").alias("bestWeapon")))
    rows = pm.select(
        F.struct("slot", "part_id", "source_id").alias("row_id"), F.col("game_id").alias("game"), F.col("uid").cast("string").alias("uid"), "character",
        F.when(F.col("weapon") == 5, 0).when(F.col("weapon") != 3, F.col("weapon")).alias("weapon"), F.when(source % 4 == 0, raw).alias("raw"),
    )
    participants = pm.where(part % 7 == 0).select(F.col("game_id").alias("game"), F.col("uid").cast("string").alias("uid"), "character", "weapon")
    details = documents(spark, sf_dir).select("game", F.col("list").alias("raw"))
    return recovered_weapons(rows, participants, details).select("row_id.*", "game", "uid", "character", "weapon", "recovered", "source", "reason")


LINES = f"""{PM}, m AS (SELECT *, game_id % 37 = 0 AS torn, game_id % 41 = 0 AS odd FROM pm)"""


def match_files(spark, sf_dir) -> str:
    """A folder of JSON lines by season: some lines cut short, some with a word for a number."""
    pm = player_match(spark, sf_dir)
    shown = F.struct(*(F.col(f.name) for f in MATCH.fields))
    line = F.to_json(shown)
    line = F.when(F.col("game_id") % 37 == 0, F.expr("left(line, length(line) - 2)")).when(F.col("game_id") % 41 == 0, F.regexp_replace("line", '"kills":[0-9]+', '"kills":"many"')).otherwise(F.col("line"))
    folder = shared_folder(spark)
    write_lines(pm.withColumn("line", F.to_json(shown)).select("season", line.alias("value")), folder, ["season"])
    return folder


@query(f"""WITH {LINES} SELECT season, count(*) lines, count(*) FILTER (torn OR odd) malformed, CAST(sum(kills) FILTER (NOT (torn OR odd)) AS BIGINT) kills FROM m GROUP BY 1""")
def json_source_quality(spark, sf_dir):
    """Lines and malformed lines of a JSON source by season; malformed lines are kept aside, not lost."""
    x = read_json_lines(spark, match_files(spark, sf_dir), MATCH, "season int")
    good = F.col("corrupt").isNull()
    return x.groupBy("season").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~good).alias("malformed"), F.sum(F.when(good, F.col("kills"))).alias("kills"))


@query(f"""WITH {LINES} SELECT uid, game_id, slot, part_id, source_id, season, kills, row_number() OVER (PARTITION BY uid ORDER BY played_at DESC, game_id DESC, slot, part_id, source_id, kills) AS position FROM m WHERE NOT (torn OR odd) AND season >= 1996""")
def json_match_history(spark, sf_dir):
    """Each player's matches from JSON files, newest first; the seasons asked for are picked by folder."""
    x = read_json_lines(spark, match_files(spark, sf_dir), MATCH, "season int").where("season >= 1996 and corrupt is null")
    w = Window.partitionBy("uid").orderBy(F.desc("played_at"), F.desc("game_id"), "slot", "part_id", "source_id", "kills")
    return x.select("uid", "game_id", "slot", "part_id", "source_id", "season", "kills", F.row_number().over(w).cast("long").alias("position"))


@query(f"""WITH {PM}, b AS (SELECT uid, season, count(*) games, CAST(sum(kills) AS BIGINT) kills, max(updated_at) cached_at FROM pm GROUP BY 1, 2)
SELECT CAST(uid AS VARCHAR) uid, season, games, kills, row_number() OVER (PARTITION BY uid ORDER BY cached_at DESC, season DESC) AS position FROM b WHERE (uid + season) % 13 <> 0""")
def season_cache_bodies(spark, sf_dir):
    """All cached season bodies of every player, by key prefix, last cached first; bodies that cannot be read are left out."""
    b = player_match(spark, sf_dir).groupBy("uid", "season").agg(F.count(F.lit(1)).alias("games"), F.sum("kills").alias("kills"), F.max("updated_at").alias("cached_at"))
    body = F.to_json(F.struct("season", "games", "kills"))
    body = F.when((F.col("uid") + F.col("season")) % 13 == 0, F.substring(body, 1, 9)).otherwise(body)
    folder = shared_folder(spark)
    keyed_bodies(b.select(F.concat_ws(":", "uid", "season").alias("id"), body.alias("data"), "cached_at"), folder)
    x = cached_bodies(spark, folder, "season int, games long, kills long")
    w = Window.partitionBy("uid").orderBy(F.desc("cached_at"), F.desc("body.season"))
    return x.select("uid", "body.season", "body.games", "body.kills", F.row_number().over(w).cast("long").alias("position"))
