"""Scans, sinks, filters, survivorship and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.core import nickname, stable_hash
from matchloom.operators.survivorship import completeness, first_by, first_n_by, merge_by_priority, outcome, upsert
from matchloom.sources.facts import PM, mode_filter, player_match, rank_only, spread, table

from .registry import query


@query(f"""WITH {PM}, s AS (SELECT *, row_number() OVER (ORDER BY played_at DESC, game_id DESC, slot, part_id, source_id, kills, updated_at) r FROM pm WHERE season = 1996 AND game_mode = 'rank')
SELECT game_id, uid, slot, kills, r, (SELECT count(*) FROM s) total FROM s WHERE r > 20 AND r <= 60""")
def season_match_page(spark, sf_dir):
    """One page of a season with the total count, newest first: two small jobs share the pruned scan."""
    s = player_match(spark, sf_dir).where("season = 1996 and game_mode = 'rank'")
    order = [F.desc("played_at"), F.desc("game_id"), "slot", "part_id", "source_id", "kills", "updated_at"]
    page = s.orderBy(*order).limit(60)
    page = page.withColumn("r", F.row_number().over(Window.orderBy(*order)).cast("long")).where("r > 20")
    return page.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("total")))).select("game_id", "uid", "slot", "kills", "r", "total")


@query(f"WITH {PM} SELECT uid, max(struct_pack(p := played_at, g := game_id)).g game_id, max(played_at) played_at FROM pm GROUP BY uid")
def latest_game_per_player(spark, sf_dir):
    return player_match(spark, sf_dir).groupBy("uid").agg(F.max_by("game_id", F.struct("played_at", "game_id")).alias("game_id"), F.max("played_at").alias("played_at"))


@query(f"WITH {PM} SELECT uid, arg_max(rp_delta, (played_at, game_id, slot, part_id, source_id)) rp_delta FROM pm WHERE rp_delta IS NOT NULL GROUP BY uid")
def latest_known_delta(spark, sf_dir):
    """The latest value that is known: rows without it do not count."""
    return player_match(spark, sf_dir).where("rp_delta is not null").groupBy("uid").agg(F.max_by("rp_delta", F.struct("played_at", "game_id", "slot", "part_id", "source_id")).alias("rp_delta"))


@query("SELECT o_orderkey game_id, count(l_orderkey) participants, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') listed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def match_detail_nested(spark, sf_dir):
    """Games with their participants as a sorted array, written out as text."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    nested = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("participants"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    j = o.select(F.col("o_orderkey").alias("game_id")).join(nested, F.col("game_id") == F.col("l_orderkey"), "left")
    text = F.array_join(F.transform("p", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",")
    return j.select("game_id", F.coalesce("participants", F.lit(0)).cast("long").alias("participants"), F.coalesce(text, F.lit("")).alias("listed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events WHERE (event_type <> 'error' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20') OR event_type = 'error'")
def ttl_cache_read(spark, sf_dir):
    """JSON blobs that have not expired; an entry without expiry is permanent."""
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.when(F.col("event_type") != "error", F.col("ts") + F.expr("INTERVAL 10 DAYS")))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("2024-01-20").cast("timestamp"))
    return e.where(live).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT c_custkey uid, lower(trim(c_name)) nick FROM customer WHERE lower(c_name) LIKE '%r#00000001%' AND length(trim(c_name)) >= 2")
def nickname_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(F.lower("c_name").contains("r#00000001")).select(F.col("c_custkey").alias("uid"), nickname(F.col("c_name")).alias("nick")).where("nick is not null")


@query(f"WITH {PM} SELECT game_mode, weapon = 6 coded, count(*) n FROM pm WHERE game_mode = 'cobalt' OR weapon = 6 GROUP BY 1, 2")
def mode_filter_counts(spark, sf_dir):
    return player_match(spark, sf_dir).where(mode_filter("cobalt")).groupBy("game_mode", (F.col("weapon") == 6).alias("coded")).agg(F.count(F.lit(1)).alias("n"))


REJECT = "CASE WHEN game_mode <> 'rank' THEN 'mode' WHEN season < 1996 THEN 'season' WHEN weapon = 0 THEN 'weapon' WHEN damage IS NULL THEN 'damage' ELSE 'kept' END"


@query(f"WITH {PM} SELECT {REJECT} reason, count(*) n, count(DISTINCT uid) players FROM pm GROUP BY 1")
def filter_rejections(spark, sf_dir):
    """A filter cascade in which each row counts for the first test that rejects it."""
    reason = F.when(F.col("game_mode") != "rank", "mode").when(F.col("season") < 1996, "season").when(F.col("weapon") == 0, "weapon").when(F.col("damage").isNull(), "damage").otherwise("kept")
    return player_match(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("players"))


ORDER_SQL = "played_at, slot, part_id, source_id, kills, updated_at"


@query(f"""WITH {PM}, r AS (SELECT *, row_number() OVER (PARTITION BY uid, game_id ORDER BY {ORDER_SQL}) d FROM pm),
b AS (SELECT CASE WHEN d > 1 THEN 'duplicate' WHEN game_mode <> 'rank' THEN 'unsupported' WHEN weapon = 0 THEN 'ungradable' ELSE 'eligible' END bucket, uid FROM r)
SELECT bucket, count(*) n, count(DISTINCT uid) players FROM b GROUP BY 1""")
def analysis_eligibility(spark, sf_dir):
    """Every match in exactly one bucket; repeated games count as duplicates whatever else they are."""
    w = Window.partitionBy("uid", "game_id").orderBy(*ORDER_SQL.split(", "))
    pm = player_match(spark, sf_dir).withColumn("d", F.row_number().over(w))
    bucket = F.when(F.col("d") > 1, "duplicate").when(F.col("game_mode") != "rank", "unsupported").when(F.col("weapon") == 0, "ungradable").otherwise("eligible")
    players = spread(pm.select(bucket.alias("bucket"), "uid"), sf_dir, "bucket", "uid").groupBy("bucket", "uid").agg(F.count(F.lit(1)).alias("n"))
    return players.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("uid").alias("players"))


@query(f"""WITH {PM}, d AS (SELECT *, row_number() OVER (PARTITION BY uid, game_id ORDER BY {ORDER_SQL}) r FROM pm WHERE season IN (1996, 1997))
SELECT uid, game_id, slot, game_mode FROM d WHERE r = 1 AND game_mode = 'rank'""")
def dedupe_then_mode(spark, sf_dir):
    """The first row of each game, then the mode: the order of the two steps matters."""
    s = player_match(spark, sf_dir).where(F.col("season").isin(1996, 1997))
    return rank_only(first_by(s, ["uid", "game_id"], *map(F.col, ORDER_SQL.split(", ")))).select("uid", "game_id", "slot", "game_mode")


@query(f"""WITH {PM}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY source_id % 10 = 0 DESC, updated_at DESC, (damage IS NOT NULL)::INT + (rp_delta IS NOT NULL)::INT DESC, uid, slot, part_id, source_id, kills) d FROM pm)
SELECT game_id, uid, source_id, part_id, updated_at, (damage IS NOT NULL)::INT + (rp_delta IS NOT NULL)::INT complete FROM r WHERE d = 1""")
def survivor_per_game(spark, sf_dir):
    """Canonical owner, then newest, then most complete, then least uid."""
    pm = player_match(spark, sf_dir).withColumn("complete", completeness("damage", "rp_delta"))
    order = [F.desc(F.col("source_id") % 10 == 0), F.desc("updated_at"), F.desc("complete"), "uid", "slot", "part_id", "source_id", "kills"]
    return first_by(pm, ["game_id"], *order).select("game_id", "uid", "source_id", "part_id", "updated_at", "complete")


@query(f"""WITH {PM}, u AS (SELECT uid, game_id, slot, part_id, source_id, 0 s, 'rank' origin FROM pm WHERE game_mode = 'rank' UNION ALL SELECT uid, game_id, slot, part_id, source_id, 1, 'all' FROM pm),
r AS (SELECT *, row_number() OVER (PARTITION BY uid, game_id ORDER BY s, slot, part_id, source_id) d FROM u) SELECT uid, game_id, origin, slot FROM r WHERE d = 1""")
def merge_rank_over_all(spark, sf_dir):
    pm = player_match(spark, sf_dir).select("uid", "game_id", "slot", "part_id", "source_id", "game_mode")
    sources = [rank_only(pm).withColumn("origin", F.lit("rank")), pm.withColumn("origin", F.lit("all"))]
    return merge_by_priority(sources, ["uid", "game_id"], F.col("slot"), F.col("part_id"), F.col("source_id")).select("uid", "game_id", "origin", "slot")


@query(f"""WITH {PM}, s AS (SELECT uid, season, count(*) games, sum(kills) kills FROM pm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY kills DESC, season) d FROM s)
SELECT uid, season, games, CAST(kills AS BIGINT) kills FROM r WHERE d = 1""")
def best_season_per_player(spark, sf_dir):
    s = player_match(spark, sf_dir).groupBy("uid", "season").agg(F.count(F.lit(1)).alias("games"), F.sum("kills").alias("kills"))
    return first_by(s, ["uid"], F.desc("kills"), F.col("season"))


@query(f"""WITH {PM}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY played_at DESC, game_id, slot, part_id, source_id, kills, updated_at) d FROM pm WHERE game_mode = 'rank')
SELECT uid, game_id, slot, d FROM r WHERE d <= 20""")
def recent20(spark, sf_dir):
    order = [F.desc("played_at"), F.col("game_id"), F.col("slot"), F.col("part_id"), F.col("source_id"), F.col("kills"), F.col("updated_at")]
    pm = rank_only(player_match(spark, sf_dir))
    return pm.withColumn("d", F.row_number().over(Window.partitionBy("uid").orderBy(*order)).cast("long")).where("d <= 20").select("uid", "game_id", "slot", "d")


OLD = "SELECT uid, max(game_id) game_id, max(rp_after) rp, max(rp_delta) delta FROM pm WHERE season < 1999 GROUP BY uid"
NEW = "SELECT uid, max(game_id) game_id, max(rp_after) rp, CASE WHEN uid % 3 > 0 THEN max(rp_delta) END delta FROM pm WHERE season >= 1999 GROUP BY uid"


def _state(spark, sf_dir, new):
    pm = player_match(spark, sf_dir).where("season >= 1999" if new else "season < 1999")
    delta = F.when(F.col("uid") % 3 > 0, F.max("rp_delta")) if new else F.max("rp_delta")
    return pm.groupBy("uid").agg(F.max("game_id").alias("game_id"), F.max("rp_after").alias("rp"), delta.alias("delta"))


@query(f"""WITH {PM}, o AS ({OLD}), n AS ({NEW})
SELECT uid, CASE WHEN n.game_id IS NOT NULL THEN n.game_id ELSE o.game_id END game_id, CASE WHEN n.game_id IS NOT NULL THEN n.rp ELSE o.rp END rp, coalesce(n.delta, o.delta) delta FROM o FULL JOIN n USING (uid)""")
def keyed_upsert(spark, sf_dir):
    """New rows replace old ones, but a null delta keeps the old one."""
    return upsert(_state(spark, sf_dir, False), _state(spark, sf_dir, True), ["uid"], keep_if_null=("delta",))


@query(f"""WITH {PM}, o AS ({OLD}), n AS ({NEW}) SELECT uid, CASE WHEN o.game_id IS NOT NULL AND n.rp < o.rp THEN 'kept' WHEN n.game_id IS NULL THEN 'kept' ELSE 'replaced' END done,
CASE WHEN n.game_id IS NULL OR n.rp < o.rp THEN o.rp ELSE n.rp END rp FROM o FULL JOIN n USING (uid)""")
def guarded_replace(spark, sf_dir):
    """A stored row is never replaced by a poorer one."""
    o, n = (_state(spark, sf_dir, x).select("uid", F.col("rp").alias(name)) for x, name in ((False, "old"), (True, "new")))
    keep = F.col("new").isNull() | (F.col("old").isNotNull() & (F.col("new") < F.col("old")))
    return o.join(n, "uid", "full_outer").select("uid", F.when(keep, "kept").otherwise("replaced").alias("done"), F.when(keep, F.col("old")).otherwise(F.col("new")).alias("rp"))


@query(f"""WITH {PM}, o AS (SELECT uid, max(rp_after) // 100 fp FROM pm WHERE season < 1999 GROUP BY 1), n AS (SELECT uid, max(rp_after) // 100 fp FROM pm GROUP BY 1)
SELECT CASE WHEN o.fp IS NULL THEN 'created' WHEN o.fp = n.fp THEN 'reused' ELSE 'updated' END outcome, count(*) n FROM n LEFT JOIN o USING (uid) GROUP BY 1""")
def snapshot_write_outcomes(spark, sf_dir):
    pm = player_match(spark, sf_dir)
    old, new = (x.groupBy("uid").agg(F.floor(F.max("rp_after") / 100).alias("fp")) for x in (pm.where("season < 1999"), pm))
    return outcome(old, new, ["uid"], "fp").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, event_type endpoint, count(*) requests, count(*) FILTER (value < 20) failures, count(*) FILTER (value >= 20) successes FROM events GROUP BY 1, 2")
def api_usage_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("endpoint")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") < 20).alias("failures"), F.count_if(F.col("value") >= 20).alias("successes"))


@query(f"WITH {PM} SELECT game_id, uid, count(*) n FROM pm WHERE game_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2")
def invalidated_cache(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("game_id"))
    return player_match(spark, sf_dir).join(gone, "game_id", "left_anti").groupBy("game_id", "uid").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PM}, s AS (SELECT character_num, weapon, min(damage) fix FROM pm WHERE damage IS NOT NULL GROUP BY 1, 2)
SELECT character_num, count(*) FILTER (damage IS NULL) missing, count(*) FILTER (damage IS NULL AND fix IS NOT NULL) repaired, round(sum(CAST(coalesce(damage, fix) AS DECIMAL(18, 2))), 2)::DOUBLE total FROM pm LEFT JOIN s USING (character_num, weapon) GROUP BY 1""")
def repair_missing(spark, sf_dir):
    """Missing attributes filled from a second source."""
    pm = player_match(spark, sf_dir)
    s = pm.where("damage is not null").groupBy("character_num", "weapon").agg(F.min("damage").alias("fix"))
    j = pm.join(s, ["character_num", "weapon"], "left")
    return j.groupBy("character_num").agg(
        F.count_if(F.col("damage").isNull()).alias("missing"), F.count_if(F.col("damage").isNull() & F.col("fix").isNotNull()).alias("repaired"),
        F.sum(F.coalesce("damage", "fix").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query(f"""WITH {PM}, g AS (SELECT DISTINCT game_id, row_number() OVER (ORDER BY game_id) r FROM (SELECT DISTINCT game_id FROM pm WHERE weapon = 0))
SELECT pm.game_id, count(*) samples FROM pm JOIN g USING (game_id) WHERE weapon = 0 AND r <= 100 GROUP BY 1""")
def capped_distinct_games(spark, sf_dir):
    """At most so many distinct games; all samples of a chosen game are kept."""
    s = player_match(spark, sf_dir).where("weapon = 0")
    chosen = s.select("game_id").distinct().orderBy("game_id").limit(100)
    return s.join(chosen, "game_id", "left_semi").groupBy("game_id").agg(F.count(F.lit(1)).alias("samples"))


@query(f"""WITH {PM} SELECT uid, string_agg(source, ',' ORDER BY source) sources FROM (SELECT DISTINCT uid, 'rank' source FROM pm WHERE game_mode = 'rank' UNION SELECT DISTINCT uid, 'high' FROM pm WHERE rp_after > 6500 UNION SELECT DISTINCT c_custkey, 'name' FROM customer WHERE c_name LIKE '%7') GROUP BY 1""")
def candidate_union(spark, sf_dir):
    pm, c = player_match(spark, sf_dir), table(spark, sf_dir, "customer")
    parts = [rank_only(pm).select("uid", F.lit("rank").alias("source")), pm.where("rp_after > 6500").select("uid", F.lit("high").alias("source")), c.where(F.col("c_name").endswith("7")).select(F.col("c_custkey").alias("uid"), F.lit("name").alias("source"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(f"""WITH {PM}, g AS (SELECT uid, string_agg(game_id, '|' ORDER BY game_id) games, count(*) n FROM (SELECT DISTINCT uid, game_id FROM pm) GROUP BY 1)
SELECT sha256(games) fingerprint, min(uid) first_uid, count(*) members, min(n) games FROM g GROUP BY 1""")
def identical_list_clusters(spark, sf_dir):
    """Players with the very same list of games."""
    g = player_match(spark, sf_dir).select("uid", "game_id").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("game_id")).alias("l"))
    g = g.select("uid", F.sha2(F.array_join(F.col("l").cast("array<string>"), "|"), 256).alias("fingerprint"), F.size("l").cast("long").alias("n"))
    return g.groupBy("fingerprint").agg(F.min("uid").alias("first_uid"), F.count(F.lit(1)).alias("members"), F.min("n").alias("games"))


@query("SELECT o_orderstatus status, o_orderkey game_id, o_orderpriority priority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) r FROM orders) WHERE r <= 10")
def claim_queue_heads(spark, sf_dir):
    """The ten next rows of each queue, by priority and age."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("game_id"), F.col("o_orderpriority").alias("priority"), "o_orderdate")
    return first_n_by(o, ["status"], 10, F.col("priority"), F.col("o_orderdate"), F.col("game_id")).drop("o_orderdate")


@query(f"""WITH {PM} SELECT uid, count(DISTINCT game_id) n, sha256(uid || '|' || count(DISTINCT game_id) || '|' || max(game_id)) fingerprint FROM pm GROUP BY uid""")
def source_fingerprint(spark, sf_dir):
    g = player_match(spark, sf_dir).groupBy("uid").agg(F.countDistinct("game_id").alias("n"), F.max("game_id").alias("last"))
    return g.select("uid", "n", stable_hash(F.col("uid"), F.col("n"), F.col("last")).alias("fingerprint"))
