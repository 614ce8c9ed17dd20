"""Row-level scores, buckets, text and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.core import (
    deaths_per_10m, duration_bucket, interpolate, js_round, participation_capped, participation_raw, per_minute, placement_bucket, safe_kda, stable_hash, tier_of,
)
from matchloom.sources.facts import PM, TIER_SQL, player_match, rank_only, table

from .registry import query

R2, R4, R6 = (f"floor(({{0}}) * {10**d} + 0.5) / {10**d}" for d in (2, 4, 6))
KEY = "game_id, slot, part_id, source_id, kills"
CURVE = [(10.0, 0.8), (15.0, 0.95), (20.0, 1.0), (25.0, 1.15)]


@query(f"""WITH {PM} SELECT {KEY}, {R2.format("CASE WHEN deaths <= 0 THEN kills + assists ELSE (kills + assists) / CAST(deaths AS DOUBLE) END")} kda, {R6.format("damage / (duration / 60.0)")} dpm, {R6.format("deaths / (duration / 600.0)")} deaths10,
{R6.format("CASE WHEN team_kills > 0 THEN least((kills + 0.7 * assists) / team_kills, 1.0) END")} capped, {R6.format("CASE WHEN team_kills > 0 THEN (kills + assists) / CAST(team_kills AS DOUBLE) END")} raw,
CASE WHEN duration / 60.0 >= 30 THEN '30+' WHEN duration / 60.0 >= 25 THEN '25-30' WHEN duration / 60.0 >= 20 THEN '20-25' WHEN duration / 60.0 >= 15 THEN '15-20' ELSE '<15' END bucket,
CASE WHEN placement <= 1 THEN '1' WHEN placement <= 3 THEN '2-3' WHEN placement <= 6 THEN '4-6' ELSE '7+' END place FROM pm WHERE game_mode = 'rank'""")
def match_metrics(spark, sf_dir):
    """Per-match metrics with their null rules, all in one projection over the scan."""
    c = F.col
    return rank_only(player_match(spark, sf_dir)).select(
        *KEY.split(", "), safe_kda(c("kills"), c("assists"), c("deaths")).alias("kda"), per_minute(c("damage"), c("duration")).alias("dpm"), deaths_per_10m(c("deaths"), c("duration")).alias("deaths10"),
        js_round(participation_capped(c("kills"), c("assists"), c("team_kills")), 6).alias("capped"), js_round(participation_raw(c("kills"), c("assists"), c("team_kills")), 6).alias("raw"),
        duration_bucket(c("duration")).alias("bucket"), placement_bucket(c("placement")).alias("place"),
    )


@query(f"""WITH {PM}, s AS (SELECT {KEY}, placement, least(greatest(30 + 4 * kills + 2 * assists - 3 * deaths + coalesce(damage, 0) / 5000, 0), 100) s FROM pm)
SELECT {KEY}, {R4.format("s")} score, {R4.format("least(greatest(s + CASE WHEN placement = 1 AND s >= 50 THEN 4 WHEN placement <= 3 AND s >= 50 THEN 2 WHEN placement >= 7 AND s < 50 THEN -3 ELSE 0 END, 0), 100)")} adjusted FROM s""")
def match_scores(spark, sf_dir):
    """A weighted score with a gated placement bonus."""
    c = F.col
    s = F.least(F.greatest(F.lit(30) + F.lit(4) * c("kills") + F.lit(2) * c("assists") - F.lit(3) * c("deaths") + F.coalesce("damage", F.lit(0.0)) / 5000, F.lit(0.0)), F.lit(100.0))
    x = player_match(spark, sf_dir).withColumn("s", s)
    bonus = F.when((c("placement") == 1) & (c("s") >= 50), 4.0).when((c("placement") <= 3) & (c("s") >= 50), 2.0).when((c("placement") >= 7) & (c("s") < 50), -3.0).otherwise(0.0)
    return x.select(*KEY.split(", "), js_round(c("s"), 4).alias("score"), js_round(F.least(F.greatest(c("s") + bonus, F.lit(0.0)), F.lit(100.0)), 4).alias("adjusted"))


@query(f"""WITH {PM} SELECT {KEY}, {R6.format("CASE WHEN duration / 60.0 <= 10 THEN 0.8 WHEN duration / 60.0 <= 15 THEN 0.8 + (duration / 60.0 - 10) * 0.03 WHEN duration / 60.0 <= 20 THEN 0.95 + (duration / 60.0 - 15) * 0.01 WHEN duration / 60.0 <= 25 THEN 1.0 + (duration / 60.0 - 20) * 0.03 ELSE 1.15 END")} multiplier FROM pm""")
def duration_multiplier(spark, sf_dir):
    """A piecewise-linear curve over the minute."""
    pm = player_match(spark, sf_dir)
    return pm.select(*KEY.split(", "), js_round(interpolate(F.col("duration") / F.lit(60.0), CURVE), 6).alias("multiplier"))


@query("SELECT " + TIER_SQL.format("c_acctbal") + " tier, count(*) n, min(c_acctbal) low, max(c_acctbal) high FROM customer GROUP BY 1")
def tier_ladder(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(tier_of(F.col("c_acctbal")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("SELECT conv_id, turn, CASE WHEN length(lower(trim(role))) >= 2 THEN lower(trim(role)) END nick, trim(text) body, length(text) n FROM conversations")
def normalized_names(spark, sf_dir):
    from matchloom.functions.core import nickname

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nickname(F.col("role")).alias("nick"), F.trim("text").alias("body"), F.length("text").cast("long").alias("n"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') kst_day, CAST(month(ts + INTERVAL 9 HOUR) AS VARCHAR) || '. ' || CAST(day(ts + INTERVAL 9 HOUR) AS VARCHAR) || '.' kst_label, CASE WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts) < 3600 THEN 'now' WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts) < 86400 THEN 'today' ELSE CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400) AS INT) || 'd' END age FROM events")
def day_labels(spark, sf_dir):
    """Seoul day, its label and the age as text."""
    from matchloom.functions.core import kst_day

    k, old = F.col("ts") + F.expr("INTERVAL 9 HOURS"), F.expr("timestampdiff(SECOND, ts, timestamp_ntz'2024-02-01')")
    age = F.when(old < 3600, "now").when(old < 86400, "today").otherwise(F.concat(F.floor(old / 86400).cast("string"), F.lit("d")))
    return table(spark, sf_dir, "events").select("event_id", kst_day(F.col("ts")).alias("kst_day"), F.concat(F.month(k).cast("string"), F.lit(". "), F.dayofmonth(k).cast("string"), F.lit(".")).alias("kst_label"), age.alias("age"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), CAST(json_extract_string(props, '$.k') AS DOUBLE)) v FROM events")
def first_alias_number(spark, sf_dir):
    """The first finite number among alias keys of a JSON object."""
    from matchloom.functions.core import finite

    m = F.from_json("props", "map<string,string>")
    first = lambda key: F.try_element_at(m, F.lit(key)).try_cast("double")
    keep = lambda c: F.when(finite(c), c)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(keep(first("missing")), keep(first("k"))).alias("v"))


@query("SELECT conv_id, turn, regexp_replace(text, '[0-9]{3,}', '#', 'g') redacted, regexp_matches(text, '[0-9]') has_digits, regexp_matches(lower(text), 'the ') english FROM conversations")
def redacted_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[0-9]{3,}", "#").alias("redacted"), F.col("text").rlike("[0-9]").alias("has_digits"), F.lower("text").contains("the ").alias("english"))


@query("SELECT c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) h, 'uid_' || left(sha256(CAST(c_custkey AS VARCHAR)), 10) short FROM customer")
def hashed_identities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", stable_hash(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("h"), F.concat(F.lit("uid_"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 10)).alias("short"))


@query(f"""WITH {PM}, a AS (SELECT uid, list(kills ORDER BY game_id, slot, part_id, source_id, kills) l FROM pm GROUP BY 1) SELECT uid, len(l) n, len(list_filter(l, lambda x: x > 5)) high, CAST(list_sum(l) AS BIGINT) total, l[1] AS first FROM a""")
def array_profiles(spark, sf_dir):
    g = player_match(spark, sf_dir).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("game_id", "slot", "part_id", "source_id", "kills"))).alias("s"))
    k = F.transform("s", lambda x: x["kills"])
    return g.select("uid", F.size("s").cast("long").alias("n"), F.size(F.filter(k, lambda x: x > 5)).cast("long").alias("high"), F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("s")[0]["kills"].alias("first"))


@query(f"""WITH {PM} SELECT {KEY}, CASE WHEN damage IS NULL THEN 'missing' WHEN weapon = 0 THEN 'unknown_weapon' WHEN team_kills = 0 THEN 'no_team_kills' ELSE 'complete' END reason, CASE WHEN deaths IS NULL THEN NULL ELSE {R4.format("coalesce(damage, 0) / (1 + greatest(0, deaths))")} END tanking FROM pm""")
def evidence_gates(spark, sf_dir):
    reason = F.when(F.col("damage").isNull(), "missing").when(F.col("weapon") == 0, "unknown_weapon").when(F.col("team_kills") == 0, "no_team_kills").otherwise("complete")
    tank = F.coalesce("damage", F.lit(0.0)) / (F.lit(1) + F.greatest(F.lit(0).cast("long"), F.col("deaths")))
    return player_match(spark, sf_dir).select(*KEY.split(", "), reason.alias("reason"), js_round(tank, 4).alias("tanking"))
