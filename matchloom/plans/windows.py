"""Time: day series, runs, splits, folds over ordered events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.core import js_round, kst_day
from matchloom.operators.counted import numbered
from matchloom.sources.facts import PM, player_match, rank_only, table
from matchloom.sources.scratch import shared_folder

from .registry import query

R4 = "floor(({0}) * 10000 + 0.5) / 10000"
LAST = "played_at, game_id, slot, part_id, source_id"


@query(f"""WITH {PM}, d AS (SELECT uid, strftime(played_at + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) games, min(rp_after) low, max(rp_after) high, arg_max(rp_after, ({LAST})) AS closing FROM pm WHERE game_mode = 'rank' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY day DESC) r FROM d) SELECT uid, day, games, low, high, closing FROM r WHERE r <= 7""")
def rp_day_series(spark, sf_dir):
    """Closing, least and greatest RP of each Seoul day; the last seven played days."""
    d = rank_only(player_match(spark, sf_dir)).groupBy("uid", kst_day(F.col("played_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("games"), F.min("rp_after").alias("low"), F.max("rp_after").alias("high"), F.max_by("rp_after", F.struct(*LAST.split(", "))).alias("closing")
    )
    w = Window.partitionBy("uid").orderBy(F.desc("day"))
    return d.withColumn("r", F.row_number().over(w)).where("r <= 7").drop("r")


@query("""WITH x AS (SELECT user_id, ts, event_id, value < 50 low, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 50 ORDER BY ts, event_id) g FROM events),
r AS (SELECT user_id, g, count(*) n FROM x WHERE low GROUP BY 1, 2) SELECT u.user_id, coalesce(max(n), 0) longest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY 1""")
def longest_low_run(spark, sf_dir):
    """The longest run of values under 50, by the difference of two row numbers."""
    e = table(spark, sf_dir, "events").withColumn("low", F.col("value") < 50)
    a, b = (F.row_number().over(Window.partitionBy(*k).orderBy("ts", "event_id")) for k in (["user_id"], ["user_id", "low"]))
    runs = e.withColumn("g", a - b).groupBy("user_id", "low", "g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("low"), F.col("n"))), F.lit(0)).cast("long").alias("longest"))


@query(f"""WITH {PM}, r AS (SELECT role, kills, row_number() OVER (PARTITION BY role ORDER BY {LAST}, kills, updated_at) r, count(*) OVER (PARTITION BY role) n FROM pm) SELECT role, CASE WHEN r <= floor(0.7 * n) THEN 'train' ELSE 'validation' END part, count(*) n, {R4.format("avg(kills)")} mean FROM r GROUP BY 1, 2""")
def train_validation_split(spark, sf_dir):
    """The first 70 % by time train."""
    order = [*LAST.split(", "), "kills", "updated_at"]
    r = numbered(player_match(spark, sf_dir).select("role", *order), ["role"], order, shared_folder(spark), "r").withColumnRenamed("total", "n")
    return r.groupBy("role", F.when(F.col("r") <= F.floor(F.lit(0.7) * F.col("n")), "train").otherwise("validation").alias("part")).agg(F.count(F.lit(1)).alias("n"), js_round(F.avg("kills"), 4).alias("mean"))


@query(f"""WITH {PM}, g AS (SELECT DISTINCT game_id, CAST('0x' || substr(sha256(CAST(game_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 h FROM pm) SELECT CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'calibration' ELSE 'final' END part, count(*) games FROM g GROUP BY 1""")
def hashed_game_split(spark, sf_dir):
    """A game is in one split only: the first 32 bits of its sha256 as a share of their largest value."""
    g = player_match(spark, sf_dir).select("game_id").distinct()
    h = F.conv(F.substring(F.sha2(F.col("game_id").cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return g.groupBy(F.when(h < 0.6, "train").when(h < 0.8, "calibration").otherwise("final").alias("part")).agg(F.count(F.lit(1)).alias("games"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r, count(*) OVER (PARTITION BY user_id) n FROM events),
f AS (SELECT user_id, r, n, value s FROM e WHERE r = 1 UNION ALL SELECT f.user_id, e.r, f.n, 0.3 * e.value + 0.7 * f.s FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, n, floor(s * 10000 + 0.5) / 10000 ewma FROM f WHERE r = n""")
def ewma_state(spark, sf_dir):
    """An exponential average, as the closed weighted sum: value i of n weighs 0.3 * 0.7^(n - i), the first 0.7^(n - 1)."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy("ts", "event_id")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    weight = F.when(F.col("r") == 1, F.pow(F.lit(0.7), F.col("n") - 1)).otherwise(F.lit(0.3) * F.pow(F.lit(0.7), F.col("n") - F.col("r")))
    return e.groupBy("user_id", "n").agg(js_round(F.sum(weight * F.col("value")), 4).alias("ewma"))


@query(f"""WITH {PM}, r AS (SELECT uid, kills, row_number() OVER (PARTITION BY uid ORDER BY {LAST}, kills, updated_at) r, count(*) OVER (PARTITION BY uid) n FROM pm) SELECT uid, max(n) n, {R4.format("avg(kills) FILTER (r > n - n // 2) - avg(kills) FILTER (r <= n - n // 2)")} delta FROM r WHERE n >= 4 GROUP BY 1""")
def recent_half_delta(spark, sf_dir):
    w = Window.partitionBy("uid")
    r = player_match(spark, sf_dir).select("uid", "kills", F.row_number().over(w.orderBy(*LAST.split(", "), "kills", "updated_at")).alias("r"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 4")
    newer = F.col("r") > F.col("n") - F.expr("n div 2")
    return r.groupBy("uid").agg(F.max("n").alias("n"), js_round(F.avg(F.when(newer, F.col("kills"))) - F.avg(F.when(~newer, F.col("kills"))), 4).alias("delta"))


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events) SELECT user_id, count(*) FILTER (p IS NULL OR ts - p > INTERVAL 12 HOUR) sessions, count(*) n FROM e GROUP BY 1""")
def activity_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("p").isNull() | (F.col("ts") > F.col("p") + F.expr("INTERVAL 12 HOURS"))).alias("sessions"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-30' - INTERVAL 14 DAY THEN 'deferred' WHEN ts < TIMESTAMP '2024-01-30' - INTERVAL 6 HOUR THEN 'past' ELSE 'open' END state, CAST(least(3600, 30 * pow(2, event_id % 12)) AS BIGINT) retry_seconds FROM events WHERE event_type = 'error'""")
def retry_schedule(spark, sf_dir):
    """Late rows are deferred, not dropped; the retry delay doubles up to an hour."""
    now = F.lit("2024-01-30").cast("timestamp")
    state = F.when(F.col("ts") < now - F.expr("INTERVAL 14 DAYS"), "deferred").when(F.col("ts") < now - F.expr("INTERVAL 6 HOURS"), "past").otherwise("open")
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", state.alias("state"), F.least(F.lit(3600.0), F.lit(30.0) * F.pow(F.lit(2.0), F.col("event_id") % 12)).cast("long").alias("retry_seconds"))


@query(f"""WITH {PM} SELECT game_id, min(rp_after // 1000) priority, arg_min(source_id, (played_at, slot, part_id, source_id)) first_source, count(*) proposals FROM pm WHERE game_mode = 'rank' GROUP BY 1""")
def enqueue_games(spark, sf_dir):
    """A queue keyed by game: the least priority number and the first attributes survive."""
    return rank_only(player_match(spark, sf_dir)).groupBy("game_id").agg(F.min(F.floor(F.col("rp_after") / 1000)).alias("priority"), F.min_by("source_id", F.struct("played_at", "slot", "part_id", "source_id")).alias("first_source"), F.count(F.lit(1)).alias("proposals"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) n FROM events GROUP BY 1), x AS (SELECT day, n, lag(n) OVER (ORDER BY day) p FROM d) SELECT day, n, CASE WHEN p IS NULL THEN 'start' WHEN n > p * 1.05 THEN 'growing' WHEN n < p * 0.95 THEN 'draining' ELSE 'stable' END trend FROM x""")
def backlog_trend(spark, sf_dir):
    """Day against day: the window runs over the few daily sums, not over events."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    p = F.lag("n").over(Window.orderBy("day"))
    trend = F.when(p.isNull(), "start").when(F.col("n") > p * F.lit(1.05), "growing").when(F.col("n") < p * F.lit(0.95), "draining").otherwise("stable")
    return d.select("day", "n", trend.alias("trend"))


@query("""WITH m AS (SELECT conv_id, role, turn, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) nxt FROM conversations) SELECT conv_id, count(*) turns, count(*) FILTER (role <> nxt) switches, max(turn) last_turn FROM m GROUP BY 1""")
def conversation_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") != F.col("nxt")).alias("switches"), F.max("turn").alias("last_turn"))
