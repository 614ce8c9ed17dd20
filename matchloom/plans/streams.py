"""Queries that run a stream to its end and return what it has written.

The source is given as a pattern, since a file source takes a folder or a pattern but not a single file."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom.functions.core import js_round
from matchloom.sources.facts import table
from matchloom.sources.scratch import shared_folder
from matchloom.sources.sinks import VersionedTable
from matchloom.streaming.collector import caps_of, collector_states, rocksdb_state
from matchloom.streaming.jobs import deduplicated, events_stream, merge_latest, mode_updates, run_once, usage_counters

from .registry import query


@query("SELECT CAST(ts AS DATE) AS day, event_type endpoint, count(*) requests, count(*) FILTER (value < 20) failures, count(*) FILTER (value >= 20) successes FROM events GROUP BY 1, 2")
def stream_usage_counters(spark, sf_dir):
    folder = shared_folder(spark)
    counters = usage_counters(deduplicated(events_stream(spark, f"{sf_dir}/[e]vents.parquet"), "40 days"))
    table = VersionedTable(spark, f"{folder}/counters", counters.schema)
    writer = counters.writeStream.outputMode("update").foreachBatch(lambda batch, _: table.merge(batch, ["day", "endpoint"]))
    run_once(writer, f"{folder}/state")
    return table.current()


@query("SELECT user_id, max(ts) ts, max(struct_pack(t := ts, e := event_id)).e event_id, arg_max(event_type, (ts, event_id)) event_type FROM events GROUP BY 1")
def stream_latest_event(spark, sf_dir):
    folder = shared_folder(spark)
    events = events_stream(spark, f"{sf_dir}/[e]vents.parquet").select("user_id", "ts", "event_id", "event_type")
    table = VersionedTable(spark, f"{folder}/latest", StructType(events.schema.fields))
    run_once(events.writeStream.foreachBatch(merge_latest(table, ["user_id"], ["ts", "event_id"])), f"{folder}/state")
    return table.current()


@query(None)
def stream_mode_controller(spark, sf_dir):
    """The state machine's last mode per user; tested against a plain loop."""
    folder = shared_folder(spark)
    events = events_stream(spark, f"{sf_dir}/[e]vents.parquet").select("user_id", "ts", "event_id", "value")
    table = VersionedTable(spark, f"{folder}/modes", mode_updates(events).schema)
    run_once(mode_updates(events).writeStream.outputMode("update").foreachBatch(lambda batch, _: table.merge(batch, ["user_id"])), f"{folder}/state")
    return table.current().select("user_id", js_round(F.col("mean"), 6).alias("mean"), "mode", "seen")


def run_reports(spark, sf_dir):
    """Events as reports of workers' runs; they arrive up to six hours late."""
    e, c = table(spark, sf_dir, "events"), F.col
    waiting = F.floor(c("value") * 150).cast("long")
    game, user, identity = c("event_id") % 21, c("event_id") % 13, 40 + c("event_id") % 30
    return e.select(
        c("user_id").alias("worker"), c("ts").cast("timestamp").alias("at"), F.unix_micros(c("ts").cast("timestamp")).alias("at_us"), "event_id",
        (game + user + identity + 5 + (c("event_id") % 41 == 0).cast("long")).alias("calls"), (waiting - c("event_id") % 900 + 300).alias("pending_before"), waiting.alias("pending"),
        game.alias("game_api"), user.alias("user_api"), identity.alias("identity_api"), F.lit(5).cast("long").alias("maintenance_api"),
        (game * (c("event_id") % 5) / 4).cast("long").alias("added_game"), (user * (c("event_id") % 3) / 4).cast("long").alias("added_user"), (identity * (c("event_id") % 7) / 6).cast("long").alias("processed"),
        (c("ts").cast("timestamp") + F.make_dt_interval(hours=(c("event_id") % 7).cast("int"))).alias("arrived"),
    )


@query(None)
def collector_modes(spark, sf_dir):
    """Mode and caps after each run and stale runs, from reports that arrive in three parts; tested against a plain loop.

    The last part holds one row of a later time only, with which the watermark passes all reports."""
    folder, reports = shared_folder(spark), run_reports(spark, sf_dir)
    first, last = reports.agg(F.min("arrived"), F.max("arrived")).first()
    schema = reports.drop("arrived").schema
    start, stop = (F.lit(t).cast("timestamp") for t in (first, last))
    half = start + (stop - start) / 2
    end = (stop + F.expr("INTERVAL 60 DAYS")).alias("at")
    close = spark.range(1).select(*(end if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    for part in (reports.where(F.col("arrived") <= half), reports.where(F.col("arrived") > half), close):
        part.select(*schema.names).write.mode("append").parquet(f"{folder}/reports")
        states = collector_states(spark.readStream.schema(schema).parquet(f"{folder}/reports"), "12 hours", stale_seconds=86400)
        with rocksdb_state(spark):
            run_once(states.writeStream.format("parquet").option("path", f"{folder}/states"), f"{folder}/state")
    return spark.read.schema(states.schema).parquet(f"{folder}/states")


CAPS_SQL = """WITH e AS (SELECT event_id, CAST(100 + event_id % 400 AS BIGINT) calls, value / 50.0 per_game, value / 200.0 per_user, (event_id % 17) / 10.0 per_identity FROM events),
k AS (SELECT *, calls * 25 // 100 g0, calls * 15 // 100 u0, calls * 55 // 100 least, calls * 5 // 100 upkeep FROM e),
f AS (SELECT *, list_max([t FOR t IN range(0, g0 + u0 + 1) IF least(g0, greatest(t - u0, t // 2)) * per_game + (t - least(g0, greatest(t - u0, t // 2))) * per_user <= greatest(least, calls - t - upkeep) * per_identity * CAST(0.9 AS DOUBLE)]) best FROM k),
h AS (SELECT *, CASE WHEN g0 * per_game + u0 * per_user <= least * per_identity * CAST(0.9 AS DOUBLE) THEN g0 + u0 ELSE coalesce(best, 0) END kept FROM f)
SELECT event_id, calls, least(g0, greatest(kept - u0, kept // 2)) game_cap, kept - least(g0, greatest(kept - u0, kept // 2)) user_cap FROM h"""


@query(CAPS_SQL)
def balanced_caps(spark, sf_dir):
    """The most calls for games and users whose inflow the other calls can work off, at each event's rates."""
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", (100 + F.col("event_id") % 400).alias("calls"), (F.col("value") / 50.0).alias("g"), (F.col("value") / 200.0).alias("u"), (F.col("event_id") % 17 / 10.0).alias("i"))
    caps = caps_of(F.col("calls"), F.col("g"), F.col("u"), F.col("i"))
    return e.select("event_id", "calls", caps.alias("c")).select("event_id", "calls", F.col("c.game").alias("game_cap"), F.col("c.user").alias("user_cap"))
