"""Incremental collection as Structured Streaming: each job takes what is new, and ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.sources.sinks import VersionedTable


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder or pattern, with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run_once(stream_writer, checkpoint: str) -> None:
    """Works through all that is new in micro-batches; a restart goes on from the checkpoint."""
    stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def usage_counters(events: DataFrame) -> DataFrame:
    """Requests and failures by UTC day and endpoint; the state is one row per day and endpoint."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 day").alias("w"), F.col("event_type").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") < 20).alias("failures"), F.count_if(F.col("value") >= 20).alias("successes")
    ).select(F.to_date("w.start").alias("day"), "endpoint", "requests", "failures", "successes")


def deduplicated(events: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Each event once; state is kept for the watermark's delay only."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def merge_latest(table: VersionedTable, keys: list[str], order: list[str]):
    """A foreachBatch function: the newest row of each key in the batch, if newer than the stored one, replaces it. Repeating a batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*table.schema.names), F.struct(*order)).alias("r")).select("r.*")
        old = table.current().select(*keys, F.struct(*order).alias("_old"))
        fresh = newest.join(old, keys, "left").where(F.col("_old").isNull() | (F.struct(*order) > F.col("_old"))).drop("_old")
        table.merge(fresh, keys)

    return put


MODES = ("normal", "soft", "hard")


def controller(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An operating mode per key from an exponential average: up at once, down one step after three calm events."""
    mean, mode, calm, seen = state.get if state.exists else (0.0, 0, 0, 0)
    # A micro-batch may come in several frames; they are put in order by time within the batch.
    for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
        mean = r.value if seen == 0 else 0.3 * r.value + 0.7 * mean
        seen += 1
        want = 2 if mean > 75 else 1 if mean > 55 else 0
        if want > mode:
            mode, calm = want, 0
        elif want < mode:
            calm += 1
            if calm >= 3:
                mode, calm = mode - 1, 0
        else:
            calm = 0
    state.update((mean, mode, calm, seen))
    yield pd.DataFrame({"user_id": [key[0]], "mean": [mean], "mode": [MODES[mode]], "seen": [seen]})


def mode_updates(events: DataFrame) -> DataFrame:
    """The mode of each user after every micro-batch, from state kept between batches."""
    return events.groupBy("user_id").applyInPandasWithState(
        controller, "user_id long, mean double, mode string, seen long", "mean double, mode long, calm long, seen long", "update", GroupStateTimeout.NoTimeout
    )
