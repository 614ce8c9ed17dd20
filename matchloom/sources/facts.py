"""The fact table player_match (one player in one game), bound to the order tables, and its SQL for checks.

The binding carries no meaning of its own: it gives every role of the schema a column with ties, nulls and duplicates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.core import tier_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the lineitem files to a task. A task then has some 450,000 matches, whatever the size of the table.
TASK_BYTES = 8_000_000


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks the matches are dealt to; none where spark.sql.shuffle.partitions is enough."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    n = ceil(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() / TASK_BYTES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, sf_dir: str, *keys: str) -> DataFrame:
    """df dealt out by keys to a number of tasks that grows with the matches, so that a task's sorts and hash tables do not; small tables are left to Spark."""
    n = tasks(df.sparkSession, sf_dir)
    return df.repartition(n, *keys) if n else df


def player_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that a query uses are read: the projection is pushed to both scans. Large tables come dealt out by game, so what follows by game shuffles nothing."""
    l, o = spread(table(spark, sf_dir, "lineitem"), sf_dir, "l_orderkey"), spread(table(spark, sf_dir, "orders"), sf_dir, "o_orderkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    whole = lambda c: F.floor(c).cast("long")
    return j.select(
        F.col("o_custkey").alias("uid"), F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("slot"),
        (F.col("l_linenumber") % 3).alias("team_number"), (F.col("l_partkey") % 50).alias("character_num"), (F.col("l_suppkey") % 8).alias("weapon"),
        F.col("l_linenumber").alias("placement"), (whole(F.col("l_quantity")) % 13).alias("kills"), (F.col("l_suppkey") % 7).alias("deaths"),
        (F.col("l_partkey") % 11).alias("assists"), (whole(F.col("l_quantity")) % 13 + F.col("l_partkey") % 5).alias("team_kills"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_extendedprice")).alias("damage"), whole(F.col("o_totalprice") / 60).alias("rp_after"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 61 - 30).alias("rp_delta"), (F.col("l_orderkey") * 37 % 1500 + 500).alias("duration"),
        F.when(F.col("l_returnflag") == "A", "rank").when(F.col("l_returnflag") == "N", "normal").otherwise("cobalt").alias("game_mode"),
        (F.col("l_linenumber") == 1).alias("victory"), F.col("o_orderdate").alias("played_at"), F.year("o_orderdate").alias("season"),
        F.col("l_shipdate").alias("updated_at"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("part_id"), (F.col("l_partkey") % 4).alias("role"),
        tier_of(whole(F.col("o_totalprice") / 60)).alias("tier"),
    )


#: The same columns for DuckDB, as the common table expression pm.
TIER_SQL = (
    "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 'unranked' WHEN {0} >= 7600 THEN 'mithril_plus' WHEN {0} >= 6400 THEN 'meteorite_plus' WHEN {0} >= 5000 THEN 'diamond_plus' "
    "WHEN {0} >= 3600 THEN 'platinum' WHEN {0} >= 2400 THEN 'gold' WHEN {0} >= 1400 THEN 'silver' WHEN {0} >= 600 THEN 'bronze' ELSE 'iron' END"
)
PM = f"""pm AS (SELECT o_custkey uid, l_orderkey game_id, l_linenumber slot, l_linenumber % 3 team_number, l_partkey % 50 character_num, l_suppkey % 8 weapon,
 l_linenumber placement, CAST(floor(l_quantity) AS BIGINT) % 13 kills, l_suppkey % 7 deaths, l_partkey % 11 assists,
 CAST(floor(l_quantity) AS BIGINT) % 13 + l_partkey % 5 team_kills, CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END damage,
 CAST(floor(o_totalprice / 60) AS BIGINT) rp_after, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey % 61 - 30 END rp_delta, l_orderkey * 37 % 1500 + 500 duration,
 CASE l_returnflag WHEN 'A' THEN 'rank' WHEN 'N' THEN 'normal' ELSE 'cobalt' END game_mode, l_linenumber = 1 victory, o_orderdate played_at,
 CAST(year(o_orderdate) AS INTEGER) season, l_shipdate updated_at, l_suppkey source_id, l_partkey part_id, l_partkey % 4 AS role,
 {TIER_SQL.format('floor(o_totalprice / 60)')} tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def rank_only(pm: DataFrame) -> DataFrame:
    return pm.where(F.col("game_mode") == "rank")


def mode_filter(mode: str) -> Column:
    """all, one mode, or cobalt by mode or team code."""
    if mode == "all":
        return F.lit(True)
    if mode == "cobalt":
        return (F.col("game_mode") == "cobalt") | (F.col("weapon") == 6)
    return F.col("game_mode") == mode
