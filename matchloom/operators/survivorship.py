"""One row per key: which one survives is said by explicit orderings, ties included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def merge_by_priority(sources: list[DataFrame], keys: list[str], *order: Column) -> DataFrame:
    """Keyed union: an earlier source wins over a later one."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return first_by(both, keys, F.col("_source"), *order)


def completeness(*columns: str) -> Column:
    """How many of the columns are not null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in by key; columns of keep_if_null keep their old value where the new one is null."""
    o = old.select(*keys, F.struct(*old.columns).alias("o"))
    n = new.select(*keys, F.struct(*new.columns).alias("n"))
    j = o.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in old.columns))


def outcome(old: DataFrame, new: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """For each new row: created, updated or reused, by its fingerprint."""
    o = old.select(*keys, F.col(fingerprint).alias("_old"))
    return new.join(o, keys, "left").withColumn(
        "outcome", F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col(fingerprint), "reused").otherwise("updated")
    ).drop("_old")
