"""Ranks and quantiles from counted values, and row numbers of large groups.

Equal values of a group are counted first, map-side too, so windows run over a group's distinct values and never over its
rows. A row number, which cannot be counted, is taken range by range: the table is range-partitioned by group and order,
each range numbers its own rows, and the sizes of the ranges before it are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """keys, value and n, the rows that have it; further aggregates go along. Null values are counted too."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *more)


def ranked(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Adds before, how many rows of the group have a smaller value, and total, its rows with a value; a null value has no part in them."""
    w = Window.partitionBy(*keys)
    real = F.when(F.col(value).isNotNull(), F.col(n))
    before = F.sum(real).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum(real).over(w)})


def by_range(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df dealt out by ranges of order, to parts tasks if given: rows equal in order meet in one range. Its number, spark_partition_id(), never falls as order rises."""
    return df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)


def quantile(value: str, p: float, n: str = "n") -> Column:
    """The interpolated p-quantile of a group of ranked counts, as an aggregate."""
    pos = (F.col("total") - 1) * F.lit(float(p))
    upto = F.col("before") + F.col(n)
    at = lambda i: F.min(F.when(F.col(value).isNotNull() & (upto > i), F.col(value))).cast("double")
    low, high, place = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos)
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def nearest_quantile(value: str, p: float, n: str = "n") -> Column:
    """The smallest value that at least the share p of a group does not exceed."""
    return F.min(F.when(F.col(value).isNotNull() & (F.col("before") + F.col(n) >= F.col("total") * F.lit(float(p))), F.col(value)))


def with_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df's rows with before, n and total of their value; rows whose key or value is null go, as a join drops them.

    The join is with a table of distinct values: broadcast where that is small, else split by Spark where a value is hot."""
    return df.join(ranked(counted(df.where(F.col(value).isNotNull()), keys, value), keys, value), [*keys, value])


def midrank(before: Column, n: Column, total: Column) -> Column:
    """100 (below + equal / 2) / n."""
    return F.lit(100.0) * (before + n / 2) / total


def index_midrank(before: Column, n: Column, total: Column) -> Column:
    """The mean index of the equal values over n - 1; 0.5 for a single value."""
    return F.when(total == 1, F.lit(0.5)).otherwise((before + (n - 1) / 2) / (total - 1))


def numbered(df: DataFrame, keys: list[str], order: list[str], folder: str, number: str = "number", weight: str | None = None) -> DataFrame:
    """df with the place of each row in its group, from 1, and total, the group's rows; ties in order are broken anyhow.

    With weight a row stands for so many, and its place is that of the last of them. The ranges are written to the shared folder, so
    that all that follows sees the same ones, whatever executor is lost. What is joined has a row for each range and group that meet."""
    spark, path = df.sparkSession, f"{folder}/{number}"
    ranges = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranges.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(ranges.schema).parquet(path)
    w, size = Window.partitionBy(*keys), F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = rows.groupBy("_range", *keys).agg(size.alias("_n"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(w)})
    sizes = sizes.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_{k}") for k in keys), "_before", "total")
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    own = rows.withColumn("_own", F.row_number().over(inside) if weight is None else F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(sizes, on).withColumn(number, F.col("_before") + F.col("_own")).select(*df.columns, number, "total")
