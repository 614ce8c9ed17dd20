"""Hierarchical lookups: from the finest key with enough samples to coarser ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_means(df: DataFrame, levels: list[list[str]], value: str, n: str | None = None) -> list[DataFrame]:
    """Mean and count of a value at each level of keys; with n, value is a sum over so many."""
    mean, count = (F.avg(value), F.count(value)) if n is None else (F.try_divide(F.sum(value), F.sum(n)), F.sum(n))
    return [(df.groupBy(*keys) if keys else df.groupBy()).agg(mean.alias(f"mean{i}"), count.alias(f"n{i}")) for i, keys in enumerate(levels)]


def first_level(rows: DataFrame, source: DataFrame, levels: list[list[str]], aggs: list[Column], least: tuple[int, ...], finest: Column, n: Column | None = None) -> DataFrame:
    """rows with the aggregates of the first level of keys that has a record, baseline_n and level.

    least: samples a record needs, level by level (1 where it ends); finest: the condition on rows for the first level;
    n: how a record counts its samples, if the rows of source are no samples themselves.
    Each level is a join with a table of its keys."""
    out, names = rows, [f"_level{i}" for i in range(len(levels))]
    for i, keys in enumerate(levels):
        record = source.groupBy(*keys).agg((F.count(F.lit(1)) if n is None else n).alias("baseline_n"), *aggs)
        need = least[i] if i < len(least) else 1
        record = record.where(F.col("baseline_n") >= need).select(*keys, F.struct(*(c for c in record.columns if c not in keys)).alias(names[i]))
        out = out.join(record, keys, "left")
    found = F.coalesce(F.when(finest, F.col(names[0])), *map(F.col, names[1:]))
    level = F.when(finest & F.col(names[0]).isNotNull(), 0)
    for i, n in enumerate(names[1:], 1):
        level = level.when(F.col(n).isNotNull(), i)
    return out.withColumns({"_found": found, "level": level}).select(*rows.columns, "level", "_found.*")


def shrunk_levels(rows: DataFrame, source: DataFrame, levels: list[list[str]], value: str, k: float, n: str | None = None) -> DataFrame:
    """rows with expected: from the coarsest level down, each level's mean shrunk to that of the level above by n / (n + k)."""
    out = rows
    for means, keys in zip(level_means(source, levels, value, n), levels):
        out = out.join(means, keys, "left") if keys else out.crossJoin(F.broadcast(means))
    expected = F.col(f"mean{len(levels) - 1}")
    for i in range(len(levels) - 2, -1, -1):
        many = F.coalesce(F.col(f"n{i}"), F.lit(0))
        w = many / (many + F.lit(float(k)))
        expected = F.when(many > 0, w * F.col(f"mean{i}") + (F.lit(1.0) - w) * expected).otherwise(expected)
    return out.withColumn("expected", expected).drop(*(f"{c}{i}" for i in range(len(levels)) for c in ("mean", "n")))
