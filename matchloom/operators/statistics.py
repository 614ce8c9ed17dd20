"""Order statistics and robust statistics as grouped or windowed expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counted import counted, nearest_quantile, quantile, ranked


def winsorized_mean(df: DataFrame, keys: list[str], value: str, p: float, interpolated: bool) -> DataFrame:
    """The mean of the values capped at the p-quantile, interpolated or of the nearest rank; of counted values."""
    counts = ranked(counted(df.where(F.col(value).isNotNull()), keys, value), keys, value)
    caps = counts.groupBy(*keys).agg((quantile if interpolated else nearest_quantile)(value, p).alias("_cap"))
    return counts.join(caps, keys).groupBy(*keys).agg((F.sum(F.least(F.col(value), F.col("_cap")) * F.col("n")) / F.sum("n")).alias("winsorized"))


def pearson(x: str, y: str) -> Column:
    """Null for a constant column or a single row."""
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def isotonic(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted monotone regression by pooling adjacent violators; a group is one curve, one row per point of x."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, x]) + ", fitted double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        pools: list[list[float]] = []
        for v, w in zip(pdf[y], pdf[weight]):
            pools.append([float(v), float(w), 1])
            while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                total = a[1] + b[1]
                pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
        return pdf[[*keys, x]].assign(fitted=[v for v, _, n in pools for _ in range(int(n))])

    return df.groupBy(*keys).applyInPandas(fit, schema)
