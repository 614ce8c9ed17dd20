"""Bootstrap of groups: replicates drawn by a fixed 32-bit generator from counted values.

A group is its sorted values with their counts; draw number t of a group takes the value at floor(u * n), u being the t-th
number of the generator, so replicate i has the draws from i * n on. The generator can jump to any draw, so replicates are
drawn anywhere. Rows are never copied: a replicate is the values with new counts.

Null and non-finite values have no part; a group without values has no row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.core import finite

from .counted import counted

# The generator's factor and step.
FACTOR, STEP = 1664525, 1013904223
# End of fixed values.

MASK = (1 << 32) - 1
#: Indexes of a block, after which the next one begins; a block of few values may have more.
BLOCK = 1 << 23
#: Draws made at a time, values of a row, and the values of a block for which draws are compared with the ends instead of looked up.
CHUNK, ROW, FEW = 1 << 16, 1 << 10, 16
#: Draws of a range of replicates at most, unless a group then has more ranges than RANGES.
DRAWS, RANGES = 1 << 28, 8


def jump(state: int, steps: int) -> int:
    """The generator's state so many steps on."""
    factor, step, a, c = 1, 0, FACTOR, STEP
    while steps:
        if steps & 1:
            factor, step = factor * a & MASK, (step * a + c) & MASK
        a, c, steps = a * a & MASK, (a * c + c) & MASK, steps >> 1
    return (state * factor + step) & MASK


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and steps of 1 to n steps of the generator."""
    a, c = np.array([FACTOR], np.uint32), np.array([STEP], np.uint32)
    while len(a) < n:
        a, c = np.concatenate([a, a * a[-1]]), np.concatenate([c, a * c[-1] + c])
    return a[:n], c[:n]


def draws(seed: int, first: int, count: int, n: int) -> np.ndarray:
    """Indexes below n of the draws first to first + count - 1."""
    a, c = _powers(max(count, CHUNK))
    states = np.uint32(jump(seed & MASK, first)) * a[:count] + c[:count]
    return np.floor(states / 4294967296.0 * n).astype(np.int64)


def _tasks(df: DataFrame) -> int:
    """Rows of draws are small and their work is not, so they are dealt out by number and not by size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def packed(counts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, _first, _vs, _ns: the counted values of each group in order, up to so many a row. Ranges and not groups are sorted, so a group may span tasks."""
    kinds = dict(counts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _first double, _vs array<double>, _ns array<long>"
    rows = counts.select(*keys, "_v", "n").repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v")

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if not batch.num_rows:
                continue
            v, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_v", "n"))
            edge = np.zeros(len(v), bool)
            for k in keys:
                codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                edge[1:] |= codes[1:] != codes[:-1]
            edge[0] = True
            starts = np.flatnonzero(edge)
            at = np.concatenate([np.arange(b, e, size) for b, e in zip(starts, [*starts[1:], len(v)])])
            cuts = pa.array(np.append(at, len(v)), pa.int32())
            own = [batch.column(batch.schema.get_field_index(k)).take(pa.array(at)) for k in keys]
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (v, n)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(v[at]), *lists], names=[*keys, "_first", "_vs", "_ns"])

    return rows.mapInArrow(pack, schema)


class _Replicate:
    """A replicate while its group's values pass in order: how many draws have been met, the sum of the smallest, and the values at four places."""

    def __init__(self, n: int, ps: tuple[float, float]):
        self.n, self.met, self.sum = n, 0, 0.0
        self.pos = [(n - 1) * p for p in ps]
        self.places = [f(x) for x in self.pos for f in (floor, ceil)]
        self.found: list[float | None] = [None] * 4
        self.least = self.places[0] + 1

    def meet(self, values: np.ndarray, new: np.ndarray) -> None:
        upto = np.cumsum(new)
        many = int(upto[-1])
        for k, place in enumerate(self.places):
            if self.met <= place < self.met + many:
                self.found[k] = float(values[np.searchsorted(upto, place - self.met, side="right")])
        rest = self.least - self.met
        if rest >= many:
            self.sum += float((values * new).sum())
        elif rest > 0:
            j = int(np.searchsorted(upto, rest))
            self.sum += float((values[:j] * new[:j]).sum()) + float(values[j]) * (rest - (int(upto[j - 1]) if j else 0))
        self.met += many

    def at(self, k: int) -> float:
        low, high, pos = self.found[2 * k], self.found[2 * k + 1], self.pos[k]
        return low if low == high else (ceil(pos) - pos) * low + (pos - floor(pos)) * high

    def mean(self) -> float:
        """All that lies above the place of the cap counts as the cap."""
        return (self.sum + (self.n - self.least) * self.at(0)) / self.n


def _met(seed: int, first: int, n: int, low: int, high: int, ends: np.ndarray, few: bool, direct: bool) -> np.ndarray:
    """How many of the n draws from first on fall to each value of a block: the indexes low to high, cut at ends (relative to low)."""
    step = min(n, CHUNK)
    a, c = _powers(CHUNK)
    start, scale = jump(seed & MASK, first), n / 4294967296.0
    whole = high - low == n
    got, total = [], np.zeros(len(ends), np.int64)
    for begin in range(0, n, step):
        many = min(step, n - begin)
        states = np.uint32(start) * a[:many] + c[:many]
        start = int(states[-1])
        x = states * scale
        if few:
            total += [np.count_nonzero(x < low + e) for e in ends.tolist()]
            if low:
                total -= np.count_nonzero(x < low)
            continue
        index = x.astype(np.int64)
        if not whole:
            index = index[(index >= low) & (index < high)] - low
        if direct:
            got.append(index)
        else:
            total += np.bincount(np.searchsorted(ends, index, side="right"), minlength=len(ends))
    if few:
        return np.diff(total, prepend=0)
    if not direct:
        return total
    new = np.bincount(np.concatenate(got), minlength=high - low)
    return new if len(ends) == high - low else np.add.reduceat(new, np.concatenate([[0], ends[:-1]]))


def replicates(df: DataFrame, keys: list[str], value: str, iterations: int, seed: int, cap: float = 0.95, anchor: float = 0.9) -> DataFrame:
    """keys, iteration, mean (of values capped at the cap-quantile) and anchor (a quantile) of every replicate of every group.

    Counted values meet a range of replicates in one task and pass it in order, a block at a time; a task draws a replicate's numbers
    anew for each block. So neither draws nor replicates are shuffled, and a task holds one block and one replicate's draws in it."""
    values = df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = counted(values, keys, "_v")
    kinds = dict(values.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", iteration int, mean double, anchor double"
    size = BLOCK
    totals = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    per = F.greatest(F.lit(-(-iterations // RANGES)), F.least(F.lit(iterations), (F.lit(DRAWS) / F.col("_total")).cast("int")))
    ranges = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), "_total", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), per)).alias("_from"), per.alias("_per"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    parts = packed(counts, keys, min(size, ROW)).join(ranges, on).select(*keys, "_from", "_per", "_total", "_first", "_vs", "_ns")

    def pass_block(state: list[_Replicate], begin: int, n: int, low: int, vs: list[np.ndarray], ns: list[np.ndarray]) -> int:
        v, ends = np.concatenate(vs), np.cumsum(np.concatenate(ns))
        high = low + int(ends[-1])
        for i, r in enumerate(state, begin):
            r.meet(v, _met(seed, i * n, n, low, high, ends, len(ends) <= FEW, high - low <= 2 * size))
        return high

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, state, low, vs, ns, held, distinct = None, [], 0, [], [], 0, 0

        def finished() -> Iterator[pd.DataFrame]:
            if unit is not None:
                key, begin, n = unit
                if vs:
                    pass_block(state, begin, n, low, vs, ns)
                yield pd.DataFrame([(*key, i, r.mean(), r.at(1)) for i, r in enumerate(state, begin)], columns=[*keys, "iteration", "mean", "anchor"])

        for pdf in frames:
            for *key, begin, many, n, v, w in pdf[[*keys, "_from", "_per", "_total", "_vs", "_ns"]].itertuples(index=False):
                now = (tuple(None if pd.isna(k) else k for k in key), int(begin), int(n))
                if now != unit:
                    yield from finished()
                    unit, low, vs, ns, held, distinct = now, 0, [], [], 0, 0
                    state = [_Replicate(int(n), (cap, anchor)) for _ in range(int(begin), min(int(begin + many), iterations))]
                vs.append(v)
                ns.append(w)
                held, distinct = held + int(w.sum()), distinct + len(v)
                if held >= size and distinct > FEW:
                    low, vs, ns, held, distinct = pass_block(state, int(begin), int(n), low, vs, ns), [], [], 0, 0
        yield from finished()

    spread = parts.repartition(_tasks(df), *keys, "_from").sortWithinPartitions(*keys, "_from", "_first")
    return spread.mapInPandas(drawn, schema)
