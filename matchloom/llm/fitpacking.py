"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized once; what is longer than a sequence is cut into whole sequences and a rest. A plan is made from the
histogram alone, which has a row for each length up to a sequence's: lengths in falling order, each taking the sequences
with the least room that holds it, many alike at a time. The plan is a table of runs: ranks a to b of a length go into
sequences from s on, so many in each, at an offset. A piece's rank within its length is its place in its block (the task
that wrote it, which counts by length) after the pieces of that length in earlier blocks; by that rank it takes its slot.

No step sorts or groups the documents: blocks bound every key of the join, also where one length is that of most documents.
The plan has some ten thousand runs at most: each length leaves at most four new ranges of sequences, and the room of a
range more than halves whenever it is moved as a whole.

Null texts are documents of one end id; null ids and repeated rows are packed like others; no documents, no rows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, read, shared_dir, small_batches, tokenizer_path, written
from .tokens import encoder

#: Rows of (length, block) that are broadcast at most.
BROADCAST_BLOCKS = 300_000


def pieces(docs: DataFrame, tokenizer: str, room: int, end_id: int, keep_ids: bool) -> DataFrame:
    """A row per piece, with its block and how many pieces of its length the block has before it."""

    def make():
        enc = encoder(tokenizer)
        end, block = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId()
        seen = [0] * (room + 1)

        def apply(batch):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), room)):
                    part = ids[start : start + room]
                    n, data = len(part), part.tobytes()
                    for c, v in zip(out, (doc_id, piece, start, n, zlib.crc32(data), seen[n], data)):
                        out[c].append(v)
                    seen[n] += 1
            return out | {"block": [block] * len(out["piece"])}

        return apply

    kind = dict(docs.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block long, nth long" + (", ids binary" if keep_ids else "")
    return map_batches(docs.select("doc_id", "text"), make, ddl)


def plan(histogram: dict[int, int], room: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset), and the number of sequences: best fit, longest first."""
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(left: int, begin: int, n: int) -> None:
        if left and n:
            if left not in ranges:
                ranges[left] = []
                insort(rooms, left)
            ranges[left].append((begin, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                begin, n = ranges[left].pop()
                if not ranges[left]:
                    del ranges[left], rooms[at]
            else:
                left, begin, n = room, used, -(-todo // (room // length))
                used += n
            each = left // length
            full = min(n, todo // each)
            for times, per in ((full, each), (1, todo - full * each)) if full < n else ((full, each),):
                if times and per:
                    runs.append((length, rank, begin, per, room - left))
                    put(left - per * length, begin, times)
                    begin, n, rank, todo = begin + times, n - times, rank + times * per, todo - times * per
            put(left, begin, n)
    return runs, used


def placed(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Every piece with the sequence and offset of its rank's slot, found by binary search in the runs."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def make():
        def apply(batch):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            _, first, sequence, per, offset = table[at].T
            place = rank - first
            kept = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            return kept | {"sequence_id": sequence + place // per, "offset": offset + place % per * length}

        return apply

    ddl = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"
    return map_batches(ranked, make, ddl)


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, room: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with keep_ids also its ids, packed as 32-bit numbers."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    with small_batches(spark):
        cut = written(pieces(docs, tokenizer_path("word_bpe_49k.json", tokenizer), room, end_id, keep_ids), folder, "pieces")
    counts = cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = written(counts.withColumn("before", F.coalesce(before, F.lit(0))), folder, "blocks")
    histogram = {r.length: r.n for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # room rows at most
    starts = blocks.select("length", "block", "before")
    if blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    ranked = cut.join(starts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("nth"))
    ids = ["ids"] if keep_ids else []
    return placed(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "rank"), plan(histogram, room)[0])


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(read(spark, sf_dir, "documents"))
