"""Packing along a space-filling curve.

A document's token ids are hashed into a count vector, scaled to length 1 and projected onto a few fixed random
directions; the Hilbert key of that point orders documents so that neighbours on the curve are alike. The table is
range-sorted by the key, and every range is packed in curve order into sequences of a fixed length. Documents are cut
where a sequence is full. What remains at the end of a range is split into sequences of powers of two, which need no
padding.

Null texts are documents of one end id. Rows with the same id or text are packed each. Equal keys, such as those of
copies, are spread by document id, so that no range grows with a group of copies.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, shared_dir, small_batches, tokenizer_path, written
from .records import ranges
from .tokens import encoder

DIMS, BITS, BUCKETS = 4, 15, 256


def projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of integer points (n, dims) with so many bits a coordinate, by axis exchanges and a Gray code."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, curve key, number of ids and the packed ids, end id included."""

    def make():
        enc, table = encoder(tokenizer), projection()
        bucket = (np.arange(enc.tokenizer.get_vocab_size(), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
        end = np.array([end_id], enc.dtype).tobytes()

        def apply(batch):
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            counts = np.zeros((len(ids), BUCKETS))
            for k, x in enumerate(ids):
                counts[k] = np.bincount(bucket[np.frombuffer(x, enc.dtype)], minlength=BUCKETS)
            point = (counts / np.linalg.norm(counts, axis=1, keepdims=True)) @ table
            grid = np.clip((point + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            return {"doc_id": batch.column("doc_id"), "curve": hilbert(grid), "n": [len(x) // enc.dtype.itemsize for x in ids], "width": [enc.dtype.itemsize] * len(ids), "ids": ids}

        return apply

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, curve long, n long, width int, ids binary")


def pack(tokens: DataFrame, length: int = 1024, range_bytes: int = 64 << 20) -> DataFrame:
    """One row per piece: which ids of its document it holds, and its sequence and place there.

    The number of ranges follows from the size of the ids."""
    size = tokens.agg(F.sum(F.col("n") * F.col("width")).alias("n")).first().n or 0
    spread = tokens.repartitionByRange(ranges(tokens.sparkSession, size, range_bytes), "curve", "doc_id", "n").sortWithinPartitions("curve", "doc_id", "n")

    def make():
        # Sequences are numbered within a range; the upper bits hold the range.
        state = {"sequence": TaskContext.get().partitionId() << 32, "used": 0, "held": []}

        def tail() -> list[tuple]:
            """The held pieces of an unfinished sequence, cut anew into sequences of powers of two."""
            out, room, at = [], 0, 0
            left = state["used"]
            for doc_id, start, ids, total in state["held"]:
                while len(ids):
                    if not room:
                        room, at = 1 << (left.bit_length() - 1), 0
                        left -= room
                        state["sequence"] += 1
                    take = min(room, len(ids))
                    out.append((doc_id, start, ids[:take], total, state["sequence"] - 1, at))
                    start, ids, room, at = start + take, ids[take:], room - take, at + take
            state["held"], state["used"] = [], 0
            return out

        def apply(batch):
            out = []
            for doc_id, width, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "width", "ids"))):
                ids = np.frombuffer(raw, f"<u{width}")
                total, start = len(ids), 0
                while start < total:
                    take = min(length - state["used"], total - start)
                    state["held"].append((doc_id, start, ids[start : start + take], total))
                    state["used"] += take
                    start += take
                    if state["used"] == length:
                        at = 0
                        for d, s, x, n in state["held"]:
                            out.append((d, s, x, n, state["sequence"], at))
                            at += len(x)
                        state["sequence"] += 1
                        state["held"], state["used"] = [], 0
            return rows(out)

        def rows(out):
            return {
                "doc_id": [r[0] for r in out], "start": [r[1] for r in out], "length": [len(r[2]) for r in out],
                "ids_crc32": [zlib.crc32(r[2].astype("<u4").tobytes()) for r in out], "doc_tokens": [r[3] for r in out],
                "sequence_id": [r[4] for r in out], "offset": [r[5] for r in out],
            }

        apply.finish = lambda: rows(tail())
        return apply

    return _map_with_finish(spread.select("doc_id", "width", "ids"), make)


def _map_with_finish(df: DataFrame, make) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from .common import schema_of

    schema = schema_of("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        apply = make()
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        for batch in batches:
            yield table(apply(batch))
        yield table(apply.finish())

    return df.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Tokens are written once to the shared folder, so that the range sort reads keys alone to find its bounds."""
    folder = shared_dir(docs.sparkSession)
    with small_batches(docs.sparkSession):
        tokens = written(tokenized(docs, tokenizer_path("byte_bpe_50k.json", tokenizer), end_id), folder, "tokens")
    return pack(tokens, length)


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
