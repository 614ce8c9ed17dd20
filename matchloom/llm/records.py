"""Binary token records: length-delimited frames with masked checksums, and a separate offset index.

A data file is a run of frames: length (u64), masked crc32c of those 8 bytes (u32), payload, masked crc32c of the payload
(u32), all little-endian. The payload is document id (i64), flags (u16: 1 no id; bytes an id in the upper byte) and the
token ids. The index file beside it holds the offset of each frame (u64) and at last the size of the data file, so that
a reader can take frames in any order.

Files are written by tasks into a shared folder under names of their own; the manifest, itself a Parquet table, lists
those of successful tasks, so a lost executor or a second attempt leaves nothing behind that is read.

Null texts are empty documents of one end id. Rows with the same id are kept, in the order of their texts' hashes. A
null id sorts first and is flagged.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, map_batches, read, schema_of, shared_dir, slices, tokenizer_path, written
from .tokens import encoder

BLOCK = 512


def _byte_table() -> np.ndarray:
    """The table of CRC-32C, reflected polynomial 0x82F63B78."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0x82F63B78), x >> 1).astype(np.uint32)
    return x


T1 = _byte_table()
_X = np.arange(1 << 16, dtype=np.uint32)
_X = T1[_X & 255] ^ (_X >> 8)
#: Two bytes at a time.
T2 = (T1[_X & 255] ^ (_X >> 8)).astype(np.uint32)


def _zeros(state: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        state = T1[state & 255] ^ (state >> 8)
    return state


#: What a state becomes after BLOCK zero bytes, by each of its four bytes.
SKIP = [_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * i), BLOCK) for i in range(4)]


def _skip(state: np.ndarray) -> np.ndarray:
    return SKIP[0][state & 255] ^ SKIP[1][(state >> 8) & 255] ^ SKIP[2][(state >> 16) & 255] ^ SKIP[3][state >> 24]


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of many messages at once: all blocks of all messages walk through the table side by side."""
    if not messages:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(m) for m in messages], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    # The first block is padded on the left; with an initial state of 0 leading zeros do not count.
    padded = np.frombuffer(b"".join(b"\0" * int(b * BLOCK - n) + m for m, n, b in zip(messages, sizes, blocks)), "<u2").reshape(-1, BLOCK // 2)
    raw = np.empty(len(padded), np.uint32)
    for part in slices(len(padded), 1 << 15):
        columns, state = padded[part].T.copy(), np.zeros(part.stop - part.start, np.uint32)
        for w in columns:
            state = T2[(state ^ w) & 0xFFFF] ^ (state >> 16)
        raw[part] = state
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    out, order = np.zeros(len(messages), np.uint32), np.argsort(-blocks, kind="stable")
    ranked = blocks[order]
    for k in range(int(blocks.max())):
        live = order[: np.searchsorted(-ranked, -k, side="left")]
        out[live] = _skip(out[live]) ^ raw[first[live] + k]
    return out ^ _initial(sizes) ^ np.uint32(0xFFFFFFFF)


def _initial(sizes: np.ndarray) -> np.ndarray:
    """What the initial state of all ones becomes after so many bytes: by powers of two of zero bytes."""
    state = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    step = [T1[np.arange(256, dtype=np.uint32)] if i == 0 else np.arange(256, dtype=np.uint32) << np.uint32(8 * i - 8) for i in range(4)]
    left = sizes.copy()
    while left.any():
        moved = step[0][state & 255] ^ step[1][(state >> 8) & 255] ^ step[2][(state >> 16) & 255] ^ step[3][state >> 24]
        state = np.where(left & 1, moved, state).astype(np.uint32)
        step = [step[0][s & 255] ^ step[1][(s >> 8) & 255] ^ step[2][(s >> 16) & 255] ^ step[3][s >> 24] for s in step]
        left >>= 1
    return state


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits, plus the fixed constant of the framing."""
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)).astype(np.uint32)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)), masked(crc32c(payloads))
    return [h + struct.pack("<I", x) + p + struct.pack("<I", y) for h, x, p, y in zip(heads, a.tolist(), payloads, b.tolist())]


def payloads(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """The payloads of the frames that start at offsets in data, checked."""
    heads, out, sums = [], [], []
    for at in offsets.tolist():
        head = data[at : at + 8]
        n = struct.unpack("<Q", head)[0]
        heads.append(head)
        out.append(data[at + 12 : at + 12 + n])
        sums.append((data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]))
    for got, k in ((masked(crc32c(heads)), 0), (masked(crc32c(out)), 1)):
        if b"".join(x[k] for x in sums) != got.astype("<u4").tobytes():
            raise ValueError("a record's checksum does not match")
    return out


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def ranges(spark: SparkSession, size: int, range_bytes: int) -> int:
    """How many ranges of about range_bytes so much data makes, and as many as the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes), 1)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, range_bytes: int = 64 << 20) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order, one file a task; returns the manifest: part, data, documents, tokens.

    Range partitions on (doc_id, hash of the text) give every task a stretch of the order, also if many rows share an id.
    Their number follows from the size of the texts."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(ranges(docs.sparkSession, size, range_bytes), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = schema_of("part long, data string, documents long, tokens long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        system, base = filesystem(folder)
        end = np.array([end_id], enc.dtype).tobytes()
        flag = enc.dtype.itemsize << 8
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        total = documents = tokens = 0
        with system.open_output_stream(f"{name}.rec") as out, system.open_output_stream(f"{name}.idx") as index:
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                for s in slices(len(ids), 1024):
                    data = enc.encode(texts.slice(s.start, s.stop - s.start).to_pylist())
                    done = frames([struct.pack("<qH", i or 0, flag | (i is None)) + x + end for i, x in zip(ids[s], data)])
                    sizes = np.array([len(x) for x in done], "<u8")
                    index.write((total + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype("<u8").tobytes())
                    out.write(b"".join(done))
                    total += int(sizes.sum())
                    documents += len(done)
                    tokens += sum(map(len, data)) // enc.dtype.itemsize + len(done)
            index.write(struct.pack("<Q", total))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, name, documents, tokens), arrow)], schema=arrow)

    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    return written(ordered.mapInArrow(run, schema), folder, "manifest")


def starts(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """The manifest with the number of ids before each file: sums within groups of files, then over the groups."""
    files = manifest.withColumn("group", F.floor(F.col("part") / group))
    within = files.withColumn("start", F.sum("tokens").over(Window.partitionBy("group").orderBy("part")) - F.col("tokens"))
    groups = files.groupBy("group").agg(F.sum("tokens").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.orderBy("group")) - F.col("n")).select("group", "before")
    return within.join(before, "group").withColumn("start", F.col("start") + F.col("before")).drop("group", "before")


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """A payload's document id and token ids."""
    doc_id, flags = struct.unpack_from("<qH", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, f"<u{flags >> 8}", offset=10)


def index_of(name: str) -> np.ndarray:
    """The offsets of a file's frames and, at last, its size."""
    system, path = filesystem(name)
    with system.open_input_stream(f"{path}.idx") as file:
        return np.frombuffer(file.read(), "<u8")


def take(name: str, records: np.ndarray, offsets: np.ndarray) -> list[tuple[int | None, np.ndarray]]:
    """The records of a file with the given numbers, in that order, by its index: what a reader in random order does."""
    system, path = filesystem(name)
    out = []
    with system.open_input_file(f"{path}.rec") as file:
        for k in records.tolist():
            file.seek(int(offsets[k]))
            data = file.read(int(offsets[k + 1] - offsets[k]))
            out += [parsed(p) for p in payloads(data, np.zeros(1, np.uint64))]
    return out


def spread(manifest: DataFrame, most: int = 10_000) -> DataFrame:
    return manifest.repartition(max(1, min(most, manifest.count())))


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's files: doc_id, start, n_tokens and the crc32 of the ids as unsigned 32-bit numbers.

    start counts the ids of all records before it."""

    def make():
        def one(name: str, start: int) -> Iterator[tuple]:
            system, path = filesystem(name)
            index = index_of(name)
            with system.open_input_file(f"{path}.rec") as file:
                for s in slices(len(index) - 1, 1024):
                    begin = int(index[s.start])
                    file.seek(begin)
                    data = file.read(int(index[s.stop]) - begin)
                    for doc_id, ids in map(parsed, payloads(data, index[s] - np.uint64(begin))):
                        yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                        start += len(ids)

        def apply(batch):
            rows = [r for b in batch.to_pylist() for r in one(b["data"], b["start"])]
            return dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*rows) if rows else [[]] * 4))

        return apply

    return map_batches(spread(starts(manifest).select("data", "start")), make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(manifest: DataFrame, seed: int, at_once: int = 1024) -> DataFrame:
    """One row (doc_id, ids) per record, in an order that the seed fixes for every file; tasks take files in turn."""
    schema = schema_of("doc_id long, ids array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(batch.column("data").to_pylist(), batch.column("part").to_pylist()):
                index = index_of(name)
                order = np.random.default_rng([seed, part]).permutation(len(index) - 1)
                for s in slices(len(order), at_once):
                    rows = take(name, order[s], index)
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x.astype(np.int64) for _, x in rows], arrow.field("ids").type)], schema=arrow)

    return spread(manifest.select("data", "part")).mapInArrow(run, schema)


def op3_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = shared_dir(spark)
    manifest = write_records(read(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json", tokenizer))
    return read_records(manifest)
