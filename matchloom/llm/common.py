"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Lower-cases A-Z and turns every ASCII character that is no digit or letter into a space; bytes of
#: non-ASCII characters stay, so splitting the result gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; a null text has none."""
    return text.translate(WORD_TABLE).split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def give_back() -> None:
    """Returns unused memory of Arrow and of the C library, where it can, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m"):
    """Arrow batches of about `most` bytes for the jobs that run inside; a limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """Applies make()(batch) -> {column: values} to the Arrow batches of every partition.

    make runs once a task, so that it may load what the task needs. Rows of a batch may map to any number of rows.
    Workers are reused, so a task gives its memory back to the system at its end."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            out = apply(batch)
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow],
                schema=arrow,
            )
        give_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with df's own columns on both sides, whatever their names: on its way in a column is called by its place."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.rename_columns(names) for batch in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, df.schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df, with all their columns, for which make()(batch) says True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))
        give_back()

    return map_rows(df, run)


def replace_column(df: DataFrame, name: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with the values of one column replaced by make()(batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in batches:
            at = batch.schema.get_field_index(name)
            yield batch.set_column(at, batch.schema.field(at), pa.array(values(batch), batch.schema.field(at).type))
        give_back()

    return map_rows(df, run)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, as in local tests, a temporary folder takes its place; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/matchloom-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Rows of 8-byte keys that are broadcast at most: 8 MB.
BROADCAST_KEYS = 1_000_000


def filtered(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """df's rows with (or without: left_anti) a key of a written one-column table of numbers, which is broadcast if it is small."""
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, on, how)


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))


def tokenizer_path(name: str, path: str | None = None) -> str:
    """path if given, else the installed public vocabulary file of that name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
