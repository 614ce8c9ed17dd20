"""Vector code compression: a codebook for each of 16 parts of the vectors, fitted through metric trees.

Components become integers floor(256 x). Rows are taken in blocks of a few thousand; for each block and part one tree
(metrictree) is built and written to the shared folder. Each round sends the codebooks (at most 16 x 64 entries) to the
tasks, descends every tree, and adds up sums and counts by part and entry; the last descent gives codes and errors. All
figures are integers, so they do not depend on how rows are dealt out; equal vectors of a block are one point of its trees.

Dropped: null vectors, vectors with a null or non-finite component, vectors whose length is not a positive multiple of 16
or not that of the kept vector with the smallest vec_id (ties: the smaller vector; null ids last). Repeated rows count
each. Integer components are held within a bound, 2^27 for 64 components, so that an error fits a long; a label's sum
beyond a long is null. With fewer than 64 kept vectors the codebooks are shorter; without any there are no rows."""

from __future__ import annotations

from hashlib import sha256
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, shared_dir, slices, small_batches, written
from .metrictree import Tree

PARTS, ENTRIES, ROUNDS, BLOCK = 16, 64, 2, 4096
#: Labels whose sums are broadcast at most.
BROADCAST_LABELS = 100_000


def whole_components(vectors: DataFrame, parts: int) -> DataFrame:
    """vec_id, label and the integer components q of the rows that can be coded."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    size = F.size("embedding")
    df = vectors.where(F.col("embedding").isNotNull() & (size > 0) & (size % parts == 0) & F.forall("embedding", fine))
    limit = lambda n: F.floor(F.sqrt(F.lit(float(1 << 60)) / n))
    held = lambda x: F.floor(F.greatest(-limit(size), F.least(limit(size), x.cast("double") * 256)))
    return df.select("vec_id", "label", F.transform("embedding", held).alias("q"))


def start_entries(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, one a row."""
    order = F.col("vec_id").asc_nulls_last(), F.col("q")
    rows = [r.q for r in kept.orderBy(*order).limit(entries).select("q").collect()]
    if len({len(q) for q in rows}) > 1:
        rows = [r.q for r in kept.where(F.size("q") == len(rows[0])).orderBy(*order).limit(entries).select("q").collect()]
    return np.array(rows, np.int64)


def forest(kept: DataFrame, dims: int, parts: int) -> DataFrame:
    """Blocks of rows: their ids and labels, and a tree for each part."""

    def make():
        def apply(batch):
            ids, labels, trees = [], [], []
            q = batch.column("q").values.to_numpy(zero_copy_only=False).reshape(-1, parts, dims // parts)
            for s in slices(batch.num_rows, BLOCK):
                ids.append(batch.column("vec_id")[s.start : s.stop].to_pylist())
                labels.append(batch.column("label")[s.start : s.stop].to_pylist())
                trees.append([Tree(q[s, p]).packed() for p in range(parts)])
            return {"ids": ids, "labels": labels, "trees": trees}

        return apply

    kinds = dict(kept.dtypes)
    return map_batches(kept.where(F.size("q") == dims), make, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees array<binary>")


def next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry moved to the mean, rounded down, of its parts; unused ones stay. At most parts x entries rows are collected."""
    parts, entries, width = books.shape

    def make():
        def apply(batch):
            sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
            for row in batch.column("trees").to_pylist():
                for p, raw in enumerate(row):
                    Tree.unpacked(raw).add_to(books[p], sums[p], counts[p])
            part, entry = np.nonzero(counts)
            return {"part": part, "entry": entry, "n": counts[part, entry], "sums": sums[part, entry].tolist()}

        return apply

    found = map_batches(trees.select("trees"), make, "part int, entry int, n long, sums array<long>")
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect():
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def codes(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row."""
    kinds = dict(trees.dtypes)
    element = lambda c: kinds[c].removeprefix("array<").removesuffix(">")

    def make():
        def apply(batch):
            code, error = [], []
            for row in batch.column("trees").to_pylist():
                entry, off = zip(*(Tree.unpacked(raw).nearest(books[p]) for p, raw in enumerate(row)))
                code += [x.tobytes().hex() for x in np.column_stack(entry).astype(np.uint8)]
                error += sum(off).tolist()
            return {"vec_id": batch.column("ids").flatten(), "label": batch.column("labels").flatten(), "code": code, "error": error}

        return apply

    return map_batches(trees, make, f"vec_id {element('ids')}, label {element('labels')}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that can be coded; entries: 256 at most."""
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    kept = whole_components(vectors, parts)
    start = start_entries(kept, entries)
    dims = start.shape[1] if len(start) else parts
    books = start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    with small_batches(spark):
        trees = written(forest(kept, dims, parts), folder, "trees")
        for _ in range(rounds if len(start) else 0):
            books = next_books(trees, books)
        coded = written(codes(trees, books), folder, "codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(read(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """A round in SQL: books b{i-1} to b{i}."""
    return f"""n{i} AS (SELECT k, part, first(entry ORDER BY d, entry) entry FROM (SELECT q.k, q.part, b.entry, sum((q.x - b.x) * (q.x - b.x)) d FROM q JOIN b{i - 1} b USING (part, pos) GROUP BY ALL) GROUP BY ALL),
m{i} AS (SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) x FROM n{i} JOIN q USING (k, part) GROUP BY ALL),
b{i} AS (SELECT part, entry, pos, coalesce(m.x, b.x) x FROM b{i - 1} b LEFT JOIN m{i} m USING (part, entry, pos))"""


OP11_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT k, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 16 AS w FROM v),
q AS MATERIALIZED (SELECT k, i // w AS part, i % w AS pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) x FROM e),
b0 AS (SELECT part, k AS entry, pos, x FROM q WHERE k < 64),
{_round(1)},
{_round(2)},
c AS (SELECT k, part, first(entry ORDER BY d, entry) entry, min(d) d FROM (SELECT q.k, q.part, b.entry, sum((q.x - b.x) * (q.x - b.x)) d FROM q JOIN b2 b USING (part, pos) GROUP BY ALL) GROUP BY ALL),
r AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) code, CAST(sum(d) AS BIGINT) error FROM c GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) codebooks_sha256 FROM r JOIN v USING (k)"""
