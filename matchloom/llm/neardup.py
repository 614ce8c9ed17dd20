"""Near-duplicate documents by DartMinHash signatures and banded joining.

Elements are shingles of five lower-cased words, weighted by how often they occur; similarity is weighted Jaccard, 0.8
or more. A document of fewer words is one shingle. Copies with the same words collapse to one representative first.
Signatures of 240 coordinates, dealt twice into 30 bands of 8, put a pair of similarity 0.8 into a common bucket with
probability 0.9999, one of 0.5 with 0.21 and one of 0.3 with 0.004.

First every document is held against one other, the hottest hub of its buckets, which gives fewer pairs than documents and
puts nearly all of a large group of copies into one class. Then all pairs of different classes that share a bucket are
checked, exactly, on the texts: those of buckets with few members as rows of pairs, those of larger buckets in blocks, where
a group of rows is two blocks of documents and no pair becomes a row. Before that, blocks of sketches (one byte of each
coordinate) find the documents that agree with any other closely enough to be similar; a pair that agrees on fewer
coordinates than five standard deviations below the threshold goes, which loses one similar pair in three million. So the classes are the connected components of
all similar pairs that share a bucket, however rows are dealt and whatever the hubs are; members of one class do not meet
again. The work for a bucket grows with the documents outside its largest class times its members.

Texts without words are alone in their class. Repeated rows are copies of each other. A class is named by its least
doc_id; null ids sort last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, deleted, filtered, map_batches, read, shared_dir, slices, small_batches, words_of, written
from .components import components
from .dartminhash import GOLDEN, bands, mix, signatures, strips

WORDS, SIMILARITY, K, ROWS, DEALS = 5, 0.8, 240, 8, 2
#: A bucket with so many members at most gives its pairs of different classes as rows; a larger one is checked in blocks.
FEW = 16
#: Documents, and bytes of text, in a block at most, about.
BLOCK, BLOCK_BYTES = 1024, 8 << 20


class Shingler:
    """Hashes of words, kept for at most `most` distinct ones, and of runs of words."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def shingles(self, words: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, shingle hash) of all documents; documents without words have none."""
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set().union(*words) if words else ():
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((known[w] for x in words for w in x), np.uint64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
        first = np.arange(len(flat)) == np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.flatnonzero((left >= n) | first)
        out = np.zeros(len(starts), np.uint64)
        padded = np.concatenate([flat, np.zeros(n, np.uint64)])
        for i in range(n):
            out = out * GOLDEN + np.where(left[starts] > i, mix(padded[starts + i] + np.uint64(i + 1)), np.uint64(0))
            out = mix(out)
        return doc[starts], out


_SHINGLER = Shingler()


def signed(docs: DataFrame, folder: str, words: int, k: int, rows: int, deals: int) -> DataFrame:
    """Writes the rows of docs with a row number, a 128-bit key of their words, the bands of their signatures and sketches.

    A copy within a batch gets no signature: the first one stands for it."""
    schema = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        part = TaskContext.get().partitionId()
        state = {"rows": part << 40}

        def apply(batch):
            texts = batch.column("row").field("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 8 * k)
            keys: list = []
            out: list = []
            sketches: list = []
            known: set = {None}
            i = 0
            # A part of the batch at a time: about a megabyte of text, or one document.
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1_000_000)))
                lists = [words_of(t) for t in as_bytes(texts.slice(i, j - i))]
                for n, w in enumerate(lists):
                    key = xxhash.xxh3_128_digest(b" ".join(w)) if w else None
                    keys.append(key)
                    if key in known:
                        lists[n] = []
                    known.add(key)
                doc, element = _SHINGLER.shingles(lists, words)
                signature = signatures(strips(doc, element), doc, j - i, k)
                out += [x.tolist() if w else [] for w, x in zip(lists, bands(signature, rows, deals))]
                sketches += [x.tobytes() for x in (signature >> np.uint64(56)).astype(np.uint8)]
                i = j
            first = state["rows"]
            state["rows"] += len(texts)
            return {"rid": np.arange(first, first + len(texts)), "key": keys, "bands": out, "sketch": sketches, "row": batch.column("row")}

        return apply

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return written(map_batches(packed, make, f"rid long, key binary, bands array<long>, sketch binary, row struct<{schema}>"), folder, "signed")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two documents by their sorted strips."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def checked(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar: exact, pair by pair."""
    left = texts.select(F.col("rid").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("rid").alias("b"), F.col("text").alias("b_text"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")

    def make():
        kept: dict[int, np.ndarray] = {}
        size = 0

        def of(rid: int, text: bytes | None) -> np.ndarray:
            nonlocal size
            if rid not in kept:
                # A row of a large group meets many others; 8 MB of hashes are kept.
                if size > 1_000_000:
                    kept.clear()
                    size = 0
                doc, element = _SHINGLER.shingles([words_of(text)], words)
                kept[rid] = np.sort(strips(doc, element))
                size += len(kept[rid])
            return kept[rid]

        def apply(batch):
            found = []
            for part in slices(batch.num_rows, 64):
                some = batch.slice(part.start, part.stop - part.start)
                for a, b, x, y in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), as_bytes(some.column("a_text")), as_bytes(some.column("b_text"))):
                    x, y = of(a, x), of(b, y)
                    # The smaller must be large enough, else the pair cannot be similar.
                    if min(len(x), len(y)) >= least * max(len(x), len(y)) and similarity(x, y) >= least:
                        found.append((a, b))
            return {"a": [a for a, _ in found], "b": [b for _, b in found]}

        return apply

    return map_batches(joined, make, "a long, b long")


def overlaps(x: tuple, y: tuple, columns: int = 8192) -> np.ndarray:
    """How many strips each document of a block shares with each of another; a block is (documents, document, strip)."""
    (n, dx, sx), (m, dy, sy) = x, y
    both = np.intersect1d(sx, sy)
    out = np.zeros((n, m), np.float32)
    if not len(both):
        return out
    at = []
    for d, s in ((dx, sx), (dy, sy)):
        i = np.minimum(np.searchsorted(both, s), len(both) - 1)
        hit = both[i] == s
        at.append((d[hit], i[hit]))
    for part in slices(len(both), columns):
        dense = []
        for k, (d, i) in zip((n, m), at):
            here = (i >= part.start) & (i < part.stop)
            one = np.zeros((k, part.stop - part.start), np.float32)
            one[d[here], i[here] - part.start] = 1
            dense.append(one)
        out += dense[0] @ dense[1].T
    return out


def part_of(doc: np.ndarray, strip: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The numbers of the documents that keep marks, and the block of them."""
    own = np.flatnonzero(keep)
    number = np.cumsum(keep) - 1
    hit = keep[doc]
    return own, (len(own), number[doc[hit]], strip[hit])


def links(side: np.ndarray, kind: np.ndarray, doc: np.ndarray, strip: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Similar pairs of different classes between the documents of sides 0 and 1, or among those of side 2: one for each pair of classes.

    A document with too many strips that no document of the other side has is similar to none of them."""
    size = np.bincount(doc, minlength=len(side)).astype(np.float64)
    left, right = side != 1, side != 0
    if (side == 2).all():
        # A pair of different classes has one document at least outside the largest class.
        names, counts = np.unique(kind, return_counts=True)
        left = left & (kind != names[counts.argmax()])
        value, at, n = np.unique(strip, return_inverse=True, return_counts=True)
        shared = np.bincount(doc, n[at] > 1, minlength=len(side))
    else:
        shared = np.zeros(len(side))
        for own, other in ((side == 0, side == 1), (side == 1, side == 0)):
            shared[own] = np.bincount(doc, np.isin(strip, strip[other[doc]]), minlength=len(side))[own]
    hopeful = (shared >= least * size) & (size > 0)
    x, one = part_of(doc, strip, left & hopeful)
    y, two = part_of(doc, strip, right & hopeful)
    if not len(x) or not len(y):
        return []
    both = overlaps(one, two).astype(np.float64)
    similar = (both >= least * (size[x][:, None] + size[y][None, :] - both)) & (kind[x][:, None] != kind[y][None, :])
    found: dict = {}
    for i, j in zip(*np.nonzero(similar)):
        p, q = int(x[i]), int(y[j])
        found.setdefault((min(kind[p], kind[q]), max(kind[p], kind[q])), (p, q))
    return list(found.values())


def block_links(words: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """links() for a table (rid, class, side, text) of two blocks, or of one with itself (side 2)."""

    def apply(table):
        side, rid, kind = (table.column(c).to_numpy() for c in ("side", "rid", "class"))
        doc, element = _SHINGLER.shingles([words_of(t) for t in as_bytes(table.column("text").combine_chunks())], words)
        found = links(side, kind, doc, strips(doc, element), least)
        return pa.table({c: pa.array([int(rid[p[k]]) for p in found], pa.int64()) for k, c in enumerate("ab")})

    return apply


def close(side: np.ndarray, kind: np.ndarray, sketch: np.ndarray, least: float) -> np.ndarray:
    """Which documents agree closely enough with one of another class on the other side (side 2: on the same) to be similar."""
    k = sketch.shape[1]
    need = int(np.ceil(k * (least - 5 * (least * (1 - least) / k) ** 0.5)))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if (side == 2).all():
        names, counts = np.unique(kind, return_counts=True)
        left = left[kind[left] != names[counts.argmax()]]
    out = np.zeros(len(side), bool)
    other, other_kind = sketch[right], kind[right]
    for part in slices(len(left), max(1, (1 << 24) // max(1, len(right) * k))):
        own = left[part]
        agree = np.count_nonzero(sketch[own][:, None, :] == other[None, :, :], axis=2)
        hit = (agree >= need) & (kind[own][:, None] != other_kind[None, :])
        out[own] |= hit.any(1)
        out[right] |= hit.any(0)
    return out


def block_close(least: float) -> Callable[[pa.Table], pa.Table]:
    """The rows (bucket, rid) of a table (bucket, rid, class, side, sketch) that close() keeps."""

    def apply(table):
        side, kind = (table.column(c).to_numpy() for c in ("side", "class"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(side), -1)
        return table.select(["bucket", "rid"]).filter(pa.array(close(side, kind, sketch, least)))

    return apply


def shared(buckets: DataFrame) -> DataFrame:
    """The rows of buckets with two members or more, with the number n of them: dealt out by bucket once, for counts and join."""
    dealt = buckets.repartition(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    more = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return dealt.join(more.hint("merge"), "bucket")


def proposals(buckets: DataFrame) -> DataFrame:
    """(a, b): for each row number b the hottest hub a of its buckets. buckets: bucket, rid, heat.

    Heat, the sum of a document's bucket sizes, is largest for the text that others were made from."""
    hubs = buckets.groupBy("bucket").agg(F.max(F.struct("heat", (-F.col("rid")).alias("least"))).alias("hub"))
    best = buckets.select("bucket", "rid").join(hubs, "bucket").groupBy("rid").agg(F.max("hub").alias("hub"))
    return best.select((-F.col("hub.least")).alias("a"), F.col("rid").alias("b")).where("a <> b")


def classed(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df with the class of its row numbers."""
    named = classes.select(F.col("node").alias("rid"), F.col("component").alias("class"))
    return df.join(named, "rid", "left").withColumn("class", F.coalesce("class", "rid"))


def mixed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, rid, class, members: the rows of buckets that hold several classes."""
    of = classed(buckets.select("bucket", "rid"), classes)
    several = of.groupBy("bucket").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.count(F.lit(1)).alias("members"))
    return of.join(several.where("first <> last").select("bucket", "members"), "bucket")


def across(few: DataFrame) -> DataFrame:
    """(a, b): all pairs of different classes in buckets of few members, each pair once."""
    here = few.select("bucket", "class", "rid")
    other = here.select("bucket", F.col("class").alias("other"), F.col("rid").alias("b"))
    return here.join(other, "bucket").where("rid < b and class <> other").select(F.col("rid").alias("a"), "b").distinct()


def blocks_met(many: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """bucket, u, v, rid, class, side: the rows of each pair (u, v) of blocks that meet in a bucket; a block meets itself as side 2.

    Buckets are dealt into blocks of about so many documents or bytes. A class over that has blocks of its own, which do
    not meet each other; smaller classes share blocks."""
    sizes = many.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    weight = F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)
    sizes = sizes.select("bucket", "class", weight.alias("weight"))
    loose = sizes.groupBy("bucket").agg(F.sum(F.when(F.col("weight") <= 1, F.col("weight")).otherwise(0.0)).alias("loose"))
    big, parts = F.col("weight") > 1, lambda n: F.greatest(F.ceil(F.col(n)), F.lit(1))
    salt = F.when(big, F.pmod(F.xxhash64("rid"), parts("weight"))).otherwise(F.pmod(F.xxhash64("class"), parts("loose")))
    owner = F.when(big, F.col("class")).otherwise(-1)
    dealt = many.join(sizes, ["bucket", "class"]).join(loose, "bucket").select("bucket", "class", "rid", F.struct(owner.alias("owner"), salt.alias("salt")).alias("u"))
    blocks = dealt.select("bucket", "u").distinct()
    pairs = blocks.join(blocks.select("bucket", F.col("u").alias("v")), "bucket").where("u <= v and (u.owner <> v.owner or u.owner = -1)")
    ends = pairs.select("bucket", "u", "v", F.explode(F.expr("if(u = v, array(named_struct('block', u, 'side', 2)), array(named_struct('block', u, 'side', 0), named_struct('block', v, 'side', 1)))")).alias("end"))
    ends = ends.select("bucket", "u", "v", "end.side", F.col("end.block").alias("block"))
    return dealt.withColumnRenamed("u", "block").join(ends, ["bucket", "block"]).select("bucket", "u", "v", "rid", "class", "side")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, k: int = K, rows: int = ROWS, deals: int = DEALS) -> tuple[DataFrame, DataFrame]:
    """The signed rows of docs (rid, row, ...) and their classes (rid, class: the least row number of the class).

    Jobs with Python run here, in small batches: a pair brings two texts, so a full batch of pairs would be large."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, least, k, rows, deals)


def _near_duplicates(docs: DataFrame, words: int, least: float, k: int, rows: int, deals: int) -> tuple[DataFrame, DataFrame]:
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    work = f"{folder}/work"
    table = signed(docs, folder, words, k, rows, deals)
    copies = written(table.where("key is not null").groupBy("key").agg(F.min("rid").alias("rep")), folder, "copies")
    slim = table.where("key is not null").select("rid", "bands")
    reps = slim.join(copies.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi")
    full = written(shared(reps.select("rid", F.explode("bands").alias("bucket"))), work, "full")
    heat = written(full.groupBy("rid").agg(F.sum("n").alias("heat")), work, "heat")
    buckets = written(full.drop("n").join(heat, "rid"), work, "buckets")
    # The texts of all documents that share a bucket with another; what follows reads these alone.
    pool = written(filtered(table.select("rid", "row.text"), heat.select("rid"), "rid"), work, "pool")

    def texts(of: DataFrame, name: str) -> DataFrame:
        return written(filtered(pool, written(of.distinct(), work, f"{name}-rids"), "rid"), work, name)

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        needed = texts(pairs.select(F.explode(F.array("a", "b")).alias("rid")), f"{name}-texts")
        return written(checked(pairs, needed, words, least), work, f"{name}-similar")

    found = similar(written(proposals(buckets), work, "first"), "first")
    rest = written(mixed(buckets, components(found, f"{work}/first-steps")), work, "mixed")
    found = found.unionByName(similar(written(across(rest.where(F.col("members") <= FEW)), work, "few"), "few"))
    many = rest.where(F.col("members") > FEW)
    sketched = blocks_met(many.withColumn("bytes", F.lit(k)), BLOCK, BLOCK_BYTES).join(table.select("rid", "sketch"), "rid")
    near = written(sketched.groupBy("bucket", "u", "v").applyInArrow(block_close(least), "bucket long, rid long").distinct(), work, "close")
    close_ones = many.join(near, ["bucket", "rid"], "left_semi").join(pool.select("rid", F.octet_length("text").alias("bytes")), "rid")
    met = written(blocks_met(close_ones, BLOCK, BLOCK_BYTES), work, "met")
    joined = met.join(texts(met.select("rid"), "many-texts"), "rid")
    found = found.unionByName(written(joined.groupBy("bucket", "u", "v").applyInArrow(block_links(words, least), "a long, b long"), work, "many-similar"))
    classes = written(components(found, f"{work}/steps"), folder, "classes")
    deleted(spark, work)
    member = table.select(F.col("rid").alias("own"), "key").join(copies, "key", "left").select("own", F.coalesce("rep", "own").alias("rid"))
    return table, classed(member, classes).select(F.col("own").alias("rid"), "class")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, classes = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = table.select("rid", F.col("row.doc_id").alias("doc_id")).join(classes, "rid")
    names = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(names, "class").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """One row of every class, with all its columns: the one with the least doc_id."""
    table, classes = near_duplicates(docs, **params)
    rows = table.select("rid", F.col("row.doc_id").alias("doc_id")).join(classes, "rid")
    least = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    kept = written(least.select("first.rid"), shared_dir(docs.sparkSession), "kept")
    return filtered(table, kept, "rid").select("row.*")
