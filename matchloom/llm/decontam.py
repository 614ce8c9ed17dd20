"""Benchmark decontamination by suffix arrays.

Words of the training documents are numbered by the benchmark's vocabulary. Each shard (an Arrow batch of documents)
keeps the stretches that consist of benchmark words alone - nothing else can match - and sorts their suffixes. Every
suffix of every benchmark item is then looked up by binary search, word by word, which gives the places of each window
and the longest verbatim match. A window is so many consecutive words of an item; an item of fewer words is one window.

The benchmark is sent to the executors in blocks of bounded size, one pass over the documents for each; the results of
the passes are merged row by row, without a shuffle, so neither side need fit in memory and no row meets another.

Null and empty texts have no words: such a document is clean, such an item matches nothing. Items that share an id count
once. A null item id counts as the id "". Repeated rows are judged each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, read, words_of


class Block:
    """Some benchmark items: their words as numbers, and the windows that they hold."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        ids, owners, sizes = [], [], []
        for name, text in items:
            words = words_of(text)
            if words:
                ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
                owners.append(name)
                sizes.append(len(words))
        self.names = owners
        #: All items, each followed by a 0, which no document word equals.
        self.words = np.concatenate([np.append(x, 0) for x in ids]).astype(np.int32) if ids else np.zeros(0, np.int32)
        sizes_ = np.array(sizes, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes_ + 1)[:-1]]).astype(np.int64) if ids else np.zeros(0, np.int64)
        #: Every suffix: where it starts, its item and its length; and how long its window is, 0 if it has none.
        self.item = np.repeat(np.arange(len(sizes_)), sizes_)
        within = np.arange(int(sizes_.sum())) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
        self.start = first[self.item] + within
        self.left = sizes_[self.item] - within
        self.window = np.where(self.left >= window, window, np.where(within == 0, self.left, 0))
        self.least = int(np.minimum(sizes_, window).min()) if ids else 0
        self.longest = int(sizes_.max()) if ids else 0


class Shard:
    """The suffix array of the documents' stretches of benchmark words."""

    def __init__(self, documents: list[np.ndarray], least: int, depth: int):
        sizes = np.array([len(d) for d in documents], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.concatenate([np.append(d, 0) for d in documents]).astype(np.int32) if documents else np.zeros(0, np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (flat != 0).astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        a, b = a[b - a >= least], b[b - a >= least]
        size = b - a
        #: Kept words, one 0 after each stretch, and where each lies in flat.
        self.place = np.repeat(a - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(int((size + 1).sum())) if len(a) else np.zeros(0, np.int64)
        self.words = flat[self.place] if len(a) else np.zeros(0, np.int32)
        if len(a):
            self.words[np.cumsum(size + 1) - 1] = 0
        self.suffixes = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        """Prefix doubling until suffixes differ or `depth` words are compared."""
        n = len(self.words)
        rank, step = self.words.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while step < depth and n:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
            rank, step = new, 2 * step
            if rank[order[-1]] == n - 1:
                break
        # A suffix that begins with the end of a stretch holds nothing.
        return order[self.words[order] != 0]

    def search(self, block: Block) -> tuple[np.ndarray, ...]:
        """For every suffix of the block: the range of suffixes that start with its window, and its longest match's length and place in the array."""
        n, q = len(self.suffixes), len(block.start)
        low, high = np.zeros(q, np.int64), np.full(q, n, np.int64)
        window_low, window_high = np.zeros(q, np.int64), np.zeros(q, np.int64)
        length = np.zeros(q, np.int64)
        live = np.arange(q) if n else np.zeros(0, np.int64)
        depth = 0
        padded = np.append(self.words, 0)
        while len(live):
            want = block.words[block.start[live] + depth]
            a = self._bound(padded, low[live], high[live], depth, want, False)
            b = self._bound(padded, a, high[live], depth, want, True)
            found = (b > a) & (want != 0)
            live, a, b = live[found], a[found], b[found]
            low[live], high[live] = a, b
            depth += 1
            length[live] = depth
            full = live[block.window[live] == depth]
            window_low[full], window_high[full] = low[full], high[full]
            live = live[block.left[live] > depth]
        return window_low, window_high, length, low

    def _bound(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search by the word at so great a depth, within ranges that agree up to there."""
        a, b = low.copy(), high.copy()
        last = len(words) - 1
        for _ in range(int(max(1, (b - a).max(initial=1))).bit_length()):
            mid = (a + b) // 2
            open_ = a < b
            got = words[np.minimum(self.suffixes[np.minimum(mid, len(self.suffixes) - 1)] + depth, last)]
            less = (got <= want) if upper else (got < want)
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_hits(shard: Shard, block: Block) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each document of the shard: the stretches of words inside windows, and the items whose windows occur."""
    docs = len(shard.first) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    items: list[list[str]] = [[] for _ in range(docs)]
    low, high, _, _ = shard.search(block)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return spans, items
    # Windows of the same words have the same range: one of them gives the places, all of them their items.
    key = np.stack([low[hit], block.window[hit]], 1)
    _, one, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    a, b, w = low[hit][one], high[hit][one], block.window[hit][one]
    count = b - a
    at = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    place = shard.place[shard.suffixes[at]]
    cover = np.zeros(int(shard.first[-1]) + 1, np.int32)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + np.repeat(w, count), -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]])))
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
        d = int(np.searchsorted(shard.first, x, side="right")) - 1
        spans[d].append((x - int(shard.first[d]), y - int(shard.first[d])))
    doc = np.searchsorted(shard.first, place, side="right") - 1
    pairs = np.unique(doc * len(one) + np.repeat(np.arange(len(one)), count))
    of_group: list[set[str]] = [set() for _ in range(len(one))]
    for g, i in zip(group.tolist(), block.item[hit].tolist()):
        of_group[g].add(block.names[i])
    held: dict[int, set[str]] = {}
    for p in pairs.tolist():
        held.setdefault(p // len(one), set()).update(of_group[p % len(one)])
    for d, names in held.items():
        items[d] = sorted(names)
    return spans, items


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The benchmark in parts of about block_bytes of text, as broadcast variables; all rows of an item are in one part."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = int(-(-size // block_bytes)) or 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect()
        yield spark.sparkContext.broadcast(Block([(r.name, bytes(r.text) if r.text is not None else None) for r in rows], window))


def numbered(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    get = vocabulary.get
    out = []
    for t in texts:
        words = words_of(t)
        out.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """row (a struct of the columns of docs, which has a string column text), words (their number), spans (word ranges inside
    windows) and items. The struct keeps names of docs apart from these."""
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = packed
    for block in benchmark_blocks(benchmark, window, block_bytes):
        seen = found is not packed

        def make(block=block, seen=seen):
            part = block.value

            def apply(batch):
                numbers = numbered(as_bytes(batch.column("row").field("text")), part.vocabulary)
                spans, items = shard_hits(Shard(numbers, part.least, part.longest), part) if part.names else ([[]] * len(numbers), [[]] * len(numbers))
                if seen:
                    spans = [merge(x + [(s["a"], s["b"]) for s in y]) for x, y in zip(spans, batch.column("spans").to_pylist())]
                    items = [sorted({*x, *y}) for x, y in zip(items, batch.column("items").to_pylist())]
                return {"row": batch.column("row"), "words": list(map(len, numbers)), "spans": [[{"a": a, "b": b} for a, b in x] for x in spans], "items": items}

            return apply

        found = map_batches(found, make, f"row struct<{row}>, words long, spans array<struct<a:long,b:long>>, items array<string>")
    return found


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """For every suffix of every item (item_id as text, word): the longest verbatim match in the documents and one place of it.

    Every shard answers for its documents; the longest of all shards is kept, the smallest doc_id among equals."""
    out = None
    for block in benchmark_blocks(benchmark, 1, block_bytes):

        def make(block=block):
            part = block.value

            def apply(batch):
                ids = batch.column("doc_id").to_pylist()
                shard = Shard(numbered(as_bytes(batch.column("text")), part.vocabulary), 1, part.longest)
                _, _, length, at = shard.search(part)
                rows = []
                for k in np.flatnonzero(length).tolist():
                    place = int(shard.place[shard.suffixes[at[k]]])
                    d = int(np.searchsorted(shard.first, place, side="right")) - 1
                    item = int(part.item[k])
                    first = int(part.start[np.searchsorted(part.item, item)])
                    rows.append((part.names[item], int(part.start[k]) - first, int(length[k]), ids[d], place - int(shard.first[d])))
                return dict(zip(("item_id", "word", "length", "doc_id", "doc_word"), zip(*rows) if rows else [[]] * 5))

            return apply

        one = map_batches(docs.select("doc_id", "text"), make, "item_id string, word long, length long, doc_id long, doc_word long")
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("item_id", "word").agg(F.max_by(F.struct("length", "doc_id", "doc_word"), F.struct("length", -F.col("doc_id"), -F.col("doc_word"))).alias("best"))
    return best.select("item_id", "word", "best.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    return find_windows(docs, benchmark, window).where(F.size("items") == 0).select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') k FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) xs FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(xs, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
