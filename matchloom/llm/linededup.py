"""Line dedup by site-relative frequency.

For every host, the different pages that contain a line are divided by the different pages of the host; lines over the ratio
are boilerplate of that host and are dropped from its pages. Exact copies of a page are one page on both sides, so that
they neither turn their own lines into boilerplate nor hide it. Lines are compared without the white space around them;
empty lines stay. A line on one page alone repeats nothing and stays, however few pages the host has.

Tasks count the lines of their documents before anything is shuffled, so a hot host or line arrives as one row from each
task. Lines travel as 64-bit hashes of host and line. Up to a fixed number, which is counted first, the lines to drop are
broadcast; beyond it they are joined with the lines of the documents, so that their number is not bounded by a machine.

Rows without host have no site and stay as they are. Null texts are no pages and stay null; a page that held boilerplate alone
becomes empty. Repeated rows are treated alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, read, replace_column, shared_dir, written

SPACE = b" \t\n\x0b\x0c\r"
#: Line hashes that are broadcast at most: 16 MB.
MOST_LINES = 2_000_000


def line_hash(host: bytes, line: bytes) -> int:
    """A signed 64-bit hash of the host and the line."""
    x = xxhash.xxh3_64_intdigest(host + b"\n" + line)
    return x - (1 << 64) if x >> 63 else x


def stripped(text: bytes | None) -> list[bytes]:
    return [x.strip(SPACE) for x in text.split(b"\n")] if text else []


def line_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """host, line, pages: for each host and line hash, the rows that contain the line."""

    def make():
        def apply(batch):
            seen: Counter = Counter()
            for h, text in zip(as_bytes(batch.column("host")), as_bytes(batch.column("text"))):
                seen.update((h, x) for x in set(stripped(text)) if x)
            return {"host": [h.decode() for h, _ in seen], "line": [line_hash(h, x) for h, x in seen], "pages": list(seen.values())}

        return apply

    return map_batches(pages_of(docs, host), make, "host string, line long, pages long").groupBy("host", "line").agg(F.sum("pages").alias("pages"))


def pages_of(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(F.col(host).cast("string").alias("host"), "text").where("host is not null and text is not null")


def line_pages(docs: DataFrame, host: str, lines: np.ndarray | None) -> DataFrame:
    """host, line, page: the line hashes of each page, a page being the hash of its text; with lines only those."""
    wanted = None if lines is None else docs.sparkSession.sparkContext.broadcast(lines)

    def make():
        found = None if wanted is None else frozenset(wanted.value.tolist())

        def apply(batch):
            rows: set = set()
            for h, text in zip(as_bytes(batch.column("host")), as_bytes(batch.column("text"))):
                own = {line_hash(h, x) for x in stripped(text) if x}
                own = own if found is None else own & found
                if own:
                    page = line_hash(b"", text)
                    rows.update((h, k, page) for k in own)
            return {"host": [h.decode() for h, _, _ in rows], "line": [k for _, k, _ in rows], "page": [p for _, _, p in rows]}

        return apply

    return map_batches(pages_of(docs, host), make, "host string, line long, page long")


def few(lines: DataFrame, most: int) -> np.ndarray | None:
    """The hashes of a written one-column table, sorted, or None if there are more than most."""
    if lines.limit(most + 1).count() > most:
        return None
    return np.unique(lines.toPandas()["line"].to_numpy(np.int64))


def distinct_counts(docs: DataFrame, lines: DataFrame, host: str = "source", most: int = MOST_LINES) -> DataFrame:
    """host, line, pages for the given line hashes: the different texts that contain each."""
    wanted = few(lines, most)
    rows = line_pages(docs, host, wanted)
    rows = rows if wanted is not None else rows.join(lines.distinct(), "line", "left_semi").select("host", "line", "page")
    return rows.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))


def over_ratio(counts: DataFrame, totals: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    kept = counts.where(F.col("pages") >= least_pages)
    return kept.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("total")).select("line")


def host_totals(docs: DataFrame, host: str = "source") -> DataFrame:
    """host, total: the different texts of each host."""
    return pages_of(docs, host).select("host", F.xxhash64("text").alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 2, most: int = MOST_LINES) -> DataFrame:
    """The hashes of the lines to drop, as a written one-column table."""
    folder = shared_dir(docs.sparkSession)
    totals = written(host_totals(docs, host), folder, "totals")
    # Counts of rows are never below counts of different texts, so this finds every line that may be dropped.
    rough = written(over_ratio(line_counts(docs, host), totals, ratio, least_pages), folder, "rough")
    return written(over_ratio(distinct_counts(docs, rough, host, most), totals, ratio, least_pages), folder, "lines")


def without(text: bytes, host: bytes, found) -> bytes:
    rows = text.split(b"\n")
    keep = [x for x in rows if not (y := x.strip(SPACE)) or line_hash(host, y) not in found]
    return b"\n".join(keep) if len(keep) < len(rows) else text


def drop_lines(docs: DataFrame, lines: DataFrame, host: str = "source", most: int = MOST_LINES) -> DataFrame:
    """docs without the given lines of their hosts."""
    known = few(lines, most)
    if known is None:
        return _drop_by_join(docs, lines, host)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        found = frozenset(sent.value.tolist())

        def values(batch):
            both = zip(as_bytes(batch.column(host).cast("string")), as_bytes(batch.column("text")))
            return [text if text is None else (without(text, h, found) if h is not None else text).decode() for h, text in both]

        return values

    return replace_column(docs, "text", make)


def _drop_by_join(docs: DataFrame, lines: DataFrame, host: str) -> DataFrame:
    """The same for any number of lines: each row's own lines to drop come by a join on the line hash."""
    folder = shared_dir(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    numbered = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(host).cast("string").alias("host"), "text", row), folder, "rows")

    def make():
        def apply(batch):
            out: dict[str, list] = {"rid": [], "line": []}
            for rid, h, text in zip(batch.column("rid").to_pylist(), as_bytes(batch.column("host")), as_bytes(batch.column("text"))):
                own = {line_hash(h, x) for x in stripped(text) if x}
                out["rid"] += [rid] * len(own)
                out["line"] += own
            return out

        return apply

    own = map_batches(numbered.select("rid", "host", "text").where("host is not null and text is not null"), make, "rid long, line long")
    drop = own.join(lines.distinct(), "line", "left_semi").groupBy("rid").agg(F.collect_list("line").alias("drop"))
    joined = numbered.join(drop, "rid", "left").select("row", "host", "text", "drop")

    def cut():
        def values(batch):
            rows = zip(as_bytes(batch.column("host")), as_bytes(batch.column("text")), batch.column("drop").to_pylist())
            return [None if text is None else (without(text, h, frozenset(d)) if d else text).decode() for h, text, d in rows]

        return values

    changed = replace_column(joined, "text", cut)
    return changed.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 2, most: int = MOST_LINES) -> DataFrame:
    """The rows of docs, with all their columns, their text without the boilerplate of their host."""
    return drop_lines(docs, boilerplate(docs, host, ratio, least_pages, most), host, most)


def n_lines(column: str):
    """Lines of a text; a null or empty text has none."""
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", 0).otherwise(F.size(F.split(column, "\n"))).cast("long")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text", n_lines("text").alias("n_lines"))
    return dedup_lines(docs).select("doc_id", "source", "n_lines", (F.col("n_lines") - n_lines("text")).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, source, text, trim(x, E' \t\n\v\f\r') k, x, i FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents)),
t AS (SELECT source, count(DISTINCT text) n FROM documents WHERE source IS NOT NULL GROUP BY 1),
g AS (SELECT source, k, count(DISTINCT text) c FROM l WHERE k <> '' AND source IS NOT NULL GROUP BY 1, 2),
b AS (SELECT source, k FROM g JOIN t USING (source) WHERE c >= 2 AND c > 0.1 * n),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) s FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = l.source AND b.k = l.k) GROUP BY 1)
SELECT doc_id, source, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) n_lines,
       CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END - CASE WHEN coalesce(s, '') = '' THEN 0 ELSE len(string_split(s, chr(10))) END AS BIGINT) n_dropped,
       sha256(coalesce(s, '')) text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
