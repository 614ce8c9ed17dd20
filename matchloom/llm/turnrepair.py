"""Repair of conversations whose turns no longer alternate, by aligning them with the strings of a grammar.

The roles of a sound conversation are `(s?(ua)+)?` by their first letters. Turns are aligned (Wagner-Fischer) with each
feasible length of that alternating string; the incumbent's cost bounds the lengths and the band of each table (Ukkonen),
and of alignments of equal cost the audit that is ASCII-least stays. Each edit's cost follows from its letter and its row,
so no audit of a cheapest edit is the start of another, and audits may be compared piece by piece.

A conversation is worked through in blocks of a few turns: for every state before a block and after it (nothing yet, s, u
or a), the cheapest way is kept: its cost, its audit and the digest of its text so far. A block ends early after three
whole turns a, u, a in a row: any cheapest alignment keeps the last of them, as giving it up costs more than the at most
two inserts that keeping it may need. So a task holds the texts of one block and letters of audits, never a conversation.
Turns of a conversation must pass one task in order, as the contract's digest runs over its whole text; Spark sorts
(and spills) them by turn, and by role and text where turns are equal.

Null ids are one conversation; null roles and texts are one space. A role that is empty or has another first letter
cannot be kept. Repeated rows are duplicates. A table without rows gives none."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from os.path import commonprefix
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, read, schema_of

#: Turns of a block at most.
BLOCK = 16
DELETE, EDIT, TRUNCATED = 4, 3, 3
SPACE = "\x20\t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
#: The letter that follows a state without an insert or re-role to spare.
NEXT = {"^": "u", "s": "u", "a": "u", "u": "a"}


def gap(d: int) -> int:
    """The least cost of being d letters ahead of (behind: negative) the turns."""
    return EDIT * d if d > 0 else -DELETE * d


def align(turns: str, target: str, most: int) -> tuple[int, str] | None:
    """The cheapest alignment's cost and least audit, if not above most. A turn: s, u, a or o (other), upper case if truncated."""
    n, m = len(turns), len(target)
    if gap(m - n) > most:
        return None
    inf = most + 1
    band = [range(max(0, i - n), min(m, i + m) + 1) for i in range(n + 1)]
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in reversed(band[i]):
            if gap(j - i) + gap((m - j) - (n - i)) > most:
                continue
            best = 0 if i == n and j == m else inf
            if i < n:
                best = min(best, DELETE + cost[i + 1][j])
                if j < m and (p := pair(turns[i], target[j])) is not None:
                    best = min(best, p + cost[i + 1][j + 1])
            if j < m and target[j] != "s":
                best = min(best, EDIT + cost[i][j + 1])
            cost[i][j] = best
    if cost[0][0] > most:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:  # the least letter of a cheapest way: D, I, K, R
        left = cost[i][j]
        if i < n and DELETE + cost[i + 1][j] == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and EDIT + cost[i][j + 1] == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def pair(turn: str, letter: str) -> int | None:
    """The cost of keeping or re-roling a turn as that letter."""
    extra = TRUNCATED if turn.isupper() else 0
    return extra if turn.lower() == letter else None if letter == "s" else EDIT + extra


def targets(entry: str, exit: str, length: int) -> list[str]:
    """The strings of that length that lead from one state to the other: one, two or none."""
    if not length:
        return [""] if entry == exit else []
    starts = ["ua"] if entry in "sa" else ["au"] if entry == "u" else ["ua", "s"]
    found = []
    for start in starts:
        s = "s" + "ua" * length if start == "s" else start * length
        if s[length - 1] == exit:
            found.append(s[:length])
    return found


@lru_cache(maxsize=200_000)
def cheapest(turns: str, entry: str, exit: str) -> tuple[int, str] | None:
    """Over all feasible lengths, nearest to the number of turns first, until the lengths alone cost more than the incumbent."""
    best: tuple[int, str] | None = None
    n = len(turns)
    for away in range(n + 4 * n + 8):
        bound = best[0] if best else DELETE * n + EDIT * (n + away + 2)
        if best and min(gap(away), gap(-away)) > bound:
            break
        for length in {n + away, n - away} if away <= n else {n + away}:
            for target in targets(entry, exit, length):
                if (found := align(turns, target, best[0] if best else bound)) and (best is None or found < best):
                    best = found
    return best


class Way(NamedTuple):
    """A cheapest edit of all turns so far that ends in one state: what of its audit is not settled, and its text's digest."""

    cost: int
    audit: str
    digest: Any
    empty: bool


class Conversation:
    """Takes the turns in order; result() ends it."""

    def __init__(self, key):
        self.key = key
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.before = None
        self.audit: list[str] = []
        #: The turns of the block; a number stands for so many that must be deleted.
        self.rows: list = []
        self.block, self.tail = "", ""
        self.open: dict[str, Way] = {"^": Way(0, "", sha256(), True)}

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        letter = role[:1]
        if self.before is not None and self.before + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = letter
        last = text.rstrip(SPACE)[-1:]
        if not last or repeated:
            self.blank, self.duplicate = self.blank + (not last), self.duplicate + bool(last)
            if self.rows and isinstance(self.rows[-1], int):
                self.rows[-1] += 1
            else:
                self.rows.append(1)
            return
        kind = letter if letter and letter in "sua" else "o"
        if last not in ".!?":
            self.truncated += 1
            kind = kind.upper()
        self.rows.append((role, text))
        self.block, self.tail = self.block + kind, (self.tail + kind)[-3:]
        if self.tail == "aua":
            self._close("a")
        elif len(self.block) == BLOCK:
            self._close("^sua")

    def _close(self, exits: str) -> None:
        ways = {}
        for entry, way in self.open.items():
            for exit in exits:
                if found := cheapest(self.block, entry, exit):
                    new = way.cost + found[0], way.audit + self._full(found[1]), entry, found[1]
                    if exit not in ways or new < ways[exit]:
                        ways[exit] = new
        done = len(commonprefix([w[1] for w in ways.values()]))
        self.audit.append(next(iter(ways.values()))[1][:done])
        self.open = {q: Way(cost, audit[done:], *self._digest(entry, letters)) for q, (cost, audit, entry, letters) in ways.items()}
        self.rows, self.block = [], ""

    def _full(self, letters: str) -> str:
        """The letters with those of the turns that must be deleted: a D goes before an I."""
        out, rows = [], iter(self.rows)
        row = next(rows, None)
        for x in [*letters, ""]:
            while isinstance(row, int):
                out.append("D" * row)
                row = next(rows, None)
            out.append(x)
            if x != "I":
                row = next(rows, None)
        return "".join(out)

    def _digest(self, state: str, letters: str) -> tuple:
        way = self.open[state]
        digest, empty = way.digest.copy(), way.empty
        rows = (r for r in self.rows if not isinstance(r, int))
        for x in letters:
            role, text = ("", "") if x == "I" else next(rows)
            if x == "D":
                continue
            state = role[0] if x == "K" else NEXT[state]
            digest.update(f"{'' if empty else chr(10)}{role if x == 'K' else NAMES[state]}:{text}".encode())
            empty = False
        return digest, empty

    def result(self) -> tuple:
        self._close("^a")
        way = min(self.open.values(), key=lambda w: w[:2])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, way.cost + DELETE * (self.blank + self.duplicate), "".join(self.audit) + way.audit, way.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with live = false for a dropped row, so that its conversation stays known."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).when(kind > 0, F.col("text"))
    role = F.when(kind == 4, "user").when(kind > 0, F.col("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", F.when(kind > 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), (kind > 0).alias("live"), times.alias("copy")).drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """A row per conversation: its faults, cost, audit and digest. rows: conv_id, turn, role, text, live. One shuffle, by conversation."""
    from pyspark.sql import Window

    same = Window.partitionBy("conv_id", "live", "role", F.md5("text")).orderBy(F.col("turn").asc_nulls_first())
    marked = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    ordered = marked.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    kind = dict(rows.dtypes)["conv_id"]
    schema = schema_of(f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        now: Conversation | None = None
        for batch in batches:
            done = []
            for key, turn, role, text, live, nth in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "live", "nth"))):
                if now is None or now.key != key:
                    if now:
                        done.append(now.result())
                    now = Conversation(key)
                if live:
                    now.add(turn, role, text, nth > 1)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.result(), arrow)], schema=arrow)
        give_back()

    return ordered.mapInArrow(run, schema)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(read(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by shortest ways over the grammar's states, one row after the other: v0 to v3 are (cost, audit, repaired) after nothing, s, u and a."""
    crc = "xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda x: list_transform(range(8), lambda i: (ord(x) >> i) & 1))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295)"
    none = "{'c': 1000000000, 'a': '~', 't': ''}"
    step = lambda v, c, a, t="''": f"{{'c': {v}.c + {c}, 'a': {v}.a || {a}, 't': {v}.t || {t}}}"
    line = lambda role, text="''": f"(chr(10) || {role} || ':' || {text})"
    ins = lambda v, role: step(v, 3, "'I'", line(f"'{role}'"))
    kept, put = lambda v: step(v, "extra", "'K'", line("role", "text")), lambda v, role: step(v, "3 + extra", "'R'", line(f"'{role}'", "text"))
    gone = lambda v: step(v, 4, "'D'")
    least = lambda *x: f"list_min([{', '.join(x)}])"
    given = lambda what, v: f"CASE WHEN letter = '{what}' THEN {kept(v)} ELSE {none} END"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT *, {crc} % 20 AS kind FROM k),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind > 0),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
 substr(role, 1, 1) AS letter FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM f),
g AS (SELECT *, cut = '' AS blank, cut <> '' AND nth > 1 AS duplicate, cut <> '' AND nth = 1 AND right(cut, 1) NOT IN ('.', '!', '?') AS truncated, lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM h),
t AS MATERIALIZED (SELECT *, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM g),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS v0, {none} AS v1, {none} AS v2, {none} AS v3 FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT conv_id, i, {gone('v0')} AS v0, CASE WHEN blank OR duplicate THEN {gone('v1')} ELSE {least(gone('v1'), given('s', 'v0'))} END AS v1,
 CASE WHEN blank OR duplicate THEN {gone('v2')} ELSE {least(gone('w2'), given('u', 'v0'), given('u', 'v1'), given('u', 'w3'), put('v0', 'user'), put('v1', 'user'), put('w3', 'user'))} END AS v2,
 CASE WHEN blank OR duplicate THEN {gone('v3')} ELSE {least(gone('w3'), given('a', 'w2'), put('w2', 'assistant'))} END AS v3
 FROM (SELECT *, {least('v3', ins('w2', 'assistant'))} AS w3 FROM (SELECT t.*, v0, v1, v2, v3, {least('v2', ins('v0', 'user'), ins('v1', 'user'), ins('v3', 'user'))} AS w2 FROM w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1))),
e AS (SELECT conv_id, i, {least('v0', 'v3', ins('w2', 'assistant'))} AS z FROM (SELECT *, {least('v2', ins('v0', 'user'), ins('v1', 'user'), ins('v3', 'user'))} AS w2 FROM w)),
n AS (SELECT conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (blank) blank, count(*) FILTER (duplicate) duplicate, count(*) FILTER (truncated) truncated,
 count(*) FILTER (prev || letter NOT IN ('su', 'ua', 'au')) illegal FROM t GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, CAST(z.c AS BIGINT) AS cost, z.a AS audit, sha256(substr(z.t, 2)) repaired_sha256
FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id WHERE e.i = coalesce(n.n, 0)"""


OP12_SQL = _sql()
