"""Raw match JSON of unknown nesting: an inventory of its paths by a plain walk in tasks, and weapons read back from it by VARIANT expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from matchloom.functions.core import bound
from matchloom.functions.fixed import FIELD_CATEGORIES, FIELD_KEYWORDS, FIELD_MEANINGS, HIDDEN_KEYS
from matchloom.sources.scratch import written


def kind_and_number(v: Column) -> Column:
    """struct(kind, number): null, boolean, number, string, array or object (SQL null for SQL null), and the value of a JSON number."""

    def read(s: Column) -> Column:
        number = s.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        kind = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(number, "number").when(s.isNotNull(), "string")
        return F.struct(kind.alias("kind"), F.when(number, F.try_variant_get(v, "$", "double")).alias("number"))

    return bound(F.schema_of_variant(v), read)


def number_of(v: Column) -> Column:
    """The value of a JSON number; null for all else, also for digits in quotes."""
    return kind_and_number(v)["number"]


def text_of(v: Column) -> Column:
    return F.when(kind_and_number(v)["kind"] == "string", F.try_variant_get(v, "$", "string"))


def part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key twice")
    return out


def _no_number(name: str):
    raise ValueError(name)


#: All numbers become doubles; NaN and Infinity are no JSON.
_DECODER = json.JSONDecoder(object_pairs_hook=_once, parse_int=float, parse_constant=_no_number)


def _loaded(text: str) -> object:
    return _DECODER.decode(text)


KINDS = ["number", "string", "boolean", "null", "array", "object"]
NUMBER, STRING, BOOLEAN, NULL, ARRAY, OBJECT = range(6)
#: Which kind of a path's places counts, and their order where the places are equal (by the kinds' names).
_RANK = [(0, 1), (1, 1), (1, 0), (2, 0), (3, 0), (3, 1)]


class _Paths:
    """The paths met in a batch, by number; -1 stands for hidden keys and 0 for the root."""

    def __init__(self):
        self.names, self.below, self.numbers = [""], {}, {"": 0}

    def number(self, name: str) -> int:
        n = self.numbers.get(name)
        if n is None:
            n = self.numbers[name] = len(self.names)
            self.names.append(name)
        return n

    def child(self, parent: int, key: str | None) -> int:
        """key None: an array's items."""
        up = self.names[parent]
        if key is None:
            n = self.number(up + "[]")
        elif key.lower() in HIDDEN_KEYS:
            n = -1
        else:
            key = key.encode("utf-8", "replace").decode()
            n = self.number(up + key if up in ("", "[]") else f"{up}.{key}")
        self.below[parent, key] = n
        return n

    def walk(self, value: object) -> dict[int, tuple]:
        """The place that counts of each path below the root: (rank, places in arrays, number, kind)."""
        found, below, todo = {}, self.below, [(0, (), value)]
        while todo:
            path, at, v = todo.pop()
            t = type(v)
            if t is float:
                kind, number = NUMBER, v
            elif t is dict:
                kind, number = OBJECT, 0.0
                for key, x in v.items():
                    n = below.get((path, key))
                    if n is None:
                        n = self.child(path, key)
                    if n >= 0:
                        todo.append((n, at, x))
            elif t is list:
                kind, number = ARRAY, 0.0
                if v:
                    n = below.get((path, None)) or self.child(path, None)
                    todo.extend([(n, (*at, i), v[i]) for i in range(len(v) - 1, -1, -1)])
            else:
                kind, number = STRING if t is str else NULL if v is None else BOOLEAN, 0.0
            rank = _RANK[kind]
            old = found.get(path)
            if old is None or (rank[0], at, rank[1], number) < (old[0][0], old[1], old[0][1], old[2]):
                found[path] = (rank, at, number, kind)
        found.pop(0, None)
        return found


#: Rows of a batch that goes back to Spark, at least.
ROWS = 50_000


def json_paths(docs: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """A row per document and path below the root: keep, path, kind, number; of a path's several places in a document the first number
    counts, else the first other scalar that is not null, else null if a scalar is there, else the first container.

    A text that is null or no JSON, or names a key twice in one object, gives one row with a null path; so does one that is nested deeper than
    the parser goes. Each text is read once, where it is, and nothing is shuffled. An empty table gives no rows; a document without paths gives none either."""
    rows = docs.select(*keep, F.col(json))
    fields = [StructField("path", StringType()), StructField("kind", StringType()), StructField("number", DoubleType())]
    schema = StructType([*rows.schema.fields[:-1], *fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, last = _Paths(), batch.column(batch.num_columns - 1).to_pylist(), batch.num_rows - 1
            at, path, kind, number = [], [], [], []
            for i, text in enumerate(texts):
                try:
                    found = None if text is None else paths.walk(_loaded(text))
                except (ValueError, RecursionError):
                    found = None
                if found is None:
                    at.append(i)
                    path.append(None)
                    kind.append(None)
                    number.append(None)
                else:
                    at.extend([i] * len(found))
                    path.extend(found)
                    for _, _, x, k in found.values():
                        kind.append(k)
                        number.append(x if k == NUMBER else None)
                if at and (i == last or len(at) >= ROWS):
                    take = pa.array(at, pa.int32())
                    named = [pa.array(names, pa.string()).take(pa.array(x, pa.int32())) for names, x in ((paths.names, path), (KINDS, kind))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(batch.num_columns - 1)), *named, pa.array(number, pa.float64())], names=schema.names)
                    at, path, kind, number = [], [], [], []

    return rows.mapInArrow(read, schema)


def field_inventory(paths: DataFrame) -> DataFrame:
    """A row per path with its counts, kinds, range and mean; the null path counts the texts that cannot be read."""
    known = F.col("path").isNotNull()
    return paths.groupBy("path").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("kind") != "null").alias("filled"), F.count("number").alias("numbers"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("number").alias("low"), F.max("number").alias("high"), F.avg("number").alias("mean"),
        F.avg(F.when(F.col("number").isNotNull(), (F.col("number") != 0).cast("double"))).alias("nonzero"),
    ).withColumns({"keyword": F.when(known, is_keyword(F.col("path"))), "categories": F.when(known, categories(F.col("path"))), "meanings": F.when(known, meanings(F.col("path")))})


def is_keyword(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(path), F.lit(k.lower())) for k in FIELD_KEYWORDS))


def _tags(path: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Names whose patterns all occur in the lower-cased path; a pattern after a minus must not."""
    low = F.lower(path)
    holds = lambda ps: reduce(lambda a, b: a & b, (~low.rlike(p[1:]) if p.startswith("-") else low.rlike(p) for p in ps))
    return F.concat_ws(",", *(F.when(holds(ps), name) for name, ps in rules.items()))


def categories(path: Column) -> Column:
    return _tags(path, FIELD_CATEGORIES)


def meanings(path: Column) -> Column:
    return _tags(path, FIELD_MEANINGS)


def _owner(v: Column) -> Column:
    """The account that an entry names: the first of uid and userId that is a string and not blank."""
    filled = lambda name: bound(text_of(part(v, name)), lambda c: F.when(F.trim(c) != "", c))
    return F.coalesce(filled("uid"), filled("userId"))


def _weapon(v: Column) -> Column:
    return bound(number_of(part(v, "bestWeapon")), lambda w: F.when((w > 0) & (w != float("inf")), w))


def recovered_weapons(rows: DataFrame, participants: DataFrame, details: DataFrame) -> DataFrame:
    """row_id, game, uid, character, weapon (as it was), recovered, source and reason, for rows whose weapon is missing or not positive.

    rows: row_id, game, uid, character, weapon, raw (the row's own JSON); participants: game, uid, character, weapon; details: game, raw
    (a JSON array with an entry per player). A row's own JSON counts first, if it names no other account and the same character; then the
    participant's positive weapon (the highest); then the game's JSON, if the entries of this character that name this account or none
    agree on one weapon. Unreadable JSON and rows without a game, account or character find nothing. Only the rows in need are joined.
    A text is parsed once; the games' entries are read from it once and written, as accounts and entries without one both need them."""
    fits = lambda v: F.coalesce(_owner(v) == F.col("uid"), F.lit(True)) & (number_of(part(v, "characterNum")) == F.col("character"))
    own = bound(F.try_parse_json("raw"), lambda v: F.when(fits(v), _weapon(v)))
    state = F.when(F.col("weapon").isNull() | F.isnan(F.col("weapon").cast("double")), "missing-best-weapon").when(F.col("weapon") <= 0, "invalid-best-weapon")
    need = rows.withColumn("reason", state).where("reason is not null").withColumn("own", own).drop("raw")
    known = participants.where("weapon > 0").groupBy("game", "uid", "character").agg(F.max("weapon").alias("listed"))
    entries = details.select("game", F.explode(F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")).alias("e"))
    entries = entries.select("game", number_of(part(F.col("e"), "characterNum")).alias("character"), _owner(F.col("e")).alias("uid"), _weapon(F.col("e")).alias("w"))
    entries = written(entries, "weapon_entries").where("w is not null")
    named = entries.where("uid is not null").groupBy("game", "character", "uid").agg(F.min("w").alias("low"), F.max("w").alias("high"))
    nameless = entries.where("uid is null").groupBy("game", "character").agg(F.min("w").alias("low0"), F.max("w").alias("high0"))
    found = need.join(known, ["game", "uid", "character"], "left").withColumn("character", F.col("character").cast("double"))
    found = found.join(named, ["game", "character", "uid"], "left").join(nameless, ["game", "character"], "left")
    low, high = F.least("low", "low0"), F.greatest("high", "high0")
    told = F.when(low == high, low)
    source = F.when(F.col("own").isNotNull(), "player-match-raw-json").when(F.col("listed").isNotNull(), "match-participant").when(told.isNotNull(), "match-detail-raw-json")
    out = found.withColumns({"recovered": F.coalesce("own", "listed", told).cast("long"), "source": source}).where("source is not null")
    return out.select("row_id", "game", "uid", F.col("character").cast("long").alias("character"), "weapon", "recovered", "source", "reason")
