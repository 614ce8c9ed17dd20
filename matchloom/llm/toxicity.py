"""Weights of toxic wording, for all languages at once, fitted to labelled documents at run time.

Elements are beginnings of lower-cased words, of several lengths in bytes. fit gives each its log-odds among toxic documents
against the others; a word weighs as much as its heaviest element, and a document's score is the sum of its words' weights
over its words and 20. The limit is the least with the wanted precision on labelled documents that had no part in the weights, halfway to the
next score below.

The labelled rows are a sample, of at most `rows` rows, which does not depend on how the tables are dealt. With under
`least_toxic` toxic documents for the weights, or without a limit of such precision, the model finds nothing toxic.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

LENGTHS, LEAST_DOCS, LEAST_WEIGHT, PRECISION = (4, 5, 6, 8), 3, 2.0, 0.95


def elements(word: bytes) -> list[bytes]:
    return [word[:n] for n in LENGTHS if len(word) >= n]


class Toxicity:
    """Weights of elements and a limit of the score; keeps the weights of at most `most` words that it met."""

    def __init__(self, weights: dict[bytes, float] | None = None, limit: float = math.inf, most: int = 200_000):
        self.weights, self.limit, self.most = weights or {}, limit, most
        self.known: dict[bytes, float] = {}

    def __reduce__(self):
        return Toxicity, (self.weights, self.limit, self.most)

    def score(self, words: list[bytes]) -> float:
        known, get = self.known, self.weights.get
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = max((get(x, 0.0) for x in elements(w)), default=0.0)
        return sum(map(known.__getitem__, words)) / (len(words) + 20)

    def __call__(self, text: bytes) -> bool:
        return bool(self.weights) and self.score(words_of(text)) >= self.limit


def part(doc_id: int) -> str:
    """The part of the labelled documents that one belongs to; the last only measures."""
    return ("fit", "fit", "limit", "held out")[(doc_id * 2654435761 >> 7) % 4]


def fit(rows: list[tuple[int, bytes, int]], precision: float = PRECISION, least_toxic: int = 20) -> Toxicity:
    """A model from (doc_id, text, toxic); rows of the held-out part are not looked at."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n: Counter = Counter()
    for i, text, y in rows:
        if part(i) == "fit":
            n[y] += 1
            seen[y].update({e for w in set(words_of(text)) for e in elements(w)})
    if n[1] < least_toxic:
        return Toxicity()
    odds = {s: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][s] + 0.5) / (n[0] + 1)) for s, c in seen[1].items() if c >= LEAST_DOCS}
    found = Toxicity({s: v for s, v in odds.items() if v > LEAST_WEIGHT})
    scores = sorted(((found.score(words_of(text)), y) for i, text, y in rows if part(i) == "limit"), reverse=True)
    hits = 0
    for k, (v, y) in enumerate(scores, 1):
        hits += y
        below = scores[k][0] if k < len(scores) else 0.0
        if v > 0 and hits >= precision * k and below < v:
            found.limit = (v + below) / 2
    return found


def labelled(documents: DataFrame, labels: DataFrame, rows: int = 8000) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, toxic) of at most `rows` labelled documents, the same ones however the tables are dealt."""
    some = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max(F.struct("toxic", "text")).alias("row"))
    return [(r.doc_id, r.row.text.encode(), int(r.row.toxic)) for r in one.collect()]
