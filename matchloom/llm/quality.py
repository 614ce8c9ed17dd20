"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Every rule, those of the base included, is a predicate on one document and pays for the measures that it reads; measures
are taken when a rule first asks for them. The first rows of the table, a bounded number, give each rule's cost
(seconds a document) and selectivity (share rejected); rules then run by falling rejection per cost, and a document's
cascade ends with the first rule that rejects it. The order changes the time only: a document is kept if no rule
rejects it. Toxic wording is found by weights fitted to labelled documents of the same table (see toxicity), beside a
short list of English insults, which also serves where nothing is labelled.

Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, row by row.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, filter_batches, map_batches, read
from .toxicity import Toxicity, fit, labelled

#: Insults that mark abusive wording; a rule needs two of them, or one in a short text.
ABUSE = frozenset(
    b"idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile "
    b"dumbass bastard bastards asshole assholes bitch bitches retard retards".split()
)
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


class Page:
    """One document and its measures, each taken once, when it is first read."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, SPACE + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, each word once."""
    windows = list(zip(words, words[1:], words[2:]))
    known = dict.fromkeys(windows)
    if len(known) == len(windows):
        return 0
    for i, w in enumerate(known):
        known[w] = i
    at = np.fromiter(map(known.__getitem__, windows), np.int64, len(windows))
    often = np.bincount(at)[at] > 1
    hit = np.zeros(len(words), bool)
    hit[:-2] |= often
    hit[1:-1] |= often
    hit[2:] |= often
    return int(hit.sum())


def symbol_heavy(p: Page) -> bool:
    return 10 * p.n_symbols > 2 * p.n_words


def odd_word_length(p: Page) -> bool:
    return not 2 * p.n_words <= p.word_chars <= 15 * p.n_words


def shouting(p: Page) -> bool:
    return 2 * sum(map(bytes.isupper, p.words)) > p.n_words


def repeated_lines(p: Page) -> bool:
    return len(p.lines) >= 4 and 100 * p.n_dup_lines > 50 * len(p.lines)


def few_letters(p: Page) -> bool:
    return 10 * sum(1 for w in p.words if w.upper() != w.lower() or max(w) > 127) < 6 * p.n_words


def one_word(p: Page) -> bool:
    return bool(p.words) and 10 * max(Counter(p.words).values()) > 4 * p.n_words


def abusive(p: Page) -> bool:
    n = sum(1 for w in p.words if w.lower().strip(b".,;:!?\"'()") in ABUSE)
    return n >= 2 or n == 1 and p.n_words <= 100


Rules = dict[str, Callable[[Page], bool]]
RULES: Rules = {f.__name__: f for f in (symbol_heavy, odd_word_length, shouting, repeated_lines, few_letters, one_word, abusive)}


def base_rules(least_words: int = 50, most_repeated: int = 50) -> Rules:
    return {
        "too_few_words": lambda p: p.n_words < least_words,
        "repeated_words": lambda p: 100 * p.n_repeat_words > most_repeated * p.n_words,
    }


def all_rules(toxic: Toxicity | None = None, base: Rules | None = None) -> Rules:
    """Base rules, fixed rules and, with a fitted model, toxic wording."""
    return (base_rules() if base is None else base) | RULES | ({"toxic_wording": lambda p: toxic(p.text)} if toxic and toxic.weights else {})


def rule_order(docs: DataFrame, rules: Rules, sample_rows: int = 1000) -> list[str]:
    """The rules by falling rejection per cost, as an executor measures them on the first sample_rows documents.

    A rule is timed on pages of which nothing is known yet. Only one row a rule reaches the driver. With no documents
    the order is that of the dictionary."""

    def make():
        def apply(batch):
            texts = as_bytes(batch.column("text"))
            out: dict[str, list] = {"rule": [], "cost": [], "rejected": []}
            for name, rule in rules.items():
                pages = [Page(t) for t in texts]
                began = time.perf_counter()
                rejected = sum(map(rule, pages))
                for k, v in (("rule", name), ("cost", time.perf_counter() - began), ("rejected", rejected)):
                    out[k].append(v)
            return out

        return apply

    seen = map_batches(docs.select("text").limit(sample_rows), make, "rule string, cost double, rejected long")
    got = {r.rule: r for r in seen.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()}
    if not got:
        return list(rules)
    gain = lambda name: got[name].rejected / max(got[name].cost, 1e-9)
    return sorted(rules, key=lambda name: (-gain(name), name))


def judge(docs: DataFrame, rules: Rules | None = None, base: Rules | None = None, sample_rows: int = 1000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns of keep, the base counts, base_failed, kept and the rule that rejected it.

    docs needs a string column text; further columns are ignored unless named in keep. Counts are results here, so all of
    them are taken."""
    base = base_rules() if base is None else base
    rules = all_rules(base=base) if rules is None else rules
    order = rule_order(docs, rules, sample_rows)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def make():
        def apply(batch):
            out: dict[str, list] = {k: [] for k in (*COUNTS, "base_failed", "kept", "failed_rule")}
            for text in as_bytes(batch.column("text")):
                p = Page(text)
                why = next((name for name in order if rules[name](p)), None)
                for k in COUNTS:
                    out[k].append(getattr(p, k))
                out["base_failed"].append(any(rule(p) for rule in base.values()))
                out["kept"].append(why is None)
                out["failed_rule"].append(why)
            return out | {f"keep_{k}": batch.column(k) for k in keep}

        return apply

    ddl = "".join(f"`keep_{k}` {fields[k]}, " for k in keep) + "".join(f"{k} long, " for k in COUNTS) + "base_failed boolean, kept boolean, failed_rule string"
    found = map_batches(docs.select(*dict.fromkeys([*keep, "text"])), make, ddl)
    return found.select(*(F.col(f"keep_{k}").alias(k) for k in keep), *COUNTS, "base_failed", "kept", "failed_rule")


def kept_documents(docs: DataFrame, rules: Rules | None = None, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    rules = all_rules() if rules is None else rules
    order = rule_order(docs, rules, sample_rows)

    def make():
        def keep(batch):
            return [not any(rules[name](p) for name in order) for p in map(Page, as_bytes(batch.column("text")))]

        return keep

    return filter_batches(docs, make)


def fitted_rules(spark: SparkSession, sf_dir: str, label_rows: int = 8000) -> Rules:
    """All rules, toxic wording by weights fitted to at most label_rows labelled documents of that folder."""
    return all_rules(fit(labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), label_rows)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), fitted_rules(spark, sf_dir)).drop("failed_rule")
