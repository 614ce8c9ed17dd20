"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over word-initial and continuing pieces. A failure link says where to go on when the longest
match so far must be cut off, and how many pieces that pops; both are worked out once for every state, so that a
word is read once from left to right, in time linear in its length, and no pieces are built. Many words walk side by
side through the trie.

A word is a run of anything but ASCII white space. As with word-piece tokenizers, a word that the vocabulary cannot
spell counts as one unknown token. Null and empty texts have no words and no tokens. Repeated rows are counted alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, map_batches, read, slices, tokenizer_path

INITIAL = "▁"


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model: those that begin a word are marked with INITIAL."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """The trie as a double array: the child of state s by class k is at base[s] + k, if owner there is s.

    States are the nodes of the trie; state 0 is its root, before a continuing piece. A word's walk starts in the
    node of INITIAL. fail and popped: where a state without the wanted child goes on, and the pieces that it has found
    by then. The state dead means that the word cannot be spelt."""

    def __init__(self, pieces: list[str]):
        pieces = sorted(set(pieces))
        chars = sorted({c for p in pieces for c in p})
        self.codes = np.array([ord(c) for c in chars], np.uint32)
        classes = {c: i for i, c in enumerate(chars)}
        children: list[dict[int, int]] = [{}]
        final = [False]
        for p in pieces:
            s = 0
            for c in p:
                k = classes[c]
                if k not in children[s]:
                    children[s][k] = len(children)
                    children.append({})
                    final.append(False)
                s = children[s][k]
            final[s] = True
        self.start = children[0].get(classes.get(INITIAL, -1), -1)
        dead = self.dead = len(children)
        self.classes = len(chars)
        fail, popped = [dead] * (dead + 1), [0] * (dead + 1)
        # Breadth first: the failure link of a node depends on those of shorter ones.
        todo = [(0, k, t) for k, t in children[0].items()]
        while todo:
            nxt = []
            for up, k, s in todo:
                nxt += [(s, x, t) for x, t in children[s].items()]
                if final[s]:
                    fail[s], popped[s] = 0, 1
                    continue
                z, count = fail[up], popped[up]
                while z != dead and k not in children[z]:
                    count += popped[z]
                    z = fail[z]
                if z != dead:
                    fail[s], popped[s] = children[z][k], count
            todo = nxt
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self._lay_out(children)
        # At a word's end the failure links are followed to the root; else the word cannot be spelt.
        last = [0] * (dead + 1)
        for s in range(dead + 1):
            z, total = s, 0
            while z not in (0, dead):
                total += popped[z]
                z = fail[z]
            last[s] = total if z == 0 else -1
        self.last = np.array(last, np.int64)

    def _lay_out(self, children: list[dict[int, int]]) -> None:
        """First fit, the states with most children first; where free slots get rare, the search starts further on."""
        size = 4 * len(children) + 4 * self.classes
        self.base, self.owner, self.child = np.zeros(len(children) + 1, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        used, front = bytearray(size), 0
        for s in sorted((s for s in range(len(children)) if children[s]), key=lambda s: -len(children[s])):
            keys = sorted(children[s])
            b, tries = max(0, used.find(0, front) - keys[0]), 0
            while any(used[b + k] for k in keys):
                b, tries = max(b + 1, used.find(0, b + keys[0] + 1) - keys[0]), tries + 1
            if tries > 30:
                front = max(front, b)
            for k in keys:
                used[b + k] = 1
                self.owner[b + k], self.child[b + k] = s, children[s][k]
            self.base[s] = b

    def lengths(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of the words that lie in codes (code points) from starts on; 1 for a word that cannot be spelt."""
        out = np.ones(len(starts), np.int64)
        if not len(starts) or self.start < 0:
            return out
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        kind = np.where(self.codes[at] == codes, at, -1).astype(np.int32)
        order = np.argsort(-sizes, kind="stable")
        where, left = starts[order], sizes[order]
        state, total = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int64)
        for i in range(int(left[0])):
            live = int(np.searchsorted(-left, -i, side="left"))
            k, s, t = kind[where[:live] + i], state[:live], total[:live]
            s[k < 0] = self.dead
            slot = self.base[s] + k
            stuck = np.flatnonzero((self.owner[slot] != s) & (s != self.dead))
            hit = np.where(s == self.dead, self.dead, self.child[slot])
            while len(stuck):
                z = s[stuck]
                t[stuck] += self.popped[z]
                s[stuck] = z = self.fail[z]
                slot = self.base[z] + k[stuck]
                fits = (self.owner[slot] == z) | (z == self.dead)
                hit[stuck] = np.where(z == self.dead, self.dead, self.child[slot])
                stuck = stuck[~fits]
            state[:live] = hit
            if live < 64 and (hit == self.dead).all():
                break
        end = self.last[state]
        out[order] = np.where((state == self.dead) | (end < 0), 1, total + end)
        return out


class Counter:
    """Tokens of texts; keeps the lengths of at most `most` distinct words."""

    def __init__(self, automaton: Automaton, most: int = 1_000_000):
        self.automaton, self.most = automaton, most
        self.known: dict[bytes, int] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        todo = [w for w in words if w not in self.known]
        for part in slices(len(todo), 100_000):
            codes = np.frombuffer(b" ".join(todo[part]).decode("utf-8").encode("utf-32-le"), np.uint32)
            edge = np.flatnonzero(np.diff(np.concatenate([[True], codes == 32, [True]]).astype(np.int8)))
            self.known.update(zip(todo[part], self.automaton.lengths(codes, edge[::2], edge[1::2] - edge[::2]).tolist()))

    def count(self, texts: list[bytes | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text. Works through about 4 MB at a time."""
        n_words: list[int] = []
        n_tokens: list[int] = []
        part: list[list[bytes]] = []
        size = 0
        for t in [*texts, None]:
            part.append(t.split() if t else [])
            size += len(t or b"")
            if size > 4_000_000 or len(n_words) + len(part) > len(texts):
                self._learn(set().union(*part))
                n_words += map(len, part)
                n_tokens += [sum(map(self.known.__getitem__, x)) for x in part]
                part, size = [], 0
        return n_words[: len(texts)], n_tokens[: len(texts)]


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): its words and word-piece tokens.

    The driver builds the automaton, of the vocabulary's size, and sends it along."""
    path = tokenizer_path("piece_bpe_32k.model", model)
    automaton = Automaton(vocabulary(path))

    def make():
        counter = _COUNTERS.setdefault(path, Counter(automaton))

        def apply(batch):
            words, tokens = counter.count(as_bytes(batch.column("text")))
            return {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens}

        return apply

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
