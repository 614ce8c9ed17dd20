"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct piece encoded once.

A batch's texts are cut between neighbouring bytes where the library's pre-tokenizer always cuts, whatever surrounds them:
after a letter of ASCII or Latin-1 before any other ASCII sign, before white space after a visible ASCII sign, before a
letter after a sign, before a space that a visible sign follows, and after a single line break. Fewer cuts are as right,
so all doubtful places are left alone. Arrow finds the distinct pieces. Those that are one word of the pre-tokenizer's
pattern for sure go through the library's BPE model, many at a time; any other piece goes through the whole library.
The ids equal those of encoding the whole text (tested)."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex

#: The letters of ASCII and Latin-1.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x20-\x7e\t\n\r{_L}]*+\Z")
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> list[str]:
    """How this kind of vocabulary writes bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(other)) for b in range(256)]


_LETTERS = _byte_letters()
_SPACE = _LETTERS[0x20]
_UNITS = np.array([*map(ord, _LETTERS)], "<u2")

#: Kinds of bytes, as bits. BEGIN starts a character beyond ASCII that is no white space for sure; REST is anything else.
LETTER, DIGIT, SIGN, QUOTE, SPACE, BREAK, BEGIN, REST = (1 << i for i in range(8))


def _kinds() -> np.ndarray:
    out = np.full(256, REST, np.uint8)
    out[0x21:0x7F] = SIGN
    for c, kind in [("0123456789", DIGIT), ("'", QUOTE), (" ", SPACE), ("\t\n\r", BREAK)]:
        out[[*c.encode()]] = kind
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    out[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = BEGIN
    return out


_KINDS = _kinds()
#: Whether there is a cut between two neighbours of these kinds.
_BETWEEN = np.zeros((256, 256), bool)
for _a, _b in [
    (LETTER, (DIGIT, SIGN, QUOTE, SPACE, BREAK)), (DIGIT, (LETTER, SPACE, BREAK)), (SIGN, (LETTER, SPACE, BREAK)), (QUOTE, (SPACE, BREAK)),
]:
    _BETWEEN[_a, list(_b)] = True
_BETWEEN = _BETWEEN.ravel()
#: What may follow a space that begins a piece, or stand beside a single line break.
_VISIBLE = np.isin(np.arange(256), [LETTER, DIGIT, SIGN, QUOTE, BEGIN])
_SOLID = np.isin(np.arange(256), [LETTER, DIGIT, SIGN, QUOTE])


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; both bytes of a letter of Latin-1 from U+00C0 on are letters."""
    out = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    last = data[lead + 1]
    lead = lead[(last != 0x97) & (last != 0xB7)]
    out[lead] = out[lead + 1] = LETTER
    return out


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte; starts are those of texts that are not empty."""
    kind = kinds(data)
    here = np.zeros(len(data), bool)
    if len(data) > 1:
        here[1:] = _BETWEEN[kind[:-1].astype(np.uint16) << 8 | kind[1:]]
        space = np.flatnonzero(kind[:-1] == SPACE)
        here[space] |= _VISIBLE[kind[space + 1]]
        lone = np.flatnonzero(data[1:-1] == 0x0A) + 1
        here[lone[_SOLID[kind[lone - 1]] & _VISIBLE[kind[lone + 1]]] + 1] = True
        # The last byte of a text has no neighbour to judge by.
        last = starts[starts > 0] - 1
        here[last] &= (last > 0) & _BETWEEN[kind[last - 1].astype(np.uint16) << 8 | kind[last]]
    here[starts] = True
    return here


def gathered(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ids[first : first + size] of all, one after the other."""
    before = np.cumsum(sizes) - sizes
    return ids[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))]


def _binary(starts: np.ndarray, data) -> pa.Array:
    """Neighbouring pieces of data, from each start to the next one."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])


def _parts(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of pieces, and where each begins in them; at last their end."""
    starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


class Encoder:
    """Ids as little-endian unsigned 16- or 32-bit numbers.

    Works through about `part` characters at a time. Once over `most` of the known pieces were met or learned since the time before
    that they were so many, the others are forgotten."""

    def __init__(self, path: str, most: int = 150_000, part: int = 4_000_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.most, self.part = most, part
        self.model = self.tokenizer.model
        added = [*self.tokenizer.get_added_tokens_decoder().values()]
        names = sorted((t.content for t in added), key=len, reverse=True)
        #: A piece with an added token is no plain text.
        self.added = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.added_bytes = re.compile(self.added.pattern.encode())
        self.words: dict[str, bytes] = {}
        #: The BPE model alone, for words written in byte letters with line breaks between them.
        self.lines = Tokenizer(self.model)
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[[*vocabulary.values()]] = [*map(len, vocabulary)]
        #: Whether the rules of the cuts hold for this vocabulary.
        form = json.loads(self.tokenizer.to_str())
        before, model = form["pre_tokenizer"] or {}, form["model"]
        self.cuttable = (
            not form["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t.lstrip or t.rstrip or re.search(r"\s", t.content) or t.content.isalpha() or not re.search("[A-Za-z]", t.content) for t in added)
            and all(x in vocabulary for x in _LETTERS)
        )
        #: Known pieces, their ids one after the other, where those of each begin (at last their end), and which were met.
        self.known = _binary(np.zeros(1), b"")
        self.ids, self.first, self.met = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, bool)

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []

    def _word(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalnum():
            word = _SPACE + word[1:] if word[0] == " " else word
        else:
            word = "".join(map(_LETTERS.__getitem__, word.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _single(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which pieces are one word for sure: one byte, or all letters, digits or signs but for a space at first."""
        kind, first = kinds(data), starts[:-1]
        sizes = np.diff(starts)
        kind[first[(data[first] == 0x20) & (sizes > 1)]] = 0
        within = np.bitwise_or.reduceat(kind, first)
        return (sizes == 1) & (within != REST) | np.isin(within, [LETTER, DIGIT, SIGN])

    def _lined(self, data: np.ndarray, starts: np.ndarray, chunk: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has, by the BPE model, about `chunk` bytes at a time."""
        sizes = np.diff(starts)
        units = np.insert(_UNITS[data], starts[1:-1], 0x0A)
        ends = starts[1:] + np.arange(1, len(starts))
        out, at = [], 0
        while at < len(ends):
            begin = int(ends[at - 1]) if at else 0
            upto = min(max(int(np.searchsorted(ends, begin + chunk)), at + 1), len(ends))
            text = units[begin : int(ends[upto - 1]) - 1].tobytes().decode("utf-16-le")
            out.append(np.array(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype))
            at = upto
        ids = np.concatenate(out)
        found = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes), side="right")
        return ids, np.diff(found, prepend=0)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has."""
        data, starts = _parts(pieces)
        single = self._single(data, starts) if self.cuttable else np.zeros(len(pieces), bool)
        counts = np.zeros(len(pieces), np.int64)
        odd = self._whole([x.decode() for x in pieces.filter(pa.array(~single)).to_pylist()])
        counts[~single] = [len(x) // self.dtype.itemsize for x in odd]
        ids = np.frombuffer(b"".join(odd), self.dtype)
        if single.any():
            words, counts[single] = self._lined(*_parts(pieces.filter(pa.array(single))))
            ids = np.concatenate([ids, words])
        # Odd pieces' ids come first, words' after them.
        order = np.argsort(single, kind="stable")
        first = np.empty_like(counts)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(ids, first, counts), counts

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the pieces begin."""
        if not self.cuttable:
            return starts
        here = cuts(data, starts)
        at, found = 0, self.added_bytes.search(data)
        while found:
            # No cut within an added token, nor before a space in front of it; also if the token only seems to be there.
            here[max(0, found.start() - (found.start() > 0 and data[found.start() - 1] == 0x20)) : found.end()] = False
            at = found.start() + 1
            found = self.added_bytes.search(data, at)
        here[starts] = True
        return np.flatnonzero(here)

    def _encode(self, texts: list[str]) -> list[bytes]:
        data, begin = _parts(pa.array(texts, pa.large_string()))
        if not len(data):
            return [b""] * len(texts)
        at = self._pieces(data, begin[:-1][np.diff(begin) > 0])
        old = len(self.known)
        # Known pieces come first, so that their numbers stay.
        coded = pa.concat_arrays([self.known, _binary(np.append(at, len(data)), data)]).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)[old:]
        if len(coded.dictionary) > old:
            ids, counts = self._learn(coded.dictionary.slice(old))
            self.ids, self.first = np.concatenate([self.ids, ids]), np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
            self.known, self.met = coded.dictionary, np.concatenate([self.met, np.ones(len(counts), bool)])
        self.met[number] = True
        sizes = np.diff(self.first)[number]
        raw = gathered(self.ids, self.first[number], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, begin)] * self.dtype.itemsize
        if np.count_nonzero(self.met) > self.most:
            self._forget()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _forget(self) -> None:
        counts = np.diff(self.first)[self.met]
        self.ids = gathered(self.ids, self.first[:-1][self.met], counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.known = self.known.filter(pa.array(self.met))
        self.met = np.zeros(len(counts), bool)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of every text; a null text has none."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size > self.part:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)


#: The fixed pattern of lower-casing vocabularies with word ends, for lower-cased text of those letters; what it leaves out is dropped.
_FOLDED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
#: White space for str.split, but none for the library.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")


class FoldedEncoder(Encoder):
    """For vocabularies that lower-case, drop white space and mark word ends: no word crosses white space, so that a plain text is its
    pattern's words, and any other text is cut at white space and each distinct piece encoded once."""

    def __init__(self, path: str, most: int = 150_000, part: int = 1_000_000):
        super().__init__(path, most, part)

    def _ids(self, words: list[list[str]]):
        known = self.words
        for w in set().union(*words).difference(known):
            known[w] = self._word(w)
        get = known.__getitem__
        out = [b"".join(map(get, x)) for x in words]
        if len(known) > self.most:
            self.words = {w: known[w] for x in words for w in x}
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, other = [], {}
        for i, t in enumerate(texts):
            if _PLAIN.match(t) and not ("<" in t and self.added.search(t)):
                plain.append(i)
            else:
                other[i] = [x for x in (_SPACES.split(t) if _SEPARATORS.search(t) else t.split()) if x]
        for i, ids in zip(plain, self._ids([_FOLDED.findall(texts[i].lower()) for i in plain])):
            out[i] = ids
        pieces = set().union(*other.values())
        single = [x for x in pieces if _PLAIN.match(x) and not ("<" in x and self.added.search(x))]
        known = dict(zip(single, self._ids([_FOLDED.findall(x.lower()) for x in single])))
        odd = list(pieces.difference(known))
        known.update(zip(odd, self._whole(odd)))
        for i, x in other.items():
            out[i] = b"".join(map(known.__getitem__, x))
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        kind = Encoder(path)
        _ENCODERS[path] = FoldedEncoder(path) if getattr(kind.tokenizer.model, "end_of_word_suffix", None) else kind
    return _ENCODERS[path]
