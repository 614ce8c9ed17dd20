"""License scans: template markup compiled to token automata.

A template is mandatory wording with two kinds of marked regions: [[...]] is optional, {a,b} stands for between a and b
arbitrary words. It becomes an automaton over words; a text has the license if the automaton accepts a run of
its words, so mandatory wording must match exactly and in order. Words are lower-cased A-Z, punctuation is ignored. TEXTS are
whole licenses with conditions and disclaimer, NOTICES sentences that put a work under one; either gives its label.
Runs of one template do not overlap (the first and longest counts), those of different templates may.

The score is 1 if the text has a label, by a phrase or a template, else the largest share of a template's mandatory words
that one place reads in order.

Null and empty texts have no words, no labels and score 0. Repeated rows are scanned alike, row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, map_batches, read, words_of

#: Fixed base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

DISCLAIMER = (
    "this software is provided by {1,14} as is and any express {0,1} implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {1,14} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution "
)
FSF = "free software you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the free software foundation either version {1} of the license or at your option any later version"
CC = "[[licensed]] [[released]] [[available]] under [[a]] [[the]] [[creative commons]] "

#: Whole texts of public licenses, with optional and replaceable regions marked: a copy with changed mandatory wording has no label.
TEXTS = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as "
        "is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "{1,2} in no event shall the {1,8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc": [
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and {1,3} disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall {1,3} be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software"
    ],
    "0bsd": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and "
        "{1,3} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {1,3} be "
        "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
        "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd-2-clause": [BSD + DISCLAIMER],
    "bsd-3-clause": [
        BSD + "[[3]] neither the name of {1,14} nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission " + DISCLAIMER
    ],
    "bsd-4-clause": [
        BSD + "[[3]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes "
        "software developed by {1,20} [[4]] neither the name of {1,14} nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission " + DISCLAIMER
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use "
        "of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you "
        "wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
        "required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice "
        "may not be removed or altered from any source distribution"
    ],
    "bsl-1": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to "
        "permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire "
        "statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or "
        "in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code "
        "generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone "
        "distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that "
        "recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act "
        "of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty "
        "of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in "
        "no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
        "or in connection with the software or the use or other dealings in the software"
    ],
}

#: Fixed wording of notices that put a work under a license.
NOTICES = {
    "mit": ["[[released]] [[licensed]] [[distributed]] [[available]] under the [[terms of the]] mit license", "spdx license identifier mit"],
    "isc": ["[[licensed]] under the isc license", "spdx license identifier isc"],
    "apache-2": [
        "licensed under the apache license [[version]] 2 [[0]]", "spdx license identifier apache 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {1,8} "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd-2-clause": ["[[licensed]] under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd-3-clause": ["[[licensed]] under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "gpl-2": ["[[licensed]] under the [[terms of the]] gnu general public license version 2", FSF.format("", "2"), "spdx license identifier gpl 2 0 [[only]] [[or later]]"],
    "gpl-3": [
        "[[licensed]] under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
        "gnu gpl {0,1} 3 [[0]]", FSF.format("", "3"), "spdx license identifier gpl 3 0 [[only]] [[or later]]",
    ],
    "lgpl-2-1": [FSF.format("lesser", "2 1"), "spdx license identifier lgpl 2 1 [[only]] [[or later]]"],
    "lgpl-3": ["[[licensed]] under the gnu lesser general public license [[either]] version 3", FSF.format("lesser", "3"), "spdx license identifier lgpl 3 0 [[only]] [[or later]]"],
    "agpl-3": ["[[licensed]] under the gnu affero general public license [[either]] version 3", FSF.format("affero", "3"), "spdx license identifier agpl 3 0 [[only]] [[or later]]"],
    "mpl-2": [
        "subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at]]", "[[licensed]] under the mozilla public license [[version]] 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "cc-by-nc": ["cc by nc [[sa]] [[nd]] {1,1} 0", CC + "attribution non commercial [[sharealike]] [[noderivatives]] {1,1} 0", CC + "attribution noncommercial [[sharealike]] [[noderivatives]] {1,1} 0"],
    "cc-by-sa": ["cc by sa {1,1} 0", CC + "attribution sharealike {1,1} 0", CC + "attribution share alike {1,1} 0"],
    "cc-by": ["cc by 4 0", "cc by 3 0", CC + "attribution {1,1} 0"],
    "cc0": ["cc0 1 0", "dedicated to the public domain under {0,3} cc0"],
    "unlicense": ["released into the public domain under the unlicense", "spdx license identifier unlicense"],
}
TEMPLATES = {label: TEXTS.get(label, []) + NOTICES.get(label, []) for label in sorted({*TEXTS, *NOTICES})}


class Automaton:
    """A template as states 0..n: state i either reads a word, may be passed, or reads any word."""

    def __init__(self, template: str):
        self.moves: list[dict[bytes, int]] = []
        self.free: list[int | None] = []
        self.skip: list[set[int]] = []
        self.mandatory: list[bytes] = []
        self.done: list[int] = []
        for optional, least, most, word in re.findall(r"\[\[(.*?)\]\]|\{(\d+),(\d+)\}|([^\s\[\]{}]+)", template):
            if optional:
                start = len(self.moves)
                for w in optional.split():
                    self._add({w.encode(): len(self.moves) + 1}, None, set())
                self.skip[start].add(len(self.moves))
            elif most:
                for i in range(int(most)):
                    at = self._add({}, len(self.moves) + 1, set())
                    if i >= int(least):
                        self.skip[at].add(at + 1)
            else:
                self.mandatory.append(word.encode())
                self._add({word.encode(): len(self.moves) + 1}, None, set())
        self.end = len(self.moves)
        self._add({}, None, set())
        self.first = {w for s in self._closed({0}) for w in self.moves[s]}
        assert not any(self.free[s] is not None for s in self._closed({0})), "a template begins with a word"
        self.total = len(self.mandatory)
        # mandatory words read before state i
        self.done = [0] * (self.end + 1)
        need = list(self.mandatory)
        optional_states = {s for a in range(self.end) for b in self.skip[a] for s in range(a, b)}
        for s in range(self.end):
            self.done[s + 1] = self.done[s] + (s not in optional_states and bool(self.moves[s]))
        assert self.done[self.end] == len(need)

    def _add(self, moves: dict[bytes, int], free: int | None, skip: set[int]) -> int:
        self.moves.append(moves)
        self.free.append(free)
        self.skip.append(skip)
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()] - out:
                out.add(t)
                todo.append(t)
        return out

    def match(self, words: list[bytes], start: int) -> tuple[int | None, int]:
        """The end of the longest accepted run from start, if any, and the most mandatory words read."""
        states, end, most, i = self._closed({0}), None, 0, start
        while states:
            if self.end in states:
                end = i
            most = max(most, max(self.done[s] for s in states))
            if i == len(words):
                break
            step = {t for s in states if (t := self.moves[s].get(words[i])) is not None}
            step |= {self.free[s] for s in states if self.free[s] is not None}
            states, i = self._closed(step), i + 1
        return end, most


def compiled(templates: dict[str, list[str]]) -> dict[bytes, list[tuple[int, str, Automaton]]]:
    """The automata, numbered, by the words that they can begin with."""
    out: dict[bytes, list[tuple[int, str, Automaton]]] = {}
    for n, (label, text) in enumerate((label, t) for label, ts in templates.items() for t in ts):
        a = Automaton(text)
        for w in a.first:
            out.setdefault(w, []).append((n, label, a))
    return out


def scan(words: list[bytes], automata: dict[bytes, list[tuple[int, str, Automaton]]]) -> tuple[list[tuple[str, int, int]], float]:
    """(label, first word, end) of every accepted run, and the largest share of a template's mandatory words read from one place."""
    found, score = [], 0.0
    free: dict[int, int] = {}
    if automata.keys().isdisjoint(words):
        return found, score
    for i, w in enumerate(words):
        for n, label, a in automata.get(w, ()):
            if free.get(n, 0) <= i:
                end, most = a.match(words, i)
                score = max(score, most / a.total)
                if end is not None:
                    found.append((label, i, end))
                    free[n] = end
    return found, score


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of all places where a phrase's words stand consecutively."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        at, word, counted = joined.find(phrase), 0, 0
        while at >= 0:
            word, counted = word + joined.count(b" ", counted, at), at
            out.append((word, label))
            at = joined.find(phrase, at + 1)
    return sorted(out)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per row of docs (doc_id, text): base phrase places, labels, score and the runs accepted by templates."""
    spaced = {f" {p} ".encode(): label for p, label in phrases.items()}

    def make():
        automata = compiled(templates)

        def apply(batch):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "runs")}
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                base = phrase_places(words, spaced)
                runs, score = scan(words, automata)
                labels = {x for _, x in base}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {x for x, _, _ in runs})))
                out["score"].append(1.0 if base or runs else score)
                out["runs"].append([{"label": a, "first_word": b, "end_word": c} for a, b, c in runs])
            return out | {"doc_id": batch.column("doc_id")}

        return apply

    return map_batches(
        docs.select("doc_id", "text"), make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, runs array<struct<label:string,first_word:long,end_word:long>>",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("runs")
