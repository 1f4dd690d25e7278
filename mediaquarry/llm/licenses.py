"""License scans: matching statistics against a generalised suffix automaton of licence words.

The automaton holds every run of consecutive words of every template. A text streams through it word by word, which
gives at each word the longest run of licence words that ends there. Runs of at least MIN_RUN words that can't be
longer are anchors (place in the text, place in a template); for each template the anchors that keep its order, with
gaps of at most MAX_GAP words, chain into a span, and a span that covers at least MIN_COVER of the template's words
gives the template's label. The score is the best cover over all templates, whether it is enough or not.

Templates are whole licences (the text files in the folder licences, labelled by their names) and short notices.

Defined cases: a null text counts as empty and has no words, labels "" and score 0; templates that share a passage each
count it, so a text may have several labels; of chains that cover as much of a template the one that ends first stays;
repeated rows each give a row; an empty table gives an empty result; other columns of the input play no part. Texts are
scanned whole; memory is that of one text's anchors.
"""

from __future__ import annotations

import re
from functools import lru_cache
from importlib import resources
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_rows

# What a word is, and the phrases with their labels.
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Public notices, by label.
NOTICES = (
    ("mit-notice", "Released under the MIT License"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0-notice", "This work is licensed under the GNU General Public License, version 2"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)



@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str], ...]:
    folder = resources.files(__package__) / "licences"
    return NOTICES + tuple((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in sorted(folder.iterdir(), key=lambda x: x.name) if x.name.endswith(".txt"))


MIN_RUN = 4
MAX_GAP = 12
MIN_COVER = 0.75

COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])


def words_of(text: str) -> list[str]:
    """Words of a text whose A-Z are lower-cased (bytes.lower leaves all other letters as they are)."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Anchor(NamedTuple):
    start: int
    end: int
    at: int  # start in the template


class LicenceAutomaton:
    """Generalised suffix automaton over word ids: one automaton, each template added from the root."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in templates]
        words = [words_of(text) for _, text in templates]
        self.lengths = [len(x) for x in words]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]  # by template: where runs of this state end in it
        for template, sequence in enumerate(words):
            state = 0
            for end, word in enumerate(sequence, 1):
                state = self.extended(state, self.vocabulary[word])
                self.ends[state].setdefault(template, set()).add(end)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            for template, ends in self.ends[state].items():
                self.ends[self.link[state]].setdefault(template, set()).update(ends)

    def new_state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def split(self, state: int, word: int) -> int:
        """The state that word leads to from state, made so that its longest run is one longer than state's."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self.new_state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def extended(self, state: int, word: int) -> int:
        if word in self.next[state]:  # another template has this run already
            return self.split(state, word)
        new = self.new_state(self.length[state] + 1, 0, {})
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self.split(state, word)
        return new

    def runs(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, state) of each longest run that the next word doesn't continue, of at least MIN_RUN words."""
        found, state, length, at = [], 0, 0, -2
        following, links, lengths = self.next, self.link, self.length
        for i, word in [(i, x) for i, x in enumerate(map(self.vocabulary.get, words)) if x is not None]:
            if i != at + 1:
                if length >= MIN_RUN:
                    found.append((at + 1 - length, at + 1, state))
                state = length = 0
            elif word not in following[state] and length >= MIN_RUN:
                found.append((i - length, i, state))
            while state and word not in following[state]:
                state = links[state]
                length = lengths[state]
            if word in following[state]:
                state, length = following[state][word], length + 1
            at = i
        if length >= MIN_RUN:
            found.append((at + 1 - length, at + 1, state))
        return found

    def chains(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, cover) of the best chain from each group of anchors that are near one another."""
        anchors: dict[int, list[Anchor]] = {}
        for start, end, state in self.runs(words):
            for template, ends in self.ends[state].items():
                anchors.setdefault(template, []).extend(Anchor(start, end, x - (end - start)) for x in sorted(ends) if x >= end - start)
        found = []
        for template, mine in sorted(anchors.items()):
            best: tuple[int, int, int] | None = None  # (words covered, start, end)
            live: list[tuple[Anchor, int, int]] = []  # anchors near enough to be continued: (anchor, covered, chain's start)
            for a in sorted(mine):
                live = [x for x in live if a.start - x[0].end <= MAX_GAP]
                if not live and best:
                    found.append((template, best[1], best[2], best[0] / self.lengths[template]))
                    best = None
                covered, start = a.end - a.start, a.start
                for b, n, s in live:
                    cut = max(0, b.end - a.start, b.at + b.end - b.start - a.at)  # words that both anchors cover
                    if b.at < a.at and b.start < a.start and (more := n + a.end - a.start - cut) > covered:
                        covered, start = more, s
                live.append((a, covered, start))
                best = max(best or (0, 0, 0), (covered, start, a.end), key=lambda x: x[0])
            if best:
                found.append((template, best[1], best[2], best[0] / self.lengths[template]))
        return found


@lru_cache(maxsize=1)
def automaton() -> LicenceAutomaton:
    return LicenceAutomaton(templates())


@lru_cache(maxsize=1)
def phrases_by_first() -> dict[str, list[tuple[list[str], str]]]:
    by_first: dict[str, list[tuple[list[str], str]]] = {}
    for phrase, label in PHRASES:
        by_first.setdefault(phrase.split()[0], []).append((phrase.split(), label))
    return by_first


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) wherever a phrase's words stand one after another."""
    found, by_first = [], phrases_by_first()
    for i in [i for i, w in enumerate(words) if w in by_first]:
        found += [(i, label) for phrase, label in by_first[words[i]] if words[i : i + len(phrase)] == phrase]
    return found


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): words, base places, labels, score and the covered template spans (label:first word:end:cover)."""

    def make(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in ARROW}
        out["doc_id"] = columns["doc_id"]
        for text in columns["text"]:
            words = words_of(text or "")
            places = base_places(words)
            chains = automaton().chains(words)
            covered = [x for x in chains if x[3] >= MIN_COVER]
            base = {label for _, label in places}
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min((i for i, _ in places), default=None))
            out["last_word"].append(max((i for i, _ in places), default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {automaton().labels[x[0]] for x in covered})))
            out["score"].append(min(1.0, max((x[3] for x in chains), default=0.0)))
            out["spans"].append(",".join(f"{automaton().labels[t]}:{start}:{end}:{cover:.3f}" for t, start, end, cover in covered))
        return out

    return docs.select("doc_id", "text").mapInArrow(by_rows(make, ARROW), COLUMNS)
