"""License scans by templates with optional and replaceable regions.

A template is text in which ``[[...]]`` may be left out and ``{{name:n}}`` stands for up
to ``n`` words of any wording. It is compiled to an automaton over words: mandatory words
must match one by one, an optional region may be jumped over, a replaceable one
consumes any words. A text is accepted wherever the automaton runs to its end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrid.llm.common import plain_words, text_bytes

# Phrases whose mere presence gives a label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as their authors prescribe them, with markup; the label each one adds.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 [[the license you may not use this file except in compliance with the license]]",
    "cc-by-nc-4.0": "licensed under [[a creative commons]] cc by nc 4.0 [[international license]]",
    "cc-by-4.0": "licensed under [[a creative commons]] cc by 4.0 [[international license]]",
    "gpl-3.0": "[[this {{kind:2}} is]] licensed under the gnu general public license [[as published by the free software foundation]] version 3 [[or any later version]]",
    "mit": "[[copyright {{holder:12}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "[[released|licensed]] under the mit license [[see {{file:4}} for details]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}
FULL, MENTION = 1.0, 0.5
_MARKUP = re.compile(r"\[\[|\]\]|\{\{[^}]*?:\d+\}\}|\|")


class Automaton:
    """States over words. ``steps[s]`` maps a word to the next states, ``any_[s]`` are the
    states after any word, and ``jumps[s]`` those that need no word."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, list[int]]] = []
        self.any_: list[list[int]] = []
        self.jumps: list[list[int]] = []
        at = start = self._state()
        opened: list[tuple[int, list[int]]] = []
        place = 0
        for mark in [*_MARKUP.finditer(template), None]:
            for word in plain_words(template[place:mark.start() if mark else None].encode()):
                after = self._state()
                self.steps[at].setdefault(word, []).append(after)
                at = after
            if mark is None:
                break
            place = mark.end()
            if mark[0] == "[[":
                opened.append((at, []))
                at = self._branch(at)
            elif mark[0] == "|":
                opened[-1][1].append(at)
                at = self._branch(opened[-1][0])
            elif mark[0] == "]]":
                before, ends = opened.pop()
                after = self._state()
                for s in [before, at, *ends]:
                    self.jumps[s].append(after)
                at = after
            else:
                exits = [at]
                for _ in range(int(mark[0][2:-2].rsplit(":", 1)[1])):
                    after = self._state()
                    self.any_[at].append(after)
                    at = after
                    exits.append(at)
                after = self._state()
                for s in exits:
                    self.jumps[s].append(after)
                at = after
        self.start, self.end = start, at
        #: The longest stretch of mandatory words: a text without it can't be accepted.
        plain = re.split(r"\s*\x00\s*", self._outside(template))
        self.needed = max((b" ".join(plain_words(p.encode())) for p in plain), key=len)
        self.first = self._closed({start})

    @staticmethod
    def _outside(template: str) -> str:
        while (cut := re.sub(r"\[\[[^\[\]]*\]\]|\{\{[^}]*\}\}", "\0", template)) != template:
            template = cut
        return template

    def _state(self) -> int:
        self.steps.append({})
        self.any_.append([])
        self.jumps.append([])
        return len(self.steps) - 1

    def _branch(self, at: int) -> int:
        new = self._state()
        self.jumps[at].append(new)
        return new

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.jumps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def ends(self, words: list[bytes], at: int) -> int | None:
        """Where the longest accepted stretch from ``at`` ends, None if there is none."""
        states, found = self.first, None
        while True:
            if self.end in states:
                found = at
            if at >= len(words) or not states:
                return found
            after: set[int] = set()
            for s in states:
                after.update(self.steps[s].get(words[at], ()))
                after.update(self.any_[s])
            states, at = self._closed(after), at + 1

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """All accepted stretches from left to right, each the longest from where it starts."""
        out, at = [], 0
        while at < len(words):
            end = self.ends(words, at)
            if end is not None and end > at:
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


def phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase starts, in words joined and framed by blanks."""
    out, at, sought, word, counted = [], 0, b" " + phrase + b" ", 0, 0
    while (at := line.find(sought, at)) >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        out.append(word)
        at += 1
    return out


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>,"
    " spans array<struct<label: string, start: int, end: int>>, score double"
)


def scan_licenses(text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> Column:
    """What a text says about its license, as a struct.

    ``n_words`` its lower-cased words (ASCII letters, digits, anything beyond ASCII);
    ``n_base``, ``first_word``, ``last_word`` the places of the phrases (null if there are
    none); ``base_labels`` theirs, ``labels`` those and the accepted templates', both
    distinct and sorted; ``spans`` the accepted stretches in words; ``score`` is 1 if a
    template was accepted, 0.5 if only a phrase was found, else 0. Null text is empty.
    """

    @F.pandas_udf(RESULT)
    def scan(data: pd.Series) -> pd.DataFrame:
        machines = {label: Automaton(t) for label, t in templates.items()}
        wanted = {b" ".join(plain_words(p.encode())): label for p, label in phrases.items()}
        rows = []
        for x in data:
            words = plain_words(x)
            line = b" " + b" ".join(words) + b" "
            places, base, spans = [], set(), []
            for phrase, label in wanted.items():
                if at := phrase_places(line, phrase):
                    places += at
                    base.add(label)
            for label, machine in machines.items():
                if b" " + machine.needed + b" " in line:
                    spans += [{"label": label, "start": s, "end": e} for s, e in machine.spans(words)]
            labels = base | {s["label"] for s in spans}
            rows.append((
                len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels),
                spans, FULL if spans else MENTION if base else 0.0,
            ))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text_bytes(text))
