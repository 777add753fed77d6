"""License scans by template markup.

A template is wording with regions: ``[[...]]`` may be absent, ``<<n>>`` stands for 0 to n words of any kind, all other
words are mandatory and must match exactly, in order. Templates compile to one automaton over words: a state is a place
in a template, an optional region is an edge around it, a replaceable one a chain of states that any word passes. Sets
of states become states of a deterministic automaton as texts reach them, so a word of a text costs one lookup.

Base phrases are counted beside it: every place where a phrase's words stand consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.common import slices, texts_of

# The phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The wording of public license texts and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "licensed under [[the terms of]] the apache license [[version]] 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http www apache org licenses license 2 0]] [[https www apache org licenses license 2 0]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "[[is]] [[are]] [[licensed]] [[released]] [[distributed]] [[available]] under [[the terms of]] the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl-3.0", "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-2.0", "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation either]] version 2"),
    ("gpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version"),
    ("gpl-2.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version"),
    ("lgpl-2.1-or-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or [[at your option]] any later version"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by [[international]] 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[international]] 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa [[international]] 4 0"),
    ("cc-by-nd-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nd [[international]] 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 international [[public]] license"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] creative commons attribution sharealike 4 0 international [[public]] license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of <<12>> nor the names of [[its]] [[the]] contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARKUP = re.compile(r"\[\[|\]\]|<<(\d+)>>|[^\s\[\]<>]+")
#: Deterministic states that a worker remembers; beyond, it begins anew.
STATES_MAX = 50_000


def parsed(template: str) -> list:
    """Parts of a template: words, numbers (0 to n words of any kind) and lists (optional parts); regions may be nested."""
    top: list = []
    open_ = [top]
    for m in MARKUP.finditer(template):
        if m[0] == "[[":
            open_[-1].append([])
            open_.append(open_[-1][-1])
        elif m[0] == "]]":
            open_.pop()
            if not open_:
                raise ValueError(f"a region that ends and does not begin: {template}")
        else:
            open_[-1].append(int(m[1]) if m[1] else m[0])
    if len(open_) != 1:
        raise ValueError(f"a region that does not end: {template}")
    return top


def mandatory(parts: list) -> int:
    return sum(isinstance(x, str) for x in parts)


def as_pattern(parts: list) -> str:
    """The same language as a regular expression over words that each have a space behind; for SQL and tests."""
    out = ""
    for x in parts:
        out += f"(?:[^ ]+ ){{0,{x}}}" if isinstance(x, int) else f"(?:{as_pattern(x)})?" if isinstance(x, list) else f"{x} "
    return out


@dataclass
class Automaton:
    """All templates as one automaton that looks for them at every word.

    ``edges[s]``: (word or None for any, next state); ``free[s]``: states reached without a word; ``ends[s]``: the
    template that ends there.
    """

    templates: list[tuple[str, list]]
    edges: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for number, (_, parts) in enumerate(self.templates):
            if not mandatory(parts):
                raise ValueError("a template without mandatory words")
            start = self.state()
            if number == 0:
                self.starts = []
            self.starts.append(start)
            self.ends[self.chain(parts, start)] = number
        self.begin = self.closed(self.starts)
        self.forget()

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def chain(self, parts: list, at: int) -> int:
        for x in parts:
            if isinstance(x, list):
                end = self.chain(x, at)
                after = self.state()
                self.free[at].append(after)
                self.free[end].append(after)
                at = after
            elif isinstance(x, int):
                after = self.state()
                for _ in range(x):
                    self.free[at].append(after)
                    step = self.state()
                    self.edges[at].append((None, step))
                    at = step
                self.free[at].append(after)
                at = after
            else:
                step = self.state()
                self.edges[at].append((x.encode(), step))
                at = step
        return at

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def forget(self) -> None:
        """Deterministic states: number by set; of each the steps by word, that of any other word, and the templates it ends."""
        self.number, self.steps, self.other, self.found = {}, [], [], []
        self.number_of(self.begin)

    def number_of(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.steps)
            self.steps.append({})
            by: dict[bytes | None, set[int]] = {None: set()}
            for s in states:
                for w, t in self.edges[s]:
                    by.setdefault(w, set()).add(t)
            self.other.append(by)
            self.found.append(frozenset(self.ends[s] for s in states if s in self.ends))
        return self.number[states]

    def step(self, at: int, word: bytes) -> int:
        """The state after a word: that of any other word where no state waits for this one."""
        by = self.other[at]
        key = word if word in by else None
        steps = self.steps[at]
        if key not in steps:
            steps[key] = self.number_of(self.closed(by[None] | by.get(key, set()) | set(self.starts)))
        return steps[key]

    def scan(self, words: list[bytes]) -> set[int]:
        """Numbers of the templates that stand somewhere in the text."""
        if len(self.steps) > STATES_MAX:
            self.forget()
        at, seen = 0, set()
        for w in words:
            at = self.step(at, w)
            if self.found[at]:
                seen |= self.found[at]
        return seen


def places(words: list[bytes], phrases: dict[bytes, list[tuple[list[bytes], str]]]) -> list[tuple[int, str, int]]:
    """(start, label, words) of every place where a phrase stands; ``phrases`` by first word."""
    out = []
    for i, w in enumerate(words):
        for rest, label in phrases.get(w, ()):
            if words[i + 1 : i + 1 + len(rest)] == rest:
                out.append((i, label, 1 + len(rest)))
    return out


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    ``score`` is 1 - 1 / (1 + m) with m the most mandatory words of a template or phrase that the text has, 0 without
    one: longer wording is stronger evidence. Texts without a label have empty strings, null and empty texts no words.
    Every row is judged by its own text, so null and repeated ids stay as they are; extra columns are ignored. One pass
    over batches, no shuffle.
    """
    compiled = [(label, parsed(t)) for label, t in templates]
    first: dict[bytes, list] = {}
    for phrase, label in phrases.items():
        head, *rest = phrase.encode().split()
        first.setdefault(head, []).append((rest, label))
    # a text without the longest word of any template or phrase has none of them
    keys = {max((x for x in parts if isinstance(x, str)), key=len) for _, parts in compiled} | {max(phrase.split(), key=len) for phrase in phrases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(compiled)
        needed = {key.encode() for key in keys}
        for batch in slices(batches):
            out = []
            for text in texts_of(batch):
                words = WORD.findall(text.lower())
                if needed.isdisjoint(words):
                    out.append((len(words), 0, None, None, "", "", 0.0))
                    continue
                base, found = places(words, first), automaton.scan(words)
                labels = {label for _, label, _ in base}
                most = max([n for *_, n in base] + [mandatory(compiled[t][1]) for t in found], default=0)
                out.append((
                    len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted(labels)), ",".join(sorted(labels | {compiled[t][0] for t in found})), 1 - 1 / (1 + most) if most else 0.0,
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=names)

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, RESULT)
