"""License scan: template-markup matching over words.

A template is license wording with marked regions: ``[[optional words]]`` may be missing and
``{{n}}`` stands for 0 to n words of the licensor's choice. Each template is compiled to an automaton
over words; a text is accepted where the mandatory wording matches exactly, in order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The word pattern, the base phrases and their labels.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, template); fixed values: the wording of well-known public licenses, whole, and of their short notices.
TEMPLATES = (
    ("mit", "licensed [[to you]] under the [[terms of the]] mit license"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of {{12}} and associated
        documentation files {{4}} to deal in {{4}} without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of {{4}} and to permit persons to whom {{4}}
        is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of {{4}} {{4}} is
        provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with {{4}} or the use or other dealings in {{4}}"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software
        is provided as is and {{6}} disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall {{6}} be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action
        of contract negligence or other tortious action arising out of or in connection with the use or performance of
        this software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the
        above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution [[[[3]] neither the name of {{10}} nor the names of {{4}} contributors
        may be used to endorse or promote products derived from this software without specific prior written permission]]
        this software is provided by {{10}} as is and any express or implied warranties including but not limited to the
        implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be
        held liable for any damages arising from the use of this software permission is granted to anyone to use this
        software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions"""),
    ("bsl-1", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license the software to use reproduce display distribute execute
        and transmit the software and to prepare derivative works of the software and to permit third parties to whom
        the software is furnished to do so all subject to the following"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means"""),
    ("apache-2", "licensed under the apache license version 2 [[0]]"),
    ("apache-2", "you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{8}}]]"),
    ("bsd-3", "licensed under the bsd 3 clause [[new or revised]] license"),
    ("gpl-3", "licensed under the gnu general public license [[as published by the free software foundation]] version 3"),
    ("gpl-3", "under the terms of the gnu general public license [[as published by {{6}}]] [[either]] version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "under the [[terms of the]] gnu affero general public license [[as published by {{6}}]] version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc [[4 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[4 0]] [[international]]"),
    ("cc-by", "creative commons attribution [[4 0]] [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa [[4 0]]"),
    ("cc0", "cc0 1 0 universal"),
    ("proprietary", "all rights reserved [[by {{6}}]] no part of {{6}} may be reproduced"),
)


class Automaton:
    """States are places in the template; a step reads one word."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.step: list[dict[str, int]] = [{}]
        self.skip: dict[int, list[int]] = defaultdict(list)  # moves without a word
        self.loop: dict[int, int] = {}  # a move on any word
        opened: list[int] = []
        self.mandatory = 0
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            at = len(self.step) - 1
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.skip[opened.pop()].append(at)
            elif part.startswith("{{"):
                n = int(part[2:-2])
                for _ in range(n):
                    self.loop[len(self.step) - 1] = len(self.step)
                    self.step.append({})
                self.skip[at] += range(at + 1, at + n + 1)
                # every place inside the region may leave it
                for inside in range(at + 1, at + n):
                    self.skip[inside].append(at + n)
            else:
                self.mandatory += not opened
                self.step[at][part] = at + 1
                self.step.append({})
        self.final = len(self.step) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for there in self.skip.get(todo.pop(), ()):
                if there not in states:
                    states.add(there)
                    todo.append(there)
        return states

    def first_words(self) -> set[str]:
        return {word for state in self.closed({0}) for word in self.step[state]}

    def longest(self, words: list[str], start: int) -> int | None:
        """The end of the longest accepted run of words from start, or None."""
        states, end, at = self.closed({0}), None, start
        while states and at < len(words):
            word, moved = words[at], set()
            for state in states:
                if word in self.step[state]:
                    moved.add(self.step[state][word])
                if state in self.loop:
                    moved.add(self.loop[state])
            states, at = self.closed(moved), at + 1
            if self.final in states:
                end = at
        return end


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.by_word: dict[str, list[Automaton]] = defaultdict(list)
        for label, template in templates:
            automaton = Automaton(label, template)
            for word in automaton.first_words():
                self.by_word[word].append(automaton)
        self.phrases = [(phrase.split(), label) for phrase, label in PHRASES.items()]
        self.openers = set(self.by_word) | {phrase[0] for phrase, _ in self.phrases}

    def scan(self, low: str) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words; (start, label) of base places; (start, end, label, share) of accepted templates."""
        words = WORD.findall(low)
        base, taken = [], []
        if self.openers.isdisjoint(words):
            return len(words), base, taken
        for at, word in enumerate(words):
            if word not in self.openers:
                continue
            for phrase, label in self.phrases:
                if word == phrase[0] and words[at : at + len(phrase)] == phrase:
                    base.append((at, label))
            for automaton in self.by_word.get(word, ()):
                if (end := automaton.longest(words, at)) is not None:
                    taken.append((at, end, automaton.label, automaton.mandatory / (end - at)))
        return len(words), base, taken


MATCHES = "array<struct<start:int,stop:int,label:string,share:double>>"


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per input row: ``key``, ``n_words``, ``base`` (start, label) and ``matches``.

    A match has its first word, its end (exclusive), its label and the share of its words that are
    mandatory. Null or empty text: no words, no matches. Repeated rows stay. Texts are read whole.
    Other columns of the input are not read, so their names may be anything.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        place = pa.list_(pa.struct([("start", pa.int32()), ("label", pa.string())]))
        match = pa.list_(
            pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("share", pa.float64())])
        )
        for batch in batches:
            counts, bases, matches = [], [], []
            for value in batch.column(1):
                n, base, taken = scanner.scan((value.as_py() or "").encode().lower().decode())  # of bytes: A-Z alone
                counts.append(n)
                bases.append([{"start": s, "label": label} for s, label in base])
                matches.append([dict(zip(("start", "stop", "label", "share"), m, strict=True)) for m in taken])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, place), pa.array(matches, match)],
                ["k", "n_words", "base", "matches"],
            )

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    out = slim.mapInArrow(scan, f"k {kind}, n_words long, base array<struct<start:int,label:string>>, matches {MATCHES}")
    return out.select(F.col("k").alias(key), "n_words", "base", "matches")


def license_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns; score is 1 for a base phrase, else the best mandatory share, else 0."""
    base_labels = F.array_sort(F.array_distinct("base.label"))
    labels = F.array_sort(F.array_distinct(F.concat("base.label", "matches.label")))
    best = F.coalesce(F.array_max("matches.share"), F.lit(0.0))
    return found.select(
        key, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )
