"""Operator 13: licence scans by a generalised suffix automaton over template words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dupeframe.llm.words import WordHashes, text_bytes

# What a word is, phrases that are labels by themselves, and licence texts (each label may
# have several, apart by an empty line).
WORD_BYTES = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": """
Licensed under the Apache License, Version 2.0

you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met

Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission""",
    "cc-by-4.0": """
This work is licensed under a Creative Commons Attribution 4.0 International License

Licensed under CC BY 4.0""",
    "cc-by-nc-4.0": """
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License

Licensed under CC BY-NC 4.0""",
    "cc-by-sa-4.0": """
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License

Licensed under CC BY-SA 4.0""",
    "gpl-3.0": """
licensed under the GNU General Public License, version 3

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version""",
    "isc": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "mit": """
under the MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction""",
    "mpl-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0

licensed under the Mozilla Public License, version 2.0""",
    "unlicense": """
This is free and unencumbered software released into the public domain""",
}

LEAST_MATCH = 3
MOST_GAP = 8
LEAST_SHARE = 0.8
#: Template words an automaton may have; it goes to every task.
MOST_WORDS = 1 << 18


def split_words(data: bytes) -> list[bytes]:
    return re.findall(WORD_BYTES, data.lower())


class Automaton:
    """A generalised suffix automaton of the templates and phrases.

    Each state stands for the word sequences that end at the same places of the templates;
    ``links`` lead to the longest suffix that ends at more. ``ends`` has the places
    (template, number of words up to there) of states that may hold a match of ``least_match`` words, ``closing`` the
    phrases that every sequence of the state, or the longer ones of it, ends with.
    """

    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str], least_match: int = LEAST_MATCH):
        self.phrases = [(label, split_words(text.encode())) for text, label in sorted(phrases.items())]
        self.templates = [(label, words) for label, text in sorted(templates.items())
                          for part in re.split(r"\n\s*\n", text) if (words := split_words(part.encode()))]
        sequences = [words for _, words in (*self.templates, *self.phrases)]
        if any(len(words) < 2 for words in sequences):
            raise ValueError("a phrase or a template has two words at least")
        if sum(map(len, sequences)) > MOST_WORDS:
            raise ValueError(f"the templates have more than {MOST_WORDS} words")
        self.ids = {word: k for k, word in enumerate(sorted({word for words in sequences for word in words}))}
        self.steps: list[dict[int, int]] = [{}]
        self.links, self.lengths = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(sequences):
            state = 0
            for place, word in enumerate(words):
                state = self._extend(state, self.ids[word])
                if number < len(self.templates):
                    self.ends[state].add((number, place + 1))
        order = sorted(range(1, len(self.steps)), key=self.lengths.__getitem__)
        for state in reversed(order):  # a suffix ends wherever the longer sequence does
            if self.lengths[self.links[state]] >= least_match:
                self.ends[self.links[state]] |= self.ends[state]
        own: dict[int, list[int]] = {}
        for number, (_, words) in enumerate(self.phrases):
            state = 0
            for word in words:
                state = self.steps[state][self.ids[word]]
            own.setdefault(state, []).append(number)
        self.closing: list[list[tuple[int, int]]] = [[] for _ in self.steps]  # (phrase, words matched at least)
        for state in order:
            self.closing[state] = [(p, 0) for p, _ in self.closing[self.links[state]]] + [
                (p, len(self.phrases[p][1])) for p in own.get(state, ())]

    def _copy(self, state: int, length: int) -> int:
        self.steps.append(dict(self.steps[state]))
        self.links.append(self.links[state])
        self.lengths.append(length)
        self.ends.append(set())
        return len(self.steps) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence so far and ``word``."""
        known = self.steps[last].get(word)
        if known is not None:
            if self.lengths[known] == self.lengths[last] + 1:
                return known
            return self._split(last, word, known)
        made = len(self.steps)
        self.steps.append({})
        self.lengths.append(self.lengths[last] + 1)
        self.links.append(0)
        self.ends.append(set())
        state = last
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = made
            state = self.links[state]
        if state >= 0:
            follower = self.steps[state][word]
            exact = self.lengths[follower] == self.lengths[state] + 1
            self.links[made] = follower if exact else self._split(state, word, follower)
        return made

    def _split(self, state: int, word: int, follower: int) -> int:
        """The shorter sequences of ``follower``, which end at more places, become a state."""
        copy = self._copy(follower, self.lengths[state] + 1)
        self.links[follower] = copy
        while state >= 0 and self.steps[state].get(word) == follower:
            self.steps[state][word] = copy
            state = self.links[state]
        return copy

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word, the state and the number of words of the longest
        sequence that ends there and occurs in a template."""
        state = matched = 0
        for word in words:
            step = self.ids.get(word, -1)
            while state and step not in self.steps[state]:
                state = self.links[state]
                matched = self.lengths[state]
            if step in self.steps[state]:
                state, matched = self.steps[state][step], matched + 1
            yield state, matched


def chain(anchors: list[tuple[int, int, int]], most_gap: int) -> list[tuple[int, int, int]]:
    """Disjoint chains (first word, end, covered) of one template's matches, best first.

    ``anchors`` are (end in the text, end in the template, words), by end in the text. A match may
    follow one that ends before it in the text, by at most ``most_gap`` words between them, and
    in the template; it covers what it adds to both.
    """
    best: list[tuple[int, int]] = []  # (covered, first word) of the best chain to each anchor
    low = 0
    for k, (end, place, words) in enumerate(anchors):
        covered, first = words, end - words
        longest = max((w for _, _, w in anchors[low:k + 1]), default=0)
        while low < k and anchors[low][0] < end - longest - most_gap:
            low += 1
        for i in range(low, k):
            other_end, other_place, _ = anchors[i]
            if other_end < end and other_place < place and end - words - other_end <= most_gap:
                gained = best[i][0] + min(words, end - other_end, place - other_place)
                if (gained, best[i][1]) > (covered, first):
                    covered, first = gained, best[i][1]
        best.append((covered, first))
    picked: list[tuple[int, int, int]] = []
    for covered, first, end in sorted(((c, f, anchors[k][0]) for k, (c, f) in enumerate(best)),
                                      key=lambda x: (-x[0], x[1], x[2])):
        if all(end <= a or first >= b for a, b, _ in picked):
            picked.append((first, end, covered))
    return picked


class Scanner:
    """Finds phrases and template spans in texts; made once for a task."""

    def __init__(self, automaton: Automaton, least_match: int, most_gap: int, least_share: float):
        self.automaton = automaton
        self.least_match, self.most_gap, self.least_share = least_match, most_gap, least_share
        self.hashes = WordHashes()
        inside = re.compile(WORD_BYTES)
        self.gap = np.array([not inside.match(bytes([b])) for b in range(256)])
        self.hashes.gap = self.gap
        words = sorted(automaton.ids, key=automaton.ids.__getitem__)
        own = np.array([self.hashes.of(word)[0] for word in words], np.uint64)
        self.order = np.argsort(own)
        self.known = own[self.order]
        count = len(words)
        self.pairs, self.phrase_pairs = np.zeros((2, count + 1, count + 1), bool)
        for target, sequences in ((self.pairs, (*automaton.templates, *automaton.phrases)),
                                  (self.phrase_pairs, automaton.phrases)):
            for _, sequence in sequences:
                ids = [automaton.ids[word] for word in sequence]
                target[ids[:-1], ids[1:]] = True

    def _runs(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(first word, end) of the runs in which a match of ``least_match`` words or a phrase may
        lie: each pair of neighbours stands in a template. A hash only proposes words."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        ids = np.where(self.known[at] == hashes, self.order[at], len(self.known))
        pair = self.pairs[ids[:-1], ids[1:]]
        edges = np.flatnonzero(np.diff(pair, prepend=False, append=False))
        first, end = edges[::2], edges[1::2] + 1
        phrase = np.append(0, np.cumsum(self.phrase_pairs[ids[:-1], ids[1:]]))
        wanted = (end - first >= self.least_match) | (phrase[end - 1] > phrase[first])
        return list(zip(first[wanted].tolist(), end[wanted].tolist()))

    def scan(self, data: bytes) -> dict:
        """One document's findings; words are numbered from 0."""
        automaton, data = self.automaton, data.lower()
        hashes = self.hashes.of(data) if data else np.empty(0, np.uint64)
        out = {"n_words": len(hashes), "n_phrases": 0, "first_word": None, "last_word": None, "phrase_labels": [],
               "spans": [], "share": 0.0}
        runs = self._runs(hashes) if len(hashes) > 1 else []
        if not runs:
            return out
        edges = np.flatnonzero(np.diff(self.gap[np.frombuffer(data, np.uint8)], prepend=True, append=True))
        starts, labels = [], set()
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for first, end in runs:
            words = [data[a:b] for a, b in zip(edges[2 * first:2 * end:2].tolist(), edges[2 * first + 1:2 * end:2].tolist())]
            state = matched = 0
            for place, (after, count) in enumerate((*automaton.stream(words), (0, 0)), first):
                # a longest match ends where the next word does not prolong it
                if matched >= self.least_match and count != matched + 1:
                    for template, at in automaton.ends[state]:
                        anchors.setdefault(template, []).append((place, at, matched))
                for phrase, least in automaton.closing[after]:
                    if count >= least:
                        label, sequence = automaton.phrases[phrase]
                        starts.append(place + 1 - len(sequence))
                        labels.add(label)
                state, matched = after, count
        for template, found in anchors.items():
            label, sequence = automaton.templates[template]
            for first, end, covered in chain(sorted(found), self.most_gap):
                share = covered / len(sequence)
                out["share"] = max(out["share"], share)
                if share >= self.least_share:
                    out["spans"].append({"label": label, "first_word": first, "last_word": end - 1, "share": share})
        out["spans"].sort(key=lambda span: (span["first_word"], span["label"], span["last_word"]))
        if starts:
            out |= {"n_phrases": len(starts), "first_word": min(starts), "last_word": max(starts),
                    "phrase_labels": sorted(labels), "share": 1.0}
        return out


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
_KINDS = {"n_words": pa.int64(), "n_phrases": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
          "phrase_labels": pa.list_(pa.string()), "spans": pa.list_(_SPAN), "share": pa.float64()}


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
    least_match: int = LEAST_MATCH, most_gap: int = MOST_GAP, least_share: float = LEAST_SHARE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_words, n_phrases, first_word, last_word, phrase_labels, spans, share).

    A text streams through a suffix automaton of all templates, whose state after each word is the
    longest sequence that ends there and stands in a template. Places of the phrases are read off the states;
    longest matches of ``least_match`` words are chained per template, in text and template order
    with at most ``most_gap`` words between, and a chain that covers ``least_share`` of a template is a span.
    Neighbouring words that no template has next to each other part the stream, so the automaton walks
    only the runs between them. ``share`` is the largest share covered; a phrase is covered whole.

    Map-only. Null texts are empty and have no words; one row for each row, repeated ids included.
    The automaton is bounded by ``MOST_WORDS`` template words, beyond which ValueError is raised.
    """
    automaton = Automaton(templates, phrases, least_match)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automaton, least_match, most_gap, least_share)
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array([row[name] for row in found], k) for name, k in _KINDS.items()]],
                names=["id", *_KINDS])

    read = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return read.mapInArrow(
        run, f"id {kind}, n_words long, n_phrases long, first_word long, last_word long, phrase_labels array<string>, "
        "spans array<struct<label: string, first_word: long, last_word: long, share: double>>, share double",
    ).withColumnRenamed("id", id_col)


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """Phrases and licence spans of all documents; spans as label:first-last, by their start."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_distinct(F.concat("phrase_labels", F.transform("spans", lambda s: s["label"]))))
    return found.select(
        "doc_id", "n_words", F.col("n_phrases").alias("n_base"), "first_word", "last_word",
        F.array_join("phrase_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.col("share").alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat(
            s["label"], F.lit(":"), s["first_word"].cast("string"), F.lit("-"), s["last_word"].cast("string"))),
            ",").alias("spans"))
