"""Short licence notices in texts, with errors.

A notice of n characters may have up to k errors; cut into k + 1 pieces, at least one piece stands unharmed. One
automaton finds all pieces in a text, each hit names a window, and there the regex library's bounded-error
matching says whether the notice is met, with how many edits, and where.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import slices, whole

# Phrases and labels of the base search: fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices looked for with errors: common wordings of the licences' own texts.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# One error is allowed for so many characters.
PER_ERROR = 10
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def errors(notice: str) -> int:
    return len(notice) // PER_ERROR


class Search:
    """The seeds' automaton and the notices' patterns."""

    def __init__(self, notices: dict[str, str]):
        self.notices = dict(notices)
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, int]]] = {}
        for notice in notices:
            k = errors(notice)
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(notice[a:b], []).append((notice, a))
        for seed, places in found.items():
            self.seeds.add_word(seed, (len(seed), places))
        if found:
            self.seeds.make_automaton()
        self.patterns = {n: regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={errors(n)}}}") for n in notices}

    def spans(self, line: str) -> list[tuple[int, int, str, int]]:
        """(start, end, notice, edits) of matches of each notice that don't overlap, the better ones first.

        Every seed's window is searched alone. A match that overlaps a better one gives way to what its window
        still holds beside that, so each stretch within the allowed errors is met by a span no worse.
        """
        if not self.notices:
            return []
        windows: dict[str, set[tuple[int, int]]] = {}
        for end, (size, places) in self.seeds.iter(line):
            for notice, at in places:
                k, start = errors(notice), end + 1 - size - at
                windows.setdefault(notice, set()).add((max(0, start - k), min(len(line), start + len(notice) + k)))
        found = []
        for notice, own in windows.items():
            open_: list[tuple[int, int, int, int, int]] = []
            kept: list[tuple[int, int]] = []

            def look(low: int, high: int, notice=notice, open_=open_) -> None:
                m = self.patterns[notice].search(line, low, high)
                if m:
                    heapq.heappush(open_, (sum(m.fuzzy_counts), *m.span(), low, high))

            for low, high in own:
                look(low, high)
            while open_:
                edits, start, end, low, high = heapq.heappop(open_)
                i = bisect_left(kept, (start, end))
                near = next((s for s in kept[max(i - 1, 0) : i + 1] if s[0] < end and start < s[1]), None)
                if near is None:
                    kept.insert(i, (start, end))
                    found.append((start, end, notice, edits))
                elif near != (start, end):
                    look(low, max(low, near[0]))
                    look(min(high, near[1]), high)
        return sorted(found)


def _places(line: str, phrases: list[str]) -> list[tuple[int, str]]:
    """(word index, phrase) of every place where a phrase's words stand one after the other."""
    found, padded = [], f" {line} "
    for phrase in phrases:
        before = last = 0
        at = padded.find(f" {phrase} ")
        while at >= 0:
            before, last = before + padded.count(" ", last, at), at
            found.append((before, phrase))
            at = padded.find(f" {phrase} ", at + 1)
    return found


def scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Licences named in every row of ``docs`` (doc_id, text).

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): places of the ``base`` phrases
    word by word; labels of these and of the ``notices`` met with errors; the best likeness (1 less edits per
    character; 1 for a phrase; 0 without either); start:end:notice:edits in the text's words joined by spaces.
    Null texts are empty; null and repeated ids stay rows; no rows give none; other columns are not read.
    """
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.translate(_LOW) if not text.isascii() else text.lower())
                line = " ".join(words)
                places = _places(line, list(base))
                near = search.spans(line)
                labels = {base[p] for _, p in places}
                starts = [i for i, _ in places]
                likeness = [1 - e / len(n) for _, _, n, e in near] + [1.0] * bool(places) + [0.0]
                out.append(
                    (
                        len(words),
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(labels)),
                        ",".join(sorted(labels | {notices[n] for _, _, n, _ in near})),
                        max(likeness),
                        ",".join(f"{a}:{b}:{n}:{e}" for a, b, n, e in near),
                    )
                )
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long"
    return rows.mapInArrow(run, schema + ", base_labels string, labels string, score double, spans string")
