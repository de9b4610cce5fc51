"""License scans: exact phrases, and notices with a bounded number of edits.

A text becomes its terms (letters and digits, only A-Z lower-cased), joined by
single blanks. A notice may differ by ``edits`` insertions, deletions or
substitutions of characters. It is cut into ``edits + 1`` pieces, one of which every
such match leaves whole; all pieces of all notices are searched at once by an
Aho-Corasick automaton. Where a piece stands, its offset in the notice bounds
the stretch that can hold a match, and the ``regex`` library matches the notice
there with the bounded errors, taking the best fit. A match counts if it holds the words that
tell the notice from others (``needs``) without an edit. Of overlapping matches of a
notice the one with the fewest edits stays, then the first.

``scan`` returns each place with its label, words, character span in the
original text and edits. Texts are scanned where they are read: nothing is shuffled, and what a
task holds is one Arrow batch.

Null text is empty: no words, no places. Very long texts are scanned whole. Rows are
scanned one by one, so repeated rows and null ids stay; an empty table gives an
empty one; columns other than ``keep`` and the text are left out, and names in ``keep``
that clash with the result's are an error of the caller's.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.terms import blanked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    """``text`` in terms; ``needs``: words that a match must hold as they are."""

    label: str
    text: str
    needs: tuple[str, ...] = ()

    @property
    def edits(self) -> int:
        return max(1, len(self.text) // 12)


# Phrases whose words must stand one after the other.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = (
    Notice("mit", "released under the mit license", ("mit",)),
    Notice("mit", "licensed under the mit license", ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("apache-2", "licensed under the apache license version 2 0", ("2",)),
    Notice("gpl-2", "gnu general public license version 2", ("general", "2")),
    Notice("gpl-3", "gnu general public license version 3", ("general", "3")),
    Notice("lgpl", "gnu lesser general public license", ("general",)),
    Notice("agpl", "gnu affero general public license", ("general",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification"),
    Notice("mpl-2", "mozilla public license version 2 0", ("2",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc-by", "creative commons attribution 4 0 international", ("4",)),
    Notice("cc0", "cc0 1 0 universal public domain dedication"),
    Notice("all-rights-reserved", "all rights reserved"),
)
REMEMBERED = 100_000  # stretches whose match a task knows; beyond it starts anew
PLACE = ("array<struct<label string, base boolean, first_word long, last_word long, start long, end long, "
         "edits long, score double>>")


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] | None = None):
        self.notices = notices
        self.phrases = list((PHRASES if phrases is None else phrases).items())
        found: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            whole, parts = f" {n.text} ", n.edits + 1
            cuts = [len(whole) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(whole[a:b], []).append((i, a))
        for i, (phrase, _) in enumerate(self.phrases):
            found.setdefault(f" {phrase} ", []).append((-1 - i, 0))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        # the best fit within a stretch, blanks at both ends included so that words are whole
        self.patterns = [regex.compile(f"(?b)(?: {regex.escape(n.text, literal_spaces=True)} ){{e<={n.edits}}}")
                         for n in notices]
        self.known: dict = {}

    def verify(self, number: int, stretch: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match in ``stretch``."""
        key = (number, stretch)
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            m = self.patterns[number].search(stretch)
            self.known[key] = m and (*m.span(), sum(m.fuzzy_counts))
        return self.known[key]

    def places(self, words: list[str]) -> list[tuple]:
        """``(label, base, first word, last word, edits, score)``, sorted."""
        text = " " + " ".join(words) + " "
        seeds: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                seeds.setdefault(number, set()).add(end + 1 - size - offset)
        if not seeds:
            return []
        starts = [1, *itertools.accumulate((len(w) + 1 for w in words), initial=1)][1:-1]
        out = []
        for number, at in seeds.items():
            if number < 0:
                phrase, label = self.phrases[-1 - number]
                size = phrase.count(" ")
                for a in at:
                    first = bisect.bisect_left(starts, a + 1)
                    out.append((label, True, first, first + size, 0, 1.0))
                continue
            notice, size = self.notices[number], len(self.notices[number].text) + 2
            k, best = notice.edits, []
            for a in sorted(at):
                low = max(0, a - k)
                m = self.verify(number, text[low:a + size + 2 * k])
                if not m:
                    continue
                inside = text[low + m[0]:low + m[1]]
                lead = len(inside) - len(inside.lstrip(" "))
                first = bisect.bisect_right(starts, low + m[0] + lead) - 1
                last = bisect.bisect_right(starts, low + m[0] + len(inside.rstrip(" ")) - 1) - 1
                if set(notice.needs) <= set(words[first:last + 1]):
                    place = (notice.label, False, first, last, m[2], round(1 - m[2] / len(notice.text), 6))
                    if best and first <= best[-1][3]:
                        if m[2] < best[-1][4]:
                            best[-1] = place
                    else:
                        best.append(place)
            out += best
        return sorted(out)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = NOTICES,
         phrases: dict[str, str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``places`` of every row."""
    picked = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("n_words", T.LongType()),
                           T.StructField("places", T._parse_datatype_string(PLACE))])
    names = [f.name for f in schema["places"].dataType.elementType.fields]
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), *[(n, pa.int64()) for n in names[2:7]],
                               ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for batch in batches:
            counts, places = [], []
            for value in batch.column("__text"):
                whole = value.as_py() or ""
                words = blanked(whole).decode("utf-8", "surrogatepass").split(" ")
                words = [w for w in words if w]
                counts.append(len(words))
                places.append(_spans(whole, scanner.places(words), names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(places, kind)],
                                             [*batch.schema.names[:-1], "n_words", "places"])

    return picked.mapInArrow(run, schema)


def _spans(text: str, places: list[tuple], names: list[str]) -> list[dict]:
    """``places`` with the characters of ``text`` that their words take."""
    if not places:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [dict(zip(names, (p[0], p[1], p[2], p[3], at[p[2]][0], at[p[3]][1], p[4], p[5]))) for p in places]


def digest(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row of figures for each row of ``scan``."""
    base = F.filter("places", lambda p: p["base"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    first = F.transform(base, lambda p: p["first_word"])
    return scanned.select(
        *keep, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))

