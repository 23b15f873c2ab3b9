"""Licence scans: notice phrases and identifier tags by an Aho-Corasick automaton, expressions by a shunting yard.

A text is reduced to its words (A-Z lower-cased; everything but digits, letters a-z and characters beyond
ASCII separates) joined by single spaces, and one pass of the automaton finds every phrase at word bounds.
Where an identifier tag occurs, the licence expression behind it is parsed with precedence
with > and > or and evaluated: ``or`` lets the reader choose, so the freest side counts; ``and`` binds to
both, so the strictest side counts; ``with`` adds an exception, which loosens a copyleft licence halfway.

Defined cases: a null or empty text has 0 words, no labels (empty strings) and score 0; a malformed
expression yields the identifiers up to the fault; repeated rows are scanned row by row; further columns are
ignored; an empty table gives an empty result. Texts are scanned whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

#: fixed values: base phrases and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: notice phrases that the method adds
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
#: how free the user of a text is under a label; labels not named here count as UNKNOWN
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "apache": 0.9, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1,
    "proprietary": 0.0,
}
UNKNOWN = 0.5
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of an identifier: the longest known label it begins with, else the identifier itself."""
    name = identifier.rstrip("+")
    known = [label for label in FREEDOM if name == label or name.startswith(label + "-")]
    return max(known, key=len) if known else name


def postfix(expression: str) -> list[str]:
    """An expression in postfix order by the shunting-yard method; stops at the first fault."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in re.findall(r"[()]|[a-z0-9][a-z0-9.+\-]*|\S", expression.lower()):
        if token == "(" and operand:
            held.append(token)
        elif token == ")" and not operand and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in PRECEDENCE and not operand:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif operand and token[0].isalnum() and token not in PRECEDENCE:
            out.append(token)
            operand = False
        else:
            break
    if operand and held and held[-1] != "(":
        held.pop()  # an operator without its right side
    return out + [t for t in reversed(held) if t != "("]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """(labels, freedom) of a licence expression; (empty, None) where nothing can be read."""
    labels: set[str] = set()
    held: list[tuple[float, str]] = []
    for token in postfix(expression):
        if token not in PRECEDENCE:
            held.append((FREEDOM.get(family(token), UNKNOWN), token))
            continue
        if len(held) < 2:
            break
        (right, exception), (left, name) = held.pop(), held.pop()
        if token == "with":
            labels.add(f"{family(name)}-with-{exception}")
            held.append(((1 + left) / 2 if left < 0.9 else left, ""))
            continue
        labels |= {family(n) for n in (name, exception) if n}
        held.append((max(left, right) if token == "or" else min(left, right), ""))
    labels |= {family(name) for _, name in held if name}
    return labels, held[-1][0] if held else None


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in [*BASE, *NOTICES, TAG]:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = text.translate(WORD).split()
        line = " " + b" ".join(words).decode("latin-1") + " " if words else ""
        places, base, more, tagged = [], set(), set(), False
        for end, phrase in self.automaton.iter(line):
            if phrase in BASE:
                places.append(end - len(phrase) - 1)
                base.add(BASE[phrase])
            elif phrase == TAG:
                tagged = True
            else:
                more.add(NOTICES[phrase])
        freedom = [FREEDOM[x] for x in base | more]
        # the tag's words are frequent without a tag; the expression is read where the tag itself stands
        if tagged:
            for expression in TAG_TEXT.findall(text.decode("utf-8", "replace").lower()):
                labels, free = evaluate(expression)
                more |= labels
                freedom += [] if free is None else [free]
        first = line.count(" ", 0, min(places)) if places else None
        last = line.count(" ", 0, max(places)) if places else None
        both = base | more
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(both)), min(freedom, default=0.0)


SCHEMA = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence labels of every text; ``score`` is the freedom of its strictest expression or notice, 0 where it has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in small_batches(batches):
            rows = [(i, *scanner.scan(t)) for i, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    read = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(scan, SCHEMA).withColumnRenamed("id", id)
