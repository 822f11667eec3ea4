"""Licence scans by ordered signature rules.

Each rule has a priority, a licence, keywords and a pattern. One pass of an automaton over the text in lower case, with
each run of white space as one blank, finds the keywords; only rules of which a keyword is there run their pattern, over
the text as it is. Signs that lead the lines of a comment count as white space. Detections are then taken by priority (the longer, then the earlier one, then the rule that comes
first, of equal ones); one whose interval lies within one that is taken already is suppressed.

The result has a row for each detection that stays: (doc_id, license, rule, priority, start, length). start and length
count characters. An SPDX tag gives the identifier that it names.

Cases: null and empty texts have no rows, nor have texts without a detection. Equal texts and repeated rows have equal
rows each; a null id stays null. Equal intervals leave one row. Texts of any length are taken whole. An empty table
gives an empty one; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import map_texts
from gridloom.llm.license_rules import RULES

Rule = tuple[int, str, tuple[str, ...], re.Pattern]


@cache
def rules(text: str = RULES) -> tuple[Rule, ...]:
    out = []
    for line in text.strip().splitlines():
        priority, name, keyword, pattern = line.split("|", 3)
        flexible = re.sub(r" \?", r"\\s*", pattern)
        flexible = flexible.replace(" ", r"\s+")
        flexible = re.sub(r"\[([^\]]*)\\s\+([^\]]*)\]", r"[\1\\s\2]", flexible)
        flexible = re.sub(r"(\[[^^\]][^\]]*\\s[^\]]*\]|\[\\s[^\]]*\])(?![+*{])", r"(?:\\s+|\1)", flexible)  # a blank may be a line's end and a comment's sign
        out.append((int(priority), name, tuple(keyword.split(";")), re.compile(flexible, re.IGNORECASE)))
    return tuple(out)


def resolve(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """(priority, start, end, rule, licence) rows that no row before them in the order of priority contains, by start.

    What a suppressed row contains is contained in the row that suppresses it, too. So it is enough to know, of the rows
    so far, the farthest end from each start on: a tree of greatest ends over the starts answers in logarithmic time.
    """
    rows = sorted(set(found), key=lambda r: (-r[0], r[1] - r[2], r[1], r[3]))
    place = {s: k + 1 for k, s in enumerate(sorted({r[1] for r in rows}))}
    reach = [-1] * (len(place) + 1)
    taken = []
    for row in rows:
        k = at = place[row[1]]
        while at and reach[at] < row[2]:
            at -= at & -at
        if at:
            continue
        taken.append(row)
        while k < len(reach):
            reach[k] = max(reach[k], row[2])
            k += k & -k
    return sorted(taken, key=lambda r: (r[1], r[2], r[3]))


_LEADER = re.compile(r"(?<=\n)[ \t]*(?:/\*+|\*+(?!/)|//+!?|#+!?|;+|--+|%+|>+|dnl\b|rem\b)", re.IGNORECASE)


def bare(text: str) -> str:
    """The text with what leads a comment's line as blanks, so many; places stay."""
    return _LEADER.sub(lambda m: " " * len(m.group()), text) if "\n" in text else text


def fold(text: str) -> str:
    """The text as keywords are looked up in it: letters that patterns take for each other are one, white space is a blank."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")  # the letters that lower() doesn't take to the ASCII letter
    return " ".join(text.lower().split())


class Scanner:
    def __init__(self, table: tuple[Rule, ...] | None = None):
        import ahocorasick

        self.rules = rules() if table is None else table
        by: dict[str, list[int]] = {}
        for k, (_, _, keywords, _) in enumerate(self.rules):
            for keyword in keywords:
                by.setdefault(keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for keyword, ks in by.items():
            self.automaton.add_word(keyword, tuple(ks))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[int, int, int, int, str]]:
        if not text:
            return []
        text = bare(text)
        gate = {ks for _, ks in self.automaton.iter(fold(text))}
        return self.matches(text, {k for ks in gate for k in ks})

    def matches(self, text: str, ks: Iterable[int]) -> list[tuple[int, int, int, int, str]]:
        """The detections of the rules ``ks`` that stay."""
        found = []
        for k in sorted(ks):
            priority, name, _, pattern = self.rules[k]
            for m in pattern.finditer(text):
                found.append((priority, m.start(), m.end(), k, m.group("id").rstrip(".") if name == "*SPDX" else re.split(r":\s*", m.group(), maxsplit=1)[1].strip("()") if name == "*SPDX-EXPRESSION" else name))
        return resolve(found)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, rule, priority, start, length) of all detections that stay."""

    def make():
        scanner = Scanner()

        def work(ids, texts):
            rows = [(i, name, k, p, a, b - a) for i, t in zip(ids, texts) for p, a, b, k, name in scanner.scan(t)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["doc_id", "license", "rule", "priority", "start", "length"])

        return work

    return map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], make, "doc_id long, license string, rule int, priority int, start int, length int")
