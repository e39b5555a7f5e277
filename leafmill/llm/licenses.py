"""Operator 4, licence scans: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

One Aho-Corasick pass over a text finds the keywords it holds; only rules with such a keyword run. Of all
detections, those that lie inside one of higher priority are suppressed, and so are, at equal priority, those inside a
longer one; of two over the same place the earlier rule's stays. Detections that merely overlap both stay.

The base counts the places of fixed phrases as consecutive words; the rules add labels and never remove base ones.

Defined results: a null text counts as empty: no words, no labels (an empty string), null word places, score 0. Repeated rows
get the same result each; an empty table gives an empty result; other columns play no part. The score is 1 - the product of
(1 - weight) over what was found: 0.5 for each base place, priority / 100 for each kept detection.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm._batches import map_rows
from leafmill.llm.license_rules import FAMILIES, NOTICES

#: Base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: A run of any length, taken whole: shorter ones are not retried, so time stays linear in the text.
_GAP = rb"(?:[\s*#/;>-]++)"
#: Such a run with a hyphen inside, and one of three or more.
_DASHED = rb"(?:[\s*#/;>-][\s*#/;>]*+-[\s*#/;>-]++)"
_LONG = rb"(?:[\s*#/;>-]{3,}+)"
#: One that may give marks back to a class after it that holds them too.
_GIVING = rb"(?:[\s*#/;>-]+)"
#: One that begins where the run does, so that a search tries it once.
_LEAD = rb"(?:(?<![\s*#/;>-])[\s*#/;>-]++)"
_IN = rb"[0-9a-z\x80-\xff]"
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    find: re.Pattern[bytes]


class Detection(NamedTuple):
    start: int
    end: int
    priority: int
    order: int
    label: str


def _compiled(pattern: str) -> re.Pattern[bytes]:
    out = pattern.encode("latin-1")
    for short, full in ((b"_", _GAP), (b"<lic>", rb"licen[cs]e"), (b"<dash>", _DASHED), (b"<long>", _LONG), (b"<lead>", _LEAD), (b"<giving>", _GIVING)):
        out = out.replace(short, full)
    return re.compile(out, re.S)


def _keyword(pattern: str) -> tuple[str, ...]:
    """A fixed run of letters in each alternative of a pattern, the longest: one of them occurs wherever it matches."""
    out = []
    for one in _alternatives(pattern):
        runs = re.findall(r"[a-z]{3,}", re.sub(r"<[a-z]+>|\((?:[^()]|\([^()]*\))*\)[?*]?|\[[^\]]*\][?*+]?(?:\{[^}]*\})?|\\.|.[?*]", "_", one))
        if not runs and "<lic>" in one:
            runs = ["licen"]
        out.append(max(runs or re.findall("[a-z]{2}", one), key=len))
    return tuple(out)


def _alternatives(pattern: str) -> list[str]:
    out, deep = [""], 0
    for c in pattern:
        deep += (c == "(") - (c == ")")
        if c == "|" and not deep:
            out.append("")
        else:
            out[-1] += c
    return out


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: identifier, name and address of each family (60, 50, 48), then the notices."""
    out = []
    for line in FAMILIES.strip().splitlines():
        name, title, address = (x.strip() for x in line.split(" | "))
        label = name
        out.append(Rule(label, 60, ("spdx-license-identifier",), _compiled(r"spdx-license-identifier:[ \t]*\(?(?:[a-z0-9.+-]+[ \t]+(?:or|and)[ \t]+)*" + "(?P<at>" + re.escape(name) + r")(?:-only|-or-later|\+)?(?![a-z0-9.-])")))
        out.append(Rule(label, 50, _keyword(title), _compiled(rf"(?<![a-z0-9])(?:{title})(?![a-z0-9])")))
        if address != "-":
            out.append(Rule(label, 48, _keyword(address), re.compile(address.encode("latin-1"), re.S)))
    label, priority = "", 0
    for line in NOTICES.strip().splitlines():
        if line.startswith("= "):
            _, label, priority = line.split()
        else:
            out.append(Rule(label, int(priority), _keyword(line), _compiled(line)))
    return tuple(out)


class Scanner:
    """The rules behind one automaton of their keywords."""

    def __init__(self) -> None:
        self.rules = rules()
        by: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                by.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, which in by.items():
            self.automaton.add_word(k, (k, tuple(which)))
        self.automaton.make_automaton()
        self.phrases = [(rb"(?<!%s)" % _IN + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(w.encode() for w in words) + rb"(?!%s)" % _IN, label, words[0]) for words, label in BASE.items()]
        self.phrases = [(re.compile(p), label, first.encode()) for p, label, first in self.phrases]

    def detections(self, low: bytes) -> list[Detection]:
        """All matches of rules whose keyword occurs."""
        due = set()
        for _, (_, which) in self.automaton.iter(low.decode("latin-1")):
            due.update(which)
        out = []
        for i in sorted(due):
            r = self.rules[i]
            at = "at" if "at" in r.find.groupindex else 0
            out += [Detection(*m.span(at), r.priority, i, r.label) for m in r.find.finditer(low)]
        return out

    def scan(self, text: bytes | None) -> dict:
        """n_words, places of base phrases, labels and kept detections of one text."""
        low = (text or b"").lower()
        places, base = [], set()
        for find, label, first in self.phrases:
            if first in low:
                found = [m.start() for m in find.finditer(low)]
                places += found
                if found:
                    base.add(label)
        inside = _WORD[np.frombuffer(low, np.uint8)]
        first_letter = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
        at = np.searchsorted(first_letter, sorted(places)).tolist()
        kept = settle(self.detections(low))
        miss = 0.5 ** len(places)
        for d in kept:
            miss *= 1 - d.priority / 100
        return {
            "n_words": len(first_letter),
            "n_base": len(places),
            "first_word": at[0] if at else None,
            "last_word": at[-1] if at else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {d.label for d in kept})),
            "score": 1 - miss,
            "detections": kept,
        }


def settle(found: list[Detection]) -> list[Detection]:
    """The detections that lie in none of higher priority, or of equal priority and longer or earlier; in order of place."""
    kept: list[Detection] = []
    cover: list[tuple[int, int]] = []  # (start, end) of kept ones with rising starts and ends: each covers the most to its right
    for priority in sorted({d.priority for d in found}, reverse=True):
        starts, reach = [c[0] for c in cover], [c[1] for c in cover]
        most, fresh = -1, []
        for d in sorted((d for d in found if d.priority == priority), key=lambda d: (d.start, -d.end, d.order)):
            k = bisect_right(starts, d.start) - 1
            if d.end > most and (k < 0 or reach[k] < d.end):
                fresh.append(d)
                most = d.end
        kept += fresh
        top, cover = -1, []
        for s, e in sorted(((d.start, d.end) for d in kept), key=lambda x: (x[0], -x[1])):
            if e > top:
                cover.append((s, e))
                top = e
    return sorted(kept, key=lambda d: (d.start, -d.end, d.order))


def scan_licenses(documents: DataFrame, with_spans: bool = True) -> DataFrame:
    """The scan of each row of ``documents``: doc_id, counts, labels, score and, with spans, the kept detections; one pass, no shuffle."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if with_spans:
        schema += ", detections array<struct<start: int, end: int, priority: int, label: string>>"

    def make():
        scanner = Scanner()

        def work(part: pa.RecordBatch) -> dict:
            got = [scanner.scan(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            out = {"doc_id": part.column("doc_id")} | {n: [g[n] for g in got] for n in names}
            if with_spans:
                out["detections"] = [[{"start": d.start, "end": d.end, "priority": d.priority, "label": d.label} for d in g["detections"]] for g in got]
            return out

        return work

    return map_rows(documents.select("doc_id", "text"), "text", schema, make)
