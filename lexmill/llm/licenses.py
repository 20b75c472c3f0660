"""Operator 6: licence scans by conditional compression.

A text is read as words, so comment marks and line breaks do not count.  Around
every cue each template (short notices and whole licence texts) is aligned with
the words by the bit-parallel form of the edit distance with free ends: all of
the template against any run of words, at most ``MOST_DIFFERENCES`` of the
template's words apart.  Templates are left out only where too few of their words
occur, which no such alignment survives.  A run so found is compressed with
zstandard alone and with the template as a raw-content dictionary; it counts
where the relative size reduction is ``LEAST_REDUCTION`` or more.  Tags
``SPDX-License-Identifier:`` name their licences themselves.

Defined results: null and empty texts have no licences; an occurrence is in reach
of a cue; a sentence that is as a whole within the bound of a notice counts, a
part of a sentence must keep the notice's naming words too; of overlapping runs of
one template of ``LONG`` words or more the one of fewest differences counts, then the
later; of occurrences that overlap the one of most words less twice the differences
wins, then fewer differences, then the larger reduction, then the first by name; a tag gives one row for each
licence of its expression; every occurrence in a text is reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import slim_docs

LEAST_REDUCTION, MOST_DIFFERENCES, LONG = 0.2, 0.25, 60

# Short notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0-only": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words a notice of a few words must keep where it is only a part of its sentence: without them it names another licence.
NAMING = {
    "Apache-2.0": "apache 2",
    "CC-BY-4.0": "cc by 4",
    "CC-BY-NC-4.0": "cc by nc 4",
    "CC-BY-SA-4.0": "cc by sa 4",
    "GPL-2.0-only": "gnu general 2",
    "GPL-3.0-only": "gnu general 3",
    "LGPL-3.0-only": "lesser general 3",
    "MIT": "mit",
    "MPL-2.0": "mozilla 2",
    "Unlicense": "unencumbered",
}
CUES = ("licen", "permission", "public domain", "redistribut", "copyright", "spdx")
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s|$)|(?=\n)|$)")
_WORD = re.compile(r"\w+")
_CUE_WORD = re.compile("licen|permission|redistribut|copyright|spdx")
_FOLD = re.compile(r"\s*\n[\s#*/;%!<>|-]*")
_MARKS = ("dnl", "rem")  # comment marks that are words
_ID = r"\(*[A-Za-z0-9]+(?:[.:_-][A-Za-z0-9]+)*\+?\)*"
_TAG = re.compile(rf"(?i:SPDX-License-Identifier):[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+{_ID})*)")


def full_texts() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of ``license_texts``: whole licences, and the longer notices of the GNU licences,
    whose whole texts do not say "only" or "or later"."""
    return [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences that hold a cue."""
    low = text.lower()
    if len(low) != len(text) or not any(c in low for c in CUES):
        if not any(c in low for c in CUES):
            return
        low = None
    for m in _SENTENCE.finditer(text):
        part = m[0].lower() if low is None else low[m.start() : m.end()]
        if any(c in part for c in CUES):
            s, e = m.span()
            while s < e and text[s].isspace():
                s += 1
            yield s, e


def differences(a: list[str], b: list[str], bound: int) -> int:
    """Word-level edit distance, or bound + 1 if it is larger."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > bound:
            return bound + 1
    return min(row[-1], bound + 1)


class Template:
    def __init__(self, name: str, text: str, naming: str = "") -> None:
        self.name, self.text, self.words = name, text, _WORD.findall(text.lower())
        self.size, self.bound = len(self.words), int(MOST_DIFFERENCES * len(self.words))
        self.count, self.naming = Counter(self.words), set(naming.split())
        self.forward, self.backward = _bits(self.words), _bits(self.words[::-1])
        self.packer = _packer(text)

    def may_occur(self, found: Counter) -> bool:
        """False only if no run of the counted words is within the bound."""
        need = self.size - self.bound
        return found.total() >= need and sum(min(n, found[w]) for w, n in self.count.items() if w in found) >= need


def _bits(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _packer(text: str) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(_FOLD.sub(" ", text.lower()).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False)


def distances(bits: dict[str, int], size: int, words: list[str], free: bool) -> Iterator[int]:
    """After each word, the edit distance between the template and the words so far, or, with a free start, the
    best of their ends (Myers 1999; one template word a bit)."""
    mask, top = (1 << size) - 1, 1 << size - 1
    up, down, d = mask, 0, size
    for w in words:
        eq = bits.get(w, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(h | up)) & mask, up & h
        if more & top:
            d += 1
        elif less & top:
            d -= 1
        more = more << 1 | (not free)
        less <<= 1
        up, down = (less | ~(v | more)) & mask, more & v & mask
        yield d


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]]) -> None:
        """Templates are (name, text, naming words)."""
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.templates = [Template(*t) for t in sorted(templates)]

    def reduction(self, block: str, packer: zstandard.ZstdCompressor) -> float:
        raw = _FOLD.sub(" ", block.lower()).encode("utf-8", "surrogatepass")
        return 1 - len(packer.compress(raw)) / len(self.plain.compress(raw))

    def scan(self, text: str) -> list[tuple[str, int, int, float, int]]:
        low = text.lower()
        if not any(c in low for c in CUES) and "domain" not in low:
            return []
        words, starts, ends = [], [], []
        for m in _WORD.finditer(text):
            w = m[0].lower()
            if w in _MARKS and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t@"):
                continue
            words.append(w)
            starts.append(m.start())
            ends.append(m.end())
        cues = [i for i, w in enumerate(words) if _CUE_WORD.search(w) or w == "domain" and i and words[i - 1] == "public"]
        if not cues:
            return []
        whole = {}  # sentences with a cue, as spans of words
        for s, e in sentences(text):
            first, last = bisect_left(starts, s), bisect_right(ends, e) - 1
            if first <= last:
                whole[first, last] = (s, e)
        found = []
        for start, end, name, packer in self._tags(text):
            found.append((name, start, end, self.reduction(text[start:end], packer), 0))
        ranked = []
        for t, first, last, n in self._candidates(words, cues, whole):
            s, e = self._span(text, whole, first, last, starts, ends)
            gain = self.reduction(text[s:e], t.packer)
            if gain >= LEAST_REDUCTION:
                ranked.append((2 * n - (last + 1 - first), n, -gain, t.name, first, last, s, e))
        taken: list[tuple[int, int]] = []
        for _, n, gain, name, first, last, s, e in sorted(ranked):
            if all(last < f or first > g for f, g in taken):
                taken.append((first, last))
                found.append((name, s, e, -gain, n))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))

    @staticmethod
    def _tags(text: str) -> Iterator[tuple[int, int, str, zstandard.ZstdCompressor]]:
        for m in _TAG.finditer(text):
            before = ""
            for part in m[1].split():
                if part.upper() not in ("AND", "OR", "WITH") and before != "WITH":
                    name = part.strip("()")
                    yield m.start(), m.end(), name, _packer(f"SPDX-License-Identifier: {name}")
                before = part.upper()

    @staticmethod
    def _span(text: str, whole: dict, first: int, last: int, starts: list[int], ends: list[int]) -> tuple[int, int]:
        if (first, last) in whole:
            return whole[first, last]
        e = ends[last]
        return starts[first], e + (text[e : e + 1] in (".", "!", "?") and not text[e + 1 : e + 2].strip())

    def _candidates(self, words: list[str], cues: list[int], whole: dict) -> Iterator[tuple[Template, int, int, int]]:
        """(template, first word, last word, differences) of the runs within the bound."""
        every = Counter(words)
        for t in self.templates:
            if not t.size or not t.may_occur(every):
                continue
            reach, i, close = t.size + t.bound, 0, []
            while i < len(cues):
                lo, hi = max(cues[i] - reach, 0), cues[i] + reach
                while i < len(cues) and cues[i] - reach <= hi:
                    hi = cues[i] + reach
                    i += 1
                part = words[lo : hi + 1]
                if len(part) == len(words) or t.may_occur(Counter(part)):
                    close += [(n, -j) for j, n in enumerate(distances(t.forward, t.size, part, True), lo) if n <= t.bound]
            best: list[int] = []
            for n, j in sorted(close):
                if t.size >= LONG and any(abs(k + j) < t.size - t.bound for k in best):
                    continue
                best.append(-j)
                lengths = [k for k, d in enumerate(distances(t.backward, t.size, words[max(1 - j - t.size - n, 0) : 1 - j][::-1], False), 1) if d == n]
                first = 1 - j - max(lengths)
                if (first, -j) in whole or t.naming <= set(words[first : 1 - j]):
                    yield t, first, -j, n
            for first, last in whole:
                if abs(last + 1 - first - t.size) <= t.bound:
                    *_, n = distances(t.forward, t.size, words[first : last + 1], False)
                    if n <= t.bound:
                        yield t, first, last, n


_FOUND = "doc_id long, found array<struct<license:string,start:long,end:long,reduction:double,differences:int>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, found) for every row. No shuffle."""
    if templates is None:
        known = [(k, v, NAMING.get(k, "")) for k, v in TEMPLATES.items()] + [(k, v, "") for k, v in full_texts()]
    else:
        known = [(k, v, "") for k, v in templates.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("differences", pa.int32())]))
        for b in batches:
            rows = [[dict(zip(("license", "start", "end", "reduction", "differences"), x, strict=True)) for x in scanner.scan(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "found"])

    return slim_docs(docs).mapInArrow(run, _FOUND)


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_licenses, licenses, spans): names sorted and distinct; spans as name:start:end:differences."""
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), x["differences"].cast("string"))), ",").alias("spans"),
    )
