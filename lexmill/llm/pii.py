"""Operator 3: personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, URL
schemes and identifier cues) in one pass over a text; deterministic local
parsers grow each anchor to the full span and validate it.  The four base kinds
(email, ip, card, phone) follow fixed grammars, leftmost and non-overlapping
within a kind; a span that fails its validation is dropped without retry.  Two
kinds are added: ``account`` (value after a cue such as "token =" or "IBAN")
and ``userinfo`` (credentials inside a URL).

Defined results: null and empty texts have no spans; repeated rows give
repeated results; any columns beside id and text are ignored (``find_spans``) or
kept (``mask``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import returning, slim_docs

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "userinfo")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _ALNUM | frozenset("_-+/.")
# Cues after which an identifier is looked for.
CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "iban", "ssn", "passport", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("account", len(form)))
    for scheme in SCHEMES:
        a.add_word(scheme, ("userinfo", len(scheme)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    s = at
    while s > floor and t[s - 1] in _LOCAL:
        s -= 1
    if s == at:
        return None
    n, e = len(t), at + 1
    while e < n and t[e] in _LABEL:
        e += 1
    if e == at + 1:
        return None
    end = None
    while e + 1 < n and t[e] == "." and t[e + 1] in _LABEL:
        e += 2
        while e < n and t[e] in _LABEL:
            e += 1
        end = e
    return (s, end) if end else None


def _digit_groups(t: str, s: int) -> tuple[list[tuple[int, int]], int]:
    """Digit runs joined by single dots, from the digit at ``s``; and where they end."""
    n, groups = len(t), []
    while True:
        e = s
        while e < n and t[e] in _DIGITS:
            e += 1
        groups.append((s, e))
        if e + 1 < n and t[e] == "." and t[e + 1] in _DIGITS:
            s = e + 1
        else:
            return groups, e


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _card(t: str, s: int) -> tuple[int, bool]:
    """End of the chain of digits with single blanks or hyphens between; and its validity."""
    n, e = len(t), s + 1
    while e < n:
        if t[e] in _DIGITS:
            e += 1
        elif t[e] in " -" and e + 1 < n and t[e + 1] in _DIGITS:
            e += 2
        else:
            break
    if e - s > 37:
        return e, False
    digits = t[s:e].replace(" ", "").replace("-", "")
    return e, 13 <= len(digits) <= 19 and _luhn(digits)


def _phone(t: str, plus: int) -> tuple[int, bool] | None:
    n = len(t)
    if plus + 1 >= n or t[plus + 1] not in _DIGITS:
        return None
    e = plus + 2
    last = None
    while e < n and t[e] in _PHONE:
        if e >= plus + 3 and t[e] in _DIGITS:
            last = e
        e += 1
    if last is None:
        return None
    count = sum(c in _DIGITS for c in t[plus : last + 1])
    return last + 1, 9 <= count <= 15


def _account(t: str, cue_end: int) -> tuple[int, int] | None:
    """The value after a cue: up to 20 letters or blanks and one of = : # between, at
    least 6 characters with a digit."""
    n, i = len(t), cue_end
    while i < n and i < cue_end + 20 and (t[i] in " _" or t[i].isalpha()):
        i += 1
    if i >= n or t[i] not in "=:#":
        return None
    i += 1
    while i < n and t[i] in " \"'":
        i += 1
    e = i
    while e < n and t[e] in _VALUE:
        e += 1
    while e > i and t[e - 1] in ".-/":
        e -= 1
    return (i, e) if e - i >= 6 and any(c in _DIGITS for c in t[i:e]) else None


def _userinfo(t: str, start: int) -> tuple[int, int] | None:
    """``user:password`` between a scheme and an at-sign."""
    e, n = start, len(t)
    while e < n and not t[e].isspace() and t[e] not in "/@\"'<>":
        e += 1
    return (start, e) if e < n and t[e] == "@" and e > start else None


class Scanner:
    def __init__(self) -> None:
        self.automaton = _automaton()

    def spans(self, t: str) -> list[tuple[str, int, int]]:
        """All spans by kind as listed, then by start (code points, end exclusive)."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        email_floor = phone_floor = ip_floor = card_floor = account_floor = 0
        for last, (kind, size) in self.automaton.iter(t):
            at = last - size + 1
            if kind == "digit":
                if at >= ip_floor:
                    groups, ip_floor = _digit_groups(t, at)
                    for k in range(0, len(groups) - 3, 4):
                        four = groups[k : k + 4]
                        if all(_octet(t[a:b]) for a, b in four):
                            found["ip"].append((four[0][0], four[3][1]))
                if at >= card_floor:
                    card_floor, good = _card(t, at)
                    if good:
                        found["card"].append((at, card_floor))
            elif kind == "email":
                if at >= email_floor and (m := _email(t, at, email_floor)):
                    found["email"].append(m)
                    email_floor = m[1]
            elif kind == "phone":
                if at >= phone_floor and (p := _phone(t, at)):
                    phone_floor = p[0]
                    if p[1]:
                        found["phone"].append((at, p[0]))
            elif kind == "account":
                if last + 1 > account_floor and (m := _account(t, last + 1)) and m[0] >= account_floor:
                    found["account"].append(m)
                    account_floor = m[1]
            elif m := _userinfo(t, last + 1):
                found["userinfo"].append(m)
        return [(k, *x) for k in KINDS for x in sorted(set(found[k]))]

    def mask(self, t: str) -> str:
        """Each span replaced by its kind in brackets; overlapping spans become one."""
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in self.spans(t)):
            if s < at:
                if e > at:
                    at = e
                continue
            out += (t[at:s], f"[{k.upper()}]")
            at = e
        return "".join(out) + t[at:] if out else t


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans. No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b["text"].to_pylist():
                spans = scanner.spans(text)
                base = [x for x in spans if x[0] in BASE_KINDS]
                for c, k in zip(cols, BASE_KINDS, strict=False):
                    c.append(sum(x[0] == k for x in base))
                cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[5].append(_joined(spans))
                cols[6].append(len(spans) - len(base))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return slim_docs(docs, id_col, text_col).mapInArrow(scan, _SPANS)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` masked; other columns are untouched, nulls stay null."""

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for whole in batches:
            i = whole.schema.get_field_index(text_col)
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                new = [None if t is None else scanner.mask(t) for t in b.column(i).to_pylist()]
                yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(returning(masked), docs.schema)
