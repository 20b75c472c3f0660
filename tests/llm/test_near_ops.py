"""Operators 5 and 9 against brute-force versions."""

import random
import re

import numpy as np
import pytest

from lexmill.llm import jaccard, suffix_dedup
from lexmill.llm.decontaminate import words
from tests.llm.fixtures import by_id, docs

SCHEMA = "doc_id long, text string, sub string, key long, places int"


def copies(seed: int, n: int, letters: str = "abcdefgh") -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    out: list[str] = []
    for i in range(n):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        if i % 4 == 1:
            ws = out[-1].split()
            for _ in range(rng.randrange(0, 6)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        if i % 5 == 2:
            at = rng.randrange(len(ws))
            ws[at:at] = passage.split()
        out.append(" ".join(ws))
        if i % 7 == 3:
            out.append(out[rng.randrange(len(out))])
    return out


def brute_links(texts: dict[int, str]) -> tuple[dict[int, int], dict[int, int]]:
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links, label = dict.fromkeys(sets, 0), {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return links, {k: find(k) for k in keys}


@pytest.mark.parametrize(("limit", "block"), [(256, 1024), (3, 4)])
def test_op9_against_brute_force(spark, limit, block):
    texts = dict(enumerate(copies(3, 160)))
    got = {r.doc_id: r for r in jaccard.link(spark.createDataFrame([(k, t, "s", 1, 2) for k, t in texts.items()], SCHEMA).repartition(4), limit=limit, block=block).collect()}
    links, classes = brute_links(texts)
    assert got.keys() == texts.keys()
    assert {k: r.n_links for k, r in got.items()} == links
    assert {k: r.class_id for k, r in got.items()} == classes


def test_op9_large_near_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(300)]
    texts = {}
    for i in range(120):
        ws = list(base)
        ws[rng.randrange(300)] = f"x{i}"
        texts[i] = " ".join(ws)
    got = jaccard.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), limit=20, block=50).collect()
    assert all(r.class_id == 0 for r in got) and sum(r.n_links for r in got) == 120 * 119


def test_op9_edge_cases(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.link(docs(spark)).collect()}
    links, classes = brute_links(by_id())
    assert got == {k: (classes[k], links[k]) for k in links}
    kept = {r.doc_id for r in jaccard.one_of_each(docs(spark)).collect()}
    assert kept == set(classes.values())
    assert jaccard.link(docs(spark).limit(0)).count() == 0


def brute_removed(texts: dict[int, bytes], length: int) -> dict[int, np.ndarray]:
    where: dict[bytes, list] = {}
    for k, t in texts.items():
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], []).append((k, i))
    out = {k: np.zeros(len(t), bool) for k, t in texts.items()}
    for at in where.values():
        if len(at) > 1:
            for k, i in at:
                out[k][i : i + length] = True
    return out


def word_spans(raw: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw)]


def check_removal(spark, texts: dict[int, str | None], length: int, passage: int, most: int) -> None:
    frame = spark.createDataFrame([(k, t, "s", 1, 2) for k, t in texts.items()], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, length, passage, most).collect()}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    for k, again in brute_removed(raw, passage).items():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(int), [0]))))
        # Words that lie wholly in a run: those of the text whose both ends do.
        words = [sum(s >= a and e <= z for s, e in word_spans(raw[k])) for a, z in zip(edge[::2], edge[1::2], strict=True)]
        assert (got[k].n_passages, got[k].passage_words) == (sum(n > 50 for n in words), sum(n for n in words if n > 50)), (k, passage)
    for k, gone in brute_removed(raw, length).items():
        kept = bytes(np.frombuffer(raw[k], np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(raw[k]), int(gone.sum()), runs, kept), (k, length)


@pytest.mark.parametrize("most", [400, 3])
def test_op5_against_brute_force(spark, most):
    texts = dict(enumerate(copies(11, 120)))
    texts |= {1000: None, 1001: "", 1002: "ab" * 400, 1003: "x" * 700, 1004: "y" * 399, 1005: "é" * 300, 1006: texts[5] + texts[5]}
    check_removal(spark, texts, 400, 240, most)
    check_removal(spark, texts, 100, 100, most)


def test_op5_edge_cases(spark):
    check_removal(spark, by_id(), 400, 240, 400)
    assert suffix_dedup.remove_repeats(docs(spark).limit(0)).count() == 0


def test_op5_short_passages_and_repeated_ids(spark):
    rng = random.Random(8)
    passage = " ".join(f"{rng.randrange(100, 999)}" for _ in range(60))  # 239 bytes with 60 words
    passage += " abcdef"
    rows = [(1, f"first {passage} tail one"), (2, f"quite another begin {passage}"), (3, "alone " * 3), (4, passage), (4, "x" * 500), (None, "x" * 500), (None, None)]
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_passages, r.passage_words) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    n = len(passage)
    assert got == [(0, 0, 0, 0, 0), (0, 500, 500, 0, 0), (1, n + 15, 0, 1, 61), (2, n + 20, 0, 1, 61), (3, 18, 0, 0, 0), (4, n, 0, 1, 61), (4, 500, 500, 0, 0)]


def test_deep_shallow_sort():
    rng = random.Random(2)
    for trial in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = [base[: rng.randrange(61)] + bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 40))]
        order, lcp = suffix_dedup.deep_shallow_sort(strings, rng.choice([0, 1, 4, 32]))
        assert [strings[i] for i in order] == sorted(strings), trial
        assert sorted(order) == list(range(len(strings)))
        for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
            x, y = strings[a], strings[b]
            assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])
