"""Operators 2 and 6, and the pipeline."""

import random
import zlib

import numpy as np

from lexmill.llm import bpe, decontaminate, licenses, pii, quality
from tests.llm.fixtures import docs


def labelled(spark, n=400):
    rng = random.Random(4)
    good = ["the", "of", "house", "river", "stone", "Morning", "light", "walk"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        ws = [rng.choice(good) + (rng.choice(["$$$", "%%%"]) if bad else rng.choice(["", "", ","])) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(ws), "en", "s", 1))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(n, None, "en", "s", 1), (n + 1, "", "en", "s", 1), (n + 2, "?" * 50000, "en", "s", 1)]
    labels += [(n + 7, 1, 0), (None, 1, 0), (3, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_op2_held_out(spark):
    d, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score(d, quality.fit(d, labels)).collect()}
    assert len(got) == 403
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for i, r in got.items() if r.held_out and i < 400]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in quality.keep_good(d, quality.fit(d, labels)).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_op2_degenerate(spark):
    d, labels = labelled(spark)
    assert {r.score for r in quality.score(d, quality.fit(d, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality.score(d.limit(0), quality.fit(d.limit(0), labels)).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    idx = np.arange(5)
    w = quality.dual_coordinate_descent([(idx, v) for v in x], y, np.ones(60), 5, epochs=500)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()

    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=5)) + 1e-6 for _ in range(200))


def plain_features(text):
    """The indicators as tuples, by a rule written for the test."""
    import re

    toks = re.findall(r"\w+|[^\w\s]+", text)
    shape = []
    for t in toks:
        c = t[0]
        shape.append(t[:3] if not c.isalnum() else "U" if len(t) > 1 and t.isupper() else "T" if c.isupper() else "9" if c.isdigit() else "a")
    return {("w", t.lower()) for t in toks} | {("2", *p) for p in zip(shape, shape[1:], strict=False)} | {("3", *p) for p in zip(shape, shape[1:], shape[2:], strict=False)}


def test_op2_against_plain_numpy(spark):
    d, labels = labelled(spark, 150)
    model = quality.fit(d, labels)
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(y)
    names = sorted({f for i in ids for f in plain_features(texts[i])})
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(ids), len(names)))
    for r, i in enumerate(ids):
        x[r, [at[f] for f in plain_features(texts[i])]] = 1
    sign = np.array([1.0 if y[i] else -1.0 for i in ids])
    pos, neg = x[sign > 0], x[sign < 0]
    ratio = np.log((pos.sum(0) + 1) / (len(pos) + 1)) - np.log((neg.sum(0) + 1) / (len(neg) + 1))
    scaled = np.hstack([x * ratio / np.sqrt(x.sum(1, keepdims=True)), np.ones((len(ids), 1))])
    cost = np.where(sign > 0, len(ids) / (2 * len(pos)), len(ids) / (2 * len(neg)))

    def loss(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - sign * (scaled @ w))).sum()

    alpha, w = np.zeros(len(ids)), np.zeros(len(names) + 1)  # the dual optimum by plain sweeps
    for _ in range(3000):
        for i in range(len(ids)):
            new = min(max(alpha[i] - (sign[i] * (scaled[i] @ w) - 1) / (scaled[i] @ scaled[i]), 0), cost[i])
            w += (new - alpha[i]) * sign[i] * scaled[i]
            alpha[i] = new
    own = np.array([model.margin(quality.features(texts[i])) for i in ids])
    assert abs(loss(w) - (alpha.sum() - w @ w / 2)) < 1e-6  # no duality gap: the optimum
    assert np.abs(own - scaled @ w).max() < 0.05
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    for i, m in zip(ids, own, strict=True):
        assert abs(got[i] - 1 / (1 + np.exp(-(model.slope * m + model.offset)))) < 1e-4


def test_op2_repeated_rows_and_contradictions(spark):
    d, labels = labelled(spark, 150)
    model = quality.fit(d, labels)
    twice = quality.fit(d.unionByName(d).repartition(5), labels.unionByName(labels))
    assert np.abs(model.weights - twice.weights).max() < 1e-9
    against = labels.where("quality is not null").selectExpr("doc_id", "1 - quality as quality", "toxic")
    assert {r.score for r in quality.score(d, quality.fit(d, labels.unionByName(against))).collect()} == {0.5}


def test_op6_against_plain_comparison(spark):
    every = {i: t for i, t in enumerate([*licenses.TEMPLATES.values(), "Before it. Released under the MIT License. After.\nnext", "Licensed under the Apache License Version 2.0", "The licence plate of a car is new.", None, "", "license " * 500, "This work is licenced under the GNU General Public License, version 3."])}
    got = {r.doc_id: r.found for r in licenses.scan(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    scanner_words = {k: licenses._WORD.findall(v.lower()) for k, v in licenses.TEMPLATES.items()}
    for i, t in every.items():
        want = []
        for s, e in licenses.sentences(t or ""):
            ws = licenses._WORD.findall(t[s:e].lower())
            close = sorted((licenses.differences(ws, own, 99), k) for k, own in scanner_words.items())
            if close[0][0] <= 0.25 * len(scanner_words[close[0][1]]):
                want.append((close[0][1], s, e, close[0][0]))
        assert [(f.license, f.start, f.end, f.differences) for f in got[i]] == want, t
    assert licenses.summary(licenses.scan(docs(spark))).where("n_licenses > 0").count() == 0


def scanned(text):
    known = [(k, v, licenses.NAMING.get(k, "")) for k, v in licenses.TEMPLATES.items()] + [(k, v, "") for k, v in licenses.full_texts()]
    return licenses.Scanner(known).scan(text)


def test_op6_blocks_of_lines(spark):
    full = dict(licenses.full_texts())
    mit, bsd, isc = (full[k].split("\n\n")[0] for k in ("MIT", "BSD-3-Clause", "ISC"))
    forms = {"MIT-text": mit, "BSD-3-Clause": bsd, "ISC": isc}
    rows = [(name, form) for name, t in forms.items() for form in (t, " ".join(t.split()), "\n".join(" * " + x for x in t.split("\n")), "dnl " + t.replace("\n", "\ndnl "))]
    got = licenses.summary(licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: name for i, (name, _) in enumerate(rows)}


def test_op6_full_texts_and_tags():
    for name, text in licenses.full_texts():
        for form in (text, "word " * 30 + "\n" + " ".join(text.split()) + "\nmore words", "\n".join("# " + x for x in text.split("\n"))):
            assert [(f[0], f[4]) for f in scanned(form)] == [(name, 0)], name
    assert [f[0] for f in scanned("/* SPDX-License-Identifier: (MIT OR GPL-2.0-or-later WITH Linux-syscall-note) */\nint x;")] == ["GPL-2.0-or-later", "MIT"]
    at = [(f[0], f[1], f[2], f[4]) for f in scanned("We ship it and it is licensed under the MIT License, see below; it was made in May.")]
    assert at == [("MIT", 21, 51, 1)]
    assert not scanned("Their code was released under the same license as before, and copyright is theirs.")


def test_op6_no_template_is_cut_before_comparison(spark):
    own = "Version {} of this licence applies to the work and to all of its later forms."
    family = {f"L-{v}": own.format(v) for v in range(1, 10)}
    quoted = {k: v.replace("Version ", 'Version: "').replace(" of this", '", of this') for k, v in family.items()}  # all compress alike
    got = licenses.scan(spark.createDataFrame(list(enumerate(quoted.values())), "doc_id long, text string"), family).collect()
    assert {r.doc_id: [(f.license, f.differences) for f in r.found] for r in got} == {i: [(k, 0)] for i, k in enumerate(family)}
    gnu = {k: v for k, v in licenses.full_texts() if k.endswith(("-only", "-or-later"))}
    assert len(gnu) == 10 and all([(f[0], f[4]) for f in scanned(v)] == [(k, 0)] for k, v in gnu.items())


def test_op6_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, n))] for n in (9, 12))
        bits = licenses._bits(a)
        assert list(licenses.distances(bits, len(a), b, False)) == [licenses.differences(a, b[:i], 99) for i in range(1, len(b) + 1)]
        assert list(licenses.distances(bits, len(a), b, True)) == [min(licenses.differences(a, b[s:i], 99) for s in range(i + 1)) for i in range(1, len(b) + 1)]


def test_differences():
    assert licenses.differences(list("abcd"), list("abxd"), 3) == 1 and licenses.differences(list("abcd"), list("wxyz"), 2) == 3


def test_pipeline_stages_on_edges(spark, tmp_path):
    """Empty tables, repeated rows and extra columns with clashing names, stage by stage."""
    import corpus_pipeline as p

    d, labels = labelled(spark, 60)
    wide = d.selectExpr("*", "'x' as ids", "'y' as words", "1 as rep", "2 as n", "cast(null as string) as quality", "3L as n_chars", "'z' as digest").unionByName(d.selectExpr("*", "'x' as ids", "'y' as words", "1 as rep", "2 as n", "cast(null as string) as quality", "3L as n_chars", "'z' as digest"))
    bench = spark.createDataFrame([(1, "never " * 20), (2, None), (None, "the of"), (4, "")], "item_id long, text string")
    for name, frame in (("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for sf in ("full", "none"):
        for rows in (wide, wide.limit(0)):
            docs_ = rows
            for name, stage in p.STAGES[:-1]:
                before, docs_ = docs_.count(), stage(spark, docs_, f"{tmp_path}/{sf}")
                assert docs_.schema.names == wide.schema.names, name
                after = docs_.count()
                assert after <= before and (before == 0 or after > 0), (sf, name)
            assert p.STAGES[-1][1](spark, docs_, f"{tmp_path}/{sf}").count() == docs_.count()
    none = f"{tmp_path}/none"
    assert p.STAGES[0][1](spark, wide, none).count() == wide.count() and p.STAGES[2][1](spark, wide, none).count() == wide.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    d, labels = labelled(spark)
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string")
    tail = spark.createDataFrame([(900, "Morning light " + " ".join(f"b{i}" for i in range(20)), "en", "s", 1), (901, "the river walk of stone to bob@example.com light", "en", "s", 1), (902, "the river walk of stone to bob@example.com light", "en", "s", 1)], d.schema)
    d = d.unionByName(tail)
    for name, frame in (("documents", d), ("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"] and p.ORACLE_SQL is None
    got = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}
    model = quality.fit(d, labels)
    kept = {r.doc_id: r.text for r in quality.keep_good(d, model).collect()}
    assert not {900, 902} & got.keys() and {i for i in kept if i < 400} >= {i for i in got if i < 400}
    import public_tokenizers

    own = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    assert 901 in got and got[901].n_tokens == len(enc.encode_ordinary(pii.Scanner().mask(kept[901])))
    assert decontaminate.words("A b")[0] == b"a"
