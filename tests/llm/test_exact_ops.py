"""Operators 1, 3, 4, 7, 8 and 10 against brute-force versions on edge cases."""

import base64
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest

from lexmill.llm import bpe, decontaminate, fingerprints, pii, token_store, warc
from tests.llm.fixtures import by_id, docs, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1_matches_tiktoken(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(bpe.encode(docs(spark), RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert len(got) == len(by_id())
    for k, t in by_id().items():
        ids = own.encode_ordinary(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t)), repr(t[:60])


def test_op1_many_blocks_parts_and_runs(spark):
    import random

    import tiktoken

    rng = random.Random(3)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rows = [(i % 2500, " ".join("".join(rng.choice("abcdeßé漢1") for _ in range(rng.randrange(1, 12))) for _ in range(20))) for i in range(5000)]  # each id twice
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, bytes(r.ids)) for r in bpe.encode(frame, RANKS, public_tokenizers.PATTERN, block_bytes=1 << 16, run_bytes=1 << 14).collect())
    assert got == sorted((i, np.array(own.encode_ordinary(t), "<u4").tobytes()) for i, t in rows)


def test_op1_empty_table(spark):
    assert bpe.digests(bpe.encode(docs(spark).limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_op1_query_decodes_in_the_worker_that_encodes(spark, tmp_path):
    """One Python worker a task in the last stage of op1_byte_bpe and pipeline; a second one stays in the executor's pool."""
    import corpus_pipeline
    from lexmill.llm import queries

    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    apart = bpe.digests(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert {r.doc_id for r in apart} == set(by_id())
    for got in (queries.op1_byte_bpe(spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["bpe"](spark, frame, str(tmp_path))):
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert sorted(got.collect()) == sorted(apart)


def test_word_cutting_and_heap():
    import pyarrow as pa
    import regex

    cutter = bpe.Words(public_tokenizers.PATTERN)
    every = [t or "" for t in texts()]
    cut = cutter.cut(pa.array(every))
    names = list(cutter.index)
    for t, c in zip(every, cut, strict=True):
        assert [names[i] for i in c] == regex.findall(public_tokenizers.PATTERN, t), repr(t[:60])


GRAMMAR = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    total = sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d)))
    return total % 10 == 0


def base_spans(t: str) -> list:
    out = []
    for kind, pattern in GRAMMAR.items():
        for m in re.finditer(pattern, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_op3_base_spans(spark):
    got = {r.doc_id: r for r in pii.find_spans(docs(spark)).collect()}
    for k, t in by_id().items():
        want = base_spans(t)
        assert got[k].base_sha256 == sha(",".join(f"{a}:{b}:{c}" for a, b, c in want)), repr(t[:80])
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x[0] == y for x in want) for y in GRAMMAR]


def test_op3_random_texts():
    import random

    rng, scanner = random.Random(1), pii.Scanner()
    for _ in range(3000):
        t = "".join(rng.choice("0123456789012345@@..--++() ab%_\n") for _ in range(rng.randrange(60)))
        assert [x for x in scanner.spans(t) if x[0] in pii.BASE_KINDS] == base_spans(t), repr(t)


def test_op3_mask(spark):
    row = pii.mask(docs(spark)).where("text like 'mail %'").first()
    assert row.text == "mail [EMAIL], a@[EMAIL] x@y. call [PHONE] or +123 now" and row.score == 0.5
    assert pii.mask(docs(spark)).where("text is null").count() == 1
    assert pii.Scanner().mask('token = "d7c90f3602a3d0b907ff" x') == 'token = "[ACCOUNT]" x'


def test_op3_mask_over_several_batches(spark):
    frame = spark.range(2501).selectExpr("id", "if(id % 7 = 0, null, concat('mail a', id, '@b.org now')) as text", "id * 2 as more").coalesce(1)
    scanner = pii.Scanner()
    got = sorted(map(tuple, pii.mask(frame).collect()))
    assert got == [(i, None if i % 7 == 0 else scanner.mask(f"mail a{i}@b.org now"), 2 * i) for i in range(2501)]


@pytest.mark.parametrize("least", [0, 10])
def test_op4_round_trip(spark, least):
    html = [None, "", "<p>x\r\n\r\ny</p>", "<p>long enough é</p>", "", "<p>long enough é</p>", "WARC/1.1\r\n\r\n", "short", "short"]
    pages = spark.createDataFrame([(10 - i, f"http://u/{i}\r\nx: y", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, refers_to string")
    got = {r.page_id: r for r in warc.round_trip(pages, min_bytes=least).collect()}
    want = {10 - i: (h or "").encode() for i, h in enumerate(html)}
    assert got.keys() == want.keys()
    for k, p in want.items():
        first = min(x for x, q in want.items() if q == p)
        to = first if first != k and len(p) >= least else None
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (got[k].refers_to, got[k].record_type) == (to, "response" if to is None else "revisit")


def fold_words(t: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


ITEMS = {1: " ".join(f"Bench{i}" for i in range(30)), 10: "only short, item", 2: "never there at all", 3: None, 4: "...", 5: " ".join(f"bench{i}" for i in range(3, 17)), 6: "naïve"}


@pytest.mark.parametrize(("chunk", "group"), [(1 << 20, 1 << 20), (3000, 1 << 20), (40, 150)])
def test_op7_against_brute_force(spark, chunk, group):
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark), bench, chunk_bytes=chunk, group_bytes=group).collect()}
    windows = {i: {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} for i, t in ITEMS.items() if (w := fold_words(t or ""))}
    left = decontaminate.clean(docs(spark), bench, chunk_bytes=chunk, group_bytes=group)
    kept = {r.doc_id for r in left.collect()}
    assert left.schema == docs(spark).schema
    for k, t in by_id().items():
        w, hit, items, telling = fold_words(t), set(), set(), False
        for i, own in windows.items():
            for x in own:
                for at in range(len(w) - len(x) + 1):
                    if tuple(w[at : at + len(x)]) == x:
                        hit.update(range(at, at + len(x)))
                        items.add(str(i))
                        telling = telling or len(x) >= 8
        flag = bool(hit) and 20 * len(hit) >= len(w)
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (len(w), len(hit), len(items), sha(",".join(sorted(items))), flag), repr(t[:60])
        assert (k in kept) == (not flag and not telling)


def test_op7_clean_leaves_no_window(spark):
    """Long documents, rows that repeat, rows that share an id: each row is judged by itself."""
    filler, passage = " ".join(f"f{i}" for i in range(3000)), " ".join(f"b{i}" for i in range(13))
    rows = [(1, filler), (1, f"{filler} {passage} {filler}"), (2, f"{passage} end"), (2, f"{passage} end"), (3, passage.replace("b12", "")), (None, passage), (4, None), (5, "")]
    bench = spark.createDataFrame([("x", f"{passage} b13 b14"), ("y", None), (None, "filler"), ("z", "f7")], "item_id string, text string")
    for chunk in (1 << 20, 30):
        left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench, chunk_bytes=chunk, group_bytes=60)
        assert sorted((r.doc_id, len(r.text or "")) for r in left.collect()) == sorted([(1, len(filler)), (3, len(rows[4][1])), (4, 0), (5, 0)])
    empty = bench.limit(0)
    assert decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), empty).count() == len(rows)
    assert {r.n_hit for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), empty).collect()} == {0}
    assert decontaminate.contamination(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_wu_manber_finds_every_occurrence():
    import random

    rng = random.Random(6)
    for _ in range(200):
        patterns = list({bytes(rng.choice(b"ab ") for _ in range(rng.choice([3, 5, 26, 30, 60, 230]))) for _ in range(rng.randrange(1, 30))})
        text = bytes(rng.choice(b"ab ") for _ in range(400)) + b"".join(rng.choices(patterns, k=4))
        want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
        assert sorted(decontaminate.WuManber(patterns).find(text)) == want
        small = []
        for c in decontaminate.WuManber(patterns).classes:
            c.find(text, small, piece=17)
        assert sorted(small) == want


def canonical(t: str) -> str:
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"[\t-\r \x85\xa0  -     　]+", " ", t).strip(" ")


def test_op8_edits_and_classes(spark):
    every = by_id()
    order = sorted(every)
    got = {r.doc_id: r for r in fingerprints.with_edits(docs(spark)).collect()}
    for k, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, q = every[k], len(every[k]) // 4
        edited = t[: len(t) - q] + every[nxt][:q]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), sha(edited))
        assert (got[k].near_edited, got[k].near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(every[nxt]))), repr(t[:60])
    prints = {k: got[k].fingerprint for k in order}
    assert all((prints[a] == prints[b]) == (canonical(every[a]) == canonical(every[b])) for a in order for b in order)
    classes = {r.doc_id: r.class_id for r in fingerprints.exact_classes(docs(spark)).collect()}
    assert classes == {k: min(x for x in order if canonical(every[x]) == canonical(every[k])) for k in order}


def test_op8_many_buckets(spark):
    big = spark.range(0, 7000).selectExpr("id * 3 as doc_id", "concat('t', id) as text")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(big, ["text"]).collect()}
    assert got == {i * 3: f"t{(i + 1) % 7000}" for i in range(7000)}


def test_op10_store(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_store.round_trip(docs(spark), path).collect()}
    start = 0
    for k in sorted(by_id()):
        ids = [*tok.encode(by_id()[k], add_special_tokens=False).ids, 2]
        assert got[k].start == start and bytes(got[k].ids) == np.array(ids, "<u4").tobytes(), repr(by_id()[k][:60])
        start += len(ids)
    assert token_store.round_trip(docs(spark).limit(0), path).count() == 0


def test_op10_many_shards_and_repeated_rows(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(token_store, "shared_dir", lambda _: f"file://{tmp_path}")  # as a cluster names it
    rows = [(i // 2, "same text" if i % 3 else f"text {i} " * (i % 7)) for i in range(600)]
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_store.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, shard_ids=300).collect())
    assert len(list(tmp_path.glob("tokens-*/tokens-*.bin"))) > 5
    own = [(d, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in rows]
    assert sorted((d, x) for _, d, x in got) == sorted(own) and [d for _, d, _ in got] == sorted(d for d, _ in own)
    at = 0
    for start, _, x in got:
        assert start == at
        at += len(x) // 4


def test_op10_packing():
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)
    control, data = token_store.pack(v)
    assert len(control) == 2 and len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 and (token_store.unpack(control, data, len(v)) == v).all()
    assert zlib.crc32(v.tobytes()) == zlib.crc32(token_store.unpack(control, data, 7).tobytes())
