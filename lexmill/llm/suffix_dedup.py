"""Operator 5: removal of byte strings that repeat, by sorting suffixes.

Every byte covered by a ``length``-byte string that also starts elsewhere, in
another document or the same one, is removed; strings are judged on the input.

Sorting all suffixes of a corpus would ship each of them with ``length`` bytes.
Instead each window of ``passage`` bytes (a shorter length, see below) names its
anchor, the leftmost of the K-byte grams in it with the least hash.  Equal
windows have equal anchors at equal offsets, and so have longer windows that
begin alike, so it is enough to compare windows around anchors of equal hash.
The windows of one anchor form a segment; its content is the bytes from its
first window to ``length`` bytes after the begin of its last one.

1. Slim rows (one a segment: its anchor's hash, a digest of its content, its
   place) are counted by hash; hashes that occur once have no repeat and go.
2. What is left is counted by content, combined before the shuffle.  A segment
   whose content occurs twice repeats as a whole (128-bit digests decide).
   Copies, however many, end here.
3. Segments of different content around equal anchors (edges of copied passages,
   near copies) are sorted.  Their bytes, one of each content, go to their
   anchor's task, where the suffixes at the anchors, and the reversed prefixes
   before them, are put in order by deep-shallow sorting: multikey quicksort
   down to SHALLOW bytes, then blind tries for the groups with longer common
   prefixes.  Longest common prefixes of neighbours in both orders say which
   windows are equal, for either length.
4. A task sorts at most MOST different contents of an anchor, 16 MB of bytes.
   An anchor with more (a passage in very many documents) is not sorted in one
   task: its windows are counted by their 128-bit digest, combined before the
   shuffle.

Beside what is removed, each document reports its repeated passages: maximal
runs covered by strings of ``passage`` bytes that repeat, where a run holds more
than PASSAGE_WORDS whole words.  240 bytes are below what 51 words take in
practice (the shortest hundredth of such stretches has 250), so a passage of
over 50 words is found although it may be shorter than ``length`` bytes.

Scratch tables are removed as soon as the next one is written.

Defined results: null texts are empty; texts shorter than ``length`` bytes keep
every byte; repeated rows are repeats of each other; rows are told apart by id
and text, so rows of one id (or none) with different texts are each judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, returning, slim_docs, written

LENGTH, PASSAGE, K, SHALLOW, MOST = 400, 240, 32, 32, 20_000
PASSAGE_WORDS = 50
CHUNK = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(raw: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every k-byte gram (k a power of two), by doubling."""
    h, size = _mix(raw.astype(np.uint64) + np.uint64(1)), 1
    while size < k:
        h = (h[:-size] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[size:] + (h[:-size] >> np.uint64(29)))
        size *= 2
    return _mix(h)


def _window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (van Herk)."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(text: bytes, length: int = LENGTH, k: int = K) -> list[tuple[int, int, int, int]]:
    """(anchor hash, anchor, first window, last window): a text's windows by anchor, in order."""
    found: list[tuple[int, int, int, int]] = []
    for at in range(0, max(1, len(text) - length + 1), CHUNK):
        raw = np.frombuffer(text, np.uint8)[at : at + CHUNK + length - 1]
        if len(raw) < length:
            break
        h = gram_hashes(raw, k)
        place = np.arange(len(h), dtype=np.uint64)
        least = _window_min((h & np.uint64(0xFFFFFFFFFF000000)) | place, length - k + 1)
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        a = anchor[first]
        found += zip(h[a].view(np.int64).tolist(), (a + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)
    return found


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


def _lcp(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the longest common prefix, known to be ``low`` at least."""
    high = min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def multikey_quicksort(items: list[int], strings: list[bytes], depth: int, until: int) -> list[list[int]]:
    """Items in order of their strings' bytes from ``depth`` to ``until``, as groups of equals so far."""
    groups: list[list[int]] = []
    stack: list[tuple[list[int], int]] = [(items, depth)]
    while stack:
        some, d = stack.pop()
        if len(some) < 2 or d >= until:
            if some:
                groups.append(some)
            continue
        keys = [strings[i][d] if d < len(strings[i]) else -1 for i in some]
        pivot = keys[len(keys) // 2]
        less = [i for i, c in zip(some, keys, strict=True) if c < pivot]
        same = [i for i, c in zip(some, keys, strict=True) if c == pivot]
        more = [i for i, c in zip(some, keys, strict=True) if c > pivot]
        stack.append((more, d))
        if pivot < 0:  # all of these strings have ended
            stack.append((same, until))
        else:
            stack.append((same, d + 1))
        stack.append((less, d))
    return groups


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: int) -> None:
        self.depth, self.leaf, self.kids = depth, leaf, {}


def blind_trie(items: list[int], strings: list[bytes], depth: int) -> list[int]:
    """Items of a group with a long common prefix, in order.  A node holds a branching
    position only; a descent that skips bytes ends at some leaf, one comparison
    with it gives the true branching position."""
    equal: dict[int, list[int]] = {items[0]: [items[0]]}
    root: _Node | int = items[0]

    def code(i: int, d: int) -> int:
        s = strings[i]
        return s[d] if d < len(s) else -1

    for i in items[1:]:
        path: list[tuple[_Node, int]] = []
        at = root
        while isinstance(at, _Node):
            c = code(i, at.depth)
            path.append((at, c))
            at = at.kids.get(c, at.leaf) if c in at.kids else at.leaf
            if isinstance(at, int):
                break
        leaf = at
        common = _lcp(strings[i], strings[leaf], depth)
        if common == len(strings[i]) == len(strings[leaf]):
            equal[leaf].append(i)
            continue
        equal[i] = [i]
        above, at = None, root
        for node, c in path:
            if node.depth >= common:
                break
            above, at = (node, c), node.kids.get(c)
        if isinstance(at, _Node) and at.depth == common:
            at.kids[code(i, common)] = i
        else:
            new = _Node(common, leaf)
            new.kids = {code(leaf, common): at, code(i, common): i}
            if above is None:
                root = new
            else:
                above[0].kids[above[1]] = new
    out: list[int] = []
    stack: list[_Node | int] = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, _Node):
            stack += [at.kids[c] for c in sorted(at.kids, reverse=True)]
        else:
            out += equal[at]
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and the longest common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    for group in multikey_quicksort(list(range(len(strings))), strings, 0, shallow):
        order += group if len(group) == 1 else blind_trie(group, strings, min(shallow, min(len(strings[i]) for i in group)))
    lcp = [0] + [_lcp(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    return order, lcp


def equal_windows(before: list[bytes], after: list[bytes], lengths: tuple[int, ...] = (LENGTH,)) -> list[list[np.ndarray]]:
    """For texts around one anchor (bytes before it; bytes from it on): for each length, per text, which
    windows that begin o bytes before the anchor, o = 0, 1, ..., equal another text's."""
    m, spread = len(before), max(map(len, before)) + 1
    left, left_lcp = deep_shallow_sort([x[::-1] for x in before])
    right, right_lcp = deep_shallow_sort(after)
    hits = [np.zeros((m, spread), bool) for _ in lengths]
    if m <= 24:
        rank_l, rank_r = {i: r for r, i in enumerate(left)}, {i: r for r, i in enumerate(right)}
        for i in range(m):
            for j in range(i + 1, m):
                a, b = sorted((rank_l[i], rank_l[j]))
                lo = min(left_lcp[a + 1 : b + 1])
                a, b = sorted((rank_r[i], rank_r[j]))
                hi = min(right_lcp[a + 1 : b + 1])
                for length, hit in zip(lengths, hits, strict=True):
                    first = max(0, length - hi)  # a window o before the anchor needs o bytes before and length - o after
                    if first <= lo:
                        hit[i, first : lo + 1] = hit[j, first : lo + 1] = True
        return [list(hit) for hit in hits]
    group_l, group_r = np.zeros(m, np.int64), np.zeros(m, np.int64)
    size_l, size_r = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    left_lcp, right_lcp = np.array(left_lcp), np.array(right_lcp)
    for o in range(spread):
        group_l[left] = np.cumsum(left_lcp < o)
        for length, hit in zip(lengths, hits, strict=True):
            has = np.flatnonzero((size_l >= o) & (size_r >= length - o))
            if len(has) > 1:
                group_r[right] = np.cumsum(right_lcp < length - o)
                _, inverse, count = np.unique(group_l[has] * (m + 1) + group_r[has], return_inverse=True, return_counts=True)
                hit[has[count[inverse] > 1], o] = True
    return [list(hit) for hit in hits]


# --- plan -----------------------------------------------------------------------------------------------------------

#: A row of a document is named by ``row``, a hash of its id and text, and its id.
_KEY = "row long, doc_id long"
_SEGMENTS = f"{_KEY}, gram long, content binary, anchor long, low long, high long, stop long"
_SPANS = f"{_KEY}, passage boolean, s long, e long"
_BYTES = f"{_KEY}, gram long, anchor long, low long, high long, stop long, before binary, after binary"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _segment_rows(length: int, passage: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, d, text in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for h, a, lo, hi in segments(raw, passage):
                    stop = min(hi + length, len(raw))
                    # The digest holds the segment's form too: at a text's end equal bytes may have fewer windows.
                    rows.append((key, d, h, xxhash.xxh3_128_digest(raw[lo:stop] + b"%d %d" % (a - lo, hi - lo)), a, lo, hi, stop))
                if len(rows) > 50_000:
                    yield _batch(rows, _SEGMENTS)
                    rows = []
            if rows:
                yield _batch(rows, _SEGMENTS)

    return run


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contents of segments, cut at the anchor."""
    for b in batches:
        rows: list[tuple] = []
        for key, d, text, places in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), b["places"].to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(key, d, p["gram"], p["anchor"], p["low"], p["high"], p["stop"], raw[p["low"] : p["anchor"]], raw[p["anchor"] : p["stop"]]) for p in places]
            if len(rows) > 5000:
                yield _batch(rows, _BYTES)
                rows = []
        if rows:
            yield _batch(rows, _BYTES)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted_spans(length: int, passage: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []

        def spans() -> list[tuple]:
            found = []
            if len(held) > 1:
                both = equal_windows([r["before"] for r in held], [r["after"] for r in held], (length, passage))
                for is_passage, size, hits in zip((False, True), (length, passage), both, strict=True):
                    for r, hit in zip(held, hits, strict=True):
                        for first, end in _runs(hit):  # offsets before the anchor: [first, end)
                            found.append((r["row"], r["doc_id"], is_passage, r["anchor"] - end + 1, r["anchor"] - first + size))
            return found

        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if r["gram"] != gram:
                    out += spans()
                    gram, held = r["gram"], []
                held.append(r)
            if out:
                yield _batch(out, _SPANS)
        if out := spans():
            yield _batch(out, _SPANS)

    return run


_WINDOWS = f"{_KEY}, passage boolean, s long, window binary"


def _window_digests(length: int, passage: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw, low = r["before"] + r["after"], r["low"]
                rows = [
                    (r["row"], r["doc_id"], is_passage, s, xxhash.xxh3_128_digest(raw[s - low : s - low + size]))
                    for is_passage, size in ((False, length), (True, passage))
                    for s in range(low, min(r["high"], r["stop"] - size) + 1)
                ]
                if rows:
                    yield _batch(rows, _WINDOWS)

    return run


def _with_key(docs: DataFrame) -> DataFrame:
    slim = slim_docs(docs)
    return slim.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on the row's key; an id may be null."""
    other = right.withColumnsRenamed({"row": "_row", "doc_id": "_doc_id"})
    return left.join(other, (left["row"] == other["_row"]) & left["doc_id"].eqNullSafe(other["_doc_id"]), how).drop("_row", "_doc_id")


def repeated_spans(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, most: int = MOST) -> DataFrame:
    """(row, doc_id, passage, s, e): byte spans that cover exactly the repeated strings of ``length`` bytes
    (passage false) and of ``passage`` bytes (true), passage <= length; they may overlap."""
    keyed = _with_key(docs)
    every = written(keyed.mapInArrow(returning(_segment_rows(length, passage)), _SEGMENTS), "suffix-segments")
    # Written first, so that both sides of the join are plain exchanges, which Spark can split where a hash is hot.
    grams = written(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "suffix-grams")
    rows = written(every.join(grams, "gram"), "suffix-repeated")
    dropped(every, grams)
    place = F.struct("row", "doc_id", "anchor", "low", "high", "stop")  # of one holder of each content
    contents = written(rows.groupBy("gram", "content").agg(F.count("*").alias("copies"), F.min(place).alias("holder")), "suffix-contents")
    mixed = contents.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = rows.join(contents.where("copies > 1").select("gram", "content"), ["gram", "content"])
    forms = F.filter(
        F.array(
            F.struct(F.lit(True).alias("passage"), F.col("low").alias("s"), (F.col("high") + passage).alias("e")),
            F.struct(F.lit(False).alias("passage"), F.col("low").alias("s"), F.least(F.col("high") + length, "stop").alias("e")),
        ),
        lambda f: f["passage"] | (f["e"] - f["s"] >= length),
    )
    spans = written(whole.select("row", "doc_id", F.inline(forms)), "suffix-whole")
    places = contents.join(mixed, "gram").select("gram", "holder.*")
    by_row = places.groupBy("row", "doc_id").agg(F.collect_list(F.struct("gram", "anchor", "low", "high", "stop")).alias("places"))
    sent = written(_joined(keyed.dropDuplicates(["row", "doc_id"]), by_row).select("row", "doc_id", "text", "places").mapInArrow(returning(_bytes_of), _BYTES), "suffix-bytes")
    large = mixed.where(F.col("kinds") > most).select("gram")
    few = sent.join(large, "gram", "left_anti").select(*(c.split()[0] for c in _BYTES.split(", "))).repartition("gram").sortWithinPartitions("gram", "row", "low")
    found = [spans, written(few.mapInArrow(returning(_sorted_spans(length, passage)), _SPANS), "suffix-sorted")]
    if not large.isEmpty():
        windows = written(sent.join(large, "gram").mapInArrow(_window_digests(length, passage), _WINDOWS), "suffix-windows")
        twice = windows.groupBy("passage", "window").agg(F.count("*").alias("n")).where("n > 1").select("passage", "window")
        size = F.when(F.col("passage"), passage).otherwise(length)
        again = windows.join(twice, ["passage", "window"]).select("row", "doc_id", "passage", "s", (F.col("s") + size).alias("e"))
        found.append(written(again, "suffix-large"))
        dropped(windows)
    dropped(rows, contents, sent)
    return reduce(DataFrame.unionByName, found)


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, passage_words long"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def whole_words(raw: bytes, s: int, e: int) -> int:
    """Words between ASCII white space that lie wholly in raw[s:e]."""
    n = len(raw[s:e].split())
    n -= s > 0 and n > 0 and not raw[s - 1 : s].isspace() and not raw[s : s + 1].isspace()
    return n - (e < len(raw) and n > 0 and not raw[e : e + 1].isspace() and not raw[e - 1 : e].isspace())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, text, spans in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gone = _merged([(p["s"], p["e"]) for p in spans or [] if not p["passage"]])
            edges = [0, *(x for span in gone for x in span), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
            words = [n for s, e in _merged([(p["s"], p["e"]) for p in spans or [] if p["passage"]]) if (n := whole_words(raw, s, e)) > PASSAGE_WORDS]
            rows.append((d, len(raw), len(raw) - len(kept), len(gone), kept, len(words), sum(words)))
        if rows:
            yield _batch(rows, _KEPT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_passages, passage_words): each text without its repeated
    strings; the passages of over PASSAGE_WORDS words in it that repeat, and their words."""
    spans = repeated_spans(docs, length, passage, most).groupBy("row", "doc_id").agg(F.collect_set(F.struct("passage", "s", "e")).alias("spans"))
    return _joined(_with_key(docs), spans, "left").select("doc_id", "text", "spans").mapInArrow(returning(_cut), _KEPT)

