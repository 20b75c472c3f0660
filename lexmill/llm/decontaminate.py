"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased in A-Z and cut into words (runs of 0-9, a-z and non-ASCII
characters).  A window is 13 consecutive words of an item; an item with fewer
words, but not none, is one window.  Windows are searched as byte strings
`` w1 w2 ... wn `` (single blanks between and around), so a match can only
begin and end at word borders.

Wu-Manber: a flat shift table says for each block of bytes (by its hash) how far
the search may jump; a block that can end a pattern's first ``m`` bytes leads to
a bucket by that suffix, whose patterns are compared directly.  Patterns are
searched in classes of similar length so that a short item cannot shorten the
jumps of the long ones.

The benchmark reaches the executors as broadcasts of a checked size: chunks whose
windows take at most ``chunk_bytes``, in groups of at most ``group_bytes`` of item
text.  A task scans a stretch of its rows with one chunk's tables after the
other, so its memory is one chunk's tables and the group; a benchmark of several
groups takes a pass over the documents for each.  Rows carry their own hits from
group to group: there is no join and no shuffle, and nothing depends on ids.

Defined results: null or empty texts have no words and are never contaminated;
items without id or text, or without words, are not searched; equal windows of
several items count for each of them; rows that repeat give repeated results; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import returning, slim_docs, written

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20) for c in range(256))
WINDOW = 13
CHUNK_BYTES, GROUP_BYTES, STRETCH_BYTES = 8 << 20, 64 << 20, 32 << 20
#: An occurrence of so many words, as a window or a whole item, makes a document go (``clean``).
TELLING = 8


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not item:
        return []
    return [b" " + b" ".join(item[i : i + size]) + b" " for i in range(max(1, len(item) - size + 1))]


def _blocks(raw: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 8) bytes from each place on, as one number."""
    out = raw[: len(raw) - size + 1].astype(np.uint64)
    for i in range(1, size):
        out |= raw[i : len(raw) - size + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    return out


class _Class:
    """Tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.m = m = min(200, *map(len, patterns))
        self.block = block = min(m, 8 if m >= 24 else 3)
        bits = max(12, min(26, (128 * len(patterns)).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - block + 1, np.uint8)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        last = None
        for end in range(block, m + 1):  # later blocks allow smaller jumps
            last = _blocks(np.ascontiguousarray(heads[:, end - block : end]).reshape(-1), block)[::block]
            self.shift[self._slots(last)] = m - end
        order = np.argsort(last, kind="stable")
        self.suffix, self.patterns = last[order], [patterns[i] for i in order]

    def _slots(self, values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> self.down

    def find(self, text: bytes, found: list[tuple[int, bytes]], piece: int = 1 << 20) -> None:
        m, block, patterns = self.m, self.block, self.patterns
        back = m - block  # a block that begins at i ends a pattern that begins at i - back
        at = back
        while at <= len(text) - block:
            values = _blocks(np.frombuffer(text, np.uint8, min(piece + block - 1, len(text) - at), at), block)
            steps, i, n = self.shift[self._slots(values)].tobytes(), 0, len(values)
            while i < n:
                if step := steps[i]:
                    i += step
                    continue
                lo, hi = np.searchsorted(self.suffix, values[i]), np.searchsorted(self.suffix, values[i], "right")
                start = at + i - back
                found += [(start, p) for p in patterns[lo:hi] if text.startswith(p, start)]
                i += 1
            at += i


class WuManber:
    """Finds every occurrence of the patterns in a byte string."""

    def __init__(self, patterns: list[bytes]) -> None:
        by_size: dict[int, list[bytes]] = {}
        for p in dict.fromkeys(patterns):
            by_size.setdefault(min(len(p), 64) // 24, []).append(p)
        self.classes = [_Class(ps) for ps in by_size.values()]

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        found: list[tuple[int, bytes]] = []
        for c in self.classes:
            c.find(text, found)
        return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Machine:
    """A chunk's windows and who owns them."""

    def __init__(self, chunk: list[tuple[str, bytes]], window: int) -> None:
        self.owners: dict[bytes, list[str]] = {}
        for item_id, piece in chunk:
            for w in set(windows(piece.split(), window)):
                self.owners.setdefault(w, []).append(item_id)
        self.search = WuManber(list(self.owners)) if self.owners else None

    def hits(self, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [first, end) inside occurrences, and the owners found; text is `` w1 w2 ... wn ``."""
        found = self.search.find(text) if self.search else []
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        items: set[str] = set()
        ranges = []
        for start, p in found:
            items.update(self.owners[p])
            first = int(np.searchsorted(blanks, start))
            ranges.append((first, first + p.count(b" ") - 1))
        return ranges, items


def _pieces(item: list[bytes], window: int, chunk_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(bytes of its windows, words) of parts of an item that together have its windows."""
    size = max(1, chunk_bytes // (8 * window * window))
    for at in range(0, max(1, len(item) - window + 1), size):
        part = b" ".join(item[at : at + size + window - 1])
        yield len(part) * window, part


def _groups(benchmark: DataFrame, window: int, chunk_bytes: int, group_bytes: int) -> Iterator[list[list[tuple[str, bytes]]]]:
    """The items as groups of chunks; the driver holds one group at a time.  At least one group comes."""
    group: list[list[tuple[str, bytes]]] = [[]]
    in_chunk = in_group = 0
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null and item_id is not null")
    for item_id, text in known.toLocalIterator():
        if not (item := words(text)):
            continue
        for cost, piece in _pieces(item, window, chunk_bytes):
            if in_group and in_group + len(piece) > group_bytes:
                yield group
                group, in_chunk, in_group = [[]], 0, 0
            if in_chunk and in_chunk + cost > chunk_bytes:
                group.append([])
                in_chunk = 0
            group[-1].append((item_id, piece))
            in_chunk += cost
            in_group += len(piece)
    yield group


_HITS = "_hits_of_benchmark"
_RANGE = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
_HIT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("telling", T.BooleanType()),
    T.StructField("ranges", T.ArrayType(_RANGE)), T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW_HIT = pa.struct([("n_words", pa.int64()), ("telling", pa.bool_()), ("ranges", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            held.append(whole.slice(at, 1000))
            if sum(b.nbytes for b in held) >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with a column of each row's hits; its name is in ``_HITS``."""
    sc = docs.sparkSession.sparkContext

    def scan(chunks: list, first: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Machine(chunks[0].value, window) if len(chunks) == 1 else None
            for b in _stretches(batches, STRETCH_BYTES if kept is None else 1):
                texts = [words(t) for t in b["text"].to_pylist()]
                count = list(map(len, texts))
                texts = [b" " + b" ".join(t) + b" " for t in texts]
                # Before the first group there are no hits.
                before = [None] * len(texts) if first else b[_HITS].to_pylist()
                ranges = [[(r["s"], r["e"]) for r in x["ranges"]] if x else [] for x in before]
                items = [set(x["items"]) if x else set() for x in before]
                telling = [bool(x and x["telling"]) for x in before]
                for chunk in chunks:
                    machine = kept or Machine(chunk.value, window)
                    for i, t in enumerate(texts):
                        r, owners = machine.hits(t)
                        if r:
                            telling[i] = telling[i] or any(e - s >= TELLING for s, e in r)
                            ranges[i] += r
                            items[i] |= owners
                hits = [{"n_words": n, "telling": f, "ranges": [{"s": s, "e": e} for s, e in merged(r)], "items": sorted(o)} for n, f, r, o in zip(count, telling, ranges, items, strict=True)]
                column = pa.array(hits, _ARROW_HIT)
                if first:
                    yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, _HITS])
                else:
                    yield b.set_column(b.schema.get_field_index(_HITS), _HITS, column)

        return run

    state, schema = docs, T.StructType([*docs.schema.fields, T.StructField(_HITS, _HIT)])
    for serial, group in enumerate(_groups(benchmark, window, chunk_bytes, group_bytes)):
        if serial:
            state = written(state, "benchmark-hits")  # done with the group before this one
        state = state.mapInArrow(returning(scan([sc.broadcast(c) for c in group], serial == 0)), schema)
    return state


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = with_hits(slim_docs(docs), benchmark, window, chunk_bytes, group_bytes).select("doc_id", f"{_HITS}.*")
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + (r["e"] - r["s"]))
    found = found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), "items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; columns unchanged, judged row by row.

    A document goes if any window, or any whole item, of TELLING words or more occurs in it, however long it is, or if
    occurrences of shorter items make up a twentieth of its words: no window of ``window`` words is left in what stays.
    """
    rows = with_hits(docs, benchmark, window, chunk_bytes, group_bytes)
    h = F.col(_HITS)
    hit = F.aggregate(h["ranges"], F.lit(0).cast("long"), lambda n, r: n + (r["e"] - r["s"]))
    return rows.where(~h["telling"] & ((hit == 0) | (20 * hit < h["n_words"]))).drop(_HITS)
