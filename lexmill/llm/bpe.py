"""Operator 1: byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern; each distinct word of the
whole corpus is encoded once, by Spark higher-order functions: a fold over the
array of the word's byte tokens merges, step by step, the leftmost adjacent
pair of lowest rank, looked up in a literal rank map.  The map is an array of
buckets (two parallel literals: pair keys, merged ranks), because a lookup in a
plain map literal would scan all its entries; within a bucket the left id names
the pair, since the bucket and the left id give the right one.

Plan: documents become blocks of about ``BLOCK_BYTES`` of text, written once to
the shared folder: the words' places in each document, and the block's distinct
words, dealt by their hash into as many parts as there are shuffle partitions.
The documents stay in the written files and are read there when a block is put
together.
A part's words come together in one task, packed (a frequent word costs a few
bytes per block, not a row per use), each distinct word is folded once, and the
ids go back to the blocks, packed again.  A task holds a block, or a run: the
words that a part gathers from blocks until their places take ``RUN_BYTES`` (a
word is folded once a run); the number of parts grows with the input.  Decoding concatenates the tokens' byte strings; where
it follows at once (``decoded``), the worker that puts a block together does it, not a second one beside it.

Words longer than ``LONG_WORD`` bytes, where a fold over arrays is quadratic,
are merged by a heap in Python (same rule, n log n).

Defined results: null and empty texts have no ids; repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import file_system, give_back, returning, shared_dir, slim_docs, written

BLOCK_BYTES, BLOCK_WORDS, LONG_WORD = 8 << 20, 150_000, 256
RUN_BYTES, PART_BYTES = 32 << 20, 1 << 30
_PAIR_BUCKETS = 1 << 16
_ODD = r"  |^ | $|^$|[\s\x0b\x{85}\p{Z}] [\s\x0b\x{85}\p{Z}]"
_MULTIPLIER = 40503


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the leftmost pair of lowest rank until none is left."""
    n = len(word)
    token: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0:
            joined = token[i] + token[j]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, i, joined))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if token[i] is None or (j := after[i]) < 0 or token[i] + token[j] != joined:
            continue
        token[i], token[j] = joined, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[t] for t in token if t is not None]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    return [whole] if whole is not None else merge_by_heap(word, ranks)


def _pair_lookup(ranks: dict[bytes, int]) -> object:
    """A function of two id columns: the rank of their concatenation, or null."""
    # The bucket of (a, b) is a * odd + b modulo the buckets; with as many buckets as ids at least, (bucket, a) gives b.
    buckets = max(_PAIR_BUCKETS, 1 << (max(ranks.values())).bit_length())
    lefts: list[list[int]] = [[] for _ in range(buckets)]
    joined: list[list[int]] = [[] for _ in range(buckets)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                at = (a * _MULTIPLIER + b) % buckets
                lefts[at].append(a)
                joined[at].append(rank)
    # Literals: Spark folds the constants once, when it plans.
    left_map, rank_map = (F.from_json(F.lit(json.dumps(m, separators=(",", ":"))), "array<array<int>>") for m in (lefts, joined))

    def rank(a: Column, b: Column) -> Column:
        at = ((a.cast("bigint") * _MULTIPLIER + b) % buckets).cast("int")
        place = F.array_position(F.get(left_map, at), a)
        return F.get(F.get(rank_map, at), (place - 1).cast("int"))

    return rank


def _let(value: Column, then: object) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Array of byte ids to array of token ids, by at most n - 1 merges."""
    rank = _pair_lookup(ranks)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(parts, F.slice(parts, 2, F.size(parts)), rank)

        def merged(pairs: Column, least: Column) -> Column:
            return _let(
                F.array_position(pairs, least).cast("int"),
                lambda i: F.concat(F.slice(parts, F.lit(1), i - 1), F.array(least), F.slice(parts, i + 2, F.size(parts))),
            )

        best = _let(pairs, lambda p: _let(F.array_min(p), lambda m: F.when(m.isNull(), parts).otherwise(merged(p, m))))
        return F.when(F.size(parts) < 2, parts).otherwise(best)

    return F.when(F.size(ids) < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(ids)), ids, step))


class Words:
    """Cuts texts into the pattern's words, as indices into the words of a block.

    Between single blanks the pattern's matches do not depend on their
    surroundings, so each distinct piece between blanks is matched once; a text
    with a blank at either end or between other white space is matched whole.
    """

    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}

    def _of(self, text: str) -> np.ndarray:
        index = self.index
        return np.array([index.setdefault(w, len(index)) for w in self.pattern.findall(text)], np.int32)

    def cut(self, texts: pa.Array) -> list[np.ndarray]:
        odd = np.array(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False), bool)
        lists = pc.split_pattern(texts, " ")
        codes = lists.flatten().dictionary_encode()
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        index = codes.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(index), bool)
        first[begin[:-1][~odd]] = True
        # Words of each distinct piece with a blank before it; a document's first piece has none.
        names = codes.dictionary.to_pylist()
        got: list[bytes] = []
        for p in names:
            if (known := self.pieces.get(p)) is None:
                known = self.pieces[p] = self._of(" " + p).tobytes() if p else b""
            got.append(known)
        firsts = [self._of(names[i]).tobytes() for i in index[first]]
        table = got + firsts
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.int32)
        start = np.cumsum(size) - size
        index[first] = len(got) + np.arange(len(firsts))
        n = size[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(start[index] - (ends - n), n) + np.arange(total)] if total else flat
        cuts = np.concatenate(([0], ends))[begin]
        found = [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero(odd):
            found[i] = self._of(texts[int(i)].as_py())
        return found


_BLOCK = "block long, part int, data binary"
_KNOWN = 65535  # the part of words that need no fold


def _packed(*parts: np.ndarray) -> bytes:
    packer = zstandard.ZstdCompressor(level=3)
    out = []
    for p in parts:
        planes = np.ascontiguousarray(p).view(np.uint8).reshape(len(p), p.itemsize).T
        data = packer.compress(planes.tobytes())
        out += [np.array([len(data), len(p), p.itemsize], np.int64).tobytes(), data]
    return b"".join(out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    at, out, reader = 0, [], zstandard.ZstdDecompressor()
    while at < len(blob):
        size, n, item = np.frombuffer(blob, np.int64, 3, at)
        raw = np.frombuffer(reader.decompress(blob[at + 24 : at + 24 + size]), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(item, n).T).view(f"<i{item}").reshape(-1))
        at += 24 + int(size)
    return out


def _blocks(docs: DataFrame, path: str, pattern: str, parts: int, block_bytes: int) -> DataFrame:
    """Rows of blocks: part -1 holds the documents, parts 0, 1, ... the distinct words to encode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        cutter = Words(pattern)
        task, serial = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal doc_ids, held, size, serial
            dealt: list[list[bytes]] = [[] for _ in range(parts)]
            part, known = np.full(len(cutter.index), _KNOWN, np.int32), []
            for w, i in cutter.index.items():
                raw = w.encode("utf-8", "surrogatepass")
                whole = ranks.get(raw)
                if whole is not None:
                    known.append([whole])
                elif len(raw) > LONG_WORD:
                    known.append(merge_by_heap(raw, ranks))
                else:
                    k = zlib.crc32(raw) % parts
                    part[i] = k
                    dealt[k].append(raw)
            rows = [(-1, _packed(
                np.array(doc_ids, np.int64), np.fromiter(map(len, held), np.int64, len(held)), np.concatenate(held), part,
                np.fromiter(map(len, known), np.int64, len(known)), np.array([x for k in known for x in k], np.int32),
            ))]
            rows += [(k, _packed(np.fromiter(map(len, d), np.uint16, len(d)), np.frombuffer(b"".join(d), np.uint8))) for k, d in enumerate(dealt) if d]
            out = pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + serial] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["block", "part", "data"]
            )
            serial += 1
            doc_ids, held, size = [], [], 0
            cutter.reset()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                held += cutter.cut(b["text"])
                doc_ids += b["doc_id"].to_pylist()
                size += b["text"].nbytes
                if size >= block_bytes or len(cutter.index) >= BLOCK_WORDS:
                    yield block()
        if held:
            yield block()
        give_back()

    return docs.mapInArrow(run, _BLOCK)


def _distinct_words(path: str, run_bytes: int) -> object:
    """Rows come by part: emit a run's distinct words, as arrays of byte ids, then each of its blocks' places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        part, index, uses, held = None, {}, [], 0

        def row(block: int, words: list[bytes], data: bytes) -> pa.RecordBatch:
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)), pa.array(byte_ids[np.frombuffer(b"".join(words), np.uint8)]))
            outer = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), inner)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary()), outer], names=["block", "part", "data", "words"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index, uses, held
            words = list(index)
            for at in range(0, len(words), 2000):
                yield row(-1, words[at : at + 2000], b"")
            for block, places in uses:
                yield row(block, [], places.tobytes())
            index, uses, held = {}, [], 0

        for b in batches:
            for block, k, blob in zip(b["block"].to_pylist(), b["part"].to_pylist(), b["data"], strict=True):
                if k != part:
                    if part is not None:
                        yield from flush()
                    part = k
                sizes, raw = _unpacked(blob.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                data = raw.tobytes()
                uses.append((block, np.array([index.setdefault(data[s:e], len(index)) for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int32)))
                held += uses[-1][1].nbytes + 200
                if held > run_bytes:
                    yield from flush()
        if part is not None:
            yield from flush()
        give_back()

    return run


def _dealt_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and run: its words' ids, then its blocks' places; emit each block's ids, packed."""
    part, sizes, flats = None, [], []
    size = flat = start = None
    for b in batches:
        out: list[tuple[int, int, bytes]] = []
        for i in range(b.num_rows):
            k, block = b["part"][i].as_py(), b["block"][i].as_py()
            if k != part or block < 0 and size is not None:
                part, sizes, flats, size = k, [], [], None
            if block < 0:
                ids = b["ids"][i].values
                sizes.append(np.asarray(pc.list_value_length(ids)))
                flats.append(np.asarray(ids.flatten()))
                continue
            if size is None:
                size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flats)
                start = np.cumsum(size) - size
            places = np.frombuffer(b["data"][i].as_py(), np.int32)
            n = size[places]
            ends = np.cumsum(n)
            ids = flat[np.repeat(start[places] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            out.append((block, k, _packed(n.astype(np.uint16), ids.astype(np.int32))))
        if out:
            blocks, parts, data = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "data"])
    sizes, flats, size, flat, start = [], [], None, None, None
    give_back()


def _parts(docs: DataFrame) -> int:
    """As many as shuffle partitions, more for a large input (by Catalyst's estimate of its size)."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= 1 << 62:  # Spark's word for unknown
        estimate = 0
    return min(_KNOWN - 1, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimate // PART_BYTES))


def encode(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, run_bytes: int = RUN_BYTES, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): each document's ids as little-endian unsigned 32-bit integers; ``decoded``: and the bytes they decode to."""
    parts = _parts(slim_docs(docs))
    folder = f"{shared_dir(docs.sparkSession)}/bpe-blocks-{uuid.uuid4().hex}"
    # Small row groups: a reader of one block touches little else.
    _blocks(slim_docs(docs), path, pattern, parts, block_bytes).write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(folder)
    blocks = docs.sparkSession.read.schema(_BLOCK).parquet(folder)
    by_part = blocks.where("part >= 0").repartition("part").sortWithinPartitions("part", "block")
    words = by_part.mapInArrow(_distinct_words(path, run_bytes), "block long, part int, data binary, words array<array<int>>")
    ranks = load_ranks(path)
    folded = words.select("block", "part", "data", F.transform("words", lambda w: fold(w, ranks)).alias("ids"))
    # Written, so that the plan after it, and what Spark notes of that, does not hold the rank literals.
    back = written(folded.mapInArrow(_dealt_back, _BLOCK), "bpe-ids")
    # A head carries the file that holds its block's documents: they are read there, no task lists the folder.
    heads = blocks.where("part < 0").select("block", "part", F.encode(F.col("_metadata.file_path"), "utf-8").alias("data"))
    rows = heads.unionByName(back).repartition("block").sortWithinPartitions("block", "part")
    return rows.mapInArrow(_assembled(path if decoded else None), "doc_id long, ids binary" + ", decoded binary" * decoded)


def _documents(name: str, block: int) -> bytes:
    """A block's packed documents, from the file where they were written; its statistics tell the row group."""
    where, path = file_system(unquote(name))
    with where.open_input_file(path) as source:
        table = pq.ParquetFile(source)
        for g in range(table.num_row_groups):
            told = table.metadata.row_group(g).column(0).statistics
            if told is not None and told.has_min_max and not told.min <= block <= told.max:
                continue
            at = table.read_row_group(g, columns=["block", "part"])
            hit = np.flatnonzero((at["block"].to_numpy() == block) & (at["part"].to_numpy() < 0))
            if len(hit):
                return table.read_row_group(g, columns=["data"])["data"][int(hit[0])].as_py()
    raise LookupError(f"block {block} is not in {name}")


def _assembled(path: str | None) -> Callable:
    """Rows come by block: its head first, then its words' ids part by part.  With a path of ranks the ids are decoded too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: int | None = None
        file = ""
        sizes: list[np.ndarray] = []
        flats: list[np.ndarray] = []
        decoder = _decoder(path) if path else None

        def finish() -> Iterator[pa.RecordBatch]:
            doc_ids, n_words, words, part, known_sizes, known = _unpacked(_documents(file, held))
            order = np.argsort(part, kind="stable")
            ordered = np.concatenate([*sizes, known_sizes]).astype(np.int64)
            flat = np.concatenate([*flats, known]).astype("<u4")
            size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            size[order], start[order] = ordered, np.cumsum(ordered) - ordered
            edges = np.concatenate(([0], np.cumsum(n_words)))
            for at in range(0, len(doc_ids), 1000):
                here = words[edges[at] : edges[min(at + 1000, len(doc_ids))]]
                n = size[here]
                ends = np.cumsum(n)
                ids = flat[np.repeat(start[here] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
                cuts = np.concatenate(([0], ends))[edges[at : at + 1001] - edges[at]]
                rows = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                out = [pa.array(doc_ids[at : at + 1000], pa.int64()), pa.array(rows, pa.binary())]
                if decoder:
                    out.append(pa.array([decoder(np.frombuffer(x, "<u4")) for x in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"][: len(out)])

        for b in batches:
            for block, k, data in zip(b["block"].to_pylist(), b["part"].to_pylist(), b["data"], strict=True):
                if k < 0:
                    if held is not None:
                        yield from finish()
                    held, file, sizes, flats = block, data.as_py().decode(), [], []
                else:
                    n, ids = _unpacked(data.as_py())
                    sizes.append(n)
                    flats.append(ids)
        if held is not None:
            yield from finish()
        held, sizes, flats = None, [], []
        give_back()

    return run


def _decoder(path: str) -> Callable[[np.ndarray], bytes]:
    """The byte strings of ids, concatenated."""
    ranks = load_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size

    def of(ids: np.ndarray) -> bytes:
        n = size[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(start[ids] - (ends - n), n) + np.arange(total)].tobytes()

    return of


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the byte strings of a row's ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for b in batches:
            out = [decoder(np.frombuffer(x.as_buffer(), "<u4")) for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(returning(run), schema)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the round trip."""
    both = encoded if "decoded" in encoded.columns else decode(encoded, path)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
