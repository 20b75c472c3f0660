"""Operator 10: token ids in binary shards.

Texts are encoded with the tokenizers library, ids are counted over all
documents, and the files hold frequency ranks (the commonest id is 0) in
byte-aligned variable-length coding: two bits per value in separate control
bytes say how many bytes it takes.  Readers decode by numpy table lookup.

The tokenizer never joins characters across white space, nor signs to a letter
or digit before them, and it lower-cases; so each distinct word
is encoded once per task and texts are put together from words; a text with the control characters U+001C to U+001F, which the two
libraries class differently, is encoded whole.

Shard layout (little-endian): 8 bytes magic, uint32 version, uint32 n_docs,
uint64 n_ids, int64 doc ids, uint32 ids per document, control bytes, data
bytes.  ``ranks.bin`` beside the shards lists the ids by rank as uint32.

Defined results: null and empty texts hold the end id only; repeated ids of
documents are kept, in the order of their texts' ids.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, file_system, give_back, shared_dir, slim_docs, written

MAGIC, VERSION = b"LXMLTOK1", 1
CACHE_PIECES = 1_000_000
SLICE_BYTES = 48 << 20
SIGNS = "".join(c for c in string.punctuation if c != "'")
LENGTHS = np.array([[(c >> (2 * k)) & 3 for k in range(4)] for c in range(256)], np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8)[None, :] < size[:, None]] = raw
    return out.view(np.uint32).reshape(-1)


class PieceEncoder:
    """Token ids of whole texts from those of their pieces between white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 0xFFFF
        self.type = np.uint32 if self.wide else np.uint16
        self.cache: dict[str, bytes] = {}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cores, tails = [], []
        for p in pieces:
            if p.isascii() or max(p) < "\u0250" and "\u0130" not in p:
                p = p.lower()
            # A run of signs after a letter or digit is a word of its own; an apostrophe may open a contraction.
            core = p.rstrip(SIGNS)
            if not core or len(core) == len(p) or core[-1] > "\u024f" or core[-1] == "\u0130" or not core[-1].isalnum() or "<|" in p:
                core = p
            cores.append(core)
            tails.append(p[len(core) :])
        new = [p for p in dict.fromkeys((*cores, *filter(None, dict.fromkeys(tails)))) if p not in self.cache]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[p] = np.array(e.ids, self.type).tobytes()
        return [self.cache[c] + self.cache[t] if t else self.cache[c] for c, t in zip(cores, tails, strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(texts)
        codes = lists.flatten().dictionary_encode()
        ids = self._pieces(codes.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.type).itemsize
        flat = np.frombuffer(b"".join(ids), self.type)
        begin = np.cumsum(size) - size
        index = codes.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(begin[index] - (ends - n), n) + np.arange(total)] if total else flat
        cut = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        found = [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i in np.flatnonzero(odd):
            found[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, self.type)
        return found


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids with the end id as little-endian unsigned numbers of 2 or 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder(path)
        end = np.array([end_id], coder.type).tobytes()
        for whole in batches:
            # As many rows at a time as SLICE_BYTES of text: a word is looked at once a slice.
            step = max(1, min(whole.num_rows, SLICE_BYTES * whole.num_rows // max(1, whole["text"].nbytes)))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                rows = [x.tobytes() + end for x in coder.encode(b["text"])]
                yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "ids"])
        coder.cache.clear()
        give_back()

    return slim_docs(docs).mapInArrow(run, "doc_id long, ids binary")


def frequencies(ids: DataFrame, vocab: int, kind: type) -> np.ndarray:
    """Counts of each id over all documents: each task counts its rows, the tasks' counts are summed by id;
    at most a row for each id of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in b["ids"]), kind), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    got = np.zeros(vocab, np.int64)
    sums = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    got[sums["id"].to_numpy()] = sums["n"].to_numpy()
    return got


def _write(where: fs.FileSystem, path: str, data: bytes) -> None:
    """Whole under its name or not at all, so that a task that is run again does no harm."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(part) as out:
        out.write(data)
    where.move(part, path)


def shard(doc_ids: list[int], sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = MAGIC + struct.pack("<IIQ", VERSION, len(doc_ids), len(ranks))
    return head + np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + control + data


def read_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, ranks)."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token shard")
    _, docs, n = struct.unpack_from("<IIQ", blob, 8)
    at = 24
    doc_ids = np.frombuffer(blob, "<i8", docs, at)
    sizes = np.frombuffer(blob, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    groups = -(-n // 4)
    return doc_ids, sizes, unpack(blob[at : at + groups], blob[at + groups :], n)


def _name(part: int, serial: int) -> str:
    return f"tokens-{part:06d}-{serial:06d}.bin"


def write_shards(ids: DataFrame, path: str, counts: np.ndarray, kind: type, shard_ids: int = 4_000_000) -> dict[str, int]:
    """Write the shards in ascending order of document, each task its own; returns how many ids stand before each shard.

    What comes to the driver, and goes to the readers, is one number for a shard, that is for ``shard_ids`` ids."""
    order = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    where, root = file_system(path)
    where.create_dir(root, recursive=True)
    _write(where, f"{root}/ranks.bin", order.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, folder = file_system(path)
        part = TaskContext.get().partitionId()
        totals: list[int] = []
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal held_ids, held, size
            if held_ids:
                _write(there, f"{folder}/{_name(part, len(totals))}", shard(held_ids, [len(x) for x in held], rank_of[np.concatenate(held)]))
                totals.append(size)
            held_ids, held, size = [], [], 0

        for b in batches:
            for d, x in zip(b["doc_id"].to_pylist(), b["ids"], strict=True):
                one = np.frombuffer(x.as_buffer(), kind)
                if size and size + len(one) > shard_ids:
                    flush()
                held_ids.append(d)
                held.append(one.copy())
                size += len(one)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(totals), pa.int32()), pa.array(range(len(totals)), pa.int32()), pa.array(totals, pa.int64())], names=["part", "serial", "total"])
        give_back()

    ranged = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    listed = written(ranged.mapInArrow(run, "part int, serial int, total long"), "token-shards").toArrow().sort_by([("part", "ascending"), ("serial", "ascending")])
    total = listed["total"].to_numpy()
    starts = (np.cumsum(total) - total).tolist()
    return {_name(k, n): at for k, n, at in zip(listed["part"].to_pylist(), listed["serial"].to_pylist(), starts, strict=True)}


def read_store(spark: SparkSession, path: str, starts: dict[str, int]) -> DataFrame:
    """(doc_id, start, ids) from the files: ids as little-endian unsigned 32-bit integers."""
    where, root = file_system(path)
    with where.open_input_stream(f"{root}/ranks.bin") as f:
        order = np.frombuffer(f.read(), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b["path"].to_pylist(), b["content"], strict=True):
                doc_ids, sizes, ranks = read_shard(blob.as_py())
                ids = order[ranks]
                ends = np.cumsum(sizes, dtype=np.int64)
                begin = ends - sizes
                raw = pa.array([ids[a:e].tobytes() for a, e in zip(begin, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(begin + starts[name.rsplit("/", 1)[1]]), raw], names=["doc_id", "start", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(path).select("path", "content")
    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, shard_ids: int = 4_000_000) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back: (doc_id, start, ids)."""
    spark = docs.sparkSession
    coder = PieceEncoder(path)
    vocab, kind = max(coder.tokenizer.get_vocab_size(), end_id + 1), coder.type
    ids = written(encode(docs, path, end_id), "token-ids")
    counts = frequencies(ids, vocab, kind)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    starts = write_shards(ids, folder, counts, kind, shard_ids)
    dropped(ids)
    return read_store(spark, folder, starts)

