"""Operator 9: n-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles.  In each of several independent runs a
set picks a few of its tokens by a hash threshold (about 1/RATE of them), every
picked token is a node of the run's tree, and sets that picked the same token
meet there.  A node with more than LIMIT sets is split again by tokens picked
with a hash of the path so far, down to DEPTH.  Sets of similarity s share a
node of a run with a probability that the runs drive to the target recall: at
0.8, 0.99995 over 8 runs at the first level and 0.997 at the third.

Cost control without dropping anything:
* Documents of equal shingle sets are one class with a multiplicity.
* A pair that meets at several nodes is handled at its least common node only;
  so a pair is counted once and no pair is ever shuffled.
* A first pass over slim rows (key, size, 64-byte sketch) finds which sets have
  a pair to verify at which node; only these sets are built from their texts
  and sent there.
* A node that is still large at the last depth is dealt out as pairs of blocks
  of at most BLOCK sets.
* Exact similarity is computed at the node; out come link counts and a
  spanning forest, not pairs.

Defined results: null texts are empty; a text without words has no shingles,
links with nothing and is its own class; a text of one to four words has one
shingle; rows that repeat an id must repeat its text and count as copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, returning, slim_docs, written
from lexmill.llm.decontaminate import words

SHINGLE, THRESHOLD = 5, 0.8
RUNS, RATE, LIMIT, BLOCK, BINS = 8, 0.65, 256, 1024, 64

_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * 2 + 1
_SEEDS = _rng.integers(0, 2**63, RUNS, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts as sorted distinct 64-bit hashes."""

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            return np.cumprod(x, dtype=np.uint64)

        self.power, self.inverse = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def of(self, text: str | None) -> np.ndarray:
        ws = words(text)
        if not ws:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(b" ".join(ws) + b" ", np.uint8)
        if len(raw) >= len(self.power):
            self._grow(2 * len(raw))
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.power[: len(raw)], dtype=np.uint64)))
        ends = np.flatnonzero(raw == 0x20)
        k = min(SHINGLE, len(ends))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - k + 1]
        return np.unique(mix((prefix[ends[k - 1 :]] - prefix[starts]) * self.inverse[starts]))


def sketch(s: np.ndarray) -> bytes:
    """One byte for each of BINS ranges of hashes: of its least member, 0 if it has none."""
    at = np.searchsorted(s, _EDGES)
    inside = at < len(s)
    v = s[np.minimum(at, len(s) - 1)] if len(s) else np.zeros(BINS, np.uint64)
    inside &= (v >> np.uint64(58)) == np.arange(BINS, dtype=np.uint64)
    return np.where(inside, (v >> np.uint64(20)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def paths(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of three levels, and for the second and third the place of their parent."""
    if not len(s):
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.int64), none, none.astype(np.int64), none
    bar = np.uint64(min(1.0, 1 / (RATE * len(s))) * (2**64 - 2049))

    def pick(parents: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(s[None, :] ^ parents[:, None])
        p, t = np.nonzero(h <= bar)
        return p, mix(h[p, t] * np.uint64(2) + np.uint64(salt))

    k1 = pick(_SEEDS, 1)[1]
    p2, k2 = pick(k1, 3)
    p3, k3 = pick(k2, 5)
    return k1, p2, k2, p3, k3


_SETS = "doc_id long, digest binary, n int, sketch binary, l1 array<long>, l2 array<struct<p:int,k:long>>, l3 array<struct<p:long,k:long>>"


def _listed(rows: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.array(offsets, pa.int32()), np.concatenate(rows) if rows else np.zeros(0)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            digest, n, sk, cols = [], [], [], [[] for _ in range(5)]
            for text in b["text"].to_pylist():
                s = shingler.of(text)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                sk.append(sketch(s))
                k1, p2, k2, p3, k3 = paths(s)
                for c, x in zip(cols, (k1.view(np.int64), p2, k2.view(np.int64), k2.view(np.int64)[p3], k3.view(np.int64)), strict=True):
                    c.append(x)
            o1, v1 = _listed(cols[0])
            o2, v2 = _listed(cols[2])
            o3, v3 = _listed(cols[4])
            l2 = pa.StructArray.from_arrays([pa.array(_listed(cols[1])[1].astype(np.int32)), pa.array(v2, pa.int64())], ["p", "k"])
            l3 = pa.StructArray.from_arrays([pa.array(_listed(cols[3])[1], pa.int64()), pa.array(v3, pa.int64())], ["p", "k"])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()),
                 pa.ListArray.from_arrays(o1, pa.array(v1, pa.int64())), pa.ListArray.from_arrays(o2, l2), pa.ListArray.from_arrays(o3, l3)],
                names=["doc_id", "digest", "n", "sketch", "l1", "l2", "l3"],
            )


def _nodes(reps: DataFrame, limit: int) -> DataFrame:
    """(rep, key, n): the nodes at which a set is compared; n sets meet there, two at least."""

    def counted(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return written(rows.join(n, "key"), "jaccard-nodes")

    level = counted(reps.select("rep", F.explode(F.array_distinct("l1")).alias("key")))
    found = level.where(F.col("n") <= limit)
    large = level.where(F.col("n") > limit)
    if not large.isEmpty():
        # l2 names its parent by place in l1; l3 by the parent's key.
        kids = reps.join(large.groupBy("rep").agg(F.collect_set("key").alias("open")), "rep")
        pairs = kids.select("rep", "l3", F.explode(F.filter("l2", lambda x: F.array_contains("open", F.get("l1", x["p"])))).alias("x"))
        level2 = counted(pairs.select("rep", F.col("x.k").alias("key")).distinct())
        large2 = level2.where(F.col("n") > limit)
        found = found.unionByName(level2.where(F.col("n") <= limit))
        if not large2.isEmpty():
            kids2 = reps.select("rep", "l3").join(large2.groupBy("rep").agg(F.collect_set("key").alias("open")), "rep")
            triples = kids2.select("rep", F.explode(F.filter("l3", lambda x: F.array_contains("open", x["p"]))).alias("x"))
            found = found.unionByName(counted(triples.select("rep", F.col("x.k").alias("key")).distinct()))
    return found.select("rep", "key", "n")


def _first_common(keys: list[np.ndarray], key: int) -> np.ndarray:
    """True where two sets have no common node before this one."""
    m = len(keys)
    own = np.ones((m, m), bool)
    where: dict[int, list[int]] = {}
    for i, ks in enumerate(keys):
        for k in ks[: np.searchsorted(ks, key)].tolist():
            where.setdefault(k, []).append(i)
    for at in where.values():
        if len(at) > 1:
            own[np.ix_(at, at)] = False
    np.fill_diagonal(own, False)
    return own


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of equal values in sorted rows, across batches; a run is one node's sets or block pair."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b[column].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(v)) + 1).tolist(), b.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0][column][0].as_py() != v[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
    if held:
        yield pa.Table.from_batches(held)


def _keys_of(t: pa.Table) -> list[np.ndarray]:
    return [np.sort(np.array(x, np.int64)) for x in t["keys"].to_pylist()]


def _open_pairs(t: pa.Table, threshold: float) -> np.ndarray:
    """Upper triangle of the pairs to verify here: responsible, of fitting sizes, not both on one side of a block pair."""
    n, side = t["n"].to_numpy(), t["side"].to_numpy()
    ok = _first_common(_keys_of(t), t["key"][0].as_py())
    ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    ok &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    return np.triu(ok, 1)


_OPEN = "rep long, sub long, key long, side int, n int, mult long, keys array<long>"


def _candidates(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _OPEN.split(", ")]
        for t in _grouped(batches, "sub"):
            ok = _open_pairs(t, threshold)
            if not ok.any():
                continue
            n = t["n"].to_numpy()
            sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
            for i in np.flatnonzero(ok.any(axis=1)):
                j = np.flatnonzero(ok[i])
                both = ((sk[j] == sk[i]) & (sk[i] > 0)).sum(axis=1)
                either = ((sk[j] > 0) | (sk[i] > 0)).sum(axis=1)
                # At 0.8 the estimate's deviation is 0.05; small sets are not judged by it.
                ok[i, j] = (np.minimum(n[i], n[j]) < 4 * BINS) | (both >= (threshold - 0.35) * either)
            need = ok.any(axis=0) | ok.any(axis=1)
            if need.any():
                yield from t.filter(pa.array(need)).select(names).combine_chunks().to_batches()

    return run


_SENT = "rep long, sub long, key long, side int, n int, mult long, keys array<long>, tokens binary"


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in _SENT.split(", ")]
    for b in batches:
        rows: list[tuple] = []
        for text, places in zip(b["text"].to_pylist(), b["places"].to_pylist(), strict=True):
            raw = shingler.of(text).tobytes()
            rows += [(p["rep"], p["sub"], p["key"], p["side"], p["n"], p["mult"], p["keys"], raw) for p in places]
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the shared tokens."""
    m = len(sets)
    if m == 2:
        return np.array([[len(sets[0]), x := len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [x, len(sets[1])]])
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int((count > 1).sum())
    out = np.zeros((m, m), np.float32)
    for a in range(0, total, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((m, min(4096, total - a)), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


_FOUND = "a long, b long, links long"


def _verified(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "sub"):
            ok = _open_pairs(t, threshold)
            if not ok.any():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
            n, rep, mult = t["n"].to_numpy().astype(np.int64), t["rep"].to_numpy(), t["mult"].to_numpy()
            inter = intersections(sets)
            ok &= inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9
            if not ok.any():
                continue
            links = (ok @ mult) + (ok.T @ mult)
            root = np.arange(len(rep))
            for i, j in zip(*np.nonzero(ok), strict=True):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    low, high = (i, j) if rep[i] < rep[j] else (j, i)
                    root[high] = low
            for i in range(len(rep)):
                while root[i] != root[root[i]]:
                    root[i] = root[root[i]]
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by hooking to the least neighbour and jumping."""
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b")).distinct(), "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "component-labels")
    last = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(hooked.join(up, "label", "left").select("node", "old", F.coalesce(F.least("label", "above"), "label").alias("label")), "component-labels")
        dropped(last)
        last, labels = new, new.select("node", "label")
        if new.where("label <> old").isEmpty():
            dropped(both)
            return labels


def link(docs: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links): class_id is the least id of the document's component of
    links; n_links counts the other documents of similarity ``threshold`` or more."""
    slim = slim_docs(docs)
    sets = written(slim.mapInArrow(returning(_describe), _SETS), "jaccard-sets")
    some = sets.where("n > 0")
    # Written step by step: the driver plans, and adapts, a few exchanges at a time.
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult")), "jaccard-classes")
    members = some.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep", "mult")
    reps = some.join(classes.select(F.col("rep").alias("doc_id"), "mult"), "doc_id").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])
    reps = written(reps.drop("digest"), "jaccard-reps")
    nodes = written(_nodes(reps.select("rep", "l1", "l2", "l3"), limit), "jaccard-nodes")
    info = reps.select("rep", "n", "sketch", "mult").join(nodes.groupBy("rep").agg(F.collect_set("key").alias("keys")), "rep")
    rows = nodes.withColumnRenamed("n", "sets").join(info, "rep")
    blocks = F.ceil(F.col("sets") / block).cast("int")
    own = F.pmod(F.hash("rep"), blocks)
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(
        "rep", F.xxhash64("key", low, high).alias("sub"), "key", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "n", "mult", "keys", "sketch"
    )
    opened = written(rows.repartition("sub").sortWithinPartitions("sub").mapInArrow(returning(_candidates(threshold)), _OPEN), "jaccard-open")
    dropped(reps, nodes)
    places = opened.groupBy("rep").agg(F.collect_list(F.struct("rep", "sub", "key", "side", "n", "mult", "keys")).alias("places"))
    texts = slim.join(places, F.col("doc_id") == F.col("rep")).dropDuplicates(["rep"]).select("text", "places")
    sent = texts.mapInArrow(returning(_with_sets), _SENT)
    found = written(sent.repartition("sub").sortWithinPartitions("sub").mapInArrow(returning(_verified(threshold)), _FOUND), "jaccard-links")
    dropped(opened)
    degrees = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(found).withColumnRenamed("node", "rep")
    by_rep = degrees.join(labels, "rep", "left")
    known = members.join(by_rep, "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    none = sets.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(none)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the least id of each class only; columns unchanged.  Rows without an id stay."""
    gone = link(docs, threshold).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
