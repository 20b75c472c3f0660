"""Operator 2: quality classifier by Naive Bayes support vectors.

A text becomes the set of its hashed word and shape n-grams (indicators).  Each
indicator is scaled by its class log-count ratio (smoothed share among label-1
rows over its share among label-0 rows), and a linear model with hinge loss is
fitted to the scaled, length-normalised vectors by dual coordinate descent.
A logistic curve fitted to the margins turns them into scores.

The fit reads a bounded sample of labelled rows (``max_per_class``, those of
smallest id hash in each class; the bound is the documented parameter that
keeps the driver's share constant); scoring covers every row in one pass
without a shuffle.  Labels, language, source and id are not inputs of a score.

Defined results: null and empty texts get the score of a text without n-grams;
labels that are null, belong to no document or contradict each other are not
used; of rows that repeat an id the one with the least text hash is learned
from; without rows of both classes every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import give_back, returning, slim_docs

BUCKETS = 1 << 18
MAX_PER_CLASS = 3000
THRESHOLD = 0.3
HELD_OUT = (5, 0)  # crc32(id as text) mod 5 == 0 is held out
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str, cache: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct buckets of the text's word, word-shape and shape-bigram indicators."""
    cache = {} if cache is None else cache
    found, shapes = set(), []
    for tok in _TOKEN.findall(text):
        known = cache.get(tok)
        if known is None:
            if len(cache) > 100_000:
                cache.clear()
            shape = tok[:3] if not tok[0].isalnum() else "U" if tok.isupper() and len(tok) > 1 else "T" if tok[0].isupper() else "9" if tok[0].isdigit() else "a"
            known = cache[tok] = (xxhash.xxh3_64_intdigest(tok.lower().encode("utf-8", "surrogatepass")) % BUCKETS, shape)
        found.add(known[0])
        shapes.append(known[1])
    for a, b in set(zip(shapes, shapes[1:], strict=False)):
        found.add(xxhash.xxh3_64_intdigest(f"{a}\0{b}".encode("utf-8", "surrogatepass"), seed=1) % BUCKETS)
    for a, b, c in set(zip(shapes, shapes[1:], shapes[2:], strict=False)):
        found.add(xxhash.xxh3_64_intdigest(f"{a}\0{b}\0{c}".encode("utf-8", "surrogatepass"), seed=2) % BUCKETS)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Model:
    """weights: per bucket, log-count ratio times hinge-loss weight; score = 1/(1+exp(-(slope*margin+offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum() / np.sqrt(max(1, len(buckets))) + self.bias)

    def score(self, buckets: np.ndarray) -> float:
        z = self.slope * self.margin(buckets) + self.offset
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12) -> np.ndarray:
    """min over w of |w|^2/2 + sum cost_i * max(0, 1 - y_i w.x_i); rows are (indices, values)."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    order = np.arange(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        largest = 0.0
        for i in order:
            if not square[i]:
                continue
            idx, val = rows[i]
            g = y[i] * float(w[idx] @ val) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                largest = max(largest, abs(step))
                w[idx] += step * y[i] * val
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton steps with his smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(d @ margin) + 1e-3 * a, float(d.sum())
        haa, hab, hbb = float(h @ margin**2) + 1e-3, float(h @ margin), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        sa, sb = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - sa, b - sb
        if abs(sa) + abs(sb) < 1e-7:
            break
    return a, b


def fit_rows(sample: list[tuple[np.ndarray, int]], smoothing: float = 1.0, c: float = 1.0) -> Model:
    y = np.array([1.0 if q else -1.0 for _, q in sample])
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    counts = {s: np.full(BUCKETS, smoothing) for s in (1.0, -1.0)}
    for (buckets, _), s in zip(sample, y, strict=True):
        counts[s][buckets] += 1
    ratio = np.log(counts[1.0] / (smoothing + (y > 0).sum())) - np.log(counts[-1.0] / (smoothing + (y < 0).sum()))
    share = {s: len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    rows = []
    for buckets, _ in sample:
        idx = np.append(buckets, BUCKETS)
        rows.append((idx, np.append(ratio[buckets] / np.sqrt(max(1, len(buckets))), 1.0)))
    w = dual_coordinate_descent(rows, y, c * np.array([share[s] for s in y]), BUCKETS + 1)
    margin = np.array([float(w[i] @ v) for i, v in rows])
    slope, offset = _logistic(margin, y)
    return Model(ratio * w[:-1], float(w[-1]), slope, offset)


def _fold(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Learn from labelled rows outside the held-out fold, at most ``max_per_class`` of each class."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~_fold())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least").drop("least")
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * max_per_class slim rows: a proven bound for the broadcast.
    picked = slim_docs(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            rows = [features(t, cache).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array(rows, pa.binary())], names=["doc_id", "quality", "buckets"])

    got = picked.mapInArrow(returning(hashed), "doc_id long, quality int, buckets binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["buckets"]))
    return fit_rows([(np.frombuffer(r["buckets"], np.int32), r["quality"]) for r in got])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    fields = model.weights.astype(np.float32), model.bias, model.slope, model.offset

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = Model(*fields), {}
        for b in batches:
            out = pa.array([m.score(features(t, cache)) for t in b["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), out], names=["doc_id", "score"])

    got = slim_docs(docs).mapInArrow(returning(scored), "doc_id long, score double")
    return got.select("doc_id", _fold().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; columns unchanged."""
    fields = model.weights.astype(np.float32), model.bias, model.slope, model.offset

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = Model(*fields), {}
        for b in batches:
            yield b.filter(pa.array([m.score(features(t or "", cache)) >= threshold for t in b["text"].to_pylist()], pa.bool_()))
        cache.clear()
        give_back()

    return docs.mapInArrow(kept, docs.schema)
