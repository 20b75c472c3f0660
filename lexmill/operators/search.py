"""Retrieval: keyword, vector, hybrid, structure and task search, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import roles, text

VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
QUERY_BLOCK, ROW_BLOCK = 2048, 1024  # vectors multiplied at a time: 16 MB of scores


def tokens_of(query: str) -> list[str]:
    """The query's tokens, duplicates kept; the same rule as the column kernel ``search_tokens``."""
    import re

    out: list[str] = []
    for run in re.findall("[㐀-䶿一-鿿\U00020000-\U0002fa1f]+|[^\\W㐀-䶿一-鿿\U00020000-\U0002fa1f]+", query):
        if "㐀" <= run[0] <= "鿿" and not run[0].isascii() or run[0] >= "\U00020000":
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        else:
            out.append(run.lower())
    return out


def _let(value: Column, then: object) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def keyword_score(body: Column, query: str) -> Column:
    """Sum over query tokens of 1 + .25 * min(count - 1, 2) over their number, plus .25 for the
    phrase, plus the density up to .25, at most 1.  A text is cut into tokens once."""
    own = tokens_of(query)
    if not own:
        return F.lit(0.0)
    phrase = F.when(F.instr(F.lower(body), query.strip().lower()) > 0, 0.25).otherwise(0.0)

    def scored(found: Column) -> Column:
        counts = F.transform(F.array(*map(F.lit, own)), lambda q: F.size(F.filter(found, lambda t: t == q)))
        overlap = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, 1.0 + F.least(c - 1, F.lit(2)) * 0.25).otherwise(0.0))
        score = lambda o: F.when(o > 0, F.least(o / len(own) + phrase + F.least(o / F.greatest(F.size(found), F.lit(1)), F.lit(0.25)), F.lit(1.0))).otherwise(0.0)
        return F.when(F.size(found) == 0, 0.0).otherwise(_let(overlap, score))

    return _let(text.search_tokens(body), scored)


def may_match(body: Column, query: str) -> Column:
    """Whether a text holds any token of the query at all: cheaper than its score, and never false where that is above 0."""
    low, hit = F.lower(body), F.lit(False)
    for token in dict.fromkeys(tokens_of(query)):
        hit = hit | F.contains(low, F.lit(token))
    return F.coalesce(hit, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_score(v: Column, query: list[float] | None) -> Column:
    """max(0, cosine); null where a vector is missing or of another size; 0 for a zero vector."""
    if query is None:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))
    return F.when(v.isNotNull() & (F.size(v) == len(query)), F.when(norm > 0, F.greatest(F.lit(0.0), dot(v, q) / norm)).otherwise(0.0))


def search(chunks: DataFrame, query: str, embedding: list[float] | None = None, limit: int = 10) -> DataFrame:
    """The best chunks by role-weighted hybrid score: ties by id, scores of 0 dropped; a top-k plan, no full sort.

    Zeros are dropped after the limit, where they can only be last: a filter below it would score twice."""
    k = keyword_score(F.col("text"), query)
    v = vector_score(F.col("embedding"), embedding) if "embedding" in chunks.columns else F.lit(None).cast("double")
    if "embedding" not in chunks.columns or embedding is None:  # without vectors only the keywords score
        chunks = chunks.where(may_match(F.col("text"), query))
    s = chunks.select("*", k.alias("keyword"), v.alias("vector"))
    both = F.when(F.col("vector").isNotNull(), VECTOR_WEIGHT * F.col("vector") + KEYWORD_WEIGHT * F.col("keyword")).otherwise(F.col("keyword"))
    s = s.withColumn("score", text.round_half_up(F.greatest(both, F.lit(0.0)) * roles.role_weight(F.coalesce("semantic_role", F.lit("paragraph")))))
    return s.orderBy(F.desc("score"), "chunk_id").limit(limit).where("score > 0").drop("keyword", "vector")


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (id, embedding, keyword, weight) of a partition as matrices, a row of the result for each vector size; size 0 has no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= 4 * ROW_BLOCK:
                yield from pack(held)
                held, count = [], 0
        if count:
            yield from pack(held)

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        size = np.array([0 if v is None else v for v in pa.compute.list_value_length(t["embedding"]).to_pylist()])
        for d in np.unique(size):
            part = t.take(np.flatnonzero(size == d)).combine_chunks()
            m = part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes() if d else b""
            one = lambda c: [part[c].to_numpy().astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(d)], pa.int32()), pa.array([part["id"].to_pylist()], pa.list_(part.schema.field("id").type)), pa.array([m]), pa.array(one("keyword")), pa.array(one("weight"))],
                names=["size", "ids", "vectors", "keyword", "weight"],
            )

    return rows.select("id", "embedding", F.col("keyword").cast("double").alias("keyword"), F.col("weight").cast("double").alias("weight")).mapInArrow(run, f"size int, ids array<{kind}>, vectors binary, keyword binary, weight binary")


def search_all(rows: DataFrame, queries: DataFrame, limit: int, digits: int, vector_weight: float = 1.0, keyword_weight: float = 0.0) -> DataFrame:
    """(query_id, id, score): for every query vector the best rows by (score, id), exactly; all pairs are scored, in blocks.

    Rows: id, embedding, keyword, weight; queries: query_id long, embedding.  A row without a vector of the query's size
    scores by keyword alone where keywords count, else not at all.  Packed rows meet packed queries as a product of
    partitions, so nothing is broadcast; a task keeps ``limit`` rows a query."""
    kind = rows.schema["id"].dataType.simpleString()
    n = queries.count()
    q = queries.where("embedding is not null").select(F.col("query_id").alias("id"), "embedding", F.lit(0.0).alias("keyword"), F.lit(1.0).alias("weight"))
    q = _packed(q.repartition(max(1, -(-n // QUERY_BLOCK))), "bigint").select(F.col("size").alias("q_size"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = _packed(rows, kind).hint("shuffle_replicate_nl").crossJoin(q)

    def unit(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
        m = np.frombuffer(raw, "<f4").reshape(-1, size).astype("f8")
        return m, np.sqrt((m * m).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["q_size"] == 0 or r["size"] != r["q_size"] and not keyword_weight:
                    continue
                ids, keyword, weight = np.array(r["ids"]), np.frombuffer(r["keyword"]), np.frombuffer(r["weight"])
                order = np.argsort(ids, kind="stable")
                m, norms = unit(r["vectors"], r["size"]) if r["size"] == r["q_size"] else (None, None)
                qs, q_norms = unit(r["q_vectors"], r["q_size"])
                for at in range(0, len(order), ROW_BLOCK):
                    own = order[at : at + ROW_BLOCK]
                    for k in range(0, len(qs), QUERY_BLOCK):
                        if m is None:
                            s = np.broadcast_to(keyword[own], (len(qs[k : k + QUERY_BLOCK]), len(own)))
                        else:
                            norm = q_norms[k : k + QUERY_BLOCK, None] * norms[own]
                            cos = np.divide(qs[k : k + QUERY_BLOCK] @ m[own].T, norm, out=np.zeros_like(norm), where=norm > 0)
                            s = vector_weight * np.maximum(cos, 0) + keyword_weight * keyword[own] if keyword_weight else np.maximum(cos, 0)
                        whole = np.floor(np.maximum(np.nan_to_num(s), 0) * weight[own] * 10**digits + 0.5).astype("i8")
                        key = (whole << 11) + (ROW_BLOCK - np.arange(len(own)))  # no two equal: by score, then by id
                        top = np.argpartition(-key, limit - 1, 1)[:, :limit] if len(own) > limit else np.broadcast_to(np.arange(len(own)), whole.shape)
                        v, i = np.take_along_axis(whole, top, 1), ids[own][top]
                        name = tuple(r["q_ids"][k : k + QUERY_BLOCK])
                        if name in best:
                            v, i = np.concatenate([best[name][0], v], 1), np.concatenate([best[name][1], i], 1)
                        keep = np.lexsort((i, -v), axis=1)[:, :limit]
                        best[name] = np.take_along_axis(v, keep, 1), np.take_along_axis(i, keep, 1)
        for name, (v, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(name, "i8"), v.shape[1])), pa.array(i.ravel().tolist()), pa.array(v.ravel() / 10**digits)], names=["query_id", "id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = pairs.mapInArrow(run, f"query_id long, id {kind}, score double")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def retrieval_mode(chunks: DataFrame, dimension: int) -> DataFrame:
    return chunks.agg(F.when(F.coalesce(F.bool_or(F.size("embedding") == dimension), F.lit(False)), "hybrid").otherwise("keyword").alias("mode"))


def structure_search(entries: DataFrame, query: str, limit: int = 10, role: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Share of the query's tokens in the text, weighted by role, plus .02 for each tag."""
    own = tokens_of(query)
    found = text.search_tokens(F.col("text"))
    hits = sum((F.array_contains(found, q).cast("int") for q in own), F.lit(0))
    s = entries.where(F.col("semantic_role") == role) if role else entries
    if tags:
        s = s.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    score = F.when(hits > 0, hits / F.lit(float(len(own) or 1)) * roles.role_weight(F.col("semantic_role")) + 0.02 * F.size("tags")).otherwise(0.0)
    return s.withColumn("score", text.round_half_up(score)).orderBy(F.desc("score"), "entry_id").limit(limit).where("score > 0")


def task_search(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Structure search for three times the limit, then the task-like ones of it."""
    wide = structure_search(entries, query, limit * 3)
    return wide.where(roles.task_like(F.col("semantic_role"), F.col("tags"), F.col("text"))).orderBy(F.desc("score"), "entry_id").limit(limit)


def rerank(hits: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Hits with a provider's scores: scored ones first by it, then by retrieval score; scores outside [0, 1] do not count."""
    good = scores.where("rerank between 0 and 1").groupBy("chunk_id").agg(F.max("rerank").alias("rerank"))
    return hits.join(good, "chunk_id", "left").orderBy(F.col("rerank").isNull(), F.desc("rerank"), F.desc("score"), "chunk_id").limit(limit)


def fake_embedding(body: Column, index: Column, size: int = 8) -> Column:
    """Deterministic stand-in for a provider: [index, length, 0, ...]."""
    return F.concat(F.array(index.cast("float"), F.char_length(body).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), size - 2))


def embedding_quality(chunks: DataFrame) -> DataFrame:
    e = F.col("embedding")
    return chunks.agg(F.count("*").alias("total"), F.count(e).alias("embedded"), text.round_half_up(F.avg(F.sqrt(dot(e, e)))).alias("mean_norm"))
