"""Retrieval over document lines, embeddings and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import roles
from lexmill.functions.scratch import written
from lexmill.functions.text import round_half_up
from lexmill.operators import blocks as B
from lexmill.operators import search as S
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table

QUERY = "the thing of the station"


def chunks(spark: SparkSession, d: str, query_text: str | None = None) -> DataFrame:
    """Document lines as chunks, artifacts left out; those that a query may match."""
    b = B.line_blocks(table(spark, d, "documents"), None if query_text is None else lambda c: S.may_match(c, query_text))
    # As a generator, the test takes the role as it is: a filter would be moved below it and work every role out twice.
    role = F.explode(F.filter(F.array("semantic_role"), lambda r: roles.indexable(r, F.col("content"))))
    return b.select("doc_id", F.col("block_id").alias("chunk_id"), F.col("content").alias("text"), role.alias("semantic_role"))


def _keyword(query_text: str) -> str:
    own = S.tokens_of(query_text)
    n = len(own)
    c = [f"len(list_filter(toks, lambda t: t = {Q.quoted(q)}))" for q in own]
    overlap = " + ".join(f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE + least({x} - 1, 2) * 0.25::DOUBLE ELSE 0.0::DOUBLE END)" for x in c)
    return f"""{Q.BLOCKS}, t AS (SELECT doc_id, doc_id || '-p-' || position AS chunk_id, content, list_transform(regexp_extract_all(content, {Q.quoted(Q.WORD)}), lambda x: lower(x)) AS toks FROM blocks),
 o AS (SELECT *, 0.0::DOUBLE + {overlap} AS ov FROM t),
 k AS (SELECT *, CASE WHEN len(toks) > 0 AND ov > 0 THEN least(ov / {n} + CASE WHEN contains(lower(content), {Q.quoted(query_text.lower())}) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + least(ov / greatest(len(toks), 1), 0.25::DOUBLE), 1.0::DOUBLE) ELSE 0.0 END AS kw FROM o),
 s AS (SELECT *, {Q.r4('greatest(kw, 0.0) * 1.0')} AS score FROM k)"""


@query("search_topk", f"WITH {_keyword(QUERY)} SELECT chunk_id, doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 10")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.search(chunks(spark, d, QUERY), QUERY, limit=10).select("chunk_id", "doc_id", "score")


@query("keyword_scores", f"WITH {_keyword('with their own')} SELECT doc_id, count(*) AS hits, max(score) AS best FROM s WHERE score > 0 GROUP BY ALL")
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    s = chunks(spark, d, "with their own").select("doc_id", round_half_up(F.greatest(S.keyword_score(F.col("text"), "with their own"), F.lit(0.0))).alias("score"))
    return s.where("score > 0").groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


_COS = """q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qe FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 c AS (SELECT vec_id, greatest(0.0, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))) AS cos FROM v, q)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id = 0").first()["embedding"]  # one vector: the query


@query("vector_topk", f"WITH {_COS} SELECT vec_id, floor(cos * 1e6 + 0.5) / 1e6 AS similarity FROM c ORDER BY floor(cos * 1e6 + 0.5) / 1e6 DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return e.select("vec_id", round_half_up(S.vector_score(F.col("embedding"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


def _documents_scored() -> str:
    """Documents with their keyword score; a document's vector is that of its id."""
    own = S.tokens_of(QUERY)
    c = [f"len(list_filter(toks, lambda t: t = {Q.quoted(q)}))" for q in own]
    overlap = " + ".join(f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE + least({x} - 1, 2) * 0.25::DOUBLE ELSE 0.0::DOUBLE END)" for x in c)
    return f"""t AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, {Q.quoted(Q.WORD)}), lambda x: lower(x)) AS toks FROM documents), o AS (SELECT *, 0.0::DOUBLE + {overlap} AS ov FROM t),
 k AS (SELECT doc_id, CASE WHEN len(toks) > 0 AND ov > 0 THEN least(ov / {len(own)} + CASE WHEN contains(lower(text), {Q.quoted(QUERY.lower())}) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + least(ov / greatest(len(toks), 1), 0.25::DOUBLE), 1.0::DOUBLE) ELSE 0.0 END AS kw FROM o)"""


@query("hybrid_topk", f"""WITH {_documents_scored()}, {_COS}, s AS (SELECT 'd' || k.doc_id AS chunk_id, {Q.r4('greatest(CASE WHEN cos IS NOT NULL THEN 0.7::DOUBLE * cos + 0.3::DOUBLE * kw ELSE kw END, 0.0)')} AS score FROM k LEFT JOIN c ON c.vec_id = k.doc_id)
 SELECT chunk_id, score FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 20""")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.lit("paragraph").alias("semantic_role"))
    return S.search(docs.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left"), QUERY, q, 20).select("chunk_id", "score")


_PAIRS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 c AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0.0, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)))) AS cos FROM v, v AS q WHERE q.vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id, floor(cos * 1e6 + 0.5) / 1e6 AS similarity FROM c)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_topk_all", f"WITH {_PAIRS} SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 20")
def vector_topk_all(spark: SparkSession, d: str) -> DataFrame:
    """``vector_topk`` for every hundredth vector."""
    rows = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding", F.lit(0.0).alias("keyword"), F.lit(1.0).alias("weight"))
    return S.search_all(rows, _queries(spark, d), 20, 6).select("query_id", F.col("id").alias("vec_id"), F.col("score").alias("similarity"))


@query("hybrid_topk_all", f"""WITH {_documents_scored()}, {_PAIRS.replace('s AS (SELECT query_id', 'unused AS (SELECT query_id')}, q AS (SELECT DISTINCT query_id FROM c),
 h AS (SELECT q.query_id, 'd' || k.doc_id AS chunk_id, {Q.r4('greatest(CASE WHEN cos IS NOT NULL THEN 0.7::DOUBLE * cos + 0.3::DOUBLE * kw ELSE kw END, 0.0)')} AS score FROM k, q LEFT JOIN c ON c.vec_id = k.doc_id AND c.query_id = q.query_id)
 SELECT query_id, chunk_id, score FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20""")
def hybrid_topk_all(spark: SparkSession, d: str) -> DataFrame:
    """``hybrid_topk`` with every hundredth vector; the text is scored once."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), S.keyword_score(F.col("text"), QUERY).alias("keyword"), roles.role_weight(F.lit("paragraph")).alias("weight"))
    rows = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    found = S.search_all(rows, _queries(spark, d), 20, 4, S.VECTOR_WEIGHT, S.KEYWORD_WEIGHT)
    return found.where("score > 0").select("query_id", F.col("id").alias("chunk_id"), "score")


@query("retrieval_mode", "SELECT CASE WHEN count(*) FILTER (len(embedding) = 64) > 0 THEN 'hybrid' ELSE 'keyword' END AS mode FROM embeddings")
def retrieval_mode(spark: SparkSession, d: str) -> DataFrame:
    return S.retrieval_mode(table(spark, d, "embeddings"), 64)


@query("embedding_quality", f"SELECT count(*) AS total, count(embedding) AS embedded, {Q.r4('avg(sqrt(list_dot_product(e, e)))')} AS mean_norm FROM (SELECT embedding, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def embedding_quality(spark: SparkSession, d: str) -> DataFrame:
    return S.embedding_quality(table(spark, d, "embeddings")).withColumn("mean_norm", round_half_up(F.col("mean_norm")))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Turns as structure entries: the speaker decides the role, the turn's parity the tags."""
    c = table(spark, d, "conversations")
    role = F.when(F.col("role") == "user", "note").when(F.col("role") == "assistant", "paragraph").otherwise("title")
    tags = F.when(F.col("turn") % 2 == 0, F.array(F.lit("role:a"), F.lit("page:body"))).otherwise(F.array(F.lit("page:toc")))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("entry_id"), "text", role.alias("semantic_role"), tags.alias("tags"))


_ENTRIES = f"""e AS (SELECT conv_id || '-' || turn AS entry_id, text, CASE role WHEN 'user' THEN 'note' WHEN 'assistant' THEN 'paragraph' ELSE 'title' END AS r, turn % 2 = 0 AS even, turn,
   list_transform(regexp_extract_all(text, {Q.quoted(Q.WORD)}), lambda x: lower(x)) AS toks FROM conversations),
 h AS (SELECT *, list_contains(toks, 'the')::INT + list_contains(toks, 'of')::INT + list_contains(toks, 'and')::INT AS hits FROM e),
 s AS (SELECT *, {Q.r4("hits / 3.0::DOUBLE * (CASE r WHEN 'note' THEN 1.1::DOUBLE WHEN 'title' THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END) + 0.02::DOUBLE * (CASE WHEN even THEN 2 ELSE 1 END)")} AS score FROM h WHERE hits > 0)"""


@query("structure_topk", f"WITH {_ENTRIES} SELECT entry_id, score FROM s WHERE r = 'note' AND even ORDER BY score DESC, entry_id LIMIT 10")
def structure_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.structure_search(entries(spark, d), "the of and", 10, role="note", tags=["role:a"]).select("entry_id", "score")


@query("task_topk", f"WITH {_ENTRIES}, w AS (SELECT * FROM s ORDER BY score DESC, entry_id LIMIT 60) SELECT entry_id, score FROM w WHERE r = 'note' OR (even AND regexp_matches(trim(text), '^(?i:\\d+(?:\\.\\d+)*[.)]|\\([a-z]\\)|step\\s+\\d+|task\\s+\\d+)')) ORDER BY score DESC, entry_id LIMIT 20")
def task_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.task_search(entries(spark, d), "the of and", 20).select("entry_id", "score")


@query("reranked", f"""WITH {_keyword(QUERY)}, w AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 30), r AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100) / 100.0 END AS rr FROM w)
 SELECT chunk_id, rr AS rerank FROM r ORDER BY rr IS NULL, rr DESC, score DESC, chunk_id LIMIT 10""")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    hits = written(S.search(chunks(spark, d, QUERY), QUERY, limit=30), "hits")  # the corpus is searched once, for hits and scores
    scores = hits.where("doc_id % 3 = 0").select("chunk_id", ((F.col("doc_id") % 100) / 100.0).alias("rerank"))
    return S.rerank(hits, scores, 10).select("chunk_id", "rerank")


@query("high_precision_layer", f"WITH {Q.BLOCKS} SELECT doc_id, count(*) AS chunks FROM blocks WHERE length(content) >= 120 OR ({Q.role('content')}) IN ('title', 'note', 'warning', 'caution', 'table', 'body_section') GROUP BY ALL")
def high_precision_layer(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where(roles.high_precision(F.col("semantic_role"), F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("search_token_counts", f"SELECT item_id, CAST({Q.count('text', Q.WORD)} AS INTEGER) AS tokens FROM benchmark")
def search_token_counts(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.functions.text import search_tokens

    return table(spark, d, "benchmark").select("item_id", F.size(search_tokens(F.col("text"))).alias("tokens"))
