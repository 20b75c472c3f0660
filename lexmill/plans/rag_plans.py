"""Coverage of pages, tables and figures; gates, parts and reruns, over line items: an order is a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import coverage as C
from lexmill.operators import rag as R
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table

# A line is a block; every second line a unit, on its page or two pages; every third supplier's table or figure is on the page.
_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey"


def _frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    li = table(spark, d, "lineitem").withColumns({"doc_id": F.col("l_orderkey"), "id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")), "page": F.col("l_linenumber")})
    sk, pk = F.col("l_suppkey"), F.col("l_partkey")
    blocks = li.select("doc_id", F.col("id").alias("block_id"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.when(F.col("l_quantity") > 3, F.col("l_quantity").cast("int")).alias("chars"), F.when(pk % 11 == 0, "skip").alias("index_policy"), F.col("l_returnflag").alias("provider"))
    tid = F.concat(F.lit("t"), (sk % 2).cast("string"))
    raw = li.where("l_partkey % 2 = 0").select(
        "doc_id", F.concat(F.lit("u"), F.col("id")).alias("unit_id"), F.col("page").alias("page_start"), (F.col("page") + (pk % 4 == 0).cast("int")).alias("page_end"), (pk % 10 != 0).alias("should_index"), F.when(pk % 20 == 0, "empty_text").alias("skip_reason"),
        F.array("id").alias("block_ids"), F.when(sk % 3 == 0, F.array(tid)).alias("table_ids"),
    )
    chunks = li.where("l_partkey % 7 <> 0").select("doc_id", F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), F.array("id").alias("block_ids"), F.when(pk % 13 != 0, True).alias("embedded"))
    tables = li.where("l_suppkey % 3 = 0").select("doc_id", tid.alias("table_id"), F.col("page").alias("page_number")).distinct()
    figures = li.where("l_suppkey % 3 = 1").select("doc_id", F.concat(F.lit("f"), F.col("id")).alias("figure_id"), F.col("page").alias("page_number"), F.when(pk % 5 == 0, " ").otherwise("cap").alias("caption"), F.when(pk % 15 == 0, "alt").alias("alt_text"))
    units = R.units(raw, chunks)
    pages = R.pages(blocks, units, chunks, tables, figures)
    return {"units": units, "pages": pages, "summary": R.quality(R.summary(pages, units))}


_BASE = f"""li AS (SELECT l_orderkey AS doc, {_KEY} AS id, l_linenumber AS page, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_returnflag AS pr FROM lineitem),
 c AS (SELECT doc, id, 'c' || id AS chunk, pk % 13 <> 0 AS emb FROM li WHERE pk % 7 <> 0),
 ids AS (SELECT DISTINCT doc, id, chunk, emb FROM c), cu AS (SELECT doc, id, count(DISTINCT chunk) AS n, bool_and(emb) AS emb FROM ids GROUP BY ALL),
 un AS (SELECT li.doc, 'u' || li.id AS unit, page AS p0, page + (pk % 4 = 0)::INT AS p1, pk % 10 <> 0 AS ix, CASE WHEN pk % 20 = 0 THEN 'empty_text' END AS sr, coalesce(n, 0) AS chunks, coalesce(n > 0 AND emb, false) AS emb, CASE WHEN sk % 3 = 0 THEN 't' || sk % 2 END AS tid FROM li LEFT JOIN cu USING (doc, id) WHERE pk % 2 = 0),
 u AS (SELECT *, CASE WHEN ix AND chunks = 0 THEN 'no_chunks_for_indexable_units' WHEN ix AND NOT emb THEN 'chunks_not_embedded' END AS ms FROM un),
 up AS (SELECT *, unnest(range(p0, p1 + 1)) AS page FROM u),
 bp AS (SELECT doc, page, CAST(sum(CASE WHEN pk % 11 <> 0 AND q > 3 THEN floor(q) ELSE 0 END) AS BIGINT) AS chars, count(*) AS blocks FROM li GROUP BY ALL),
 cp AS (SELECT doc, page, count(DISTINCT chunk) AS chunks, bool_and(emb) AS emb FROM (SELECT DISTINCT doc, page, id FROM li) JOIN ids USING (doc, id) GROUP BY ALL),
 pu AS (SELECT doc, page, count(*) AS units, count(*) FILTER (ix) AS ix, count(DISTINCT unit) FILTER (ms LIKE 'no_chunks%') AS uc, count(DISTINCT unit) FILTER (ms = 'chunks_not_embedded') AS ue FROM up GROUP BY ALL),
 tb AS (SELECT doc, page, count(*) AS tables, count(*) FILTER (NOT ok) AS tw FROM (SELECT doc, page, tid, EXISTS (SELECT 1 FROM up WHERE up.doc = t.doc AND up.page = t.page AND up.tid = t.tid AND ix) AS ok FROM (SELECT DISTINCT doc, page, 't' || sk % 2 AS tid FROM li WHERE sk % 3 = 0) t) GROUP BY ALL),
 fg AS (SELECT doc, page, count(*) AS figures, count(DISTINCT id) FILTER (pk % 5 = 0 AND pk % 15 <> 0) AS fm FROM li WHERE sk % 3 = 1 GROUP BY ALL),
 pg AS (SELECT doc, page, chars, blocks, coalesce(chunks, 0) AS chunks, coalesce(emb, false) AS emb, coalesce(units, 0) AS units, coalesce(ix, 0) AS ix, coalesce(uc, 0) AS uc, coalesce(ue, 0) AS ue, coalesce(tables, 0) AS tables, coalesce(tw, 0) AS tw, coalesce(figures, 0) AS figures, coalesce(fm, 0) AS fm
  FROM bp LEFT JOIN cp USING (doc, page) LEFT JOIN pu USING (doc, page) LEFT JOIN tb USING (doc, page) LEFT JOIN fg USING (doc, page)),
 p AS (SELECT *, CASE WHEN chars > 0 AND ix = 0 THEN 'no_indexable_units' WHEN ix > 0 AND (uc > 0 OR chunks = 0) THEN 'no_chunks_for_indexable_units' WHEN chunks > 0 AND NOT emb THEN 'chunks_not_embedded' END AS mr FROM pg)"""


@query("rag_units", f"""WITH {_BASE} SELECT doc AS doc_id, unit AS unit_id, chunks, emb AS embedded, ms AS missing, CASE WHEN NOT ix THEN 'skipped' WHEN ms LIKE 'no%' THEN 'missing_chunks' WHEN ms IS NOT NULL THEN ms ELSE 'covered' END AS state, CASE WHEN NOT ix THEN 'skipped' WHEN ms IS NOT NULL THEN 'failed' ELSE 'processed' END AS status,
 CASE WHEN NOT ix THEN coalesce(sr, 'not_indexable') ELSE coalesce(ms, 'chunked_and_embedded') END AS reason, CASE WHEN NOT ix THEN 'skipped' WHEN emb THEN 'embedded' ELSE 'pending' END AS embedding_state FROM u""")
def rag_units(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d)["units"].select("doc_id", "unit_id", "chunks", "embedded", "missing", "state", "status", "reason", "embedding_state")


@query("rag_pages", f"""WITH {_BASE} SELECT doc AS doc_id, CAST(page AS BIGINT) AS page_number, chars AS parsed_text_chars, blocks, chunks, emb AS embedded, units, ix AS indexable_units, ix - uc AS chunked_units, uc AS unchunked, ue AS unembedded, tables, tw AS tables_without_units, figures, fm AS figures_missing_caption, mr AS missing_reason,
 concat_ws(',', CASE mr WHEN 'no_indexable_units' THEN 'rag_empty_text_page' WHEN 'no_chunks_for_indexable_units' THEN 'rag_units_without_chunks' WHEN 'chunks_not_embedded' THEN 'rag_chunks_not_embedded' END, CASE WHEN tw > 0 THEN 'rag_table_without_unit' END, CASE WHEN fm > 0 THEN 'rag_figure_caption_missing' END) AS codes FROM p""")
def rag_pages(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return _frames(spark, d)["pages"].select(
        "doc_id", F.col("page_number").cast("long").alias("page_number"), "parsed_text_chars", "blocks", "chunks", "embedded", "units", "indexable_units", "chunked_units", n("unchunked_unit_ids").alias("unchunked"), n("unembedded_unit_ids").alias("unembedded"),
        "tables", n("table_ids_without_units").alias("tables_without_units"), "figures", n("figure_ids_missing_caption").alias("figures_missing_caption"), "missing_reason", F.array_join("codes", ",").alias("codes"),
    )


_SUM = f"""{_BASE}, sp AS (SELECT doc, count(*) AS total_pages, count(*) FILTER (chars > 0) AS wt, count(*) FILTER (ix > 0) AS wi, count(*) FILTER (mr = 'no_indexable_units') AS mu, count(*) FILTER (mr LIKE 'no_chunks%') AS mc, count(*) FILTER (mr = 'chunks_not_embedded') AS me, count(*) FILTER (mr IS NOT NULL OR tw > 0 OR fm > 0) AS gaps,
  count(*) FILTER (tw > 0) AS tw, count(*) FILTER (fm > 0) AS fm, count(*) FILTER (tables > 0) AS tp, count(*) FILTER (tables > 0 AND ix > 0) AS tpu FROM p GROUP BY ALL),
 su AS (SELECT doc, count(*) AS units, count(*) FILTER (ix) AS ix, count(*) FILTER (ix AND chunks > 0) AS ch, count(*) FILTER (ix AND emb) AS em, count(*) FILTER (ix AND chunks > 0 AND NOT emb) AS ue, count(*) FILTER (NOT ix) AS sk, count(DISTINCT unit) FILTER (ms IS NOT NULL) AS gu FROM u GROUP BY ALL),
 s AS (SELECT doc, total_pages, wt, wi, mu, mc, me, gaps, tw, fm, coalesce(units, 0) AS units, coalesce(ix, 0) AS ix, coalesce(ch, 0) AS ch, coalesce(em, 0) AS em, coalesce(ue, 0) AS ue, coalesce(sk, 0) AS sk, coalesce(gu, 0) AS gu,
  CASE WHEN wt > 0 THEN {Q.r4('wi / wt')} ELSE 1.0::DOUBLE END AS tr, CASE WHEN ix > 0 THEN {Q.r4('ch / ix')} ELSE 1.0::DOUBLE END AS cr, CASE WHEN tp > 0 THEN {Q.r4('tpu / tp')} ELSE 1.0::DOUBLE END AS br FROM sp LEFT JOIN su USING (doc)),
 qa AS (SELECT *, CASE WHEN mu > 0 THEN 'manual_review' WHEN tw + fm + mc + me > 0 THEN 'accept_with_warning' ELSE 'accept' END AS gate, CASE WHEN mu > 0 THEN 'review_parse_ir' WHEN tw > 0 THEN 'local_provider_rerun' WHEN fm > 0 THEN 'review_parse_ir' WHEN mc > 0 THEN 'rechunk_document' WHEN me > 0 THEN 'reembed_document' END AS act,
  concat_ws(',', CASE WHEN mu > 0 THEN 'rag_empty_text_page' END, CASE WHEN mc > 0 THEN 'rag_units_without_chunks' END, CASE WHEN me > 0 THEN 'rag_chunks_not_embedded' END, CASE WHEN tw > 0 THEN 'rag_table_without_unit' END, CASE WHEN fm > 0 THEN 'rag_figure_caption_missing' END) AS flags, {Q.r4('least(1.0::DOUBLE - gaps / total_pages, cr)')} AS score FROM s)"""


@query("rag_summary", f"""WITH {_SUM} SELECT doc AS doc_id, total_pages, wt AS pages_with_parsed_text, wi AS pages_with_indexable_units, mu AS pages_missing_rag_units, mc AS pages_missing_chunks, me AS pages_chunks_not_embedded, gaps AS pages_with_coverage_gaps, tw AS pages_table_without_units, fm AS pages_figure_caption_missing,
 units AS total_unit_count, ix AS total_indexable_units, ch AS total_chunked_units, em AS embedded_unit_count, ue AS unembedded_unit_count, sk AS skipped_unit_count, gu AS gap_units, tr AS text_page_coverage_ratio, cr AS unit_chunk_coverage_ratio, br AS table_unit_coverage_ratio FROM s""")
def rag_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _frames(spark, d)["summary"]
    return s.select(
        "doc_id", "total_pages", "pages_with_parsed_text", "pages_with_indexable_units", "pages_missing_rag_units", "pages_missing_chunks", "pages_chunks_not_embedded", "pages_with_coverage_gaps", "pages_table_without_units", "pages_figure_caption_missing",
        "total_unit_count", "total_indexable_units", "total_chunked_units", "embedded_unit_count", "unembedded_unit_count", "skipped_unit_count", F.size("gap_unit_ids").cast("long").alias("gap_units"), "text_page_coverage_ratio", "unit_chunk_coverage_ratio", "table_unit_coverage_ratio",
    )


@query("rag_quality", f"WITH {_SUM} SELECT doc AS doc_id, score AS rag_score, gate AS rag_gate, act AS rag_action, flags AS rag_flags FROM qa")
def rag_quality(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d)["summary"].select("doc_id", "rag_score", "rag_gate", "rag_action", F.array_join("rag_flags", ",").alias("rag_flags"))


@query("rag_manifest", f"""WITH {_SUM} SELECT s.doc AS doc_id, total_pages, gaps AS pages_with_coverage_gaps, cr AS unit_chunk_coverage_ratio, x.ix AS indexable_units, x.ch AS chunked_units, x.em AS embedded_units, x.sk AS skipped_units, y.a AS unembedded_unit_ids, y.b AS unchunked_unit_ids
 FROM s LEFT JOIN su x USING (doc) LEFT JOIN (SELECT doc, coalesce(string_agg(DISTINCT unit, ',' ORDER BY unit) FILTER (ms = 'chunks_not_embedded'), '') AS a, coalesce(string_agg(DISTINCT unit, ',' ORDER BY unit) FILTER (ms LIKE 'no%'), '') AS b FROM u GROUP BY ALL) y USING (doc)""")
def rag_manifest(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d)
    m = R.manifest(f["units"], f["summary"])
    return m.withColumns({c: F.array_join(c, ",") for c in ("unembedded_unit_ids", "unchunked_unit_ids")})


@query("quality_gate", f"""WITH {_SUM}, o AS (SELECT qa.*, CASE WHEN doc % 3 > 0 THEN (doc % 16) / 16.0::DOUBLE END AS cf FROM qa),
 f AS (SELECT *, tr < 0.98 AS a, br < 0.95 AS b, cr < 0.98 AS c, coalesce(cf < 0.75, false) AS e FROM o)
 SELECT doc AS doc_id, CASE WHEN mu > 0 THEN 'manual_review' WHEN tw > 0 OR e OR a OR b THEN 'local_rerun' WHEN fm > 0 OR c OR mc > 0 OR me > 0 THEN 'accept_with_warning' ELSE 'accept' END AS gate,
 CASE WHEN mu > 0 THEN 'review_parse_ir' WHEN act IS NOT NULL THEN act WHEN e OR a OR b THEN 'local_provider_rerun' WHEN c THEN 'rechunk_document' END AS action, mu = 0 AND NOT (tw > 0 OR e OR a OR b) AS passed,
 concat_ws(',', CASE WHEN a THEN 'text_page_coverage_below_threshold' END, CASE WHEN b THEN 'table_unit_coverage_below_threshold' END, CASE WHEN c THEN 'unit_chunk_coverage_below_threshold' END, CASE WHEN e THEN 'reading_order_confidence_below_threshold' END, CASE WHEN flags <> '' THEN flags END) AS flags FROM f""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    s = _frames(spark, d)["summary"]
    k = F.col("doc_id")
    g = s.select("*", F.col("text_page_coverage_ratio").alias("text_ratio"), F.col("table_unit_coverage_ratio").alias("table_ratio"), F.col("unit_chunk_coverage_ratio").alias("chunk_ratio"), F.when(k % 3 > 0, (k % 16) / 16.0).alias("order_confidence"))
    return C.quality_gate(g).withColumn("flags", F.array_join("flags", ","))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first six pages in three parts; the third overlaps the second."""
    docs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    p = docs.select("doc_id", F.inline(F.from_json(F.lit('[{"part_id":"a","page_start":1,"page_end":2},{"part_id":"b","page_start":3,"page_end":5},{"part_id":"c","page_start":5,"page_end":8}]'), "array<struct<part_id:string,page_start:int,page_end:int>>")))
    return p


_PART = f"""{_BASE}, pt AS (SELECT DISTINCT l_orderkey AS doc, x.part, x.f, x.l FROM lineitem, (VALUES ('a', 1, 2), ('b', 3, 5), ('c', 5, 8)) AS x(part, f, l)),
 xp AS (SELECT pt.doc, part, count(*) AS total_pages, count(*) FILTER (chars > 0) AS wt, count(*) FILTER (ix > 0) AS wi, count(*) FILTER (mr IS NOT NULL OR tw > 0 OR fm > 0) AS gaps, CAST(sum(ix) AS BIGINT) AS pix, CAST(sum(ix - uc) AS BIGINT) AS pch FROM pt JOIN p ON p.doc = pt.doc AND page BETWEEN f AND l GROUP BY ALL),
 xu AS (SELECT pt.doc, part, count(DISTINCT unit) AS units, count(DISTINCT unit) FILTER (ix AND chunks > 0 AND NOT emb) AS ue, count(DISTINCT unit) FILTER (ms IS NOT NULL) AS gu FROM pt JOIN u ON u.doc = pt.doc AND p0 <= l AND p1 >= f GROUP BY ALL),
 x AS (SELECT doc, part, total_pages, gaps, pix, pch, coalesce(units, 0) AS units, coalesce(ue, 0) AS ue, coalesce(gu, 0) AS gu, CASE WHEN wt > 0 THEN {Q.r4('wi / wt')} ELSE 1.0::DOUBLE END AS tr, CASE WHEN pix > 0 THEN {Q.r4('pch / pix')} ELSE 1.0::DOUBLE END AS cr FROM xp LEFT JOIN xu USING (doc, part))"""


@query("part_coverage", f"WITH {_PART} SELECT doc AS doc_id, part AS part_id, total_pages, gaps AS pages_with_coverage_gaps, pix AS total_indexable_units, pch AS total_chunked_units, units AS total_unit_count, ue AS unembedded_unit_count, gu AS gap_units, tr AS text_page_coverage_ratio, cr AS unit_chunk_coverage_ratio FROM x")
def part_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d)
    s = R.part_summary(_parts(spark, d), f["pages"], f["units"])
    return s.select("doc_id", "part_id", "total_pages", "pages_with_coverage_gaps", "total_indexable_units", "total_chunked_units", "total_unit_count", "unembedded_unit_count", F.size("gap_unit_ids").cast("long").alias("gap_units"), "text_page_coverage_ratio", "unit_chunk_coverage_ratio")


_STATES = """pt AS (SELECT DISTINCT l_orderkey AS doc, x.part, x.f, x.l, [NULL, 'done', ' Failed', 'parsing', 'odd'][(l_orderkey + f) % 5 + 1] AS raw, l_orderkey % 3 AS rep FROM lineitem, (VALUES ('a', 1, 2), ('b', 3, 5), ('c', 5, 8)) AS x(part, f, l)),
 sg AS (SELECT l_orderkey AS doc, l_linenumber AS page, CASE WHEN l_suppkey % 4 > 0 THEN 'code' || l_suppkey % 4 END AS code, CASE WHEN l_quantity > 40 THEN 'error' ELSE 'warning' END AS severity FROM lineitem WHERE l_quantity > 35),
 fd AS (SELECT pt.doc, part, count(*) AS n, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes, count(DISTINCT page) AS pages, count(*) FILTER (severity = 'error') AS errors FROM pt JOIN sg ON sg.doc = pt.doc AND page BETWEEN f AND l GROUP BY ALL)"""


@query("part_states", f"""WITH {_STATES}, j AS (SELECT pt.*, greatest(rep, coalesce(n, 0)) AS c, coalesce(codes, '') AS codes, coalesce(pages, 0) AS pages, coalesce(errors, 0) AS errors, coalesce(lower(trim(raw)), '') AS r FROM pt LEFT JOIN fd USING (doc, part))
 SELECT doc AS doc_id, part AS part_id, CASE WHEN r = 'failed' THEN 'failed' WHEN c > 0 AND r IN ('', 'done') THEN 'warning' WHEN r IN ('done', 'parsing') THEN r ELSE 'unknown' END AS state, c AS signals, codes, pages AS signal_pages, errors FROM j""")
def part_states(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.plans.rule_plans import pick

    k = F.col("doc_id")
    parts = _parts(spark, d).withColumns({"raw_state": pick([None, "done", " Failed", "parsing", "odd"], (k + F.col("page_start")) % 5), "reported_signals": k % 3})
    s = table(spark, d, "lineitem").where("l_quantity > 35")
    code = F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("code"), (F.col("l_suppkey") % 4).cast("string")))
    signals = s.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), code.alias("code"), F.when(F.col("l_quantity") > 40, "error").otherwise("warning").alias("severity"))
    p = R.part_states(parts, signals)
    return p.select("doc_id", "part_id", "state", "signals", F.array_join("codes", ",").alias("codes"), F.size("signal_pages").cast("long").alias("signal_pages"), F.coalesce(F.element_at("severity_counts", "error"), F.lit(0)).alias("errors"))


@query("rerun_comparison", """WITH a AS (SELECT l_partkey % 400 AS part, count(*) FILTER (l_returnflag = 'A') AS g, count(*) FILTER (l_linestatus = 'O') AS s, count(*) FILTER (l_quantity > 40) AS ue, max(l_discount) AS tr FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL),
 b AS (SELECT l_partkey % 400 AS part, count(*) FILTER (l_returnflag = 'A') AS g, count(*) FILTER (l_linestatus = 'O') AS s, count(*) FILTER (l_quantity > 40) AS ue, max(l_discount) AS tr FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL),
 fa AS (SELECT l_partkey % 400 AS part, list(DISTINCT 's' || l_suppkey % 20) AS f FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), fb AS (SELECT l_partkey % 400 AS part, list(DISTINCT 's' || l_suppkey % 20) AS f FROM lineitem WHERE l_linenumber >= 4 GROUP BY ALL),
 j AS (SELECT part, b.g - a.g AS dg, b.s - a.s AS ds, b.ue - a.ue AS du, b.tr - a.tr AS dt, list_filter(fb.f, lambda x: NOT list_contains(fa.f, x)) AS fl, list_filter(fa.f, lambda x: NOT list_contains(fb.f, x)) AS fr FROM a JOIN b USING (part) JOIN fa USING (part) JOIN fb USING (part)),
 k AS (SELECT *, concat_ws(',', CASE WHEN dg < 0 THEN 'coverage_gaps' END, CASE WHEN ds < 0 THEN 'quality_signal_count' END, CASE WHEN du < 0 THEN 'unembedded_units' END, CASE WHEN dt > 0 THEN 'text_page_coverage_ratio' END) AS up,
  concat_ws(',', CASE WHEN dg > 0 THEN 'coverage_gaps' END, CASE WHEN ds > 0 THEN 'quality_signal_count' END, CASE WHEN du > 0 THEN 'unembedded_units' END, CASE WHEN dt < 0 THEN 'text_page_coverage_ratio' END) AS down FROM j)
 SELECT part AS part_id, CASE WHEN up <> '' AND down <> '' THEN 'mixed' WHEN up <> '' THEN 'improved' WHEN down <> '' THEN 'regressed' WHEN part % 3 = 0 THEN 'provider_changed' ELSE 'unchanged' END AS status, up AS improved_axes, down AS regressed_axes, part % 3 = 0 AS provider_changed, dg AS pages_with_coverage_gaps_delta,
 array_to_string(list_sort(fl), ',') AS flags_added, array_to_string(list_sort(fr), ',') AS flags_removed FROM k""")
def rerun_comparison(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")

    def side(test: str, provider: F.Column) -> DataFrame:
        g = li.where(test).groupBy((F.col("l_partkey") % 400).alias("part_id")).agg(
            F.count_if(F.col("l_returnflag") == "A").alias("pages_with_coverage_gaps"), F.count_if(F.col("l_linestatus") == "O").alias("signals"), F.count_if(F.col("l_quantity") > 40).alias("unembedded_unit_count"),
            F.max("l_discount").alias("text_page_coverage_ratio"), F.collect_set(F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"))).alias("flags"),
        )
        gone = F.lit(None)
        return g.select("*", F.lit(1).alias("doc_id"), provider.alias("provider"), gone.cast("double").alias("unit_chunk_coverage_ratio"), gone.cast("double").alias("table_unit_coverage_ratio"), gone.cast("array<string>").alias("codes"), gone.cast("array<string>").alias("gap_unit_ids"))

    c = R.compare_reruns(side("l_linenumber < 4", F.lit("x")), side("l_linenumber >= 4", F.when(F.col("part_id") % 3 == 0, "y").otherwise("x")))
    return c.select("part_id", "status", F.array_join("improved_axes", ",").alias("improved_axes"), F.array_join("regressed_axes", ",").alias("regressed_axes"), "provider_changed", "pages_with_coverage_gaps_delta", F.array_join("flags_added", ",").alias("flags_added"), F.array_join("flags_removed", ",").alias("flags_removed"))


@query("attention_parts", """WITH p AS (SELECT o_orderkey AS k, [NULL, 'unchanged', 'provider_changed', 'regressed', 'mixed', 'improved'][o_orderkey % 6 + 1] AS rs, o_custkey % 2 = 0 AS pc, o_custkey % 3 AS gaps, o_orderkey % 4 AS sg, ['accept', 'accept_with_warning', 'local_rerun'][o_custkey % 3 + 1] AS rg, o_orderkey % 5 = 0 AS ok,
  ['done', 'warning', 'failed', 'parsing'][o_custkey % 4 + 1] AS st, o_custkey % 7 % 2 AS gu FROM orders)
 SELECT k AS part_id, CASE WHEN rs IN ('unchanged', 'provider_changed') THEN 'provider_route_plan' WHEN rs IN ('regressed', 'mixed') THEN 'parse_ir' WHEN rs = 'improved' THEN CASE WHEN gaps > 0 OR rg = 'accept_with_warning' THEN 'coverage_gaps' WHEN pc THEN 'keep_current_provider' ELSE 'quality_review' END
  WHEN ok AND (gaps > 0 OR rg = 'local_rerun') THEN 'local_provider_rerun' WHEN sg > 0 THEN 'quality_review' END AS focus FROM p WHERE st IN ('warning', 'failed') OR rs IS NOT NULL OR gaps > 0 OR gu > 0""")
def attention_parts(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.plans.rule_plans import pick

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table(spark, d, "orders").select(
        k.alias("part_id"), pick([None, "unchanged", "provider_changed", "regressed", "mixed", "improved"], k % 6).alias("rerun_status"), pick(["done", "warning", "failed", "parsing"], c % 4).alias("state"), (c % 3).alias("coverage_gaps"), (c % 7 % 2).alias("gap_units"),
        (c % 2 == 0).alias("changed"), (k % 4).alias("signals"), pick(["accept", "accept_with_warning", "local_rerun"], c % 3).alias("gate"), (k % 5 == 0).alias("supported"),
    )
    focus = R.part_focus(F.col("rerun_status"), F.col("changed"), F.col("coverage_gaps"), F.col("signals"), F.col("gate"), F.col("supported"))
    return R.attention_parts(p).select("part_id", focus.alias("focus"))
