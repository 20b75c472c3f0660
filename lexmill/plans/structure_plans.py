"""Structure of units, lists, tables, pages and boxes over orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import diagnostics as D
from lexmill.operators import geometry as G
from lexmill.operators import structure as S
from lexmill.operators import tables as T
from lexmill.plans.rule_plans import pick
from lexmill.registry import query, table


@query("unit_structure_signals", """WITH u AS (SELECT o_custkey AS doc, o_orderkey AS pos, CASE WHEN o_orderkey % 9 > 0 THEN 's' || o_orderkey // 2 * 2 END AS sid, ['body_section', 'list_item', 'table', 'clause'][o_orderkey % 4 + 1] AS role, o_orderkey % 4 = 0 AS hd, o_orderkey % 3 + 1 AS lv, CASE WHEN o_orderkey % 5 > 0 THEN 'p' END AS par, (1 + o_orderkey % 2) || '.' || (o_orderkey % 7) || ')' AS no, o_orderkey % 6 AS ll,
  CASE WHEN o_orderkey % 8 <> 3 THEN 'x' END AS t, o_orderkey % 10 AS p0, o_orderkey % 10 + (o_orderkey % 11 = 0)::INT AS p1, ['spans_pages', 'continues', NULL][o_orderkey % 3 + 1] AS ck, o_orderkey % 5 = 2 AS need FROM orders),
 w AS (SELECT *, last_value(CASE WHEN hd THEN lv END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb, lag(no) OVER (PARTITION BY doc, coalesce(par, ''), lv, hd ORDER BY pos) AS sn, row_number() OVER (PARTITION BY doc, sid ORDER BY pos) AS nth FROM u),
 r AS (SELECT doc, pos, unnest(list_filter([CASE WHEN sid IS NULL OR nth > 1 THEN 'structure_unit_identity_invalid' END, CASE WHEN hd AND lv > 1 AND par IS NULL THEN 'structure_section_parent_missing' END, CASE WHEN hd AND pos % 16 = 0 THEN 'structure_title_path_missing' END, CASE WHEN hd AND lv > hb + 1 THEN 'structure_heading_level_jump' END,
  CASE WHEN hd AND left(no, 1) = left(sn, 1) AND CAST(no[3] AS INT) > CAST(sn[3] AS INT) + 1 THEN 'structure_section_number_jump' END, CASE WHEN role = 'list_item' AND ll > 1 THEN 'structure_list_parent_missing' END, CASE WHEN role IN ('list_item', 'clause') AND t IS NULL THEN 'structure_semantic_unit_empty' END, CASE WHEN need AND coalesce(ck, '') <> 'spans_pages' AND role = 'table' THEN 'structure_cross_page_table_break' END,
  CASE WHEN need AND coalesce(ck, '') <> 'spans_pages' AND role <> 'table' THEN 'structure_cross_page_continuity_missing' END, CASE WHEN p1 > p0 AND coalesce(ck, '') NOT IN ('spans_pages', 'continues') THEN 'structure_cross_page_continuity_missing' END], lambda x: x IS NOT NULL)) AS code FROM w) SELECT pos AS unit_id, code FROM r""")
def unit_structure_signals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    u = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("position"), k.alias("unit_id"), F.when(k % 9 > 0, F.concat(F.lit("s"), (F.floor(k / 2) * 2).cast("string"))).alias("stable_unit_id"), pick(["body_section", "list_item", "table", "clause"], k % 4).alias("semantic_role"), (k % 4 == 0).alias("heading"), F.lit("x").alias("section_id"),
        F.when(k % 5 > 0, "p").alias("parent_section_id"), (k % 3 + 1).alias("section_level"), F.concat((1 + k % 2).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(")")).alias("section_no"), F.when(k % 16 > 0, F.array(F.lit("t"))).alias("title_path"), (k % 6).alias("list_level"), none.alias("list_parent"),
        F.when(k % 8 != 3, "x").alias("text"), (k % 10).alias("page_start"), (k % 10 + (k % 11 == 0).cast("int")).alias("page_end"), pick(["spans_pages", "continues", None], k % 3).alias("continuity_kind"), none.alias("continues_from"), (k % 5 == 2).alias("continuity_required"),
    )
    return S.unit_signals(u).select("unit_id", "code")


@query("list_parents", """WITH u AS (SELECT o_custkey AS doc, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'h' WHEN o_orderkey % 5 = 0 THEN 'p' ELSE 'l' END AS r, 1 + o_orderkey % 3 AS lv FROM orders),
 c AS (SELECT a.doc, a.k, max(b.k) AS up FROM u a JOIN u b ON a.doc = b.doc AND b.k < a.k AND b.r = 'l' AND b.lv = a.lv - 1 WHERE a.r = 'l' AND a.lv > 1 AND NOT EXISTS (SELECT 1 FROM u z WHERE z.doc = a.doc AND z.k > b.k AND z.k < a.k AND (z.r = 'h' OR (z.r = 'l' AND z.lv < a.lv - 1))) GROUP BY ALL)
 SELECT u.k AS unit_id, CAST(up AS VARCHAR) AS list_parent FROM u LEFT JOIN c USING (doc, k)""")
def list_parents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("position"), k.cast("string").alias("unit_id"), F.when(k % 7 == 0, "body_section").when(k % 5 == 0, "paragraph").otherwise("list_item").alias("semantic_role"), (1 + k % 3).alias("list_level"))
    return S.list_parents(u, 3).select(F.col("unit_id").cast("long").alias("unit_id"), "list_parent")


_TEXTS = ["(a) all parts", "注：见表", "* starred", "Note 2 seen", "plain words", "", "Source: x", "12. last"]


@query("table_notes", """WITH b AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 4 = 0 AS tb, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) // 6 AS page, ['(a) all parts', '注：见表', '* starred', 'Note 2 seen', 'plain words', '', 'Source: x', '12. last'][(o_orderkey // 3) % 8 + 1] AS t FROM orders),
 f AS (SELECT *, CASE WHEN tb THEN 't' WHEN t = 'plain words' THEN 'x' ELSE 'n' END AS kind, row_number() OVER (PARTITION BY doc ORDER BY k) AS rn FROM b WHERE tb OR t <> ''),
 p AS (SELECT x.doc, y.k AS tk, x.k, x.t FROM f x JOIN f y ON y.doc = x.doc AND y.kind = 't' AND y.rn < x.rn AND x.page = y.page WHERE x.kind = 'n' AND x.rn - y.rn <= 3 AND NOT EXISTS (SELECT 1 FROM f z WHERE z.doc = x.doc AND z.rn > y.rn AND z.rn < x.rn AND (z.kind <> 'n' OR z.page <> y.page)))
 SELECT 'b' || tk AS table_block, row_number() OVER (PARTITION BY tk ORDER BY k) AS n, 'b' || k AS note_block, t AS text FROM p""")
def table_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    page = F.floor(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) / 6)
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("position"), F.concat(F.lit("b"), k.cast("string")).alias("block_id"), F.when(k % 4 == 0, "table").otherwise("paragraph").alias("type"), page.alias("page_number"), pick(_TEXTS, F.floor(k / 3) % 8).alias("content"))
    return S.table_notes(b).select("table_block", F.col("n").cast("long").alias("n"), "note_block", "text")


@query("tables_of_blocks", "SELECT l_orderkey AS doc_id, l_linenumber AS block_id, min(CASE WHEN l_linenumber % 2 = 0 THEN 't' || l_linenumber END) AS table_id FROM lineitem GROUP BY ALL")
def tables_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_id")).distinct()
    return S.tables_of_blocks(b, b.where("block_id % 2 = 0").withColumn("table_id", F.concat(F.lit("t"), F.col("block_id").cast("string"))))


@query("unindexed_tables", """SELECT DISTINCT l_orderkey AS doc_id, 't' || l_linenumber AS table_id FROM lineitem a WHERE l_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_quantity > 25)""")
def unindexed_tables(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("table_id"), "l_suppkey", "l_quantity")
    units = li.select("doc_id", (F.col("l_quantity") > 25).alias("should_index"), F.array("table_id").alias("table_ids"))
    return S.unindexed_tables(li.where("l_suppkey % 2 = 0").select("doc_id", "table_id").distinct(), units)


@query("locator_recall", """WITH e AS (SELECT l_returnflag AS s, l_orderkey AS p, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS r FROM lineitem), f AS (SELECT DISTINCT l_returnflag AS s, l_orderkey AS p, CASE WHEN l_suppkey % 4 > 0 THEN l_linenumber + 1 END AS r FROM lineitem WHERE l_quantity > 30)
 SELECT s AS section, count(*) AS expected, count(*) FILTER (h) AS matched, count(*) FILTER (h) / count(*) AS recall FROM (SELECT s, EXISTS (SELECT 1 FROM f WHERE f.s = e.s AND f.p = e.p AND (f.r IS NULL OR f.r IS NOT DISTINCT FROM e.r)) AS h FROM e) GROUP BY ALL""")
def locator_recall(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    place = [F.col("l_returnflag").alias("section"), F.col("l_orderkey").alias("page")]
    e = li.select(*place, F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("row"))
    f = li.where("l_quantity > 30").select(*place, F.when(F.col("l_suppkey") % 4 > 0, F.col("l_linenumber") + 1).alias("row"))
    return S.locator_recall(e, f)


@query("content_sequence", """WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber - 1 AS i FROM lineitem), q AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS idx FROM p), n AS (SELECT doc, count(*) AS n FROM q GROUP BY ALL),
 g AS (SELECT l_orderkey AS doc, l_linenumber AS i, CASE WHEN l_linenumber % 2 = 0 THEN 'table' ELSE 'image' END AS kind, min(l_partkey % 128)::DOUBLE AS top FROM lineitem GROUP BY ALL),
 a AS (SELECT g.doc, CASE WHEN kind = 'image' AND i = 3 THEN 0 WHEN g.doc % 6 = 0 THEN n ELSE CAST(round_even(least(top, 64.0::DOUBLE) / 64.0::DOUBLE * n, 0) AS BIGINT) END AS place, 0 AS af, top, kind, i AS idx FROM g JOIN n USING (doc) UNION ALL SELECT doc, idx, 1, 0, 'paragraph', idx FROM q)
 SELECT doc AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY place, af, top, kind, idx) AS n, kind, idx FROM a""")
def content_sequence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    doc = [F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number")]
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    paragraphs = li.select(*doc, F.col("l_linenumber").alias("i")).distinct().select("doc_id", "page_number", n.alias("idx"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "table").otherwise("image")
    regions = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 128).cast("double").alias("top")).select(*doc, kind.alias("kind"), F.col("l_linenumber").alias("idx"), "top", F.when(F.col("l_linenumber") == 3, 0).alias("anchor"))
    pages = li.select(*doc).distinct().withColumn("height", F.when(F.col("doc_id") % 6 > 0, 64.0))
    return S.content_sequence(paragraphs, regions, pages).select("doc_id", F.col("n").cast("long").alias("n"), "kind", F.col("idx").cast("long").alias("idx"))


@query("trimmed_sheets", """WITH c AS (SELECT o_custkey AS s, (o_orderkey // 7) % 9 AS r, o_orderkey % 5 AS c, min(CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderstatus END) AS t FROM orders GROUP BY ALL), b AS (SELECT s, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM c WHERE trim(t) <> '' GROUP BY ALL)
 SELECT s AS sheet, r - r0 AS row_index, c - c0 AS col_index, t AS text, r0 + 1 AS first_row, c0 + 1 AS first_col FROM c JOIN b USING (s) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1""")
def trimmed_sheets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sheet"), (F.floor(k / 7) % 9).alias("row_index"), (k % 5).alias("col_index")).agg(F.min(F.when(k % 4 == 0, " ").otherwise(F.col("o_orderstatus"))).alias("text"))
    return S.trimmed_sheet(c)


@query("index_layers", """WITH c AS (SELECT vec_id // 10 AS doc, vec_id AS id, label = 1 AS hp FROM embeddings WHERE vec_id % 2 = 0) SELECT 'primary' AS layer, doc AS doc_id, id AS chunk_id FROM c UNION ALL SELECT 'high_precision', doc, id FROM c WHERE hp UNION ALL SELECT 'primary', vec_id // 5, vec_id FROM embeddings WHERE vec_id % 3 = 0 AND vec_id // 5 NOT IN (SELECT doc FROM c)""")
def index_layers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    doc = lambda n: F.floor(F.col("vec_id") / n).alias("doc_id")
    new = e.where("vec_id % 2 = 0").select(doc(10), F.col("vec_id").alias("chunk_id"), "embedding", (F.col("label") == 1).alias("high_precision"))
    old = e.where("vec_id % 3 = 0").select(F.lit("primary").alias("layer"), doc(5), F.col("vec_id").alias("chunk_id"), "embedding")
    return S.layers_of(new, old).select("layer", "doc_id", "chunk_id")


@query("union_boxes", "SELECT l_orderkey AS doc_id, min(l_partkey % 50)::DOUBLE AS x0, min(l_suppkey)::DOUBLE AS top, max(l_partkey % 50 + l_quantity - 10)::DOUBLE AS x1, max(l_suppkey + l_linenumber)::DOUBLE AS bottom FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def union_boxes(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("l_partkey") % 50).cast("double")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), x.alias("x0"), F.col("l_suppkey").cast("double").alias("top"), (x + F.col("l_quantity") - 10).alias("x1"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("double").alias("bottom"))
    return G.box_union(li, ["doc_id"])


@query("horizontal_overlaps", """SELECT o_orderkey, greatest(0.0::DOUBLE, least(a0 + 20, b0 + w) - greatest(a0, b0)) / greatest(1.0::DOUBLE, least(20, w)) AS overlap FROM (SELECT o_orderkey, (o_orderkey % 30)::DOUBLE AS a0, (o_custkey % 40)::DOUBLE AS b0, (o_orderkey % 3 * 8)::DOUBLE AS w FROM orders)""")
def horizontal_overlaps(spark: SparkSession, d: str) -> DataFrame:
    a, b, w = (F.col("o_orderkey") % 30).cast("double"), (F.col("o_custkey") % 40).cast("double"), (F.col("o_orderkey") % 3 * 8).cast("double")
    return table(spark, d, "orders").select("o_orderkey", S.horizontal_overlap(a, a + 20, b, b + w).alias("overlap"))


@query("page_coordinates", """WITH l AS (SELECT o_orderkey AS k, (o_custkey % 64)::DOUBLE AS x, (o_orderkey % 32)::DOUBLE AS y, CASE WHEN o_orderkey % 3 = 0 THEN 128.0 END AS sw, CASE WHEN o_orderkey % 4 > 0 THEN 512.0 ELSE 0.0 END AS pw, (o_orderkey % 2 * 256)::DOUBLE AS rw FROM orders)
 SELECT k, floor((CASE WHEN sw IS NULL THEN 0 ELSE 5 END + x * (coalesce(sw, CASE WHEN pw > 0 THEN pw ELSE rw END) / rw)) * 1e4 + 0.5) / 1e4 AS x0, floor(y * (1024.0 / 512.0) * 1e4 + 0.5) / 1e4 AS top FROM l WHERE rw > 0""")
def page_coordinates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, y, part = (F.col("o_custkey") % 64).cast("double"), (k % 32).cast("double"), k % 3 == 0
    li = table(spark, d, "orders").select(
        k.alias("k"), x.alias("x0"), y.alias("top"), (x + 1).alias("x1"), (y + 1).alias("bottom"), (k % 2 * 256).cast("double").alias("rendered_width"), F.lit(512.0).alias("rendered_height"), F.when(k % 4 > 0, 512.0).otherwise(0.0).alias("page_width"), F.lit(1024.0).alias("page_height"),
        F.when(part, 128.0).alias("source_width"), F.lit(None).cast("double").alias("source_height"), F.when(part, 5.0).alias("origin_x"), F.lit(None).cast("double").alias("origin_top"),
    )
    return G.ocr_coordinates(li).select("k", "x0", "top")


@query("header_paths", """WITH c AS (SELECT o_custkey AS t, o_orderkey % 4 AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) - 1 AS r, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS v FROM orders), h AS (SELECT * FROM c WHERE r < 3),
 f AS (SELECT *, lag(v) OVER (PARTITION BY t, c ORDER BY r) AS b FROM h WHERE v <> '') SELECT h.t AS table_id, h.c AS col_index, coalesce((SELECT string_agg(v, ' / ' ORDER BY r) FROM f WHERE f.t = h.t AND f.c = h.c AND (b IS NULL OR b <> v)), '') AS path FROM h GROUP BY h.t, h.c""")
def header_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = F.row_number().over(Window.partitionBy("o_custkey", k % 4).orderBy("o_orderkey")) - 1
    cells = table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), (k % 4).alias("col_index"), r.alias("row_index"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("text"))
    return T.header_paths(cells, 3)


@query("order_confidence", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_custkey % 3 < 2 THEN 0.98 WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 5 = 0 THEN 0.58 ELSE 0.64 END ELSE [0.8, 0.9, 0.84, 0.86, 0.8][o_custkey % 5 + 1] END::DOUBLE AS confidence FROM orders""")
def order_confidence(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.plans.rule_plans import pick

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", G.order_confidence(c % 3, k % 2 == 1, pick(["mixed", "gutter", "bands", "regions", "other"], c % 5), k % 9 == 0).alias("confidence"))


@query("document_confidence", "SELECT l_orderkey AS doc_id, floor(avg(CASE WHEN l_linenumber > 1 THEN least(greatest(l_quantity / 32.0::DOUBLE - 0.25::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END) * 1e4 + 0.5) / 1e4 AS confidence FROM lineitem GROUP BY ALL")
def document_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 32.0 - 0.25).alias("confidence"))
    return D.reading_confidence(p)


@query("repeated_figures", """WITH f AS (SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber AS n, l_partkey AS p, (l_partkey % 8)::DOUBLE AS x, (l_linenumber % 2 * 10)::DOUBLE AS y, CASE WHEN l_quantity > 40 THEN 0.9 ELSE 0.15 END AS cf FROM lineitem), o AS (SELECT doc, x, y, count(DISTINCT page) AS c FROM f GROUP BY ALL)
 SELECT doc AS doc_id, count(*) AS figures FROM f JOIN o USING (doc, x, y) WHERE c < 3 OR cf > 0.5 GROUP BY ALL""")
def repeated_figures(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 8).cast("double"), (F.col("l_linenumber") % 2 * 10).cast("double")
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page_number"), x.alias("x0"), y.alias("top"), (x + 20).alias("x1"), (y + 20).alias("bottom"), F.lit(100.0).alias("page_width"), F.lit(100.0).alias("page_height"), F.when(F.col("l_quantity") > 40, 0.9).otherwise(0.15).alias("confidence"))
    return G.repeated_figures(f).groupBy("doc_id").agg(F.count("*").alias("figures"))
