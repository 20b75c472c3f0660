"""Text kernels, blocks, pages, quality and sequence operators over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import roles, text
from lexmill.operators import blocks as B
from lexmill.operators import segment as S
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("token_counts", f"SELECT doc_id, CAST({Q.count('text', Q.WORD)} AS BIGINT) AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).cast("long").alias("tokens"))


@query("lines_view", f"""WITH {Q.LINES} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, doc_id || ':line:' || line_no AS line_id,
  trim(regexp_replace(line, '[ \\t　]+', ' ', 'g')) AS line FROM paged WHERE trim(regexp_replace(line, '[ \\t　]+', ' ', 'g')) <> ''""")
def lines_view(spark: SparkSession, d: str) -> DataFrame:
    rows = B.lines(docs(spark, d)).withColumn("line", text.inline_space(F.col("line"))).where("line <> ''")
    return rows.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.concat(F.col("doc_id").cast("string"), F.lit(":line:"), F.col("line_no").cast("string")).alias("line_id"), "line")


@query("candidate_lines", """SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g'))), lambda x: x <> '')) AS BIGINT) AS candidates FROM documents""")
def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), text.record_text), lambda x: x != "")
    return docs(spark, d).select("doc_id", F.size(parts).cast("long").alias("candidates"))


_PARTS = "list_transform(regexp_extract_all(trim(text), '[A-Za-z0-9一-鿿]+'), lambda x: lower(x))"


@query("garble_signals", f"""WITH p AS (SELECT doc_id, trim(text) AS t, {_PARTS} AS parts FROM documents),
 s AS (SELECT doc_id, sum(n) AS rep FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(parts) AS w FROM p) WHERE length(w) <= 2 GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL)
 SELECT p.doc_id, CAST(length(t) AS BIGINT) AS chars, CAST({Q.count('t', text.CID_TOKEN)} AS BIGINT) AS cid_tokens, CAST({Q.count('t', '[A-Za-z]')} AS BIGINT) AS latin_chars,
 CAST(len(parts) AS BIGINT) AS components, CAST(coalesce(rep, 0) AS BIGINT) AS repeated_short FROM p LEFT JOIN s USING (doc_id)""")
def garble_signals(spark: SparkSession, d: str) -> DataFrame:
    g = docs(spark, d).select("doc_id", text.garble(F.col("text")).alias("g"))
    return g.select("doc_id", *[F.col(f"g.{k}").cast("long").alias(k) for k in ("chars", "cid_tokens", "latin_chars", "components", "repeated_short")])


@query("garble_reasons", f"""WITH p AS (SELECT doc_id, trim(text) AS t, {_PARTS} AS parts FROM documents),
 s AS (SELECT doc_id, sum(n) AS rep FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(parts) AS w FROM p) WHERE length(w) <= 2 GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL)
 SELECT doc_id, CASE WHEN t = '' THEN 'empty_text' WHEN len(parts) > 0 AND coalesce(rep, 0) >= 0.35 * len(parts) THEN 'repeated_short_tokens' END AS reason FROM p LEFT JOIN s USING (doc_id)""")
def garble_reasons(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.garble_reason(text.garble(F.col("text"))).alias("reason"))


@query("document_quality", f"""WITH p AS (SELECT doc_id, trim(text) AS t, {_PARTS} AS parts FROM documents),
 s AS (SELECT doc_id, sum(n) AS rep FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(parts) AS w FROM p) WHERE length(w) <= 2 GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
 f AS (SELECT doc_id, t = '' AS e, len(parts) > 0 AND coalesce(rep, 0) >= 0.35 * len(parts) AS r FROM p LEFT JOIN s USING (doc_id))
 SELECT doc_id, CASE WHEN e THEN 0.5::DOUBLE WHEN r THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS score, CASE WHEN e THEN 'empty_output' WHEN r THEN 'repeated_short_tokens' ELSE '' END AS flags, CAST(NULL AS VARCHAR) AS action,
 CASE WHEN e THEN 'empty_text' WHEN r THEN 'repeated_short_tokens' END AS reason FROM f""")
def document_quality(spark: SparkSession, d: str) -> DataFrame:
    return B.document_quality(docs(spark, d))


@query("line_roles", f"WITH {Q.BLOCKS} SELECT {Q.role('content')} AS role, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM blocks GROUP BY ALL")
def line_roles(spark: SparkSession, d: str) -> DataFrame:
    return B.line_blocks(docs(spark, d)).groupBy(F.col("semantic_role").alias("role")).agg(F.count("*").alias("blocks"), F.count_distinct("doc_id").alias("documents"))


@query("page_quality", f"""WITH {Q.BLOCKS} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, count(*) AS blocks, quantile_cont(length(content), 0.5) AS median_length,
 count(*) FILTER (length(content) < 10) AS very_short, count(*) FILTER ({Q.FURNITURE}) AS furniture, count(*) FILTER ({Q.NUMERIC}) AS numeric_heavy,
 CAST(max(length(content)) AS BIGINT) AS max_length, count(*) FILTER (length(content) >= 2000) AS long_blocks FROM blocks GROUP BY ALL""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return B.page_quality(B.line_blocks(docs(spark, d))).withColumns({c: F.col(c).cast("long") for c in ("page_number", "max_length")})


_CASES = [  # a line, its role, and the number, title and level of the heading that it is
    ("NOTE: mind {k}", "note"), ("警告：热 {k}", "warning"), ("Caution : {k}", "caution"), ("A valve means a part {k}", "definition"), ("流程: {k}", "procedure"), ("Step 3 of {k}", "procedure_step"), ("步骤 三 拆下", "procedure_step"),
    ("• item {k}", "list_item"), ("（二）部件 {k}", "list_item"), ("4) bolts {k}", "list_item", "4", "4 bolts {k}", 1), ("Chapter 2 - General {k}", "body_section", "CHAPTER 2", "CHAPTER 2 General {k}", 1), ("section IV: Tools {k}", "body_section", "SECTION IV", "SECTION IV Tools {k}", 2),
    ("第 三 章 总则 {k}", "body_section", "第 三 章", "第 三 章 总则 {k}", 1), ("第5条 内容 {k}", "clause", "第5条", "第5条 内容 {k}", 2), ("第2款", "clause", "第2款", "第2款", 3), ("Appendix A Tables {k}", "appendix", "Appendix A", "Appendix A Tables {k}", 1), ("附录 {k}", "appendix", "附录 {k}", "附录 {k}", 1),
    ("三、目的 {k}", "body_section", "三", "三、目的 {k}", 1), ("1. Scope {k}", "body_section", "1", "1 Scope {k}", 1), ("2.3 this is a long line of words that no title would be {k}", "clause", "2.3", "2.3 this is a long line of words that no title would be {k}", 2), ("４．１ 概述", "clause", "4.1", "4.1 概述", 2),
    ("7 apples and some more pears than those {k}", "paragraph"), ("2024 年 {k}", "paragraph"), ("145.A.30 Personnel {k}", "clause"), ("Intro {k} ..... 12", "toc_entry"), ("Tools . . . N/A", "toc_entry"), ("see Page 3-1 {k}", "lep_entry"), ("plain words {k}.", "paragraph"), (" ", "paragraph"), ("1. ends with a stop so no title {k}.", "paragraph"),
]
_HEADED = ", ".join("(" + ", ".join([str(i), *["NULL" if x is None else str(x) if isinstance(x, int) else Q.quoted(x) for x in (*c, *[None] * (5 - len(c)))]]) + ")" for i, c in enumerate(_CASES))


@query("line_headings", f"""WITH v(n, line, role, section_no, title, "level") AS (VALUES {_HEADED}) SELECT o_orderkey, role, replace(section_no, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS section_no, replace(title, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS title, "level" FROM orders JOIN v ON n = o_orderkey % {len(_CASES)}""")
def line_headings(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    line = F.replace(F.get(F.array(*[F.lit(c[0]) for c in _CASES]), (k % len(_CASES)).cast("int")), F.lit("{k}"), k.cast("string"))
    return o.select("o_orderkey", line.alias("line")).select("o_orderkey", roles.semantic_role(F.col("line")).alias("role"), roles.heading(F.col("line")).alias("h")).select("o_orderkey", "role", "h.section_no", "h.title", "h.level")


@query("page_projection", f"""WITH {Q.BLOCKS}, r AS (SELECT *, {Q.role('content')} AS role FROM blocks),
 g AS (SELECT doc_id, page_number, count(*) AS blocks, list_sort(list(DISTINCT role)) AS roles, string_agg(content, chr(10) || chr(10) ORDER BY position) AS t FROM r GROUP BY ALL)
 SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, blocks, array_to_string(roles, ',') AS roles, CAST(length(t) AS BIGINT) AS text_chars,
 CASE WHEN list_has_any(roles, ['toc_entry', 'lep_entry']) OR regexp_matches(t, '(?i)^\\s*(contents?|table\\s+of\\s+contents)(\\s|$)') OR regexp_matches(t, '(?im)^\\s*(contents?|table\\s+of\\s+contents)\\s*$') THEN 'toc'
 WHEN regexp_matches(lower(t), 'signature|signed by|approved by') THEN 'signature' WHEN regexp_matches(lower(t), 'appendix|annex') THEN 'appendix' ELSE 'body' END AS page_type FROM g""")
def page_projection(spark: SparkSession, d: str) -> DataFrame:
    return B.page_projection(B.line_blocks(docs(spark, d))).withColumns({c: F.col(c).cast("long") for c in ("page_number", "text_chars")})


@query("document_summary", f"""WITH {Q.BLOCKS} SELECT doc_id, count(*) AS blocks, count(DISTINCT page_number) AS pages, CAST(sum(length(content)) AS BIGINT) AS chars, count(DISTINCT {Q.role('content')}) AS roles FROM blocks GROUP BY ALL""")
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.document_summary(B.line_blocks(docs(spark, d)))


@query("strip_repeated_lines", f"""WITH {Q.LINES}, filled AS (SELECT doc_id, page_number, line_no, trim(line) AS s FROM paged WHERE trim(line) <> ''),
 np AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM filled GROUP BY ALL HAVING count(DISTINCT page_number) >= 3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) AS z FROM filled),
 c AS (SELECT doc_id, s, side, count(*) AS n FROM (SELECT DISTINCT doc_id, page_number, s, 'h' AS side FROM rk WHERE a <= 3 AND length(s) >= 4 UNION ALL SELECT DISTINCT doc_id, page_number, s, 't' FROM rk WHERE z <= 3 AND length(s) >= 4) GROUP BY ALL),
 f AS (SELECT DISTINCT c.doc_id, s FROM c JOIN np USING (doc_id) WHERE n >= greatest(2, floor(pages * 0.5)))
 SELECT doc_id, count(*) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM paged p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = p.doc_id AND f.s = trim(p.line)) GROUP BY ALL""")
def strip_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.strip_repeated(B.lines(docs(spark, d))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.char_length("line")).alias("chars"))


_HEADING_LIKE = r"""(length(content) <= 80 AND ((len(regexp_extract_all(content, '\p{L}')) >= 3 AND len(regexp_extract_all(content, '\p{Lu}')) >= 0.8 * len(regexp_extract_all(content, '\p{L}')))
 OR regexp_matches(content, '^(?i:chapter|section|appendix|part)\s+\S|^\d+(\.\d+)*[.)]?\s+\p{Lu}')))"""


@query("merge_short_blocks", f"""WITH {Q.BLOCKS}, w AS (SELECT *, CASE WHEN length(content) >= 10 OR {_HEADING_LIKE} OR row_number() OVER (PARTITION BY doc_id ORDER BY position) = 1 THEN 1 ELSE 0 END AS st FROM blocks),
 i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY position) AS island FROM w)
 SELECT doc_id, CAST(min(position) AS BIGINT) AS position, count(*) AS merged, string_agg(content, chr(10) ORDER BY position) AS content FROM i GROUP BY doc_id, island""")
def merge_short_blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_short(B.line_blocks(docs(spark, d))).withColumn("position", F.col("position").cast("long"))


@query("merge_across_pages")
def merge_across_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_across_pages(B.line_blocks(docs(spark, d)))


@query("split_sentences_inline", """SELECT doc_id, CAST(len(string_split_regex(text, '\\s\\((?:\\d+|[A-Za-z])\\)')) - 1 AS BIGINT) AS markers FROM documents""")
def split_sentences_inline(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(r"\s\((?:\d+|[A-Za-z])\)")).cast("long").alias("markers"))


@query("structural_splits")
def structural_splits(spark: SparkSession, d: str) -> DataFrame:
    pieces = docs(spark, d).select("doc_id", F.explode(S.split_structural(F.col("text"))).alias("a"))
    pieces = pieces.select("doc_id", F.explode(S.split_toc(F.col("a"))).alias("b")).select("doc_id", F.explode(S.split_inline(F.col("b"))).alias("c"))
    return pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.char_length("c")).alias("chars"))


@query("section_chunks", f"""WITH {Q.BLOCKS}, r AS (SELECT *, CASE WHEN {Q.role('content')} IN ('body_section', 'appendix', 'title', 'clause') THEN 1 ELSE 0 END AS anchor FROM blocks),
 s AS (SELECT *, sum(anchor) OVER (PARTITION BY doc_id ORDER BY position) AS section FROM r)
 SELECT doc_id, sha256(doc_id || '|' || string_agg(doc_id || '-p-' || position, ',' ORDER BY position)) AS chunk_id, count(*) AS blocks, CAST(length(string_agg(content, chr(10) ORDER BY position)) AS BIGINT) AS chars FROM s GROUP BY doc_id, section""")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.section_chunks(B.line_blocks(docs(spark, d))).select("doc_id", "chunk_id", "blocks", F.char_length("text").cast("long").alias("chars"))


@query("latest_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS latest FROM orders""")
def latest_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    note = F.concat(F.lit("Filed 1990.13.45, seen 1991/2/3; issued "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(" for "), F.col("o_orderpriority"))
    return o.select("o_orderkey", text.last_date(note).alias("latest"))


@query("heading_sections", """WITH h AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, 1 + CAST(o_orderkey % 3 AS INTEGER) AS level, o_orderpriority AS title FROM orders),
 a AS (SELECT x.doc_id, x.position, x.level, x.title, y.title AS t, y.level AS l FROM h x JOIN h y ON y.doc_id = x.doc_id AND y.position <= x.position AND (y.position = x.position OR y.level < x.level)
       WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.doc_id = x.doc_id AND z.position > y.position AND z.position <= x.position AND z.level <= y.level))
 SELECT doc_id, CAST(position AS BIGINT) AS position, string_agg(t, ' > ' ORDER BY l) AS path FROM a GROUP BY doc_id, position""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    h = o.select(F.col("o_custkey").alias("doc_id"), n.alias("position"), (1 + F.col("o_orderkey") % 3).cast("int").alias("level"), F.col("o_orderpriority").alias("title"))
    return S.section_paths(h, 3).select("doc_id", F.col("position").cast("long").alias("position"), "path")


@query("structure_signals", """WITH h AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, 1 + CAST(o_orderkey % 3 AS INTEGER) AS level, o_orderpriority AS title FROM orders),
 w AS (SELECT *, lag(level) OVER p AS before, lead(position) OVER p AS after, count(*) OVER (PARTITION BY doc_id, level, title) AS same FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY position))
 SELECT code, count(*) AS signals, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, 'heading_level_jump' AS code FROM w WHERE level > coalesce(before, 0) + 1
 UNION ALL SELECT doc_id, 'duplicate_heading' FROM w WHERE same > 1 UNION ALL SELECT doc_id, 'empty_section' FROM w WHERE after = position + 1) GROUP BY ALL""")
def structure_signals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    h = o.select(F.col("o_custkey").alias("doc_id"), n.alias("position"), (1 + F.col("o_orderkey") % 3).cast("int").alias("level"), F.col("o_orderpriority").alias("title"))
    return S.structure_signals(h).groupBy("code").agg(F.count("*").alias("signals"), F.count_distinct("doc_id").alias("documents"))
