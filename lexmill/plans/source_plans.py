"""Sources, page geometry and catalogue pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import catalog as C
from lexmill.operators import geometry as G
from lexmill.operators import tables as T
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table
from lexmill.sources import readers as R

_TAG = "(?:h1|h2|h3|h4|h5|h6|p|li|td|th|pre|blockquote)"
_DEAD = "html"
for _x in ("script", "style", "nav", "header", "footer", "aside", "noscript", "template"):
    _DEAD = f"regexp_replace({_DEAD}, '(?is)<{_x}\\b[^>]*>.*?</{_x}\\s*>', ' ', 'g')"
_DEAD = f"regexp_replace({_DEAD}, '(?s)<!--.*?-->', ' ', 'g')"
_CLEAN = "regexp_replace(regexp_replace(raw, '^[^>]*>', ''), '(?s)<[^>]+>', ' ', 'g')"
for _k, _v in R.ENTITIES.items():
    _CLEAN = f"replace({_CLEAN}, {Q.quoted(_k)}, {Q.quoted(_v)})"


@query("html_blocks", f"""WITH r AS (SELECT page_id AS doc_id, unnest(regexp_extract_all({_DEAD}, '(?is)<({_TAG}\\b[^>]*>.*?)</{_TAG}\\s*>', 1)) AS raw FROM pages),
 b AS (SELECT doc_id, lower(regexp_extract(raw, '^(\\w+)', 1)) AS tag, trim(regexp_replace({_CLEAN}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS content FROM r)
 SELECT doc_id, CASE WHEN tag LIKE 'h_' THEN 'title' WHEN tag IN ('td', 'th') THEN 'table' WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS type, count(*) AS blocks, CAST(sum(length(content)) AS BIGINT) AS chars FROM b WHERE content <> '' GROUP BY ALL""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.html_blocks(table(spark, d, "pages")).groupBy("doc_id", "type").agg(F.count("*").alias("blocks"), F.sum(F.char_length("content")).alias("chars"))


@query("conversation_blocks", "SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, role, trim(text) AS content FROM conversations")
def conversation_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.conversation_blocks(table(spark, d, "conversations")).withColumn("position", F.col("position").cast("long"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a markdown text: a heading, a table, a paragraph."""
    w = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" |")).alias("row"))))
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(w.alias("r"))
    return g.select("doc_id", F.concat(F.lit("---\nid: x\n---\n# Orders\n\n| key | status |\n|---|:---:|\n"), F.array_join("r.row", "\n"), F.lit("\n\nEnd of\nlist.\n")).alias("text"))


@query("markdown_blocks", """SELECT o_custkey AS doc_id, unnest([0, 1, 2])::BIGINT AS position, unnest(['title', 'table', 'paragraph']) AS type, unnest(['Orders', '| key | status |' || chr(10) || '|---|:---:|' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey), 'End of' || chr(10) || 'list.']) AS content FROM orders GROUP BY o_custkey""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.markdown_blocks(_markdown(spark, d)).select("doc_id", F.col("position").cast("long").alias("position"), "type", "content")


@query("markdown_cells", """WITH n AS (SELECT o_custkey || ':t:1' AS t, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r, o_orderkey, o_orderstatus FROM orders)
 SELECT t AS table_id, r AS row_index, unnest([0, 1])::BIGINT AS col_index, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus]) AS "text" FROM n UNION ALL SELECT DISTINCT t, 0, unnest([0, 1])::BIGINT, unnest(['key', 'status']) FROM n""")
def markdown_cells(spark: SparkSession, d: str) -> DataFrame:
    return R.markdown_cells(R.markdown_blocks(_markdown(spark, d))).select("table_id", F.col("row_index").cast("long").alias("row_index"), F.col("col_index").cast("long").alias("col_index"), "text")


def words(spark: SparkSession, d: str) -> DataFrame:
    """Line items as words on the pages of their supplier."""
    li = table(spark, d, "lineitem")
    x = (F.col("l_partkey") * 37 % 500).cast("double")
    top = (F.col("l_orderkey") % 40 * 10).cast("double")
    return li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 3).cast("int").alias("page_number"), x.alias("x0"), top.alias("top"), (x + F.col("l_quantity")).alias("x1"), (top + 8.0).alias("bottom"), F.col("l_partkey").cast("string").alias("text"), F.lit(600.0).alias("page_width"))


_WORDS = """w AS (SELECT l_suppkey AS doc_id, l_orderkey % 3 AS page, (l_partkey * 37 % 500)::DOUBLE AS x0, (l_orderkey % 40 * 10)::DOUBLE AS top, (l_partkey * 37 % 500)::DOUBLE + l_quantity AS x1, (l_orderkey % 40 * 10)::DOUBLE + 8 AS bottom FROM lineitem)"""


@query("word_lines", f"""WITH {_WORDS}, c AS (SELECT *, CASE WHEN x0 - lag(x1) OVER p > 18 THEN 1 ELSE 0 END AS cut FROM w WINDOW p AS (PARTITION BY doc_id, page, top ORDER BY x0, x1)),
 l AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page, top ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS part FROM c), g AS (SELECT doc_id, page, top, part, min(x0) AS x0, max(x1) AS x1 FROM l GROUP BY ALL)
 SELECT doc_id, count(*) AS "lines", sum(x1 - x0) AS width FROM g GROUP BY ALL""")
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.words_to_lines(words(spark, d)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.col("x1") - F.col("x0")).alias("width"))


@query("line_columns", f"""WITH {_WORDS} SELECT CASE WHEN x1 - x0 >= 330 OR (x0 < 288 AND x1 > 312) THEN 0 WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 2 END AS "column", count(*) AS words FROM w GROUP BY ALL""")
def line_columns(spark: SparkSession, d: str) -> DataFrame:
    return G.column_of(words(spark, d)).groupBy("column").agg(F.count("*").alias("words"))


@query("line_bands", f"""WITH {_WORDS}, d AS (SELECT DISTINCT doc_id, page, top, bottom FROM w), o AS (SELECT *, CASE WHEN top - max(bottom) OVER (PARTITION BY doc_id, page ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2.5 THEN 1
 WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY top) = 1 THEN 1 ELSE 0 END AS op FROM d) SELECT doc_id, CAST(sum(op) AS BIGINT) AS bands FROM o GROUP BY ALL""")
def line_bands(spark: SparkSession, d: str) -> DataFrame:
    lines = words(spark, d).groupBy("doc_id", "page_number", "top", "bottom").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return G.bands(lines, 2.5).groupBy("doc_id").agg(F.count("*").alias("bands"))


@query("lines_in_regions", f"""WITH {_WORDS} SELECT doc_id, count(*) AS pairs FROM w WHERE x0 < 350 AND x1 > 100 AND top < 150 AND bottom > 55 GROUP BY ALL""")
def lines_in_regions(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).withColumn("line_id", F.monotonically_increasing_id())
    regions = w.select("doc_id", "page_number").distinct().select("doc_id", "page_number", F.lit("r").alias("region_id"), F.lit(100.0).alias("x0"), F.lit(55.0).alias("top"), F.lit(350.0).alias("x1"), F.lit(150.0).alias("bottom"))
    return G.in_region(w, regions).groupBy("doc_id").agg(F.count("*").alias("pairs"))


@query("word_columns", f"""WITH {_WORDS} SELECT CASE WHEN (x0 + x1) / 2 < 125 THEN 'a' WHEN (x0 + x1) / 2 < 300 THEN 'b' ELSE 'c' END AS name, count(*) AS words FROM w GROUP BY ALL""")
def word_columns(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    heads = F.from_json(F.lit('[{"name":"a","x0":0,"x1":100},{"name":"b","x0":150,"x1":250},{"name":"c","x0":350,"x1":450}]'), "array<struct<name:string,x0:double,x1:double>>")
    h = w.select("doc_id", "page_number").distinct().select("doc_id", "page_number", F.inline(heads))
    return G.words_to_columns(w, h).groupBy("name").agg(F.count("*").alias("words"))


@query("section_spans", """WITH h AS (SELECT o_custkey AS doc_id, o_orderpriority AS section, o_orderkey AS page FROM orders) SELECT doc_id, section, page AS first_page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, page) AS last_page FROM h""")
def section_spans(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("page_number"))
    return C.section_spans(h)


@query("row_gaps", """WITH r AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 400 AS n FROM orders), g AS (SELECT k, n, lead(n) OVER (PARTITION BY k ORDER BY n) AS nx FROM r), m AS (SELECT k, unnest(range(n + 1, nx)) AS missing FROM g WHERE nx > n + 1)
 SELECT k, count(*) AS gaps, CAST(sum(missing) AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY missing) AS rn FROM m) WHERE rn <= 100 GROUP BY ALL""")
def row_gaps(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 400).alias("n"))
    return C.row_gaps(r, "k", "n").groupBy("k").agg(F.count("*").alias("gaps"), F.sum("missing").alias("total"))


@query("catalog_audit", """WITH i AS (SELECT l_suppkey AS k, l_orderkey AS r, count(*) AS n, count(CASE WHEN l_tax > 0.02 THEN 1 END) AS dates FROM lineitem GROUP BY ALL)
 SELECT k, CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (n > 1) AS duplicate_rows, CAST(sum(dates) AS BIGINT) AS dated, CAST(sum(n) AS BIGINT) AS with_evidence, min(r) AS first_row, max(r) AS last_row FROM i GROUP BY ALL""")
def catalog_audit(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("r"), F.when(F.col("l_tax") > 0.02, F.col("l_shipdate")).alias("date"), F.col("l_returnflag").alias("e"))
    return C.audit(li, "k", "r", "date", "e")


@query("assigned_rows")
def assigned_rows(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    c = (F.col("top") + F.col("bottom")) / 2
    lines = w.groupBy("doc_id", "page_number", "top", "bottom").agg(F.min("text").alias("text")).select("doc_id", "page_number", c.alias("centre"), "text")
    n = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("centre"))
    anchors = lines.where(F.col("centre") % 40 == 4).select("doc_id", "page_number", "centre", n.alias("row_number"))
    return C.assign_rows(anchors, lines)


@query("sheet_regions", """WITH r AS (SELECT o_custkey AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderkey % 4 AS cells FROM orders),
 w AS (SELECT *, lag(cells) OVER p AS b, lead(cells) OVER p AS a FROM r WINDOW p AS (PARTITION BY sheet ORDER BY row)), o AS (SELECT *, CASE WHEN (cells > 0 AND coalesce(b, 0) = 0) OR (cells = 1 AND coalesce(a, 0) >= 2 AND coalesce(b, 0) > 0) THEN 1 ELSE 0 END AS op FROM w),
 g AS (SELECT *, sum(op) OVER (PARTITION BY sheet ORDER BY row) AS region FROM o) SELECT sheet, count(DISTINCT region) AS regions, count(*) AS "rows" FROM g WHERE cells > 0 GROUP BY ALL""")
def sheet_regions(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), n.alias("row"), (F.col("o_orderkey") % 4).alias("cells"))
    g = T.regions(r)
    return g.groupBy("sheet").agg(F.count_distinct("region").alias("regions"), F.sum(F.col("last_row") - F.col("first_row") + 1).alias("rows"))


@query("exported_rows", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS filled FROM orders""")
def exported_rows(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.sources.sinks import rendered

    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), (F.col("o_orderstatus") == "F").alias("filled"))
    return rendered(o).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
