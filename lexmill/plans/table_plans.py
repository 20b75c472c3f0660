"""Records, grids, coverage and version comparison over orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.scratch import written
from lexmill.operators import blocks as B
from lexmill.operators import coverage as C
from lexmill.operators import tables as T
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table

_FIELDS = [("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("key", "o_orderkey"), ("status", "o_orderstatus")]


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the rows 1, 2, ... of their customer's table."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), n.alias("row_index"), "*")


def row_of(texts: list) -> F.Column:
    """Cells 0, 1, ... of one row."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("col_index"), t.cast("string").alias("text")) for i, t in enumerate(texts)]))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tables: a header row with a repeated name, then a row per order."""
    body = numbered(spark, d).select("table_id", "row_index", row_of([F.col(c) for _, c in _FIELDS]))
    head = numbered(spark, d).select("table_id").distinct().select("table_id", F.lit(0).alias("row_index"), row_of([F.lit(n) for n, _ in _FIELDS]))
    return head.unionByName(body)


_ROWS = "n AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_index, * FROM orders)"


def recs(spark: SparkSession, d: str) -> DataFrame:
    """Line items as records of their order, with pages by line number."""
    li = table(spark, d, "lineitem")
    pairs = F.map_from_arrays(F.array(F.lit("flag"), F.lit("status"), F.lit("comment")), F.array("l_returnflag", "l_linestatus", F.lit("")))
    rid = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")))
    raw = F.concat_ws(" | ", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"))
    codes = F.filter(F.array(F.when(F.col("l_quantity") > 45, "large"), F.when(F.col("l_discount") == 0, "no_discount")), lambda c: c.isNotNull())
    return li.select(
        F.col("l_orderkey").alias("table_id"), rid.alias("record_id"), F.col("l_linenumber").alias("row_index"), pairs.alias("fields"), raw.alias("raw_text"), raw.alias("normalized_text"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("page_start"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") + 1).alias("page_end"), codes.alias("quality_signal_codes"),
    )


_RECS = """recs AS (SELECT l_orderkey AS table_id, l_orderkey || ':r' || l_linenumber AS record_id, l_linenumber AS row_index, l_returnflag AS flag, l_linestatus AS status,
 l_returnflag || ' | ' || l_linestatus || ' | ' || strftime(l_shipdate, '%Y-%m-%d') AS raw_text, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS page_start,
 CASE WHEN l_linenumber > 2 THEN l_linenumber + 1 END AS page_end, l_quantity > 45 AS large FROM lineitem)"""


@query("stable_headers", """SELECT DISTINCT o_custkey AS table_id, unnest([0, 1, 2, 3])::BIGINT AS col_index, unnest(['status', 'priority', 'key', 'status_2']) AS header FROM orders""")
def stable_headers(spark: SparkSession, d: str) -> DataFrame:
    return T.stable_headers(cells(spark, d)).withColumn("col_index", F.col("col_index").cast("long"))


@query("structured_records", f"""WITH {_ROWS} SELECT table_id, table_id || ':r' || row_index AS record_id, o_orderpriority AS priority, o_orderstatus AS status_2, o_orderkey AS key FROM n""")
def structured_records(spark: SparkSession, d: str) -> DataFrame:
    r = T.records(cells(spark, d))
    return r.select("table_id", "record_id", F.element_at("fields", "priority").alias("priority"), F.element_at("fields", "status_2").alias("status_2"), F.element_at("fields", "key").cast("long").alias("key"))


@query("record_filter", f"""WITH {_RECS} SELECT record_id, flag FROM recs WHERE contains(lower(concat_ws(' ', record_id, raw_text)), 'r | f') AND large AND flag = 'R'
 AND coalesce(page_end, coalesce(page_start, 1)) >= 2 AND coalesce(page_start, 1) <= 5""")
def record_filter(spark: SparkSession, d: str) -> DataFrame:
    f = T.filter_records(recs(spark, d), query="R | F", signal="large", fields={"flag": "r", "status": ""}, page_start=2, page_end=5)
    return f.select("record_id", F.element_at("fields", "flag").alias("flag"))


@query("record_page", f"""WITH {_RECS} SELECT record_id FROM recs WHERE flag = 'A' ORDER BY table_id, row_index LIMIT 50 OFFSET 20""")
def record_page(spark: SparkSession, d: str) -> DataFrame:
    f = T.filter_records(recs(spark, d), fields={"flag": "a"})
    return f.orderBy("table_id", "row_index").offset(20).limit(50).select("record_id")


@query("records_summary", f"""WITH {_RECS} SELECT count(*) AS total, count(DISTINCT table_id) AS tables, count(*) FILTER (flag = 'R') AS returned, count(*) FILTER (large) AS large FROM recs""")
def records_summary(spark: SparkSession, d: str) -> DataFrame:
    return recs(spark, d).agg(
        F.count("*").alias("total"), F.count_distinct("table_id").alias("tables"), F.count_if(F.element_at("fields", "flag") == "R").alias("returned"), F.count_if(F.array_contains("quality_signal_codes", "large")).alias("large")
    )


@query("expand_spans", """SELECT l_orderkey AS table_id, CAST(count(*) AS BIGINT) AS places, CAST(sum((r > 0 OR c > 0)::INT) AS BIGINT) AS continued FROM
 (SELECT l_orderkey, l_linenumber, unnest(range(1 + l_linenumber % 2)) AS r, l_suppkey FROM lineitem), unnest(range(CAST(1 + l_suppkey % 3 AS BIGINT))) AS u(c) GROUP BY ALL""")
def expand_spans(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (2 * F.col("l_linenumber")).alias("row_index"), F.lit(0).alias("col_index"), F.col("l_returnflag").alias("text"), (1 + F.col("l_linenumber") % 2).alias("row_span"), (1 + F.col("l_suppkey") % 3).cast("int").alias("col_span"))
    return T.expand_spans(c).groupBy("table_id").agg(F.count("*").alias("places"), F.count_if("continuation").alias("continued"))


@query("markdown_tables", f"""WITH {_ROWS} SELECT table_id, '| key | both |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || '\\|' || o_orderpriority || ' |', chr(10) ORDER BY row_index) AS markdown FROM n GROUP BY ALL""")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    n = numbered(spark, d)
    body = n.select("table_id", "row_index", row_of([F.col("o_orderkey"), F.concat_ws("|", "o_orderstatus", "o_orderpriority")]))
    head = n.select("table_id").distinct().select("table_id", F.lit(0).alias("row_index"), row_of([F.lit("key"), F.lit("both")]))
    return T.render(head.unionByName(body)).select("table_id", "markdown")


_TABLES = """t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, CAST(floor(o_orderkey / 40) AS BIGINT) AS page, o_orderstatus AS h, o_orderpriority AS l FROM orders)"""


@query("table_continuations", f"""WITH {_TABLES}, w AS (SELECT *, lag(table_id) OVER p AS pt, lag(page) OVER p AS pp, lag(h) OVER p AS ph, lag(l) OVER p AS pl FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY page, table_id))
 SELECT kind, count(*) AS links FROM (SELECT CASE WHEN page - pp <= 0 THEN NULL WHEN page - pp <= 2 AND l = pl AND h <> ph THEN 'column_continuation' WHEN page - pp = 1 AND h = ph AND l <> pl THEN 'row_continuation' END AS kind FROM w) GROUP BY ALL""")
def table_continuations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), F.floor(F.col("o_orderkey") / 40).alias("page"), F.array("o_orderstatus", F.lit("x")).alias("header"), F.array("o_orderpriority", F.lit("y")).alias("labels"), F.lit(2).alias("rows"))
    return T.continuations(t).groupBy("kind").agg(F.count("*").alias("links"))


@query("inherit_merged", f"""WITH {_ROWS}, r AS (SELECT table_id AS k, row_index AS n, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus || o_orderkey ELSE '' END AS v FROM n)
 SELECT k, CAST(n AS BIGINT) AS n, (SELECT arg_max(x.v, x.n) FROM r x WHERE x.k = r.k AND x.n <= r.n AND x.v <> '') AS v FROM r""")
def inherit_merged(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 3 == 1, F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).otherwise("")
    r = numbered(spark, d).select(F.col("table_id").alias("k"), F.col("row_index").alias("n"), v.alias("v"))
    return T.inherit_merged(r, "k", "n", "v").withColumn("n", F.col("n").cast("long"))


_UNITS = f"""{Q.BLOCKS}, u AS (SELECT doc_id, position, page_number, content, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM blocks),
 c AS (SELECT *, (doc_id + position) % 7 <> 0 AS emb, (doc_id + position) % 11 <> 0 AS made FROM u)"""


def _covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Units of all documents, written once and without their texts, and chunks of most of them, most embedded."""
    units = written(C.units(B.line_blocks(table(spark, d, "documents"))).drop("text"), "covered-units")
    at = F.col("doc_id") + F.regexp_extract(F.get("block_ids", F.lit(0)), r"-p-(\d+)$", 1).cast("long")
    chunks = C.chunks(units).where(at % 11 != 0).withColumn("embedded", at % 7 != 0)
    return units, chunks


@query("unit_coverage", f"""WITH {_UNITS} SELECT doc_id || ':ku:' || lpad(CAST(n AS VARCHAR), 6, '0') AS unit_id, CAST(made AS BIGINT) AS chunks, CAST(made AND emb AS BIGINT) AS embedded,
 made AND emb AS all_embedded, CASE WHEN NOT made THEN 'no_chunk' WHEN NOT emb THEN 'not_embedded' END AS missing_reason FROM c""")
def unit_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.unit_coverage(*_covered(spark, d)).select("unit_id", F.col("chunks").cast("long").alias("chunks"), F.col("embedded").cast("long").alias("embedded"), "all_embedded", "missing_reason")


_PAGES = f"""{_UNITS}, p AS (SELECT doc_id, page_number, count(*) AS units, count(*) AS indexable, count(*) FILTER (made) AS chunked, count(*) FILTER (made AND emb) AS embedded FROM c GROUP BY ALL),
 g AS (SELECT *, CASE WHEN chunked < indexable THEN 'missing_chunks' WHEN embedded < indexable THEN 'not_embedded' END AS gap FROM p)"""


@query("page_coverage", f"WITH {_PAGES} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, units, indexable, chunked, embedded, gap FROM g")
def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.page_coverage(C.unit_coverage(*_covered(spark, d))).withColumn("page_number", F.col("page_number").cast("long"))


_SUMMARY = f"""{_PAGES}, s AS (SELECT doc_id, count(*) AS pages, count(gap) AS pages_with_gaps, count(*) FILTER (gap = 'missing_chunks') AS pages_missing_chunks, count(*) FILTER (gap = 'not_embedded') AS pages_not_embedded,
 CAST(sum(indexable) AS BIGINT) AS indexable, CAST(sum(chunked) AS BIGINT) AS chunked, CAST(sum(embedded) AS BIGINT) AS embedded FROM g GROUP BY ALL),
 q AS (SELECT *, {Q.r4('(pages - pages_with_gaps) / pages')} AS page_ratio, {Q.r4('chunked / indexable')} AS chunk_ratio, {Q.r4('embedded / indexable')} AS embedded_ratio FROM s)"""


@query("coverage_summary", f"WITH {_SUMMARY} SELECT * FROM q")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(C.page_coverage(C.unit_coverage(*_covered(spark, d))))


@query("traceability", f"""WITH {_UNITS} SELECT count(*) AS chunks, count(*) FILTER (position % 5 <> 0) AS traceable FROM c WHERE made""")
def traceability(spark: SparkSession, d: str) -> DataFrame:
    _, chunks = _covered(spark, d)
    kept = B.line_blocks(table(spark, d, "documents")).where("position % 5 <> 0")
    return C.traceability(chunks, kept).agg(F.count("*").alias("chunks"), F.count_if("traceable").alias("traceable"))


@query("signals_in_parts", """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_returnflag AS code FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS doc_id, unnest([1, 2, 3]) AS part_id FROM lineitem)
 SELECT CAST(part_id AS BIGINT) AS part_id, code, count(*) AS signals FROM s JOIN p ON s.doc_id = p.doc_id AND page BETWEEN part_id * 2 - 1 AND part_id * 2 GROUP BY ALL""")
def signals_in_parts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.col("l_returnflag").alias("code"))
    p = li.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("part_id"))
    p = p.select("doc_id", "part_id", (2 * F.col("part_id") - 1).alias("page_start"), (2 * F.col("part_id")).alias("page_end"))
    return C.signals_in_range(s, p).groupBy(F.col("part_id").cast("long").alias("part_id"), "code").agg(F.count("*").alias("signals"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents' blocks: lines dropped, changed, moved to other pages."""
    b = B.line_blocks(table(spark, d, "documents"))
    new = b.where("(doc_id + position) % 13 <> 0").withColumn("content", F.when((F.col("doc_id") + F.col("position")) % 5 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content")))
    new = new.withColumn("page_number", F.when((F.col("doc_id") + F.col("position")) % 6 == 0, F.col("page_number") + 40).otherwise(F.col("page_number")))

    def prints(x: DataFrame) -> DataFrame:
        content, structure = F.sha2("content", 256), F.sha2(F.concat_ws("|", F.col("page_number").cast("string"), (F.col("position") % 4).cast("string")), 256)
        return x.select("doc_id", F.concat_ws("-", F.lit("u"), F.col("position").cast("string")).alias("unit_id"), "position", F.sha2(F.concat(content, structure, F.col("page_number").cast("string")), 256).alias("unit_fingerprint"), content.alias("content_fingerprint"), structure.alias("structure_fingerprint"))

    return prints(b), prints(new)


_VERSIONS = f"""{Q.BLOCKS}, n0 AS (SELECT doc_id, position, CASE WHEN (doc_id + position) % 5 = 0 THEN content || ' new' ELSE content END AS content, CASE WHEN (doc_id + position) % 6 = 0 THEN page_number + 40 ELSE page_number END AS page_number
 FROM blocks WHERE (doc_id + position) % 13 <> 0), p AS (SELECT doc_id, position, content AS c, page_number || '|' || position % 4 AS s FROM blocks), n AS (SELECT doc_id, position, content AS c, page_number || '|' || position % 4 AS s FROM n0),
 p1 AS (SELECT doc_id, c, s, min(position) AS position FROM p GROUP BY ALL HAVING count(*) = 1), n1 AS (SELECT doc_id, c, s, min(position) AS position FROM n GROUP BY ALL HAVING count(*) = 1),
 m1 AS (SELECT p1.doc_id, p1.position AS a, n1.position AS b FROM p1 JOIN n1 USING (doc_id, c, s)),
 pa AS (SELECT * FROM p ANTI JOIN m1 ON p.doc_id = m1.doc_id AND p.position = m1.a), na AS (SELECT * FROM n ANTI JOIN m1 ON n.doc_id = m1.doc_id AND n.position = m1.b),
 m2 AS (SELECT x.doc_id, x.position AS a, y.position AS b FROM (SELECT doc_id, c, min(position) AS position FROM pa GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT doc_id, c, min(position) AS position FROM na GROUP BY ALL HAVING count(*) = 1) y USING (doc_id, c)),
 pb AS (SELECT * FROM pa ANTI JOIN m2 ON pa.doc_id = m2.doc_id AND pa.position = m2.a), nb AS (SELECT * FROM na ANTI JOIN m2 ON na.doc_id = m2.doc_id AND na.position = m2.b),
 m3 AS (SELECT x.doc_id, x.position AS a, y.position AS b FROM (SELECT doc_id, s, min(position) AS position FROM pb GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT doc_id, s, min(position) AS position FROM nb GROUP BY ALL HAVING count(*) = 1) y USING (doc_id, s)),
 pc AS (SELECT * FROM pb ANTI JOIN m3 ON pb.doc_id = m3.doc_id AND pb.position = m3.a), nc AS (SELECT * FROM nb ANTI JOIN m3 ON nb.doc_id = m3.doc_id AND nb.position = m3.b),
 m4 AS (SELECT x.doc_id, x.position AS a, y.position AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY position) AS k FROM pc) x JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY position) AS k FROM nc) y USING (doc_id, c, k)),
 pd AS (SELECT * FROM pc ANTI JOIN m4 ON pc.doc_id = m4.doc_id AND pc.position = m4.a), nd AS (SELECT * FROM nc ANTI JOIN m4 ON nc.doc_id = m4.doc_id AND nc.position = m4.b),
 m5 AS (SELECT x.doc_id, x.position AS a, y.position AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY position) AS k FROM pd) x JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY position) AS k FROM nd) y USING (doc_id, s, k)),
 pe AS (SELECT * FROM pd ANTI JOIN m5 ON pd.doc_id = m5.doc_id AND pd.position = m5.a), ne AS (SELECT * FROM nd ANTI JOIN m5 ON nd.doc_id = m5.doc_id AND nd.position = m5.b),
 al AS (SELECT 'unchanged' AS status, doc_id FROM m1 UNION ALL SELECT 'relocated', doc_id FROM m2 UNION ALL SELECT 'changed', doc_id FROM m3 UNION ALL SELECT 'unknown', doc_id FROM m4 UNION ALL SELECT 'unknown', doc_id FROM m5 UNION ALL SELECT 'removed', doc_id FROM pe UNION ALL SELECT 'added', doc_id FROM ne)"""


@query("unit_diff", f"WITH {_VERSIONS} SELECT doc_id, status, count(*) AS units FROM al GROUP BY ALL")
def unit_diff(spark: SparkSession, d: str) -> DataFrame:
    return C.diff_units(*_versions(spark, d)).groupBy("doc_id", "status").agg(F.count("*").alias("units"))


@query("record_set_compare", """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS q FROM orders WHERE o_orderkey % 5 <> 3), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS q FROM orders WHERE o_orderkey % 7 <> 2)
 SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.q = b.q THEN 'same' ELSE 'changed' END AS status, count(*) AS records FROM a FULL JOIN b USING (k) GROUP BY ALL""")
def record_set_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").alias("q"))
    b = o.where("k % 7 <> 2").withColumn("q", F.when(F.col("o_custkey") % 4 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return C.compare_records(o.where("k % 5 <> 3"), b, "k", ["q"]).groupBy("status").agg(F.count("*").alias("records"))


@query("key_intersection", "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").select(F.col("c_custkey").alias("k"))).agg(F.count("*").alias("shared"))


@query("key_difference", "SELECT count(*) AS only_customers FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey").distinct().agg(F.count("*").alias("only_customers"))


@query("page_union", "SELECT DISTINCT k FROM (SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier)")
def page_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).union(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))).distinct()


@query("replaced_prefix", """WITH s AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus FROM orders)
 SELECT doc_id, count(*) FILTER (o_orderstatus <> 'F') + 2 AS blocks FROM s GROUP BY ALL""")
def replaced_prefix(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.operators.control import replace_prefix

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    stored = o.select(F.col("o_custkey").alias("doc_id"), F.concat_ws("-", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("block_id"), (F.row_number().over(w) - 1).alias("position"), F.col("o_orderpriority").alias("content"))
    fresh = o.select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.inline(F.from_json(F.lit('[{"block_id":"F-new0","position":0,"content":"a"},{"block_id":"F-new1","position":1,"content":"b"}]'), "array<struct<block_id:string,position:int,content:string>>")))
    return replace_prefix(stored, fresh, "F-").groupBy("doc_id").agg(F.count("*").alias("blocks"))
