"""Rules on states, failures, profiles, tables, providers and attention, over orders, line items and events.

Each oracle states the rule itself: it shares no constant with the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import blocks as B
from lexmill.operators import catalog as C
from lexmill.operators import control as K
from lexmill.operators import diagnostics as D
from lexmill.operators import metrics as M
from lexmill.operators import tables as T
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table


def pick(values: list, index: F.Column) -> F.Column:
    """The value at an index from 0, of a short literal list."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


_STATES = ["pending", "running", "succeeded", "not_run", "info", "passed", "warning", "needs_review", "rejected", "error", "unpublished", "published", "superseded", "withdrawn"]


@query("publication_transitions", f"""WITH s AS (SELECT {_STATES} AS names), c AS (SELECT ['execution', 'validation', 'publication'][o_orderkey % 3 + 1] AS axis, names[o_custkey % 14 + 1] AS o, names[(o_orderkey // 3) % 14 + 1] AS n FROM orders, s),
 legal AS (SELECT unnest(['execution pending running', 'execution running succeeded', 'validation not_run info', 'validation not_run passed', 'validation not_run warning', 'validation not_run needs_review', 'validation not_run rejected', 'validation not_run error',
  'validation info passed', 'validation info warning', 'validation info needs_review', 'validation info rejected', 'validation info error', 'validation passed warning', 'validation passed needs_review', 'validation passed rejected',
  'validation warning passed', 'validation warning needs_review', 'validation warning rejected', 'validation needs_review passed', 'validation needs_review warning', 'validation needs_review rejected',
  'validation rejected needs_review', 'validation rejected warning', 'validation rejected error', 'validation error not_run', 'validation error needs_review', 'validation error rejected',
  'publication unpublished published', 'publication unpublished withdrawn', 'publication published superseded', 'publication published withdrawn', 'publication superseded withdrawn']) AS way)
 SELECT axis, o AS "old", n AS "new", concat_ws(' ', axis, o, n) IN (SELECT way FROM legal) AS legal, count(*) AS changes FROM c GROUP BY ALL""")
def publication_transitions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(pick(["execution", "validation", "publication"], k % 3).alias("axis"), pick(_STATES, F.col("o_custkey") % 14).alias("old"), pick(_STATES, F.floor(k / 3) % 14).alias("new"))
    return K.check_transitions(c).groupBy("axis", "old", "new", "legal").agg(F.count("*").alias("changes"))


_FAILED = [
    ("Read timed out after 30s", "timeout"), ("HTTP Error 401: Unauthorized", "permission_denied"), ("got status code 429", "rate_limited"), ("HTTP error 404", "invalid_input"), ("Unsupported media type", "unsupported"),
    ("Empty response from provider", "invalid_response"), ("API_KEY_ENV is not set", "configuration_error"), ("No module named x", "provider_unavailable"), ("HTTP Error 503", "provider_unavailable"), ("page 401 is odd", "provider_failed"),
    ("", "provider_failed"), (None, "provider_failed"), ("connection reset by peer", "provider_unavailable"), ("page_range is wrong", "invalid_input"), ("Too Many Requests", "rate_limited"), ("timeout: http error 401", "timeout"),
]


@query("failure_classes", "WITH v(n, message, class) AS (VALUES " + ", ".join(f"({i}, {'NULL' if m is None else Q.quoted(m)}, '{c}')" for i, (m, c) in enumerate(_FAILED)) + """)
 SELECT user_id, message, class, count(*) AS n FROM (SELECT user_id, event_id % 16 AS n FROM events) e JOIN v USING (n) GROUP BY ALL""")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    message = pick([m for m, _ in _FAILED], F.col("event_id") % 16)
    return table(spark, d, "events").withColumn("message", message).groupBy("user_id", "message", M.failure_class(F.col("message")).alias("class")).agg(F.count("*").alias("n"))


@query("retry_delays", "SELECT event_id, floor(least(0.3::DOUBLE * pow(2.0, greatest(event_id % 12 - 1, 0)), 60.0::DOUBLE) * 1000 + 0.5) / 1000 AS delay FROM events")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", M.retry_delay(F.col("event_id") % 12, 0.3).alias("delay"))


_NAMES = ["Catalog.pdf", "台账.PDF", "scan_01.pdf", "book.xlsx", "pic.jpeg", None, "plain.pdf", "statement.txt"]


@query("profile_resolution", """WITH o AS (SELECT o_orderkey AS k, ['application/pdf', 'image/png', NULL, ' Application/PDF ', 'application/vnd.ms-excel'][o_orderkey % 5 + 1] AS media,
 ['Catalog.pdf', '台账.PDF', 'scan_01.pdf', 'book.xlsx', 'pic.jpeg', NULL, 'plain.pdf', 'statement.txt'][(o_orderkey // 5) % 8 + 1] AS name, CASE WHEN o_custkey % 9 > 0 THEN (o_custkey % 9) * 8388608 END AS size,
 CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 7) * 100 END AS pages, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 4) * 80 END AS tables, CASE o_orderkey % 17 WHEN 0 THEN 'OCR-heavy ' WHEN 1 THEN ' auto' WHEN 2 THEN 'odd' END AS wish FROM orders),
 f AS (SELECT k, trim(lower(coalesce(wish, ''))) AS wish, coalesce(lower(name), '') AS name, trim(lower(coalesce(media, ''))) AS media, coalesce(pages >= 500, false) AS many, coalesce(size >= 52428800, false) AS big, coalesce(tables * 2 >= pages, false) AS dense FROM o),
 g AS (SELECT *, media = 'application/pdf' OR name LIKE '%.pdf' AS pdf, name LIKE '%catalog%' AS cat, name LIKE '%台账%' OR name LIKE '%statement%' AS led, media LIKE 'application/vnd%' OR name LIKE '%.xlsx' AS xl, media LIKE 'image/%' OR name LIKE '%.jpeg' AS img FROM f),
 h AS (SELECT *, concat_ws(';', CASE WHEN many THEN 'page_count>=500' END, CASE WHEN big THEN 'file_size_bytes>=52428800' END) AS lg FROM g)
 SELECT k, CASE WHEN wish NOT IN ('', 'auto') THEN wish WHEN pdf AND (many OR big) AND cat THEN 'large-pdf-catalog' WHEN pdf AND (many OR big) AND (led OR dense) THEN 'large-pdf-ledger' WHEN pdf AND (many OR big) THEN 'large-pdf' WHEN xl THEN 'excel-ledger'
   WHEN dense THEN 'table-heavy' WHEN img THEN 'ocr-heavy' WHEN pdf AND name LIKE '%scan%' THEN 'scan-pdf' ELSE 'default' END AS profile, CASE WHEN wish NOT IN ('', 'auto') THEN 'requested' ELSE 'auto' END AS source,
  CASE WHEN wish NOT IN ('', 'auto') THEN 'requested_profile=' || wish WHEN pdf AND (many OR big) AND cat THEN lg || ';catalog_name_hint' WHEN pdf AND (many OR big) AND (led OR dense) THEN concat_ws(';', lg, CASE WHEN led THEN 'ledger_name_hint' END, CASE WHEN dense THEN 'table_density>=0.5' END)
   WHEN pdf AND many THEN 'page_count>=500' WHEN pdf AND big THEN 'file_size_bytes>=52428800' WHEN xl THEN 'excel_input' WHEN dense THEN 'table_density>=0.5' WHEN img THEN 'image_input' WHEN pdf AND name LIKE '%scan%' THEN 'scan_name_hint' ELSE 'fallback_default' END AS reasons,
  CASE WHEN wish NOT IN ('', 'auto') THEN wish = 'scan-pdf' ELSE pdf AND (many OR big OR (NOT xl AND NOT dense AND NOT img AND name LIKE '%scan%')) END AS recommended_async, wish <> 'odd' AS known FROM h""")
def profile_resolution(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda n, by: F.when(c % n > 0, (c % n) * by)
    wish = F.when(k % 17 == 0, "OCR-heavy ").when(k % 17 == 1, " auto").when(k % 17 == 2, "odd")
    media = pick(["application/pdf", "image/png", None, " Application/PDF ", "application/vnd.ms-excel"], k % 5)
    p = K.profile(media, pick(_NAMES, F.floor(k / 5) % 8), some(9, 8388608), some(7, 100), some(4, 80), wish)
    return table(spark, d, "orders").select(k.alias("k"), p.alias("p")).select("k", "p.profile", "p.source", F.array_join("p.reasons", ";").alias("reasons"), "p.recommended_async", "p.known")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cells: an order is a table, a supplier a row; every third flag is blank."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("table_id"), F.col("l_suppkey").alias("row_index"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("text")
    )


_SHAPES = """r AS (SELECT l_orderkey % 50 AS doc_id, l_orderkey AS table_id, l_suppkey AS r, count(*) AS w, count(*) FILTER (l_returnflag = 'N') AS e FROM lineitem GROUP BY ALL),
 s AS (SELECT doc_id, table_id, max(w) AS cols, count(DISTINCT w) AS kinds, arg_min(w = e, r) AS hb, sum(e) / sum(w) AS er FROM r GROUP BY ALL)"""


@query("table_warnings", f"""WITH {_SHAPES} SELECT table_id, concat_ws(',', CASE WHEN hb THEN 'table_header_missing' END, CASE WHEN kinds > 1 THEN 'table_ragged_rows' END, CASE WHEN er > 0.5 THEN 'table_empty_ratio_high' END) AS warnings FROM s""")
def table_warnings(spark: SparkSession, d: str) -> DataFrame:
    return T.warnings(T.shapes(grid(spark, d))).select("table_id", F.array_join("warnings", ",").alias("warnings"))


@query("common_columns", f"""WITH {_SHAPES}, n AS (SELECT doc_id, cols, count(*) AS n FROM s GROUP BY ALL) SELECT doc_id, cols AS common_cols FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, cols) = 1""")
def common_columns(spark: SparkSession, d: str) -> DataFrame:
    return T.common_columns(T.shapes(grid(spark, d)))


@query("table_signals", f"""WITH {_SHAPES}, n AS (SELECT doc_id, cols, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT doc_id, cols AS cc FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, cols) = 1)
 SELECT table_id, unnest(list_filter([CASE WHEN hb THEN 'table_header_missing' END, CASE WHEN kinds > 1 THEN 'table_ragged_rows' END, CASE WHEN er > 0.5 THEN 'table_empty_ratio_high' END, CASE WHEN cols <> cc THEN 'table_col_count_changed' END], lambda x: x IS NOT NULL)) AS code, 'warning' AS severity FROM s JOIN c USING (doc_id)""")
def table_signals(spark: SparkSession, d: str) -> DataFrame:
    return T.signals(T.warnings(T.shapes(grid(spark, d)))).select("table_id", "code", "severity")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "table").when(F.col("l_linenumber") == 2, "figure").otherwise("block")
    codes = F.filter(F.array(F.when(F.col("l_quantity") > 49, "rag_empty_text_page"), F.when((F.col("l_suppkey") % 4 == 1) & (F.col("l_quantity") > 40), "rag_units_without_chunks")), lambda c: c.isNotNull())
    return K.provider_usage(li.select(
        F.concat_ws("-", "l_returnflag", (F.col("l_suppkey") % 4).cast("string")).alias("provider"), (F.col("l_orderkey") % 20).alias("doc_id"), (F.col("l_orderkey") % 9).alias("page_number"), kind.alias("kind"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 64.0).alias("elapsed"), (F.col("l_quantity") - 30.0).alias("memory"), F.when(F.col("l_discount") > 0.03, F.col("l_quantity") / 32.0).alias("confidence"), codes.alias("codes"),
    ))


_USED = """b AS (SELECT l_returnflag || '-' || l_suppkey % 4 AS provider, l_orderkey % 20 AS doc, l_orderkey % 9 AS page, l_linenumber AS ln, l_quantity AS q, l_discount AS dc, l_suppkey AS sk FROM lineitem),
 p AS (SELECT provider, doc, page, max(CASE WHEN q > 10 THEN q / 64.0::DOUBLE END) AS el, max(greatest(q - 30.0::DOUBLE, 0.0::DOUBLE)) AS mem, max(CASE WHEN dc > 0.03 THEN least(1.0::DOUBLE, q / 32.0::DOUBLE) END) AS cf,
  count(*) FILTER (ln > 2) AS b, count(*) FILTER (ln = 1) AS t, count(*) FILTER (ln = 2) AS f, bool_or(q > 49) AS e1, bool_or(sk % 4 = 1 AND q > 40) AS e2 FROM b GROUP BY ALL),
 u AS (SELECT provider, count(*) AS pages, CAST(sum(b) AS BIGINT) AS blocks, CAST(sum(t) AS BIGINT) AS tables, CAST(sum(f) AS BIGINT) AS figures, floor(sum(el) * 1e6 + 0.5) / 1e6 AS elapsed, count(el) AS elapsed_pages,
  floor(max(mem) * 1e4 + 0.5) / 1e4 AS memory, count(mem) AS memory_pages, floor(avg(cf) * 1e4 + 0.5) / 1e4 AS confidence, count(cf) AS confidence_pages, bool_or(e1) AS e1, bool_or(e2) AS e2 FROM p GROUP BY ALL)"""


@query("provider_usage", f"WITH {_USED} SELECT provider, pages, blocks, tables, figures, elapsed, elapsed_pages, memory, memory_pages, confidence, confidence_pages, concat_ws(',', CASE WHEN e1 THEN 'rag_empty_text_page' END, CASE WHEN e2 THEN 'rag_units_without_chunks' END) AS codes FROM u")
def provider_usage(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).withColumn("codes", F.array_join("codes", ","))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    codes = ["rag_empty_text_page", "rag_table_without_unit", "rag_figure_caption_missing", "rag_units_without_chunks", "rag_chunks_not_embedded"]
    mine = F.filter(F.array(*[F.when(k % (i + 3) == i, F.lit(c)) for i, c in enumerate(codes)]), lambda c: c.isNotNull())
    return K.compare_providers(s.select(
        F.col("s_name").alias("provider"), (k % 30).alias("coverage_pages"), (k % 7).alias("coverage_gaps"), (k % 100).alias("blocks"), (k % 10).alias("tables"), F.when(k % 5 > 0, (k % 64) / 64.0).alias("confidence"), mine.alias("codes"),
    ))


_COMPARED = f"""s AS (SELECT s_name AS provider, s_suppkey AS k, s_suppkey % 30 AS cp, s_suppkey % 7 AS cg, s_suppkey % 100 AS blocks, s_suppkey % 10 AS tables, CASE WHEN s_suppkey % 5 > 0 THEN (s_suppkey % 64) / 64.0::DOUBLE END AS cf FROM supplier),
 f AS (SELECT *, k % 3 = 0 AS a, k % 4 = 1 AS b, k % 5 = 2 AS c, k % 6 = 3 AS e, k % 7 = 4 AS g FROM s),
 p AS (SELECT *, least(0.5::DOUBLE, cg / greatest(cp, 1) * 0.5::DOUBLE) + CASE WHEN a THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN b THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN e THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN g THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN cf < 0.75 THEN least(0.1::DOUBLE, (0.75::DOUBLE - cf) * 0.4::DOUBLE) ELSE 0.0::DOUBLE END AS pen FROM f),
 q AS (SELECT *, {Q.r4('greatest(0.0::DOUBLE, 1.0::DOUBLE - pen)')} AS score, CASE WHEN a THEN 'review_parse_ir_or_local_rerun' WHEN b THEN 'compare_table_provider_or_local_rerun' WHEN c THEN 'review_figure_caption' WHEN e THEN 'rechunk_before_provider_change'
   WHEN g THEN 'reembed_before_provider_change' WHEN cg > 0 THEN 'inspect_coverage_gaps' ELSE 'keep_candidate' END AS recommendation, CASE WHEN a THEN 'gap' WHEN cg > 0 THEN 'warning' ELSE 'ok' END AS text_axis, CASE WHEN cf IS NULL THEN 'not_observed' WHEN cf < 0.75 THEN 'warning' ELSE 'ok' END AS order_axis FROM p),
 z AS (SELECT *, row_number() OVER (ORDER BY score DESC, cg, tables DESC, blocks DESC, provider) AS rank FROM q)"""


@query("provider_ranking", f"WITH {_COMPARED} SELECT provider, score, recommendation, text_axis, order_axis, rank FROM z")
def provider_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("provider", "score", "recommendation", "text_axis", "order_axis", F.col("rank").cast("long").alias("rank"))


@query("provider_summary", f"""WITH {_COMPARED}, y AS (SELECT *, a OR cg > 0 OR b OR c OR e OR g OR coalesce(cf < 0.75, false) AS w FROM z)
 SELECT arg_min(provider, rank) AS best, count(*) AS providers, count(*) FILTER (w) AS with_warnings, count(*) FILTER (cf < 0.75) AS with_order_warning, count(*) FILTER (cg > 0) AS with_gaps, max(CASE WHEN k = 3 THEN rank END) AS primary_rank,
  arg_min(provider, rank) <> max(CASE WHEN k = 3 THEN provider END) AS best_differs, true AS needs_attention, CASE WHEN arg_min(provider, rank) <> max(CASE WHEN k = 3 THEN provider END) THEN 'inspect_provider_route_plan' ELSE 'inspect_provider_comparison' END AS action FROM y""")
def provider_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.comparison_summary(_compared(spark, d), "Supplier#000000003").withColumn("primary_rank", F.col("primary_rank").cast("long"))


@query("noisy_pages", f"""WITH {Q.BLOCKS}, p AS (SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, count(*) FILTER (length(content) < 10) / count(*) AS very_short_ratio, count(*) FILTER ({Q.FURNITURE}) + count(*) FILTER ({Q.NUMERIC}) AS noise FROM blocks GROUP BY ALL)
 SELECT * FROM p ORDER BY very_short_ratio DESC, noise DESC, doc_id, page_number LIMIT 10""")
def noisy_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = B.page_quality(B.line_blocks(table(spark, d, "documents"))).withColumn("page_number", F.col("page_number").cast("long"))
    return B.noisy_pages(pages).select("doc_id", "page_number", "very_short_ratio", "noise")


@query("fingerprint_units", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS position, o_orderstatus AS type, o_orderpriority AS role, o_orderkey % 7 AS page, 'Order ' || o_orderkey || ' "' || o_orderstatus || '" \\ x' AS t FROM orders),
 h AS (SELECT doc_id, position, sha256('{"text":' || to_json(t) || '}') AS content_fingerprint, sha256('{"page":' || page || ',"role":"' || role || '","type":"' || type || '"}') AS structure_fingerprint FROM o),
 u AS (SELECT *, sha256('{"content":"' || content_fingerprint || '","doc_id":"' || doc_id || '","structure":"' || structure_fingerprint || '"}') AS unit_fingerprint FROM h) SELECT *, doc_id || ':kuf:' || unit_fingerprint[:20] AS stable_id FROM u""")
def fingerprint_units(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    content = F.concat(F.lit(" Order  "), F.col("o_orderkey").cast("string"), F.lit('\t"'), "o_orderstatus", F.lit('"　\\\nx '))
    return B.fingerprints(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("semantic_role"), (F.col("o_orderkey") % 7).alias("page_number"), content.alias("content")))


@query("ledger_states", """WITH p AS (SELECT o_custkey // 3 AS run_id, CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'done' END ELSE 'running' END AS s, o_orderkey % 5 AS r FROM orders),
 q AS (SELECT run_id, coalesce(s, 'pending') AS s, r FROM p) SELECT run_id, count(*) AS parts, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'running') AS running,
 CASE WHEN count(*) FILTER (s = 'done') = count(*) THEN 'completed' WHEN count(*) FILTER (s = 'running') > 0 THEN 'running' WHEN count(*) FILTER (s IN ('done', 'failed')) > 0 THEN 'partial' ELSE 'planned' END AS state, count(*) FILTER (s = 'pending') AS pending, coalesce(CAST(sum(r) FILTER (s = 'done') AS BIGINT), 0) AS records FROM q GROUP BY ALL""")
def ledger_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.when(F.col("o_custkey") % 11 == 0, None).when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", F.when(k % 4 == 0, "failed").otherwise("done")).otherwise("running")
    p = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 3).alias("run_id"), s.alias("state"), F.create_map(F.lit("records"), k % 5).alias("counts"))
    none = F.lit(0).cast("long")
    return C.ledger(p).select("run_id", "parts", "done", "failed", "running", "state", F.coalesce(F.element_at("part_states", "pending"), none).alias("pending"), F.coalesce(F.element_at("completed_counts", "records"), none).alias("records"))


def _why(name: str, n: int) -> F.Column:
    """A reason on every n-th line of an order; the number tells which."""
    return F.when(F.col("l_linenumber") % n == 0, F.concat(F.lit(name), (F.col("l_suppkey") % 3).cast("string")))


@query("ocr_trace", """WITH b AS (SELECT l_orderkey % 40 AS doc, l_partkey % 6 AS page, l_orderkey * 10 + l_linenumber AS pos, l_quantity > 25 AS a, l_quantity > 45 AS u, CASE WHEN l_linenumber % 2 = 0 THEN 'try' || l_suppkey % 3 END AS r1, CASE WHEN l_linenumber % 3 = 0 THEN 'fit' || l_suppkey % 3 END AS r2,
  CASE WHEN l_linenumber % 4 = 0 THEN 'bad' || l_suppkey % 3 END AS r3, CASE WHEN l_linenumber % 6 = 0 THEN 'err' || l_suppkey % 3 END AS r4, l_partkey % 90 AS t, CASE WHEN l_linenumber > 3 THEN l_partkey % 70 END AS z, l_partkey FROM lineitem WHERE l_suppkey % 2 = 0),
 p AS (SELECT doc, page, bool_or(a) AS a, bool_or(u) AS u, arg_min(r1, (pos, r1)) FILTER (r1 IS NOT NULL) AS r1, arg_min(r2, (pos, r2)) FILTER (r2 IS NOT NULL) AS r2, arg_min(r3, (pos, r3)) FILTER (r3 IS NOT NULL) AS r3, arg_min(r4, (pos, r4)) FILTER (r4 IS NOT NULL) AS r4, max(t) AS t, coalesce(max(z), 0) AS z FROM b GROUP BY ALL)
 SELECT doc AS doc_id, count(*) FILTER (a) AS attempted_pages, count(*) FILTER (u) AS fallback_pages, count(*) FILTER (a AND NOT u) AS rejected_pages, count(r4) AS failed_pages, coalesce(string_agg(DISTINCT r1, ',' ORDER BY r1), '') AS attempt_reasons, coalesce(string_agg(DISTINCT r2, ',' ORDER BY r2), '') AS acceptance_reasons,
  coalesce(string_agg(DISTINCT r3, ',' ORDER BY r3), '') AS rejection_reasons, coalesce(string_agg(DISTINCT r4, ',' ORDER BY r4), '') AS error_reasons, CAST(sum(t) AS BIGINT) AS native_tokens, CAST(sum(z) AS BIGINT) AS final_tokens FROM p GROUP BY ALL""")
def ocr_trace(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_suppkey % 2 = 0")
    b = li.select(
        (F.col("l_orderkey") % 40).alias("doc_id"), (F.col("l_partkey") % 6).alias("page_number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), (F.col("l_quantity") > 25).alias("attempted"), (F.col("l_quantity") > 45).alias("fallback"),
        _why("try", 2).alias("attempt_reason"), _why("fit", 3).alias("acceptance_reason"), _why("bad", 4).alias("rejection_reason"), _why("err", 6).alias("error_reason"), (F.col("l_partkey") % 90).alias("native_tokens"), F.when(F.col("l_linenumber") > 3, F.col("l_partkey") % 70).alias("final_tokens"),
    )
    t = D.ocr_trace(b)
    return t.select(*[F.array_join(c, ",").alias(c) if c.endswith("_reasons") else c for c in t.columns])


@query("attention_focus", """WITH o AS (SELECT o_orderkey AS k, [NULL, 'accept', 'disabled', 'manual_review', 'accept_with_warning'][o_orderkey % 5 + 1] AS gate, ['rechunk_document', 'local_provider_rerun', 'review_parse_ir', NULL][o_custkey % 4 + 1] AS act, o_custkey % 3 = 0 AS batch,
  o_orderkey % 3 AS np, o_orderkey % 2 = 0 AS direct, o_custkey % 5 = 0 AS pa, o_custkey % 10 = 0 AS pm FROM orders), f AS (SELECT *, np > 0 AND direct AS dp, coalesce(gate NOT IN ('accept', 'disabled'), false) AS ga FROM o),
 g AS (SELECT *, CASE WHEN act = 'rechunk_document' THEN 'quality_gate' WHEN act = 'local_provider_rerun' AND batch THEN 'parts' WHEN pm THEN 'providers' WHEN act = 'local_provider_rerun' AND dp THEN 'parts' WHEN np > 0 AND (dp OR NOT pa) THEN 'parts' WHEN pa THEN 'providers' WHEN ga THEN 'quality_gate' END AS focus FROM f)
 SELECT k AS doc_id, focus, CASE focus WHEN 'quality_gate' THEN '/v1/parse/documents/' || k || '/quality' WHEN 'parts' THEN '/v1/parse/documents/' || k || '/parts' WHEN 'providers' THEN '/v1/parse/documents/' || k || '/providers' END AS entrypoint, ga OR pa OR np > 0 AS needs_attention, np AS attention_parts FROM g""")
def attention_focus(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = F.when(k % 2 == 0, "parse_ir").otherwise("quality_review")
    focuses = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(one)).otherwise(F.array(F.lit(""), one))
    o = table(spark, d, "orders").select(
        k.alias("doc_id"), pick([None, "accept", "disabled", "manual_review", "accept_with_warning"], k % 5).alias("gate"), pick(["rechunk_document", "local_provider_rerun", "review_parse_ir", None], c % 4).alias("action"),
        F.when(c % 3 == 0, F.array(F.lit("rerun_warning_parts"))).alias("gate_actions"), focuses.alias("part_focuses"), (c % 5 == 0).alias("provider_attention"), (c % 10 == 0).alias("provider_mismatch"),
    )
    return D.attention(o).select("doc_id", "focus", "entrypoint", "needs_attention", F.col("attention_parts").cast("long").alias("attention_parts"))


@query("continuity_links", """WITH u AS (SELECT o_custkey AS doc_id, o_orderkey AS unit, o_orderpriority AS ty, row_number() OVER w AS ps, row_number() OVER w + o_orderkey % 2 AS pe, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey - 10 END AS ex, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS g, o_orderkey % 4 = 1 AS cont, o_orderstatus AS tb FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
 x AS (SELECT *, CASE WHEN g IS NOT NULL THEN lag(unit) OVER (PARTITION BY doc_id, g ORDER BY unit) END AS ig, lag(unit) OVER p AS lu, lag(ty) OVER p AS lt, lag(pe) OVER p AS lp, lag(tb) OVER p AS ltb FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY unit)),
 y AS (SELECT x.*, z.unit AS named FROM x LEFT JOIN u z ON z.doc_id = x.doc_id AND z.unit = x.ex),
 k AS (SELECT *, CASE WHEN named IS NOT NULL THEN 1 WHEN ig IS NOT NULL THEN 2 WHEN cont AND ty = lt AND ps <= lp + 1 THEN 3 WHEN tb = ltb AND ps = lp + 1 THEN 4 END AS w FROM y)
 SELECT doc_id, CAST(unit AS VARCHAR) AS unit_id, CAST(CASE w WHEN 1 THEN named WHEN 2 THEN ig ELSE lu END AS VARCHAR) AS previous, ['explicit_source_relation', 'continuation_group', 'adjacent_explicit_continuation', 'same_table_across_adjacent_pages'][w] AS reason, [1.0, 1.0, 0.9, 0.95][w]::DOUBLE AS confidence FROM k WHERE w IS NOT NULL""")
def continuity_links(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    u = o.select(
        F.col("o_custkey").alias("doc_id"), k.cast("string").alias("unit_id"), k.alias("position"), F.col("o_orderpriority").alias("unit_type"), page.alias("page_start"), (page + k % 2).alias("page_end"),
        F.when(k % 10 == 0, (k - 10).cast("string")).alias("continues_from"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("group_id"), (k % 4 == 1).alias("is_continuation"), F.array("o_orderstatus").alias("table_ids"),
    )
    return D.continuity(u)
