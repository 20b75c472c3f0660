"""Runs, part jobs, gates, the reader and catalogue rows over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import catalog as C
from lexmill.operators import reader as R
from lexmill.operators import runs as U
from lexmill.plans import sqltext as Q
from lexmill.plans.rule_plans import pick
from lexmill.registry import query, table


def runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), (F.col("o_custkey") % 3).alias("tenant_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"), F.when(k % 4 > 0, F.col("o_orderdate")).alias("sealed_at"),
        pick(["unpublished", "published", "superseded"], k % 3).alias("publication"), pick(["passed", "warning", "rejected", "not_run", "error"], k % 5).alias("validation"), F.when(k % 7 > 0, "succeeded").otherwise("failed").alias("execution"),
    )


@query("staged_counts", """WITH l AS (SELECT l_orderkey AS run_id, count(*) AS blocks, count(*) FILTER (l_quantity > 40) AS chunks FROM lineitem GROUP BY ALL) SELECT o_orderkey AS run_id, coalesce(blocks, 0) AS blocks, coalesce(chunks, 0) AS chunks FROM orders LEFT JOIN l ON run_id = o_orderkey""")
def staged_counts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    return U.staged_counts(runs(spark, d), {"blocks": li, "chunks": li.where("l_quantity > 40")}).select("run_id", "blocks", "chunks")


@query("run_assets", """SELECT l_orderkey AS run_id, count(*) AS assets, CAST(sum(CASE WHEN l_linenumber <> 2 THEN l_partkey ELSE 0 END) AS BIGINT) AS bytes, string_agg('p' || l_suppkey, ',' ORDER BY l_linenumber, 'p' || l_suppkey) AS paths FROM lineitem GROUP BY ALL""")
def run_assets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("path"), F.when(F.col("l_linenumber") != 2, F.col("l_partkey")).alias("bytes"))
    return U.run_assets(a, runs(spark, d)).select("run_id", "assets", "bytes", F.array_join("paths", ",").alias("paths"))


@query("published_snapshot", """WITH p AS (SELECT o_custkey AS doc, max(o_orderkey) AS run FROM orders WHERE o_orderkey % 3 = 1 GROUP BY ALL) SELECT doc AS doc_id, run AS run_id, l_linenumber, l_partkey FROM p JOIN lineitem ON l_orderkey = run""")
def published_snapshot(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    pointers = r.where("publication = 'published'").groupBy("tenant_id", "doc_id").agg(F.max("run_id").alias("active_run_id"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey")
    return U.snapshot(pointers, r, rows).select("doc_id", "run_id", "l_linenumber", "l_partkey")


@query("preview_runs", """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), a AS (SELECT c, max(k) AS k FROM r WHERE k % 10 = 0 GROUP BY ALL)
 SELECT r.k AS run_id, CASE WHEN r.k % 6 = 5 THEN 'not_found' WHEN r.k % 7 > 0 AND r.k % 4 > 0 AND r.k % 3 = 0 AND r.k % 5 < 2 AND a.k IS NULL THEN 'available' ELSE 'not_available' END AS preview FROM r LEFT JOIN a ON a.c = r.c AND a.k = r.k""")
def preview_runs(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    pointers = r.where("run_id % 10 = 0").groupBy("tenant_id", "doc_id").agg(F.max("run_id").alias("active_run_id"))
    wanted = r.select("tenant_id", F.when(F.col("run_id") % 6 == 5, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), "run_id")
    return U.previews(wanted, r, pointers).select("run_id", "preview")


@query("id_collisions", """SELECT DISTINCT 'block:' || a.l_partkey AS collision, a.l_suppkey AS doc_id FROM lineitem a WHERE l_linenumber = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber = 2 AND b.l_partkey = a.l_partkey AND b.l_suppkey <> a.l_suppkey)""")
def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.lit("block").alias("kind"), F.col("l_partkey").cast("string").alias("id"), F.lit("t").alias("tenant_id"), F.col("l_suppkey").alias("doc_id"), "l_linenumber")
    return U.id_collisions(li.where("l_linenumber = 1"), li.where("l_linenumber = 2")).select("collision", "doc_id")


_JOBS = """j AS (SELECT event_id AS id, user_id % 5 AS t, user_id AS u, ['pending', 'parsing', 'embedding', 'done', 'failed', 'running'][event_id % 6 + 1] AS s, CASE WHEN event_id % 12 = 4 THEN ' Cancelled' END AS why, CASE WHEN event_id % 18 = 0 THEN ts + INTERVAL 1 DAY END AS nx, ts, value, event_id % 5 AS n FROM events)"""


def part_jobs_frame(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        e.alias("job_id"), (F.col("user_id") % 5).alias("tenant_id"), F.col("user_id").alias("parent_doc_id"), pick(["pending", "parsing", "embedding", "done", "failed", "running"], e % 6).alias("state"), F.when(e % 12 == 4, " Cancelled").alias("failure_reason"),
        F.when(e % 18 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("next_attempt_at"), F.col("ts").alias("created_at"), F.col("ts").alias("lease_expires_at"), F.col("value").alias("duration"), (e % 5).cast("int").alias("attempt_count"), (e % 4).alias("quota_units"),
    )


@query("claimed_job", f"WITH {_JOBS} SELECT id AS job_id FROM j WHERE s = 'pending' AND (nx IS NULL OR nx <= TIMESTAMP '2024-01-20 00:00:00') ORDER BY ts, id LIMIT 1")
def claimed_job(spark: SparkSession, d: str) -> DataFrame:
    return U.claim_next(part_jobs_frame(spark, d), "2024-01-20 00:00:00").select("job_id")


@query("retried_jobs", f"""WITH {_JOBS} SELECT id AS job_id, CASE WHEN n >= 3 THEN 'dead_letter' ELSE 'pending' END AS state, CASE WHEN n < 3 THEN TIMESTAMP '2024-01-20 00:00:00' + to_seconds(CASE n WHEN 2 THEN 2 ELSE 1 END) END AS next_attempt_at FROM j WHERE s = 'failed' OR (s = 'running' AND ts < TIMESTAMP '2024-01-20 00:00:00')""")
def retried_jobs(spark: SparkSession, d: str) -> DataFrame:
    return U.after_failure(part_jobs_frame(spark, d), "2024-01-20 00:00:00").withColumn("next_attempt_at", F.col("next_attempt_at").cast("timestamp_ntz"))


@query("part_job_metrics", f"""WITH {_JOBS}, p AS (SELECT t, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM j WHERE s = 'done' GROUP BY ALL),
 g AS (SELECT t, count(*) AS parts_total, count(*) FILTER (s = 'done') AS parts_done, count(*) FILTER (s = 'failed' AND why IS NULL) AS parts_failed, count(*) FILTER (s IN ('parsing', 'embedding')) AS parts_active, count(*) FILTER (s = 'pending') AS parts_queued, count(*) FILTER (s = 'failed' AND why IS NOT NULL) AS parts_cancelled,
  count(*) FILTER (s = 'pending' AND nx IS NOT NULL) AS parts_retry_pending, count(value) FILTER (s = 'done') AS durations, min(value) FILTER (s = 'done') AS least, max(value) FILTER (s = 'done') AS most FROM j GROUP BY ALL)
 SELECT t AS tenant_id, g.* EXCLUDE (t), v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] AS p90, v[CAST(round_even(0.99 * (len(v) - 1), 0) AS BIGINT) + 1] AS p99 FROM g LEFT JOIN p USING (t)""")
def part_job_metrics(spark: SparkSession, d: str) -> DataFrame:
    return U.part_jobs(part_jobs_frame(spark, d)).drop("mean")


@query("active_part_counts", f"WITH {_JOBS} SELECT t AS tenant_id, u AS parent_doc_id, count(*) AS active FROM j WHERE s IN ('parsing', 'embedding') GROUP BY ALL")
def active_part_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.active_parts(part_jobs_frame(spark, d))


@query("stage_timings", """WITH e AS (SELECT l_orderkey % 50 AS doc, l_returnflag AS stage, l_linenumber / 8.0::DOUBLE AS s FROM lineitem), g AS (SELECT doc, stage, sum(CASE WHEN s <> 0.375 THEN s ELSE 0 END) AS s FROM e GROUP BY ALL)
 SELECT doc AS doc_id, stage, floor(s * 1e6 + 0.5) / 1e6 AS seconds, """ + Q.r4("s / sum(s) OVER (PARTITION BY doc)") + """ AS share FROM g""")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_returnflag").alias("stage"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") / 8.0).alias("seconds"))
    return U.stage_timings(e)


@query("signal_summaries", """SELECT l_suppkey AS doc_id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_returnflag IS NULL) AS unknown, count(*) FILTER (l_linestatus = 'O') AS open_codes FROM lineitem GROUP BY ALL""")
def signal_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = U.signal_summary(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("code")), ["doc_id"])
    n = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0).cast("long"))
    return s.select("doc_id", "total", n("by_severity", "R").alias("errors"), n("by_severity", "unknown").alias("unknown"), n("by_code", "O").alias("open_codes"))


@query("tenant_dashboard", f"""WITH {_JOBS}, r AS (SELECT t, id, row_number() OVER (PARTITION BY t ORDER BY ts DESC, id DESC) AS rn FROM j) SELECT j.t AS tenant_id, count(*) AS jobs, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s NOT IN ('done', 'failed')) AS active,
 CAST(sum(greatest(id % 4, 1)) AS BIGINT) AS units, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FROM r WHERE r.t = j.t AND rn <= 5) AS recent FROM j GROUP BY j.t""")
def tenant_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return U.dashboard(part_jobs_frame(spark, d)).withColumn("recent", F.array_join(F.transform("recent", lambda x: x.cast("string")), ","))


@query("selected_parts", """WITH p AS (SELECT o_custkey AS run, o_orderkey AS k, o_orderkey % 13 AS ix, ['done', 'running', 'failed', 'pending'][o_orderkey % 4 + 1] AS s FROM orders) SELECT run AS run_id, k AS part_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ix, k) AS rn FROM p WHERE s <> 'done') WHERE rn <= 3""")
def selected_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("part_id"), (k % 13).alias("part_index"), pick(["done", "running", "failed", "pending"], k % 4).alias("state"))
    return U.selected_parts(U.recovered_parts(p), 3).select("run_id", "part_id")


@query("gold_scores", """WITH p AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), a AS (SELECT k, c, k % 5 AS an, least(k % 5, c % 6) AS ah, c % 3 AS tn, least(c % 3, k % 3) AS th, k % 2 AS od, c % 2 = 0 AS ok, 2 AS kn, k % 3 AS kh, c % 4 AS fn, least(c % 4, 1) AS fh, CASE WHEN k % 4 = 0 THEN 3 END AS cn, c % 4 AS ch, CASE WHEN k % 9 > 0 THEN (k % 9) / 8.0::DOUBLE END AS el FROM p),
 x AS (SELECT *, coalesce(cn, an) AS zn, CASE WHEN cn IS NULL THEN ah ELSE ch END AS zh FROM a),
 y AS (SELECT *, CASE WHEN an > 0 THEN ah / an ELSE 1.0 END AS x1, CASE WHEN od = 0 OR ok THEN 1.0 ELSE 0.0 END AS x2, CASE WHEN tn > 0 THEN th / tn ELSE 1.0 END AS x3, least(least(kh / kn, 1.0), 1.0 - CASE WHEN fn > 0 THEN fh / fn ELSE 0.0 END) AS x4, CASE WHEN zn > 0 THEN least(1.0, zh / zn) ELSE 1.0 END AS x5, CASE WHEN el > 0 THEN least(1.0, 0.5::DOUBLE / el) ELSE 0.0 END AS x6 FROM x),
 z AS (SELECT *, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'provider_not_completed' END, CASE WHEN k % 8 = 0 THEN 'missing_expected_page' END, CASE WHEN c % 7 = 0 THEN 'provider_license_not_approved' END, CASE WHEN th < tn THEN 'table_structure_missing_anchor' END, CASE WHEN zh < zn THEN 'critical_token_missing' END) AS v FROM y)
 SELECT k AS page_id, CASE WHEN v = '' THEN 'scored' ELSE 'blocked' END AS status, floor((0.0::DOUBLE + 25.0::DOUBLE * x1 + 20.0::DOUBLE * x2 + 25.0::DOUBLE * x3 + 15.0::DOUBLE * x4 + 10.0::DOUBLE * x5 + 5.0::DOUBLE * x6) * 1000 + 0.5) / 1000 AS score, v AS vetoes FROM z""")
def gold_scores(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table(spark, d, "orders").select(
        k.alias("page_id"), F.lit("p").alias("provider"), (k % 11 != 0).alias("done"), (k % 8).alias("blocks"), F.lit(True).alias("ordered"), F.lit(True).alias("with_provenance"), (c % 7 != 0).alias("approved"), (k % 5).alias("anchors"), F.least(k % 5, c % 6).alias("anchor_hits"),
        (c % 3).alias("table_anchors"), F.least(c % 3, k % 3).alias("table_hits"), (k % 2).alias("ordered_anchors"), (c % 2 == 0).alias("order_ok"), F.lit(2).alias("kinds"), (k % 3).alias("kind_hits"), (c % 4).alias("forbidden"), F.least(c % 4, F.lit(1)).alias("forbidden_hits"),
        F.when(k % 4 == 0, 3).alias("critical"), (c % 4).alias("critical_hits"), F.when(k % 9 > 0, (k % 9) / 8.0).alias("elapsed"), F.lit(0.5).alias("baseline_elapsed"),
    )
    return U.gold_scores(p).select("page_id", "status", "score", F.array_join("vetoes", ",").alias("vetoes"))


@query("sample_gate", """WITH s AS (SELECT o_orderstatus <> 'P' AS done, o_orderkey % 5 AS rq, o_orderkey % 7 AS pp, o_custkey % 9 > 0 AS rc, CASE WHEN o_custkey % 50 = 0 THEN 0.5 ELSE 1.0 END AS tr FROM orders)
 SELECT unnest(['all_samples_completed', 'all_samples_have_page_coverage', 'requested_pages_have_audit_record', 'missing_reason_completeness', 'chunk_source_traceability']) AS metric,
 unnest([count(*) FILTER (done)::DOUBLE, count(*) FILTER (pp > 0)::DOUBLE, count(*) FILTER (rq <= pp)::DOUBLE, count(*) FILTER (rc)::DOUBLE, min(tr)::DOUBLE]) AS actual, unnest([count(*)::DOUBLE, count(*)::DOUBLE, count(*)::DOUBLE, count(*)::DOUBLE, 1.0::DOUBLE]) AS threshold, unnest([bool_and(done), bool_and(pp > 0), bool_and(rq <= pp), bool_and(rc), min(tr) >= 1]) AS passed FROM s""")
def sample_gate(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("status"), (k % 5).alias("requested_pages"), (k % 7).alias("parsed_pages"), (c % 9 > 0).alias("reasons_complete"), F.when(c % 50 == 0, 0.5).otherwise(1.0).alias("traceability"))
    return U.sample_gate(s)


@query("ocr_benchmark", """SELECT count(*) AS documents, count(*) FILTER (l_returnflag = 'R') AS failed_documents, floor(sum(l_linenumber / 8.0::DOUBLE) * 1000 + 0.5) / 1000 AS elapsed, CAST(sum(l_partkey % 5) AS BIGINT) AS attempted, CAST(sum(l_partkey % 3) AS BIGINT) AS fallback, CAST(sum(l_linenumber) AS BIGINT) AS rejected, 0::BIGINT AS failed, CAST(sum(l_partkey) AS BIGINT) AS native_tokens,
 CAST(sum(l_suppkey) AS BIGINT) AS final_tokens, floor(sum(l_quantity) * 1000 + 0.5) / 1000 AS ocr_elapsed, floor(max(l_quantity) * 1000 + 0.5) / 1000 AS most_page FROM lineitem""")
def ocr_benchmark(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    r = li.select(F.when(F.col("l_returnflag") == "R", "failed").alias("status"), (F.col("l_linenumber") / 8.0).alias("elapsed"), (F.col("l_partkey") % 5).alias("attempted"), (F.col("l_partkey") % 3).alias("fallback"), F.col("l_linenumber").alias("rejected"), F.lit(None).cast("long").alias("failed"), F.col("l_partkey").alias("native_tokens"), F.col("l_suppkey").alias("final_tokens"), F.col("l_quantity").alias("ocr_elapsed"), F.col("l_quantity").alias("most_page"))
    return U.ocr_benchmark(r).withColumn("failed", F.col("failed").cast("long"))


@query("joined_reports", """WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS ix, min((l_linenumber - 1) * 10 + 1 + l_suppkey % 2) AS s FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey AS doc, l_linenumber AS ix, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, s + 9 AS e, coalesce(max(s + 9) OVER (PARTITION BY doc ORDER BY s, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rc FROM p JOIN n USING (doc, ix)),
 g AS (SELECT doc, count(*) AS parts, count(*) FILTER (n > 1) AS duplicate_parts, CAST(sum(greatest(0, e - greatest(rc, s - 1))) AS BIGINT) AS covered_pages, count(*) FILTER (s > rc + 1) AS gaps, count(*) FILTER (s <= rc) AS ov FROM r GROUP BY ALL)
 SELECT o_orderkey AS doc_id, o_orderkey % 4 * 10 AS total_pages, coalesce(parts, 0) AS parts, coalesce(duplicate_parts, 0) AS duplicate_parts, coalesce(covered_pages, 0) AS covered_pages, coalesce(gaps, 0) AS gaps, coalesce(ov, 0) AS "overlaps", coalesce(covered_pages, 0) = o_orderkey % 4 * 10 AND coalesce(gaps, 0) = 0 AND coalesce(ov, 0) = 0 AS complete FROM orders LEFT JOIN g ON doc = o_orderkey""")
def joined_reports(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("l_linenumber") - 1) * 10 + 1 + F.col("l_suppkey") % 2
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("part_index"), s.alias("page_start"), (s + 9).alias("page_end"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4 * 10).alias("total_pages"))
    return U.joined_reports(p, t)


# --- reader -----------------------------------------------------------------------------------------------------------


def _reader(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    doc, n, p = F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber"), F.col("p")
    bid = F.concat(F.lit("b"), n.cast("string"))
    blocks = li.select(doc, bid.alias("block_id"), (1 + n % 3).alias("page_number"), F.when(n != 4, (10 - n)).alias("reading_order"), pick(["inline", "hidden", "table", None, "source_snapshot", "inline", "inline"], p % 7).alias("reader_policy"), F.when(p % 11 == 0, "figure").alias("display_kind"), F.concat_ws("\n", F.lit("Line"), p.cast("string")).alias("text"))
    tables = li.where("p % 4 = 0").select(doc, F.concat(F.lit("t"), n.cast("string")).alias("table_id"), F.when(n < 6, bid).otherwise("").alias("block_id"), n.alias("page_number"))
    figures = li.where("p % 5 = 0").select(doc, F.concat(F.lit("f"), n.cast("string")).alias("figure_id"), F.when(n != 2, bid).alias("block_id"), n.alias("page_number"))
    units = li.where("p % 2 = 0").select(doc, F.concat(F.lit("u"), n.cast("string")).alias("unit_id"), F.array(bid).alias("block_ids"), F.when(p % 4 == 0, F.array(F.concat(F.lit("t"), n.cast("string")))).alias("table_ids"))
    return R.projection(blocks, tables, figures, units)


_READER = """l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), b AS (SELECT doc, n, p, 1 + n % 3 AS page, CASE WHEN n <> 4 THEN 10 - n ELSE 0 END AS ro, coalesce(['inline', 'hidden', 'table', NULL, 'source_snapshot', 'inline', 'inline'][p % 7 + 1], 'inline') AS pol, p % 4 = 0 AND n < 6 AS tb, p % 5 = 0 AND n <> 2 AS fg FROM l),
 v AS (SELECT *, CASE WHEN pol = 'table' OR tb THEN 'table' WHEN pol = 'source_snapshot' OR fg OR p % 11 = 0 THEN 'figure' ELSE 'text' END AS ty FROM b WHERE pol <> 'hidden'),
 s AS (SELECT doc, 0 AS part, page, ro, 'b' || n AS id, ty, CASE WHEN ty = 'table' AND tb THEN 't' || n END AS tid, CASE WHEN ty = 'figure' AND fg THEN 'f' || n END AS fid, 'b' || n AS bid, CASE WHEN ty = 'text' THEN 'Line ' || p END AS t FROM v),
 tl AS (SELECT doc, 1, n, 0, 't' || n, 'table', 't' || n, NULL, CASE WHEN n < 6 THEN 'b' || n ELSE '' END, NULL FROM l WHERE p % 4 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc = l.doc AND s.tid = 't' || l.n)),
 fl AS (SELECT doc, 2, n, 0, 'f' || n, 'figure', NULL, 'f' || n, CASE WHEN n <> 2 THEN 'b' || n ELSE '' END, NULL FROM l WHERE p % 5 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc = l.doc AND s.fid = 'f' || l.n)),
 a AS (SELECT * FROM s UNION ALL SELECT * FROM tl UNION ALL SELECT * FROM fl),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part, CASE WHEN part = 0 THEN page END, ro, id) AS rn FROM a)"""


@query("reader_projection", f"""WITH {_READER} SELECT doc AS doc_id, 'rb-' || lpad(CAST(rn AS VARCHAR), 6, '0') AS reader_block_id, page AS page_number, ty AS type, bid AS block_ids, tid AS table_id, fid AS figure_id, t AS text,
 coalesce((SELECT string_agg(DISTINCT 'u' || l.n, ',' ORDER BY 'u' || l.n) FROM l WHERE l.doc = r.doc AND l.p % 2 = 0 AND ('b' || l.n = r.bid OR (l.p % 4 = 0 AND 't' || l.n = r.tid))), '') AS unit_ids FROM r""")
def reader_projection(spark: SparkSession, d: str) -> DataFrame:
    return _reader(spark, d).drop("n").withColumns({"block_ids": F.array_join("block_ids", ","), "unit_ids": F.array_join("unit_ids", ",")})


@query("reader_signals", f"""WITH {_READER}, g AS (SELECT l_orderkey AS doc, 'code' || l_suppkey % 4 AS code, l_linenumber AS pg, CASE l_suppkey % 4 WHEN 1 THEN 't' || l_linenumber END AS tid, CASE l_suppkey % 4 WHEN 2 THEN 'f' || l_linenumber END AS fid, CASE l_suppkey % 4 WHEN 3 THEN 'b' || l_linenumber END AS bid FROM lineitem WHERE l_quantity > 25)
 SELECT doc AS doc_id, rn AS n, coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM g WHERE g.doc = r.doc AND (g.tid = r.tid OR g.fid = r.fid OR g.bid = r.bid OR (g.tid IS NULL AND g.fid IS NULL AND g.bid IS NULL AND g.pg = r.page))), '') AS codes FROM r""")
def reader_signals(spark: SparkSession, d: str) -> DataFrame:
    li, n = table(spark, d, "lineitem").where("l_quantity > 25"), F.col("l_linenumber").cast("string")
    k = F.col("l_suppkey") % 4
    none = F.lit(None).cast("array<string>")
    s = li.select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("code"), k.cast("string")).alias("code"), F.col("l_linenumber").alias("page_number"), F.when(k == 1, F.concat(F.lit("t"), n)).alias("table_id"), F.lit(" ").alias("figure_id"), F.lit(None).cast("string").alias("block_id"),
        none.alias("table_ids"), F.when(k == 2, F.array(F.concat(F.lit("f"), n))).alias("figure_ids"), F.when(k == 3, F.array(F.concat(F.lit("b"), n))).alias("block_ids"),
    )
    got = R.with_signals(_reader(spark, d), R.signal_targets(s))
    return got.select("doc_id", F.col("n").cast("long").alias("n"), F.array_join("codes", ",").alias("codes"))


@query("page_signals", """WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_suppkey % 3 = 0 AND l_partkey % 2 = 0 AS e, l_quantity > 30 AS a, l_partkey % 9 = 0 AS f, l_quantity < 40 AND l_discount < 0.04 AS lo FROM lineitem)
 SELECT doc AS doc_id, page AS page_number, unnest(list_filter([CASE WHEN e THEN 'empty_page' END, CASE WHEN a THEN 'ocr_attempted' END, CASE WHEN f THEN 'ocr_failed' END, CASE WHEN lo THEN 'reading_order_low_confidence' END], lambda x: x IS NOT NULL)) AS code FROM p""")
def page_signals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise("t").alias("text"), (F.col("l_partkey") % 2).alias("tables"), F.when(F.col("l_quantity") > 30, True).alias("ocr_attempted"),
        F.when(F.col("l_partkey") % 9 == 0, F.array(F.lit("x"))).alias("ocr_errors"), F.when(F.col("l_discount") < 0.04, F.when(F.col("l_quantity") < 40, 0.5).otherwise(0.75)).alias("reading_order_confidence"),
    )
    return R.page_signals(p).select("doc_id", "page_number", "code")


@query("quality_observation", f"""WITH p AS (SELECT l_orderkey % 200 AS doc, count(*) AS pages, avg(CASE WHEN l_linenumber > 1 THEN least(1.0::DOUBLE, l_quantity / 32.0::DOUBLE) END) AS m FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey % 200 AS doc, count(DISTINCT l_linenumber * 10 + ascii(l_returnflag) * 1000) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)
 SELECT doc AS doc_id, pages, {Q.r4('m')} AS confidence, coalesce(n, 0) AS signals FROM p LEFT JOIN s USING (doc)""")
def quality_observation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("doc_id", F.col("l_orderkey") % 200)
    pages = li.select("doc_id", F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 32.0).alias("confidence"))
    return R.quality_observation(pages, li.where("l_quantity > 45").select("doc_id", F.col("l_linenumber").alias("page_number"), F.col("l_returnflag").alias("code")))


# --- catalogue rows ---------------------------------------------------------------------------------------------------



def _catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of a page for each order, its columns, and the fields that no header names; every fifth page lacks a header, words of every third
    line begin left of the model's header."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), pick(["tc", "tda"], F.col("o_orderkey") % 2).alias("section"))
    heads = F.from_json(F.lit('[{"text":"序号","x0":10,"x1":30,"dy":0},{"text":" 证件 编号","x0":50,"x1":90,"dy":2},{"text":"持证人","x0":120,"x1":160,"dy":-3},{"text":"型号","x0":200,"x1":240,"dy":5},{"text":"型号","x0":260,"x1":290,"dy":9}]'), "array<struct<text:string,x0:double,x1:double,dy:double>>")
    h = o.select("*", F.inline(heads)).where("not (text = '持证人' and doc_id % 5 = 0)").select("doc_id", "page_number", "section", "text", "x0", "x1", (100 + F.col("dy")).alias("top"), (108 + F.col("dy")).alias("bottom"))
    aliases = spark.createDataFrame([(s, i, f, a) for s in ("tc", "tda") for i, (f, names) in enumerate([("approval.numberOriginal", ["证件编号"]), ("holder.nameOriginal", ["持有人", "持证人"]), ("item.modelOriginal", ["型别", "型号"])]) for a in names], "section string, field_no int, field string, alias string")
    columns, missing = C.header_columns(h, aliases)
    return o, columns, missing


@query("header_columns", """WITH h AS (SELECT o_orderkey AS doc_id, unnest([1, 2, 3, 4]) AS i FROM orders) SELECT doc_id, ['rowNumber', 'approval.numberOriginal', 'holder.nameOriginal', 'item.modelOriginal'][i] AS field, [10, 50, 120, 200][i]::DOUBLE AS x0, [100, 102, 97, 105][i]::DOUBLE AS top FROM h WHERE NOT (i = 3 AND doc_id % 5 = 0)""")
def header_columns(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d)[1].select("doc_id", "field", "x0", "top")


@query("missing_headers", "SELECT o_orderkey AS doc_id, 'holder.nameOriginal' AS field FROM orders WHERE o_orderkey % 5 = 0")
def missing_headers(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d)[2].select("doc_id", "field")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Two rows a page: a number, a holder (blank in every seventh first row) whose suffix stands in the model's column, and a model."""
    o, columns, _ = _catalogue(spark, d)
    k = F.col("doc_id")

    def words(row: int, top: float) -> DataFrame:
        cells = F.array(
            F.struct(F.lit("approval.numberOriginal").alias("field"), F.concat(F.lit("TC"), (k % 400).cast("string")).alias("text"), F.lit(50.0).alias("x0"), F.lit(top).alias("top")),
            F.struct(F.lit("holder.nameOriginal").alias("field"), F.when((k % 7 == 0) & (F.lit(row) == 1), " ").otherwise("Acme").alias("text"), F.lit(120.0).alias("x0"), F.lit(top + 2).alias("top")),
            F.struct(F.lit("item.modelOriginal").alias("field"), F.lit("a.s").alias("text"), F.when(k % 3 == 0, 190.0).otherwise(199.5).alias("x0"), F.lit(top + 1).alias("top")),
            F.struct(F.lit("item.modelOriginal").alias("field"), F.concat(F.lit("M"), F.lit(row).cast("string")).alias("text"), F.lit(205.0).alias("x0"), F.lit(top).alias("top")),
        )
        return o.select("doc_id", "page_number", "section", F.inline(cells))

    placed = C.overflow(words(1, 120.0).unionByName(words(2, 140.0)), columns)
    bands = o.select("doc_id", "page_number", F.inline(F.from_json(F.lit('[{"row_number":1,"start":110,"end":130},{"row_number":2,"start":130,"end":150}]'), "array<struct<row_number:int,start:double,end:double>>")))
    rows, _ = C.candidate_rows(placed, bands)
    return C.build_records(rows.join(o.select("doc_id", "section"), "doc_id").withColumn("page_number", F.col("doc_id")), "0123456789abcdef0123")


_CELLS = """r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 1 THEN 'tda' ELSE 'tc' END AS s, unnest([1, 2]) AS row FROM orders), c AS (SELECT *, 'TC' || k % 400 AS a, CASE WHEN k % 7 = 0 AND row = 1 THEN '' ELSE 'Acme' END AS h, s = 'tda' AND k % 3 = 0 AS back FROM r),
 f AS (SELECT k, s, row, a, trim(CASE WHEN back THEN h || ' a.s' ELSE h END) AS h, CASE WHEN back THEN 'M' || row ELSE 'a.s M' || row END AS m FROM c), q AS (SELECT *, h = '' AS rejected FROM f), w AS (SELECT *, row_number() OVER (PARTITION BY s, a, h, m, rejected ORDER BY k, row) AS rn FROM q)"""


@query("catalogue_records", f"""WITH {_CELLS} SELECT '0123456789abcdef:' || s || ':p' || k || ':r' || row AS record_id, a AS approval, h AS holder, m AS model, rejected, CASE WHEN rejected THEN 'holder.nameOriginal' ELSE '' END AS missing FROM w WHERE rejected OR rn = 1""")
def catalogue_records(spark: SparkSession, d: str) -> DataFrame:
    f = lambda name: F.trim(F.element_at("fields", name))
    return _records(spark, d).select("record_id", f("approval.numberOriginal").alias("approval"), f("holder.nameOriginal").alias("holder"), f("item.modelOriginal").alias("model"), "rejected", F.array_join("missing", ",").alias("missing"))


@query("omission_reviews", """WITH m AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS r FROM lineitem WHERE l_quantity > 40), v AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS r FROM lineitem WHERE l_suppkey % 3 = 0)
 SELECT 'missing' AS side, m.p AS page, m.r AS row, v.p IS NOT NULL AS reviewed FROM m LEFT JOIN v ON m.p = v.p AND m.r = v.r UNION ALL SELECT 'unused', p, r, true FROM v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.p = v.p AND m.r = v.r)""")
def omission_reviews(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row"), "l_quantity", "l_suppkey")
    m, v = li.where("l_quantity > 40").select("page", "row").distinct(), li.where("l_suppkey % 3 = 0").select("page", "row").distinct().withColumn("reviewed", F.lit(True))
    found, unused = C.omissions(m, v, ["page", "row"])
    return found.select(F.lit("missing").alias("side"), "page", "row", F.coalesce("reviewed", F.lit(False)).alias("reviewed")).unionByName(unused.select(F.lit("unused").alias("side"), "page", "row", "reviewed"))
