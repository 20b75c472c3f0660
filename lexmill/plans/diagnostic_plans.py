"""Diagnostics over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import diagnostics as D
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table


@query("stability_gate", """SELECT o_custkey AS sample, count(*) AS runs, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) >= 3 AND count(DISTINCT o_orderpriority) = 1 AND bool_and(o_orderstatus <> 'P') AS stable FROM orders GROUP BY ALL""")
def stability_gate(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("signature"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("state"), F.col("o_totalprice").alias("elapsed"))
    return D.stability_gate(r).select("sample", "runs", "least", "most", "stable")


@query("metric_drift", """WITH b AS (SELECT user_id AS sample, event_type AS metric, count(*) AS old FROM events WHERE event_id % 2 = 0 GROUP BY ALL), c AS (SELECT user_id AS sample, event_type AS metric, count(*) AS new FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
 SELECT sample, metric, new - old AS delta, new IS NULL OR old IS NULL OR abs(new - old) > CASE metric WHEN 'view' THEN 5 WHEN 'click' THEN 3 ELSE 0 END AS drifted FROM b FULL JOIN c USING (sample, metric)""")
def metric_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    budgets = spark.createDataFrame([("view", 5.0), ("click", 3.0)], "metric string, budget double")
    return D.drift(side(0), side(1), budgets).select("sample", "metric", "delta", "drifted")


@query("threshold_scan", f"""WITH {Q.LINES} SELECT CAST(t AS BIGINT) AS threshold, count(*) FILTER (length(line) >= t) AS kept, count(*) AS total FROM lines, (SELECT unnest([5, 10, 20, 50, 100]) AS t) GROUP BY ALL""")
def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    from lexmill.operators.blocks import lines

    n = lines(table(spark, d, "documents")).select(F.char_length("line").alias("n"))
    return D.threshold_scan(n, "n", [5, 10, 20, 50, 100]).withColumn("threshold", F.col("threshold").cast("long"))


@query("single_flight", """SELECT doc_id AS request_id, min(doc_id) OVER (PARTITION BY text, lang) AS leader FROM documents""")
def single_flight(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.sha2("text", 256).alias("source_hash"), F.col("lang").alias("options_hash"))
    return D.single_flight(r)[1]


@query("cache_misses", """SELECT user_id, count(*) AS misses FROM events w WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = w.user_id AND c.event_type = w.event_type AND c.ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR AND c.event_id % 5 = 0) GROUP BY ALL""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cache = e.where("event_id % 5 = 0").select("user_id", "event_type", F.col("ts").alias("stored_at"))
    return D.cache_misses(e, cache, ["user_id", "event_type"], "2024-01-20 00:00:00", 72).groupBy("user_id").agg(F.count("*").alias("misses"))


@query("expired_artifacts", "SELECT event_type, count(*) AS expired FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY GROUP BY ALL")
def expired_artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("ts", "created_at")
    return D.expired(e, "2024-01-20 00:00:00", 7).groupBy("event_type").agg(F.count("*").alias("expired"))


@query("merged_ranges", """WITH r AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey % 300 AS s, l_partkey % 300 + l_linenumber AS e FROM lineitem), w AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS op FROM r),
 k AS (SELECT *, sum(op) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w) SELECT doc_id, min(s) AS page_start, max(e) AS page_end FROM k GROUP BY doc_id, k""")
def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_partkey") % 300
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), s.alias("page_start"), (s + F.col("l_linenumber")).alias("page_end")).distinct()
    return D.coalesced_ranges(r)


@query("column_letters", "SELECT o_orderkey, (CASE WHEN n >= 702 THEN chr(CAST(65 + (n // 26 - 1) // 26 - 1 AS INT)) ELSE '' END) || (CASE WHEN n >= 26 THEN chr(CAST(65 + (n // 26 - 1) % 26 AS INT)) ELSE '' END) || chr(CAST(65 + n % 26 AS INT)) AS letters FROM (SELECT o_orderkey, o_orderkey % 1500 AS n FROM orders)")
def column_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.column_letters(F.col("o_orderkey") % 1500).alias("letters"))
