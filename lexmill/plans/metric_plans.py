"""Jobs, quotas, distributions and streams over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import round_half_up
from lexmill.operators import control as K
from lexmill.operators import metrics as M
from lexmill.plans import sqltext as Q
from lexmill.registry import query, table
from lexmill.streaming import jobs as J


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs: the type tells the state, the value the duration."""
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("parsing")
    return e.select(F.col("event_id").alias("job_id"), (F.col("user_id") % 5).alias("tenant_id"), F.col("event_type").alias("quota_key"), (F.col("event_id") % 4).alias("quota_units"), state.alias("state"), F.col("ts").alias("created_at"), F.col("value").alias("duration"))


_JOBS = """j AS (SELECT event_id AS job_id, user_id % 5 AS tenant_id, event_type AS quota_key, event_id % 4 AS quota_units, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'parsing' END AS state, ts AS created_at, value AS duration FROM events)"""
_USAGE = f"""{_JOBS}, u AS (SELECT tenant_id, quota_key, count(*) AS jobs, CAST(sum(greatest(quota_units, 1)) AS BIGINT) AS units, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM j GROUP BY ALL)"""


@query("quota_usage", f"WITH {_USAGE} SELECT * FROM u")
def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    return M.quota_usage(jobs(spark, d))


@query("quota_check", f"WITH {_USAGE} SELECT tenant_id, quota_key, units, CASE WHEN tenant_id = 1 AND quota_key = 'view' THEN 100 WHEN tenant_id = 1 THEN 500 WHEN quota_key = 'error' THEN 50 ELSE 1000 END AS limit_units, units + 10 > CASE WHEN tenant_id = 1 AND quota_key = 'view' THEN 100 WHEN tenant_id = 1 THEN 500 WHEN quota_key = 'error' THEN 50 ELSE 1000 END AS exceeded FROM u")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    usage = M.quota_usage(jobs(spark, d)).withColumn("tenant_id", F.col("tenant_id").cast("string"))
    limits = spark.createDataFrame([("1", "view", 100), ("1", "*", 500), ("*", "error", 50)], "tenant_id string, quota_key string, limit_units int")
    return M.over_quota(M.quota_limits(usage, limits, 1000), 10).select(F.col("tenant_id").cast("long").alias("tenant_id"), "quota_key", "units", "limit_units", "exceeded")


def _nearest(r: float) -> str:
    return f"list_extract(list_sort(list(duration) FILTER (state IN ('done', 'failed') AND duration IS NOT NULL)), CAST(round_even({r} * (count(duration) FILTER (state IN ('done', 'failed')) - 1), 0) AS BIGINT) + 1)"


@query("runtime_metrics", f"""WITH {_JOBS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, job_id DESC) AS rn FROM j) WHERE rn <= 1000)
 SELECT tenant_id, count(*) AS jobs, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'parsing') AS active,
 {Q.r4("count(*) FILTER (state = 'failed') / count(*) FILTER (state IN ('done', 'failed'))")} AS failure_rate, count(duration) FILTER (state IN ('done', 'failed')) AS durations,
 min(duration) FILTER (state IN ('done', 'failed')) AS least, max(duration) FILTER (state IN ('done', 'failed')) AS most, {_nearest(0.5)} AS p50, {_nearest(0.9)} AS p90, {_nearest(0.99)} AS p99 FROM r GROUP BY ALL""")
def runtime_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.runtime_metrics(jobs(spark, d), 1000)


@query("nearest_rank_percentiles", """SELECT event_type, list_extract(list_sort(list(value) FILTER (value IS NOT NULL)), CAST(round_even(0.5 * (count(value) - 1), 0) AS BIGINT) + 1) AS p50, list_extract(list_sort(list(value) FILTER (value IS NOT NULL)), CAST(round_even(0.9 * (count(value) - 1), 0) AS BIGINT) + 1) AS p90 FROM events GROUP BY ALL""")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return M.nearest_rank_by(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9})


@query("linear_percentiles", f"""SELECT event_type, count(value) AS n, {Q.r4('avg(value)')} AS mean, {Q.r4('quantile_cont(value, 0.5)')} AS p50, {Q.r4('quantile_cont(value, 0.95)')} AS p95, min(value) AS least, max(value) AS most, {Q.r4('max(value) - min(value)')} AS range, {Q.r4('stddev_pop(value)')} AS deviation, {Q.r4('100 * stddev_pop(value) / avg(value)')} AS cv_percent FROM events GROUP BY ALL""")
def linear_percentiles(spark: SparkSession, d: str) -> DataFrame:
    got = M.distribution(table(spark, d, "events"), ["event_type"], "value")
    return got.withColumns({c: round_half_up(F.col(c)) for c in ("mean", "p50", "p95", "range", "deviation", "cv_percent")})


@query("search_effectiveness", f"""WITH e AS (SELECT event_type AS layer, event_id % 4 AS hit_count, ts FROM events), w AS (SELECT layer, hit_count, h AS window_hours FROM e, (SELECT unnest([1, 6, 24, 240]) AS h) WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - to_hours(h))
 SELECT layer, window_hours, count(*) AS queries, count(*) FILTER (hit_count > 0) AS hit_queries, count(*) FILTER (hit_count = 0) AS zero_hit, CAST(sum(hit_count) AS BIGINT) AS hits, max(hit_count) AS most_hits, {Q.r4('count(*) FILTER (hit_count > 0) / count(*)')} AS hit_rate, {Q.r4('CAST(sum(hit_count) AS BIGINT) / count(*)')} AS avg_hits FROM w GROUP BY ALL""")
def search_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("layer"), (F.col("event_id") % 4).alias("hit_count"), F.col("ts").alias("created_at"))
    return M.search_effectiveness(e, "2024-01-20 00:00:00", (1, 6, 24, 240))


@query("latest_jobs", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return M.latest_by(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("recent_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return M.recent(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


@query("prometheus_lines", """SELECT 'events_total{tenant="' || (user_id % 5) || '",type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY user_id % 5, event_type""")
def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("tenant_id", F.col("user_id") % 5)
    return M.prometheus(M.event_counters(e))


@query("metric_trend", "SELECT event_type AS series, CAST(day AS BIGINT) AS seq, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM (SELECT event_type, day(ts) AS day, count(*) AS n FROM events GROUP BY ALL)")
def metric_trend(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.dayofmonth("ts").cast("long").alias("seq")).agg(F.count("*").alias("n"))
    return M.trend(g, "n")


@query("index_metrics", "SELECT layer, count(*) AS documents, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (items = 0) AS \"empty\" FROM (SELECT unnest(['primary', 'high_precision']) AS layer, unnest([event_id % 10, event_id % 3]) AS items FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY ALL)) GROUP BY ALL")
def index_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("created_at"), F.map_from_arrays(F.array(F.lit("primary"), F.lit("high_precision")), F.array(F.col("event_id") % 10, F.col("event_id") % 3)).alias("layers"))
    return M.index_metrics(m)


def _drained(spark: SparkSession, d: str, build: object, key: list[str]) -> DataFrame:
    """Run a stream over the events to its end, in update mode: the watermark bounds the state, changed windows are written again."""
    import uuid

    from lexmill.functions import scratch

    path = f"{scratch.folder(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{d}/events.parquet"
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(source if scratch.status(spark, source) == "folder" else f"{source}*")
    out = build(stream.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    schema = out.schema
    J.drain(out, f"{path}/checkpoint", J.upserts(f"{path}/out"), "update")
    return J.upserted(spark, f"{path}/out", schema, key)


@query("stream_hourly", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, d, J.tumbling, ["window_start", "event_type"]).select("window_start", "event_type", "n")


@query("stream_sliding", "SELECT window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(k) AS window_start FROM events, (SELECT unnest(range(6)) AS k)) GROUP BY ALL")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, d, J.sliding, ["window_start"])


@query("session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER p <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("part_plan", """WITH d AS (SELECT o_orderkey AS doc_id, 1 + o_orderkey % 900 AS pages, CASE WHEN o_custkey % 4 = 0 THEN 100 ELSE 200 END AS s FROM orders)
 SELECT doc_id, count(*) AS parts, CAST(sum(least(f + s - 1, pages) - f + 1) AS BIGINT) AS owned, CAST(sum(least(f + s, pages) - greatest(1, f - 1) + 1) AS BIGINT) AS input FROM (SELECT doc_id, pages, s, unnest(range(1, pages + 1, s)) AS f FROM d) GROUP BY ALL""")
def part_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_orderkey") % 900).cast("int").alias("total_pages"), F.when(F.col("o_custkey") % 4 == 0, 0.4).otherwise(0.1).alias("ocr_ratio"), F.lit(0.0).alias("failure_rate"), F.lit(10.0).alias("size_mb"))
    p = K.plan_parts(o)
    return p.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.col("last") - F.col("first") + 1).alias("owned"), F.sum(F.col("input_last") - F.col("input_first") + 1).alias("input"))


@query("validation_verdicts", """WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 17 = 0 AS ph, o_orderkey % 9 AS blocks, o_orderkey % 60 AS cid FROM orders)
 SELECT verdict, count(*) AS runs FROM (SELECT run_id, CASE WHEN blocks = 0 THEN 'error' WHEN ph THEN 'rejected' WHEN cid >= 50 THEN 'needs_review' WHEN cid >= 10 THEN 'warning' END AS verdict FROM r) WHERE verdict IS NOT NULL GROUP BY ALL""")
def validation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(k.alias("run_id"), (k % 9).alias("blocks"), F.lit(10).alias("chars"), (k % 60).alias("cid_tokens"), (k % 17 == 0).alias("placeholder"), F.lit(0.9).alias("order_confidence"))
    return K.verdicts(K.validate_runs(runs)).groupBy("verdict").agg(F.count("*").alias("runs"))


@query("active_runs", "SELECT o_custkey AS doc_id, arg_max(o_orderkey, o_orderkey) AS run_id FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL")
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    r = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("generation"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("execution"), F.lit("passed").alias("validation"), F.lit(True).alias("sealed"))
    return K.may_publish(r).where("active").select("doc_id", "run_id")


@query("routed_requests", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS \"primary\", CASE WHEN o_orderkey % 3 = 0 THEN 'b' END AS fallback, count(*) AS requests FROM orders GROUP BY ALL")
def routed_requests(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("pdf").alias("media_type"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("table"))).alias("needs"))
    providers = spark.createDataFrame([("a", ["pdf"], ["text"], 9, True, False), ("b", ["pdf", "docx"], ["text", "table"], 5, True, False), ("c", ["pdf"], ["text", "table"], 99, False, False), ("d", ["docx"], ["text"], 99, True, False)], "provider string, media_types array<string>, capabilities array<string>, priority int, enabled boolean, evaluation_only boolean")
    return K.route(requests, providers).groupBy("primary", "fallback").agg(F.count("*").alias("requests"))
