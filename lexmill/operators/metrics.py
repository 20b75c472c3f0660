"""Jobs, quotas, search effectiveness, events and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import round_half_up


def nearest_rank(values: Column, r: float) -> Column:
    """The value at index round-half-even(r * (n - 1)) of the sorted values (an array column)."""
    s = F.array_sort(values)
    return F.get(s, F.bround(F.lit(r) * (F.size(s) - 1)).cast("int"))


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key without gathering a key's values: equal values are counted,
    combined before the shuffle, and the running count of the distinct values finds the rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("n").over(by)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(r) * (F.col("total") - 1)), F.col(value))).alias(name) for name, r in ratios.items()]
    return run.groupBy(*keys).agg(*picks)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.95)).alias("p95"), F.min(v).alias("least"), F.max(v).alias("most"),
        (F.max(v) - F.min(v)).alias("range"), F.stddev_pop(v).alias("deviation"), F.when(F.avg(v) != 0, 100 * F.stddev_pop(v) / F.avg(v)).alias("cv_percent"),
    )


def quota_usage(jobs: DataFrame) -> DataFrame:
    """Per tenant and quota key: jobs, units (at least 1 each), done, failed."""
    return jobs.groupBy("tenant_id", "quota_key").agg(
        F.count("*").alias("jobs"), F.sum(F.greatest(F.coalesce("quota_units", F.lit(1)), F.lit(1))).alias("units"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed")
    )


def quota_limits(usage: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """The limit of tenant:key, else tenant:*, else *:key, else *:*, else the default.

    The four lookups are one join: a limit's specificity ranks it."""
    want = usage.select("tenant_id", "quota_key", F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.col("tenant_id").alias("t"), F.col("quota_key").alias("k")), F.struct(F.lit(2).alias("rank"), F.col("tenant_id").alias("t"), F.lit("*").alias("k")),
        F.struct(F.lit(3).alias("rank"), F.lit("*").alias("t"), F.col("quota_key").alias("k")), F.struct(F.lit(4).alias("rank"), F.lit("*").alias("t"), F.lit("*").alias("k")),
    )).alias("w"))
    got = want.join(limits.select(F.col("tenant_id").alias("lt"), F.col("quota_key").alias("lk"), "limit_units"), (F.col("w.t") == F.col("lt")) & (F.col("w.k") == F.col("lk")))
    best = got.groupBy("tenant_id", "quota_key").agg(F.min_by("limit_units", "w.rank").alias("limit_units"))
    return usage.join(best, ["tenant_id", "quota_key"], "left").withColumn("limit_units", F.coalesce("limit_units", F.lit(default)))


def over_quota(usage: DataFrame, requested: int) -> DataFrame:
    return usage.withColumn("exceeded", F.col("units") + requested > F.col("limit_units"))


def runtime_metrics(jobs: DataFrame, last: int = 5000) -> DataFrame:
    """Over the last ``last`` jobs (1 to 5000) of each tenant: states, failure rate, durations."""
    n = max(1, min(5000, last))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    recent = jobs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    ended = F.col("state").isin("done", "failed")
    duration = F.when(ended, F.col("duration"))
    sums = recent.groupBy("tenant_id").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(~ended).alias("active"),
        F.count(duration).alias("durations"), F.min(duration).alias("least"), F.max(duration).alias("most"), F.collect_list(duration).alias("all"),
    )
    picks = [nearest_rank(F.col("all"), r).alias(k) for k, r in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]  # at most 5000 values a tenant
    rate = F.when(F.col("done") + F.col("failed") > 0, round_half_up(F.col("failed") / (F.col("done") + F.col("failed")))).otherwise(0.0)
    return sums.select("tenant_id", "jobs", "done", "failed", "active", rate.alias("failure_rate"), "durations", "least", "most", *picks)


def search_effectiveness(events: DataFrame, as_of: str, hours: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """Per layer and trailing window: queries, hits, zero-hit queries, rates to four places.

    Each event is copied to the windows that hold it: the windows are a fixed few."""
    age = (F.to_timestamp(F.lit(as_of)).cast("double") - F.col("created_at").cast("timestamp").cast("double")) / 3600.0
    spans = events.withColumn("window_hours", F.explode(F.filter(F.array(*map(F.lit, hours)), lambda h: (age >= 0) & (age <= h))))
    hit = F.col("hit_count") > 0
    g = spans.groupBy("layer", "window_hours").agg(F.count("*").alias("queries"), F.count_if(hit).alias("hit_queries"), F.count_if(~hit).alias("zero_hit"), F.sum("hit_count").alias("hits"), F.max("hit_count").alias("most_hits"))
    return g.select("*", round_half_up(F.col("hit_queries") / F.col("queries")).alias("hit_rate"), round_half_up(F.col("hits") / F.col("queries")).alias("avg_hits"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, as an aggregate that is combined before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def recent(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Ring buffer: the last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def index_metrics(manifests: DataFrame) -> DataFrame:
    """Per layer: documents and items of each document's latest manifest."""
    last = latest_by(manifests, ["doc_id"], ["created_at"])
    return last.select(F.explode("layers").alias("layer", "items")).groupBy("layer").agg(F.count("*").alias("documents"), F.sum("items").alias("items"), F.count_if(F.col("items") == 0).alias("empty"))


def event_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("value").alias("most"))


def prometheus(counters: DataFrame, metric: str = "events_total") -> DataFrame:
    """Counters as lines of the text exposition format; quotes, backslashes and line ends are escaped."""
    def label(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")

    return counters.select(F.concat(F.lit(metric + '{tenant="'), label("tenant_id"), F.lit('",type="'), label("event_type"), F.lit('"} '), F.col("n").cast("string")).alias("line"))


SECRET = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|credential)"


def redact(fields: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SECRET), "[redacted]").otherwise(v))


def retry_delay(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """base * 2^(attempt - 1) seconds, at most ``most`` (or base, if that is more), to three places; no base, no delay."""
    base = max(0.0, base)
    raw = F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.coalesce(attempt, F.lit(0)) - 1, F.lit(0)))
    return round_half_up(F.least(raw, F.lit(max(base, most))), 3)


# The categories of provider failures in the order they are tried, with what a message of each contains,
# and the kinds of errors that belong to a category whatever the message says.
FAILURE_TOKENS = {
    "timeout": ["timed out", "timeout", "time-out"],
    "permission_denied": ["{401}", "{403}", "unauthorized", "forbidden", "permission denied", "access is denied", "invalid api key"],
    "rate_limited": ["{429}", "rate limit", "rate-limit", "too many requests"],
    "missing_file": [],
    "invalid_input": ["{400}", "{404}", "{409}", "{413}", "{422}", "bad request", "does not exist", "invalid input", "invalid request", "invalid file", "page_range"],
    "unsupported": ["unsupported", "not supported", "media type", "extension"],
    "invalid_response": ["invalid response", "empty response", "malformed response", "missing vector", "missing embedding", "embedding_provider_mismatch", "empty_or_invalid_response"],
    "configuration_error": ["missing configuration", "configuration error", "not configured", "api_key_env", "environment variable", "provider disabled"],
    "provider_unavailable": [
        "{500}", "{502}", "{503}", "{504}", "no module named", "is required", "not installed", "missing dependency", "connection refused", "connection reset", "name or service not known",
        "temporary failure in name resolution", "gateway unavailable", "provider unavailable", "embedding unavailable", "service unavailable", "network is unreachable",
    ],
}
FAILURE_KINDS = {
    "timeout": ["TimeoutError"], "permission_denied": ["PermissionError"], "missing_file": ["FileNotFoundError", "NotADirectoryError"],
    "invalid_response": ["JSONDecodeError", "UnicodeDecodeError"], "provider_unavailable": ["ImportError", "ConnectionError", "URLError"],
}


def failure_class(message: Column, kind: Column | None = None, status: Column | None = None) -> Column:
    """The category of a provider's failure: by the kind of error or HTTP status if known, and by its message.
    A token such as {429} stands for "http error 429" and "status code 429". Null or empty messages: provider_failed."""
    low = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    kind = F.lit(None).cast("string") if kind is None else kind
    status = F.lit(None).cast("int") if status is None else status
    statuses = {"rate_limited": status == 429, "provider_unavailable": status.between(500, 599)}
    out = F.when(F.lit(False), "")
    for name, tokens in FAILURE_TOKENS.items():
        texts = [t for token in tokens for t in ([f"{p} {token[1:-1]}" for p in ("http error", "status code")] if token[0] == "{" else [token])]
        hit = F.coalesce(kind.isin(*FAILURE_KINDS.get(name, [""])), F.lit(False)) | F.coalesce(statuses.get(name, F.lit(False)), F.lit(False))
        for t in texts:
            hit = hit | F.contains(low, F.lit(t))
        out = out.when(hit, "invalid_input" if name == "missing_file" else name)
    return out.otherwise("provider_failed")


def trend(reports: DataFrame, value: str) -> DataFrame:
    """Change of a value from report to report of a series."""
    w = Window.partitionBy("series").orderBy("seq")
    return reports.select("series", "seq", value, (F.col(value) - F.lag(value).over(w)).alias("delta"))
