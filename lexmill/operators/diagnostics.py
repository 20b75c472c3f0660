"""Diagnostics: OCR traces, stability and drift gates, threshold scans, caches, attention, continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import round_half_up


def ocr_trace(blocks: DataFrame) -> DataFrame:
    """Per document from its pages' decisions: pages attempted, fallen back to OCR, rejected (attempted without fallback), failed
    (an error is named); the distinct reasons of each kind in order; tokens before and after (a page's greatest, summed).

    A page's reason of a kind is that of its first block which has one (blocks by position). Nulls count as no and 0.
    Input: doc_id, page_number, position, attempted, fallback, attempt_reason, acceptance_reason, rejection_reason, error_reason, native_tokens, final_tokens."""
    kinds = ("attempt", "acceptance", "rejection", "error")
    named = lambda k: F.when(F.col(f"{k}_reason") != "", F.col(f"{k}_reason"))
    first = [F.min(F.when(named(k).isNotNull(), F.struct("position", named(k).alias("reason"))))["reason"].alias(k) for k in kinds]
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    page = blocks.groupBy("doc_id", "page_number").agg(
        yes("attempted").alias("attempted"), yes("fallback").alias("fallback"), *first,
        F.max(F.coalesce("native_tokens", F.lit(0))).alias("native"), F.max(F.coalesce("final_tokens", F.lit(0))).alias("final"),
    )
    return page.groupBy("doc_id").agg(
        F.count_if("attempted").alias("attempted_pages"), F.count_if("fallback").alias("fallback_pages"), F.count_if(F.col("attempted") & ~F.col("fallback")).alias("rejected_pages"),
        F.count(F.col("error")).alias("failed_pages"), *[F.array_sort(F.collect_set(k)).alias(f"{k}_reasons") for k in kinds],
        F.sum("native").alias("native_tokens"), F.sum("final").alias("final_tokens"),
    )


def stability_gate(runs: DataFrame, least_runs: int = 3) -> DataFrame:
    """Per sample: stable iff there are enough runs, all done, of one quality signature; elapsed minimum, median, maximum."""
    g = runs.groupBy("sample").agg(
        F.count("*").alias("runs"), F.count_distinct("signature").alias("signatures"), F.bool_and(F.col("state") == "done").alias("all_done"),
        F.min("elapsed").alias("least"), F.percentile("elapsed", F.lit(0.5)).alias("median"), F.max("elapsed").alias("most"),
    )
    return g.withColumn("stable", (F.col("runs") >= least_runs) & (F.col("signatures") == 1) & F.col("all_done"))


def drift(baseline: DataFrame, candidate: DataFrame, budgets: DataFrame) -> DataFrame:
    """Measures beyond their budget of change; one that either side lacks drifts. All: (sample, metric, value); budgets: (metric, budget)."""
    j = baseline.withColumnRenamed("value", "old").join(candidate.withColumnRenamed("value", "new"), ["sample", "metric"], "full_outer")
    j = j.join(budgets, "metric", "left").withColumn("delta", F.col("new") - F.col("old"))
    return j.withColumn("drifted", F.col("delta").isNull() | (F.abs("delta") > F.coalesce("budget", F.lit(0.0))))


def threshold_scan(values: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """How many rows each threshold of a grid would keep: rows are counted by value first, so the grid meets the distinct values only."""
    by_value = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    grid = by_value.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return grid.groupBy("threshold").agg(F.sum(F.when(F.col("v") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("kept"), F.sum("n").alias("total"))


def single_flight(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one request of each source and options, to be parsed; every request with the one whose result it takes)."""
    leader = requests.groupBy("source_hash", "options_hash").agg(F.min("request_id").alias("leader"))
    return leader, requests.join(leader, ["source_hash", "options_hash"]).select("request_id", "leader")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str], as_of: str, ttl_hours: int) -> DataFrame:
    """Wanted keys without an entry younger than the time to live."""
    fresh = cache.where(F.col("stored_at").cast("timestamp") >= F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(ttl_hours)))
    return wanted.join(fresh.select(key), key, "left_anti")


def expired(artifacts: DataFrame, as_of: str, retention_days: int) -> DataFrame:
    return artifacts.where(F.col("created_at").cast("timestamp") < F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(retention_days)))


# Actions on the whole document, and what a part may need that is not settled by looking at its quality.
DOCUMENT_ACTIONS = ("rechunk_document", "reembed_document")
DIRECT_FOCUSES = ("local_provider_rerun", "provider_route_plan", "parse_ir", "coverage_gaps")


def attention(documents: DataFrame) -> DataFrame:
    """Where to look first: focus is quality_gate, parts, providers or null; the entry point of it; whether anything asks for a look.

    Input: doc_id, gate, action (the gate's, or null), gate_actions (array of action ids), part_focuses (array: one of each part
    that asks for attention, "" for a part without), provider_attention, provider_mismatch (the best provider is not the primary)."""
    none = F.array().cast("array<string>")
    focuses, offered = F.coalesce("part_focuses", none), F.coalesce("gate_actions", none)
    parts = F.size(focuses)
    gate = F.lower(F.trim(F.coalesce("gate", F.lit(""))))
    by_gate = ~gate.isin("", "accept", "disabled")
    direct = F.arrays_overlap(focuses, F.array(*map(F.lit, DIRECT_FOCUSES)))
    rerun = F.coalesce(F.col("action") == "local_provider_rerun", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    focus = (
        F.when(F.coalesce(F.col("action").isin(*DOCUMENT_ACTIONS), F.lit(False)), "quality_gate").when(rerun & F.array_contains(offered, "rerun_warning_parts"), "parts").when(yes("provider_mismatch"), "providers")
        .when(rerun & direct, "parts").when((parts > 0) & (direct | ~yes("provider_attention")), "parts").when(yes("provider_attention"), "providers").when(by_gate, "quality_gate")
    )
    page = F.element_at(F.create_map(*map(F.lit, ("providers", "providers", "parts", "parts", "quality_gate", "quality"))), focus)
    entry = F.when(focus.isNotNull(), F.concat(F.lit("/v1/parse/documents/"), F.col("doc_id").cast("string"), F.lit("/"), page))
    return documents.select("*", focus.alias("focus"), entry.alias("entrypoint"), (by_gate | yes("provider_attention") | (parts > 0)).alias("needs_attention"), parts.alias("attention_parts"))


def reading_confidence(pages: DataFrame) -> DataFrame:
    """Mean of the pages' confidences clamped to 0..1; pages without one do not count."""
    c = F.when(F.col("confidence").isNotNull(), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    return pages.groupBy("doc_id").agg(round_half_up(F.sum(c) / F.count(c)).alias("confidence"))


def continuity(units: DataFrame) -> DataFrame:
    """The unit that each continues, why, and how sure that is; units that continue none are left out.

    Tried in this order: the unit that the source names (an earlier one or itself by its id), the last unit of its group, the unit
    before it if it says that it goes on (same type, next page at most), the unit before it if they share a table and its
    pages begin right after. Input: doc_id, unit_id, position, unit_type, page_start, page_end, continues_from, group_id,
    is_continuation, table_ids (array); the last four may be null."""
    at = Window.partitionBy("doc_id").orderBy("position")
    by = Window.partitionBy("doc_id", "group_id").orderBy("position")
    grouped = F.coalesce("group_id", F.lit("")) != ""
    u = units.withColumn("in_group", F.when(grouped, F.lag("unit_id").over(by)))
    for c in ("unit_id", "unit_type", "page_end", "table_ids"):
        u = u.withColumn(f"last_{c}", F.lag(c).over(at))
    names = units.select(F.col("doc_id").alias("named_doc"), F.col("unit_id").alias("named"), F.col("position").alias("named_at"))
    u = u.join(names, (F.col("doc_id") == F.col("named_doc")) & (F.col("continues_from") == F.col("named")) & (F.col("named_at") < F.col("position")), "left")
    goes_on = F.coalesce("is_continuation", F.lit(False)) & (F.col("unit_type") == F.col("last_unit_type")) & (F.col("page_start") <= F.col("last_page_end") + 1)
    table = F.arrays_overlap("table_ids", "last_table_ids") & (F.col("page_start") == F.col("last_page_end") + 1)
    ways = [
        (F.col("named"), F.lit(True), "explicit_source_relation", 1.0), (F.col("in_group"), F.lit(True), "continuation_group", 1.0),
        (F.col("last_unit_id"), goes_on, "adjacent_explicit_continuation", 0.9), (F.col("last_unit_id"), table, "same_table_across_adjacent_pages", 0.95),
    ]
    found = F.filter(F.array(*[F.when(unit.isNotNull() & ok, F.struct(unit.alias("previous"), F.lit(why).alias("reason"), F.lit(sure).alias("confidence"))) for unit, ok, why, sure in ways]), lambda w: w.isNotNull())
    return u.select("doc_id", "unit_id", F.get(found, F.lit(0)).alias("w")).where("w is not null").select("doc_id", "unit_id", "w.*")


def column_letters(n: Column) -> Column:
    """0 is A, 25 Z, 26 AA (up to three letters)."""
    n = n.cast("int")
    one = lambda k: F.char(F.lit(65) + k)
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(n >= 702, one(three)).otherwise(""), F.when(n >= 26, one(F.pmod(two, F.lit(26)))).otherwise(""), one(F.pmod(n, F.lit(26))))


def coalesced_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping or touching page ranges of a document, merged; and the pages they cover."""
    w = Window.partitionBy("doc_id").orderBy("page_start", "page_end")
    reach = F.max("page_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("opens", F.coalesce((F.col("page_start") > reach + 1).cast("int"), F.lit(1))).withColumn("k", F.sum("opens").over(w))
    return r.groupBy("doc_id", "k").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")).drop("k")
