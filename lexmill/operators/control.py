"""Publication states, validation, part planning, providers and routing: relational over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import round_half_up

# For each axis and state, the states that may follow it. A state that ends an axis has none.
TRANSITIONS = {
    "execution": {"pending": "running cancelled", "running": "succeeded failed cancelled", "succeeded": "", "failed": "", "cancelled": ""},
    "validation": {
        "not_run": "info passed warning needs_review rejected error",
        "info": "passed warning needs_review rejected error",
        "passed": "warning needs_review rejected",
        "warning": "passed needs_review rejected",
        "needs_review": "passed warning rejected",
        "rejected": "needs_review warning error",
        "error": "not_run needs_review rejected",
    },
    "publication": {"unpublished": "published withdrawn", "published": "superseded withdrawn", "superseded": "withdrawn", "withdrawn": ""},
}
SEVERITY_ORDER = ("info", "warning", "needs_review", "rejected", "error")


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(axis, a, b) for axis, states in TRANSITIONS.items() for a, after in states.items() for b in after.split()]
    return spark.createDataFrame(rows, "axis string, old string, new string")


def check_transitions(changes: DataFrame) -> DataFrame:
    """Each change with whether its axis allows it. The table has a fixed few rows; a null or unknown state allows nothing."""
    legal = F.broadcast(transition_table(changes.sparkSession).withColumn("legal", F.lit(True)))
    return changes.join(legal, ["axis", "old", "new"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


def verdicts(results: DataFrame) -> DataFrame:
    """Per run: the gravest rule result decides; info never does."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("status"))
    g = results.groupBy("run_id").agg(F.max(rank).alias("rank"), F.count_if(rank > 1).alias("findings"))
    return g.select("run_id", F.when(F.col("rank") <= 1, "passed").otherwise(F.get(F.array(*map(F.lit, SEVERITY_ORDER)), (F.col("rank") - 1).cast("int"))).alias("verdict"), "findings")


def validate_runs(runs: DataFrame) -> DataFrame:
    """Rule results of runs: run_id, code, status. Input: run_id, blocks, chars, cid_tokens, placeholder, order_confidence."""
    rules = [
        ("required_artifacts", F.when(F.col("blocks") == 0, "error")), ("placeholder_result", F.when(F.col("placeholder"), "rejected")),
        ("empty_text", F.when((F.col("blocks") > 0) & (F.col("chars") == 0), "rejected")), ("cid_garble", F.when(F.col("cid_tokens") >= 50, "needs_review").when(F.col("cid_tokens") >= 10, "warning")),
        ("reading_order", F.when(F.col("order_confidence") < 0.75, "needs_review")), ("size", F.when(F.col("chars") > 1_000_000, "info")),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(code).alias("code"), status.alias("status")) for code, status in rules]), lambda r: r["status"].isNotNull())
    return runs.select("run_id", F.explode(found).alias("r")).select("run_id", "r.*")


def may_publish(runs: DataFrame) -> DataFrame:
    ok = F.col("execution").isin("succeeded", "partial") & F.col("validation").isin("passed", "warning") & F.col("sealed")
    newest = Window.partitionBy("doc_id").orderBy(F.desc(F.when(ok, F.col("generation"))), F.desc("run_id"))
    return runs.withColumn("active", ok & (F.row_number().over(newest) == 1))


def plan_parts(docs: DataFrame, target: int = 200, context: int = 1) -> DataFrame:
    """Owned and input page ranges of a document's parts. The target halves for documents with many OCR pages
    (over .3) and again for large ones with many failures (over .2 and 100 MB)."""
    size = F.when(F.col("ocr_ratio") > 0.3, target // 2).otherwise(target)
    size = F.when((F.col("failure_rate") > 0.2) & (F.col("size_mb") > 100), F.floor(size / 2)).otherwise(size).cast("int")
    d = docs.where("total_pages > 0").withColumn("size", F.greatest(size, F.lit(1)))
    p = d.select("doc_id", "total_pages", "size", F.explode(F.sequence(F.lit(1), "total_pages", "size")).alias("first"))
    last = F.least(F.col("first") + F.col("size") - 1, F.col("total_pages"))
    return p.select("doc_id", (F.floor((F.col("first") - 1) / F.col("size")) + 1).cast("int").alias("part_index"), "first", last.alias("last"), F.greatest(F.lit(1), F.col("first") - context).alias("input_first"), F.least(last + context, F.col("total_pages")).alias("input_last"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Blocks of all parts of a parent in order, with rewritten ids and new positions."""
    w = Window.partitionBy("doc_id").orderBy("part_index", "position")
    return parts.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":merged:"), "block_id").alias("block_id"), "part_index", (F.row_number().over(w) - 1).alias("position"), "content")


def replace_prefix(stored: DataFrame, fresh: DataFrame, prefix: str) -> DataFrame:
    """Rows whose id has the prefix give way to ``fresh`` at the place of the first of them (at the end if
    there is none); positions are numbered anew. Both: doc_id, block_id, position, content."""
    gone = F.col("block_id").startswith(prefix)
    at = stored.groupBy("doc_id").agg(F.min(F.when(gone, F.col("position"))).alias("at"))
    kept = stored.where(~gone).select("doc_id", "block_id", F.col("position").alias("major"), F.lit(0).alias("minor"), "content")
    new = fresh.join(at, "doc_id", "left").select("doc_id", "block_id", F.coalesce("at", F.lit(2**31 - 1)).alias("major"), F.col("position").alias("minor"), "content")
    w = Window.partitionBy("doc_id").orderBy("major", "minor", "block_id")
    return kept.unionByName(new).select("doc_id", "block_id", (F.row_number().over(w) - 1).alias("position"), "content")


def provider_usage(blocks: DataFrame) -> DataFrame:
    """What each provider did. Values observed on several blocks of a page count once, as the page's greatest, not below 0;
    an order confidence is at most 1. Blocks without a provider do not count.

    Input: provider, doc_id, page_number, kind (block, table or figure), elapsed, memory, confidence, codes (array)."""
    b = blocks.where(F.trim(F.coalesce("provider", F.lit(""))) != "")
    seen = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c).cast("double")))
    kind = lambda k: F.count_if(F.col("kind") == k)
    codes = F.flatten(F.collect_set(F.coalesce("codes", F.array().cast("array<string>"))))
    page = b.groupBy("provider", "doc_id", "page_number").agg(
        F.max(seen("elapsed")).alias("elapsed"), F.max(seen("memory")).alias("memory"), F.max(F.when(F.col("confidence").isNotNull(), F.least(seen("confidence"), F.lit(1.0)))).alias("confidence"),
        kind("block").alias("blocks"), kind("table").alias("tables"), kind("figure").alias("figures"), codes.alias("codes"),
    )
    return page.groupBy("provider").agg(
        F.count("*").alias("pages"), F.sum("blocks").alias("blocks"), F.sum("tables").alias("tables"), F.sum("figures").alias("figures"),
        round_half_up(F.sum("elapsed"), 6).alias("elapsed"), F.count("elapsed").alias("elapsed_pages"), round_half_up(F.max("memory")).alias("memory"), F.count("memory").alias("memory_pages"),
        round_half_up(F.avg("confidence")).alias("confidence"), F.count("confidence").alias("confidence_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("codes"),
    )


# A gap's signal, what it costs in the comparison, and what is advised, the gravest first.
GAP_SIGNALS = [
    ("rag_empty_text_page", 0.2, "review_parse_ir_or_local_rerun"),
    ("rag_table_without_unit", 0.15, "compare_table_provider_or_local_rerun"),
    ("rag_figure_caption_missing", 0.1, "review_figure_caption"),
    ("rag_units_without_chunks", 0.1, "rechunk_before_provider_change"),
    ("rag_chunks_not_embedded", 0.05, "reembed_before_provider_change"),
]
ORDER_THRESHOLD = 0.75


def compare_providers(usage: DataFrame) -> DataFrame:
    """Score, advice and rank of each provider, and the state of each axis.

    Input: provider, coverage_pages, coverage_gaps, blocks, tables, confidence (or null), codes. Of 1 a provider loses up to a
    half for its share of pages with gaps, a fixed part for each signal, and .4 of what its order confidence lacks of .75 (at most .1)."""
    has = lambda code: F.coalesce(F.array_contains("codes", code), F.lit(False))
    gaps = F.coalesce("coverage_gaps", F.lit(0))
    penalty = F.least(F.lit(0.5), gaps / F.greatest(F.coalesce("coverage_pages", F.lit(0)), F.lit(1)) * 0.5)
    advice = F.when(F.lit(False), "")
    for code, cost, what in GAP_SIGNALS:
        penalty = penalty + F.when(has(code), cost).otherwise(0.0)
        advice = advice.when(has(code), what)
    low = F.coalesce(F.col("confidence") < ORDER_THRESHOLD, F.lit(False))
    penalty = penalty + F.when(low, F.least(F.lit(0.1), (ORDER_THRESHOLD - F.col("confidence")) * 0.4)).otherwise(0.0)
    state = lambda code: F.when(has(code), "gap")
    s = usage.select(
        "*", round_half_up(F.greatest(F.lit(0.0), 1.0 - penalty)).alias("score"), advice.when(gaps > 0, "inspect_coverage_gaps").otherwise("keep_candidate").alias("recommendation"),
        state("rag_empty_text_page").when(gaps > 0, "warning").otherwise("ok").alias("text_axis"), state("rag_table_without_unit").otherwise("ok").alias("table_axis"),
        state("rag_figure_caption_missing").otherwise("ok").alias("figure_axis"), F.when(has("rag_units_without_chunks") | has("rag_chunks_not_embedded"), "gap").otherwise("ok").alias("chunk_axis"),
        F.when(F.col("confidence").isNull(), "not_observed").when(low, "warning").otherwise("ok").alias("order_axis"),
    )
    w = Window.orderBy(F.desc("score"), gaps, F.desc("tables"), F.desc("blocks"), "provider")  # one row per provider: a fixed few
    return s.withColumn("rank", F.row_number().over(w))


def comparison_summary(ranked: DataFrame, primary: str) -> DataFrame:
    """One row: the best provider, whether it is not the primary one, warnings by kind, and what to do."""
    warns = F.col("text_axis").isin("gap", "warning") | (F.col("table_axis") == "gap") | (F.col("figure_axis") == "gap") | (F.col("chunk_axis") == "gap") | (F.col("order_axis") == "warning")
    g = ranked.agg(
        F.min_by("provider", "rank").alias("best"), F.count("*").alias("providers"), F.count_if(warns).alias("with_warnings"), F.count_if(F.col("order_axis") == "warning").alias("with_order_warning"),
        F.count_if(F.col("coverage_gaps") > 0).alias("with_gaps"), F.max(F.when(F.col("provider") == primary, F.col("rank"))).alias("primary_rank"),
    )
    differs = F.coalesce(F.col("best") != primary, F.lit(False))
    attention = differs | (F.col("with_warnings") + F.col("with_order_warning") + F.col("with_gaps") > 0)
    action = F.when(differs, "inspect_provider_route_plan").when(attention, "inspect_provider_comparison").otherwise("keep_current_primary")
    return g.select("*", differs.alias("best_differs"), attention.alias("needs_attention"), action.alias("action"))


def route(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Primary and fallback provider of each request: eligible ones by priority. Providers are configuration, a few rows."""
    # An equi-join on the media type: Spark chooses how, whatever the size of either side.
    by_type = providers.withColumn("media_type", F.explode(F.array_distinct("media_types")))
    j = requests.join(by_type, "media_type")
    why = F.filter(F.array(F.when(~F.col("enabled"), "disabled"), F.when(F.col("evaluation_only"), "evaluation_only"), F.when(F.size(F.array_except("needs", "capabilities")) > 0, "capability_mismatch")), lambda r: r.isNotNull())
    ok = j.withColumn("reasons", why).where(F.size("reasons") == 0)
    w = Window.partitionBy("request_id").orderBy(F.desc("priority"), "provider")
    ranked = ok.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return ranked.groupBy("request_id").agg(F.max(F.when(F.col("rn") == 1, F.col("provider"))).alias("primary"), F.max(F.when(F.col("rn") == 2, F.col("provider"))).alias("fallback"))


# The parse profiles, those run in the background, and the limits and names that choose one.
PROFILES = ("default", "large-pdf", "large-pdf-catalog", "large-pdf-ledger", "table-heavy", "ocr-heavy", "excel-ledger", "scan-pdf")
ASYNC_PROFILES = ("large-pdf", "large-pdf-catalog", "large-pdf-ledger", "scan-pdf")
LARGE_BYTES, LARGE_PAGES, DENSE_TABLES = 50 * 1024 * 1024, 500, 0.5
PDF, EXCEL = ("application/pdf",), ("application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel.sheet.macroenabled.12")
EXCEL_SUFFIXES = (".xls", ".xlsx", ".xlsm", ".xlsb", ".csv", ".tsv")
IMAGE_SUFFIXES = (".bmp", ".gif", ".heic", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
CATALOG_NAMES = ("catalog", "catalogue", "目录", "清单")
LEDGER_NAMES = ("ledger", "statement", "register", "台账", "明细", "清册")


def profile(media_type: Column, file_name: Column, size: Column, pages: Column, tables: Column, requested: Column) -> Column:
    """struct(profile, source, reasons, recommended_async, known): the requested profile unless it is empty or "auto",
    else the first rule that holds. Any input may be null: a rule that needs it does not hold."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    media, name, wish = clean(media_type), F.lower(F.coalesce(file_name, F.lit(""))), clean(requested)
    suffix = F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1)
    yes = lambda c: F.coalesce(c, F.lit(False))
    named = lambda hints: F.greatest(*[F.contains(name, F.lit(h)) for h in hints])
    many, big = yes(pages >= LARGE_PAGES), yes(size >= LARGE_BYTES)
    pdf = media.isin(*PDF) | (suffix == ".pdf")
    excel = media.isin(*EXCEL) | suffix.isin(*EXCEL_SUFFIXES)
    image = media.startswith("image/") | suffix.isin(*IMAGE_SUFFIXES)
    dense = yes((pages > 0) & (tables / pages >= DENSE_TABLES))
    large = pdf & (many | big)
    why_pages, why_size, why_dense = f"page_count>={LARGE_PAGES}", f"file_size_bytes>={LARGE_BYTES}", f"table_density>={DENSE_TABLES}"

    def because(*pairs: tuple[Column, str]) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in pairs]), lambda r: r.isNotNull())

    always = F.lit(True)
    rules = [
        (large & named(CATALOG_NAMES), "large-pdf-catalog", because((many, why_pages), (big, why_size), (always, "catalog_name_hint"))),
        (large & (named(LEDGER_NAMES) | dense), "large-pdf-ledger", because((many, why_pages), (big, why_size), (named(LEDGER_NAMES), "ledger_name_hint"), (dense, why_dense))),
        (pdf & many, "large-pdf", because((always, why_pages))),
        (pdf & big, "large-pdf", because((always, why_size))),
        (excel, "excel-ledger", because((always, "excel_input"))),
        (dense, "table-heavy", because((always, why_dense))),
        (image, "ocr-heavy", because((always, "image_input"))),
        (pdf & F.contains(name, F.lit("scan")), "scan-pdf", because((always, "scan_name_hint"))),
    ]
    asked = (wish != "") & (wish != "auto")
    chosen, reasons = F.when(asked, wish), F.when(asked, F.array(F.concat(F.lit("requested_profile="), wish)))
    for holds, which, why in rules:
        chosen, reasons = chosen.when(holds, which), reasons.when(holds, why)
    chosen, reasons = chosen.otherwise("default"), reasons.otherwise(F.array(F.lit("fallback_default")))
    return F.struct(
        chosen.alias("profile"), F.when(asked, "requested").otherwise("auto").alias("source"), reasons.alias("reasons"),
        chosen.isin(*ASYNC_PROFILES).alias("recommended_async"), chosen.isin(*PROFILES).alias("known"),
    )


def claim(queue: DataFrame, active: DataFrame, limit: int, as_of: str) -> DataFrame:
    """The oldest pending parts that are ready, as many per parent as its active limit leaves."""
    ready = queue.where((F.col("state") == "pending") & (F.coalesce("next_attempt_at", F.to_timestamp(F.lit(as_of))) <= F.to_timestamp(F.lit(as_of))))
    w = Window.partitionBy("doc_id").orderBy("created_at", "part_id")
    return ready.withColumn("rn", F.row_number().over(w)).join(active, "doc_id", "left").where(F.col("rn") <= F.lit(limit) - F.coalesce("active", F.lit(0))).drop("rn", "active")


def outbox(events: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Events not yet dispatched, one of each (tenant, doc, run, type)."""
    key = ["tenant_id", "doc_id", "run_id", "event_type"]
    return events.dropDuplicates(key).join(dispatched.select(key), key, "left_anti")
