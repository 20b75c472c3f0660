"""How well search units, chunks and embeddings cover a document's pages, tables and figures; and what its parts lack.

Rows are dealt by document once, to as many tasks as the input asks for; what belongs together meets there in windows and groups by block,
page, unit or part, which need no further exchange.  Spans are exploded to pages.  Results come in a row per page, unit, document or part;
nothing gathers more than a page's or unit's ids.

Nulls: a missing text counts as no characters, a missing flag as false, a missing array as empty.  Repeated ids of units,
tables or figures count once; rows with the same ids and different values are not expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import scratch
from lexmill.functions.text import round_half_up

# What a page or unit lacks, and the signal of each.
NO_UNITS, NO_CHUNKS, NOT_EMBEDDED = "no_indexable_units", "no_chunks_for_indexable_units", "chunks_not_embedded"
SIGNALS = {NO_UNITS: "rag_empty_text_page", NO_CHUNKS: "rag_units_without_chunks", NOT_EMBEDDED: "rag_chunks_not_embedded"}
TABLE_SIGNAL, FIGURE_SIGNAL = "rag_table_without_unit", "rag_figure_caption_missing"


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places; nothing to cover counts as covered."""
    return F.when(b > 0, round_half_up(a / b)).otherwise(F.lit(1.0))


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _with_chunks(rows: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, block_id, ...) with ``held``, the different (chunk_id, embedded) of their block; dealt by document to ``n`` tasks."""
    held = chunks.select("doc_id", F.explode("block_ids").alias("block_id"), F.struct("chunk_id", F.coalesce("embedded", F.lit(False)).alias("embedded")).alias("chunk"), F.lit(True).alias("is_chunk"))
    both = rows.withColumn("is_chunk", F.lit(False)).unionByName(held, allowMissingColumns=True).repartition(n, "doc_id")
    of_block = F.collect_set("chunk").over(Window.partitionBy("doc_id", "block_id"))
    # A row without a block or document has no chunks; nulls would meet each other in one window.
    return both.withColumn("held", F.when(F.col("doc_id").isNotNull() & F.col("block_id").isNotNull(), of_block)).where("not is_chunk").drop("chunk", "is_chunk")


def units(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each unit with its chunks: ``missing`` (what it lacks, or null), ``state``, ``status`` and ``reason`` of its processing.

    Units and chunks are dealt by document once; they meet in windows there, and the result stays dealt so.
    Raw: doc_id, unit_id, page_start, page_end, should_index, skip_reason, block_ids, table_ids.  Chunks: doc_id, chunk_id, block_ids, embedded."""
    at = raw.select("*", F.posexplode_outer("block_ids").alias("block_no", "block_id"))
    at = _with_chunks(at, chunks, scratch.parts(raw, chunks))
    own = F.array_distinct(F.flatten(F.collect_list("held").over(Window.partitionBy("doc_id", "unit_id"))))
    u = at.withColumn("own", F.when(F.col("unit_id").isNotNull(), own)).where("coalesce(block_no, 0) = 0").withColumn("own", F.coalesce("own", F.array().cast(at.schema["held"].dataType)))
    u = u.select(*raw.columns, F.size("own").cast("long").alias("chunks"), F.size(F.filter("own", lambda x: x["embedded"])).cast("long").alias("embedded_chunks")).withColumn("should_index", F.coalesce("should_index", F.lit(False)))
    embedded = (F.col("chunks") > 0) & (F.col("embedded_chunks") == F.col("chunks"))
    missing = F.when(F.col("should_index") & (F.col("chunks") == 0), NO_CHUNKS).when(F.col("should_index") & ~embedded, NOT_EMBEDDED)
    u = u.withColumn("embedded", embedded).withColumn("missing", missing)
    skipped = ~F.col("should_index")
    lack = F.col("missing")
    return u.select(
        *[c for c in u.columns if c != "embedded_chunks"],
        F.when(skipped, "skipped").when(lack == NO_CHUNKS, "missing_chunks").when(lack == NOT_EMBEDDED, NOT_EMBEDDED).otherwise("covered").alias("state"),
        F.when(skipped, "skipped").when(lack.isNotNull(), "failed").otherwise("processed").alias("status"),
        F.when(skipped, F.coalesce(F.when(F.col("skip_reason") != "", F.col("skip_reason")), F.lit("not_indexable"))).otherwise(F.coalesce(lack, F.lit("chunked_and_embedded"))).alias("reason"),
        F.when(skipped, "skipped").when(F.col("embedded"), "embedded").otherwise("pending").alias("embedding_state"),
    )


def pages(blocks: DataFrame, units_: DataFrame, chunks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Per page that a block spans: what is on it and what it lacks.

    A page lacks units if it has text but none to index; chunks, if a unit to index has none or no block has one; embeddings, if
    its blocks' chunks are not all embedded.  A table lacks a unit if none to index on its page names it, a figure a caption if
    it has neither caption nor alternative text.

    Blocks: doc_id, block_id, page_start, page_end, chars, index_policy, provider.  Tables: doc_id, table_id, page_number.
    Figures: doc_id, figure_id, page_number, caption, alt_text."""
    page = ["doc_id", "page_number"]
    span = F.explode(F.sequence("page_start", "page_end")).alias("page_number")
    n = scratch.parts(blocks, units_, chunks, tables, figures)
    chars = F.when(F.coalesce("index_policy", F.lit("")) != "skip", F.coalesce("chars", F.lit(0))).otherwise(0)
    b = _with_chunks(blocks.select("doc_id", "block_id", "page_start", "page_end", chars.alias("chars"), "provider"), chunks, n)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    # Blocks, units, tables and figures of a page meet as rows of one frame, each with the columns of its kind.
    rows = [
        b.select("doc_id", span, "chars", F.when(F.col("provider") != "", F.col("provider")).alias("provider"), F.col("held"), F.lit(1).alias("block")),
        units_.select("doc_id", span, "unit_id", "should_index", F.when(F.col("missing") == NO_CHUNKS, 0).when(F.col("missing") == NOT_EMBEDDED, 1).alias("lack"), F.when(F.col("should_index"), F.col("table_ids")).alias("named"), F.lit(1).alias("unit")),
        tables.where(F.coalesce("table_id", F.lit("")) != "").select(*page, "table_id"),
        figures.where(F.coalesce("figure_id", F.lit("")) != "").select(*page, F.when(blank("caption") & blank("alt_text"), F.col("figure_id")).alias("bare"), F.lit(1).alias("figure")),
    ]
    # Figures and tables are dealt as units and blocks are already, so that the pages need no exchange of their own.
    rows = [*rows[:2], *[r.repartition(n, "doc_id") for r in rows[2:]]]
    every = reduce(lambda x, y: x.unionByName(y.where("doc_id is not null"), allowMissingColumns=True), rows)
    # One list a page, not one for each kind of id: a collected column costs more than all the counts.
    told = F.when(F.col("held").isNotNull() | F.col("provider").isNotNull() | F.col("lack").isNotNull() | F.col("named").isNotNull() | F.col("table_id").isNotNull() | F.col("bare").isNotNull(), F.struct("provider", "held", "unit_id", "lack", "named", "table_id", "bare"))
    p = every.groupBy(*page).agg(F.sum("chars").alias("parsed_text_chars"), F.count("block").alias("blocks"), F.count("unit").alias("units"), F.count_if("should_index").alias("indexable_units"), F.count("figure").alias("figures"), F.collect_list(told).alias("x")).where("blocks > 0")
    some = lambda c, test=None: F.array_distinct(F.filter("x" if c is None else F.col("x")[c], test or (lambda v: v.isNotNull())))
    lacks = lambda k: F.sort_array(F.array_distinct(F.transform(F.filter("x", lambda v: v["lack"] == k), lambda v: v["unit_id"])))
    p = p.select(
        *page, "parsed_text_chars", "blocks", "units", "indexable_units", "figures", F.sort_array(some("provider")).alias("provider_ids"), F.filter(F.array_distinct(F.flatten(some("held"))), lambda x: x["chunk_id"].isNotNull()).alias("made"), lacks(0).alias("unchunked_unit_ids"), lacks(1).alias("unembedded_unit_ids"),
        some("table_id").alias("table_ids"), F.flatten(some("named")).alias("named"), F.sort_array(some("bare")).alias("figure_ids_missing_caption"),
    )
    p = p.select(
        *page, "parsed_text_chars", "blocks", "provider_ids", F.size("made").cast("long").alias("chunks"), ((F.size("made") > 0) & F.forall("made", lambda x: x["embedded"])).alias("embedded"), "units", "indexable_units", "unchunked_unit_ids",
        "unembedded_unit_ids", F.size("table_ids").cast("long").alias("tables"), F.sort_array(F.array_except("table_ids", "named")).alias("table_ids_without_units"), "figures", "figure_ids_missing_caption",
    )
    some = F.col("indexable_units") > 0
    missing = (
        F.when((F.col("parsed_text_chars") > 0) & ~some, NO_UNITS).when(some & ((F.size("unchunked_unit_ids") > 0) | (F.col("chunks") == 0)), NO_CHUNKS)
        .when((F.col("chunks") > 0) & ~F.col("embedded"), NOT_EMBEDDED)
    )
    p = p.withColumn("missing_reason", missing).withColumn("chunked_units", F.col("indexable_units") - F.size("unchunked_unit_ids"))
    codes = [*[F.when(F.col("missing_reason") == k, F.lit(v)) for k, v in SIGNALS.items()], F.when(F.size("table_ids_without_units") > 0, F.lit(TABLE_SIGNAL)), F.when(F.size("figure_ids_missing_caption") > 0, F.lit(FIGURE_SIGNAL))]
    return p.withColumn("codes", F.filter(F.array(*codes), lambda c: c.isNotNull()))


def signals(pages_: DataFrame) -> DataFrame:
    """A warning for each thing that a page lacks."""
    return pages_.select("doc_id", "page_number", F.explode("codes").alias("code")).withColumn("severity", F.lit("warning"))


def _page_sums() -> list[Column]:
    gap = F.col("missing_reason").isNotNull() | (F.size("table_ids_without_units") > 0) | (F.size("figure_ids_missing_caption") > 0)
    lack = lambda what: F.count_if(F.col("missing_reason") == what)
    tables = F.col("tables") > 0
    return [
        F.count("*").alias("total_pages"), F.count_if(F.col("parsed_text_chars") > 0).alias("pages_with_parsed_text"), F.count_if(F.col("indexable_units") > 0).alias("pages_with_indexable_units"),
        lack(NO_UNITS).alias("pages_missing_rag_units"), lack(NO_CHUNKS).alias("pages_missing_chunks"), lack(NOT_EMBEDDED).alias("pages_chunks_not_embedded"), F.count_if(gap).alias("pages_with_coverage_gaps"),
        F.count_if(F.size("table_ids_without_units") > 0).alias("pages_table_without_units"), F.count_if(F.size("figure_ids_missing_caption") > 0).alias("pages_figure_caption_missing"),
        F.count_if(tables).alias("table_pages"), F.count_if(tables & (F.col("indexable_units") > 0)).alias("table_pages_with_units"),
    ]


def _unit_sums() -> list[Column]:
    i = F.col("should_index")
    status = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_unit_count")
    return [
        F.count("*").alias("total_unit_count"), F.count_if(i).alias("total_indexable_units"), F.count_if(i & (F.col("chunks") > 0)).alias("total_chunked_units"), F.count_if(i & F.col("embedded")).alias("embedded_unit_count"),
        F.count_if(i & (F.col("chunks") > 0) & ~F.col("embedded")).alias("unembedded_unit_count"), status("processed"), status("skipped"), status("failed"),
        F.sort_array(F.collect_set(F.when(F.col("missing").isNotNull(), F.col("unit_id")))).alias("gap_unit_ids"),
    ]


def _with_ratios(s: DataFrame) -> DataFrame:
    unit_counts = ["total_unit_count", "total_indexable_units", "total_chunked_units", "embedded_unit_count", "unembedded_unit_count", "processed_unit_count", "skipped_unit_count", "failed_unit_count"]
    s = s.fillna(0, unit_counts).withColumn("gap_unit_ids", F.coalesce("gap_unit_ids", _none()))
    c = F.col
    return s.select(
        "*", ratio(c("pages_with_indexable_units"), c("pages_with_parsed_text")).alias("text_page_coverage_ratio"), ratio(c("total_chunked_units"), c("total_indexable_units")).alias("unit_chunk_coverage_ratio"),
        ratio(c("table_pages_with_units"), c("table_pages")).alias("table_unit_coverage_ratio"),
    )


def summary(pages_: DataFrame, units_: DataFrame) -> DataFrame:
    """Per document; a unit counts once, however many pages it spans."""
    return _with_ratios(pages_.groupBy("doc_id").agg(*_page_sums()).join(units_.groupBy("doc_id").agg(*_unit_sums()), "doc_id", "left"))


def part_summary(parts: DataFrame, pages_: DataFrame, units_: DataFrame) -> DataFrame:
    """The same per part (doc_id, part_id, page_start, page_end): pages in its range, units whose span meets it once each; a part
    without any page has no row.  Units and chunked units are counted by page, as a page's share."""
    key = ["doc_id", "part_id"]
    at = parts.select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"), "part_id")
    n = scratch.parts(parts, pages_, units_)

    def placed(rows: DataFrame) -> DataFrame:
        """A row for each part that has the row's page; rows of both sides are dealt by document."""
        both = rows.withColumn("part_id", F.lit(None).cast(at.schema["part_id"].dataType)).unionByName(at.repartition(n, "doc_id").withColumn("row_kind", F.lit("part")), allowMissingColumns=True)
        within = F.collect_list("part_id").over(Window.partitionBy("doc_id", "page_number"))
        return both.withColumn("part_ids", within).where("row_kind is null").drop("row_kind", "part_id").withColumn("part_id", F.explode("part_ids")).drop("part_ids")

    by_page = placed(pages_).groupBy(*key).agg(*_page_sums(), F.sum("indexable_units").alias("page_indexable"), F.sum("chunked_units").alias("page_chunked"))
    u = placed(units_.select("doc_id", "unit_id", "should_index", "chunks", "embedded", "missing", "status", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))).dropDuplicates([*key, "unit_id"])
    s = by_page.join(u.groupBy(*key).agg(*_unit_sums()), key, "left")
    s = s.withColumns({"total_indexable_units": F.col("page_indexable"), "total_chunked_units": F.col("page_chunked")}).drop("page_indexable", "page_chunked")
    return _with_ratios(s)


# The pages' lacks in the order in which they decide, the action and gate of each, and its flag.
LACKS = [
    ("pages_missing_rag_units", "review_parse_ir", "manual_review", "rag_empty_text_page"),
    ("pages_table_without_units", "local_provider_rerun", "accept_with_warning", TABLE_SIGNAL),
    ("pages_figure_caption_missing", "review_parse_ir", "accept_with_warning", FIGURE_SIGNAL),
    ("pages_missing_chunks", "rechunk_document", "accept_with_warning", "rag_units_without_chunks"),
    ("pages_chunks_not_embedded", "reembed_document", "accept_with_warning", "rag_chunks_not_embedded"),
]
FLAG_ORDER = ("rag_empty_text_page", "rag_units_without_chunks", "rag_chunks_not_embedded", TABLE_SIGNAL, FIGURE_SIGNAL)


def quality(summaries: DataFrame) -> DataFrame:
    """``summaries`` with rag_score (the lesser of the share of pages without gaps and of chunked units), rag_gate, rag_flags and
    rag_action."""
    gate, action = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    count_of = {flag: count for count, _, _, flag in LACKS}
    for count, act, which, _ in LACKS:
        gate, action = gate.when(F.col(count) > 0, which), action.when(F.col(count) > 0, act)
    flags = F.filter(F.array(*[F.when(F.col(count_of[f]) > 0, F.lit(f)) for f in FLAG_ORDER]), lambda f: f.isNotNull())
    pages_ok = F.greatest(F.lit(0.0), 1.0 - F.col("pages_with_coverage_gaps") / F.greatest("total_pages", F.lit(1)))
    score = round_half_up(F.least(pages_ok, F.col("unit_chunk_coverage_ratio")))
    return summaries.withColumns({"rag_score": score, "rag_gate": gate.otherwise("accept"), "rag_flags": flags, "rag_action": action})


def manifest(units_: DataFrame, summaries: DataFrame) -> DataFrame:
    """The coverage part of each document's index manifest: unit counts, and the ids of units that are embedded or skipped or lack
    something, in order."""
    ids = lambda test: F.sort_array(F.collect_set(F.when(test, F.col("unit_id"))))
    i = F.col("should_index")
    u = units_.groupBy("doc_id").agg(
        F.count_if(i).alias("indexable_units"), F.count_if(i & (F.col("chunks") > 0)).alias("chunked_units"), F.count_if(i & F.col("embedded")).alias("embedded_units"), F.count_if(~i).alias("skipped_units"),
        ids(i & (F.col("chunks") > 0) & ~F.col("embedded")).alias("unembedded_unit_ids"), ids(i & (F.col("chunks") == 0)).alias("unchunked_unit_ids"),
    )
    return summaries.select("doc_id", "total_pages", "pages_with_coverage_gaps", "unit_chunk_coverage_ratio").join(u, "doc_id", "left")


# --- parts ----------------------------------------------------------------------------------------------------------

#: States that a part may report as they are.
PART_STATES = ("pending", "parsing", "structuring", "embedding", "done", "failed", "cancelled", "warning", "partial", "unknown")


def part_states(parts: DataFrame, signals_: DataFrame) -> DataFrame:
    """Each part with the signals of its pages: their count (or what the part reports, if that is more), codes, pages and severities,
    and its state: a failed part stays failed, one that is done but has signals is a warning, an unknown state says so.

    Parts: doc_id, part_id, page_start, page_end, raw_state, reported_signals.  Signals: doc_id, page_number, code, severity."""
    key = ["doc_id", "part_id"]
    at = parts.select(*key, F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    s = signals_.join(at, ["doc_id", "page_number"])
    severities = s.groupBy(*key, F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_counts"))
    found = s.groupBy(*key).agg(F.count("*").alias("found"), F.array_sort(F.collect_set(F.when(F.col("code") != "", F.col("code")))).alias("codes"), F.array_sort(F.collect_set("page_number")).alias("signal_pages"))
    p = parts.join(found, key, "left").join(severities, key, "left")
    count = F.greatest(F.coalesce("reported_signals", F.lit(0)), F.coalesce("found", F.lit(0)))
    raw = F.lower(F.trim(F.coalesce("raw_state", F.lit(""))))
    state = F.when(raw == "failed", "failed").when((count > 0) & raw.isin("", "done"), "warning").when(raw.isin(*PART_STATES), raw).otherwise("unknown")
    return p.select(
        *parts.columns, state.alias("state"), count.alias("signals"), F.coalesce("codes", _none()).alias("codes"), F.coalesce("signal_pages", _none("int")).alias("signal_pages"), "severity_counts",
    )


# Measures of a part that are better when lower, and when higher, with the names of their axes.
LOWER = [("pages_with_coverage_gaps", "coverage_gaps"), ("signals", "quality_signal_count"), ("gap_units", "gap_units"), ("unembedded_unit_count", "unembedded_units")]
HIGHER = [(f"{k}_coverage_ratio", f"{k}_coverage_ratio") for k in ("text_page", "unit_chunk", "table_unit")]


def compare_reruns(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a part's rerun changed: axes that improved and regressed, deltas, the status, and set differences of flags, codes and
    units with gaps.  Both: doc_id, part_id, provider, the measures (a missing count is 0, a missing ratio 1), gap_unit_ids, flags, codes."""
    key = ["doc_id", "part_id"]
    sets = ("flags", "codes", "gap_unit_ids")

    def side(df: DataFrame, suffix: str) -> DataFrame:
        gaps = F.size(F.coalesce("gap_unit_ids", _none()))
        cols = [gaps.alias(f"gap_units{suffix}")]
        cols += [F.coalesce(F.col(c), F.lit(0)).alias(f"{c}{suffix}") for c, _ in LOWER if c != "gap_units"] + [F.coalesce(F.col(c), F.lit(1.0)).alias(f"{c}{suffix}") for c, _ in HIGHER]
        return df.select(*key, F.coalesce("provider", F.lit("")).alias(f"provider{suffix}"), *cols, *[F.coalesce(c, _none()).alias(f"{c}{suffix}") for c in sets])

    j = side(before, "_0").join(side(after, "_1"), key)
    delta = {c: F.col(f"{c}_1") - F.col(f"{c}_0") for c, _ in (*LOWER, *HIGHER)}
    axes = lambda good: F.filter(F.array(*[F.when((delta[c] < 0) if good else (delta[c] > 0), F.lit(a)) for c, a in LOWER], *[F.when((delta[c] > 0) if good else (delta[c] < 0), F.lit(a)) for c, a in HIGHER]), lambda a: a.isNotNull())
    j = j.withColumn("improved_axes", axes(True)).withColumn("regressed_axes", axes(False)).withColumn("provider_changed", F.col("provider_0") != F.col("provider_1"))
    up, down = F.size("improved_axes") > 0, F.size("regressed_axes") > 0
    status = F.when(up & down, "mixed").when(up, "improved").when(down, "regressed").when(F.col("provider_changed"), "provider_changed").otherwise("unchanged")
    return j.select(
        *key, status.alias("status"), "improved_axes", "regressed_axes", "provider_changed", *[round_half_up(delta[c]).alias(f"{c}_delta") if (c, c) in HIGHER else delta[c].alias(f"{c}_delta") for c in delta],
        *[F.array_sort(F.array_except(f"{c}_1", f"{c}_0")).alias(f"{c}_added") for c in sets], *[F.array_sort(F.array_except(f"{c}_0", f"{c}_1")).alias(f"{c}_removed") for c in sets],
    )


def part_focus(rerun_status: Column, provider_changed: Column, gaps: Column, signals_: Column, rag_gate: Column, rerun_supported: Column) -> Column:
    """What to look at in a part: after a rerun its outcome decides, before one its gaps, then its signals; else null."""
    status = F.lower(F.trim(F.coalesce(rerun_status, F.lit(""))))
    gate = F.coalesce(rag_gate, F.lit(""))
    improved = F.when((gaps > 0) | (gate == "accept_with_warning"), "coverage_gaps").when(F.coalesce(provider_changed, F.lit(False)), "keep_current_provider").otherwise("quality_review")
    return (
        F.when(status.isin("unchanged", "provider_changed"), "provider_route_plan").when(status.isin("regressed", "mixed"), "parse_ir").when(status == "improved", improved)
        .when(F.coalesce(rerun_supported, F.lit(False)) & ((gaps > 0) | (gate == "local_rerun")), "local_provider_rerun").when(signals_ > 0, "quality_review")
    )


def attention_parts(parts: DataFrame) -> DataFrame:
    """Parts that ask for a look: a warning or failed state, a compared rerun, or gaps in pages or units.
    Input: state, rerun_status (null without a rerun), coverage_gaps, gap_units, and whatever else."""
    asks = F.col("state").isin("warning", "failed") | F.col("rerun_status").isNotNull() | (F.coalesce("coverage_gaps", F.lit(0)) > 0) | (F.coalesce("gap_units", F.lit(0)) > 0)
    return parts.where(F.coalesce(asks, F.lit(False)))
