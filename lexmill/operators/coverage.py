"""Knowledge units, chunks, and how far pages and units are covered by embedded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import roles, scratch
from lexmill.functions.text import round_half_up


def units(blocks: DataFrame) -> DataFrame:
    """One unit per block: type, text, span, whether search should index it, else why not."""
    empty = F.trim(F.coalesce("content", F.lit(""))) == ""
    reason = F.when(empty, "empty_text").when(F.col("semantic_role").isin(*roles.NOT_INDEXED), F.concat(F.lit("semantic_role:"), F.col("semantic_role")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))
    kind = F.when(F.col("type").isin("table", "figure"), F.col("type")).when(F.col("semantic_role") == "title", "title").when(F.col("semantic_role") != "paragraph", "structured").otherwise("paragraph")
    page_end = F.col("page_end") if "page_end" in blocks.columns else F.col("page_number")
    return blocks.select(
        "doc_id", "position", F.format_string("%s:ku:%06d", F.col("doc_id").cast("string"), n).alias("unit_id"), F.array("block_id").alias("block_ids"), kind.alias("unit_type"), "semantic_role",
        F.col("content").alias("text"), F.least("page_number", page_end).alias("page_start"), F.greatest("page_number", page_end).alias("page_end"), reason.isNull().alias("should_index"), reason.alias("skip_reason"),
    )


def chunks(units_: DataFrame) -> DataFrame:
    """One chunk per indexable unit; the id is a hash, so a recomputation gives the same."""
    u = units_.where("should_index")
    return u.select("doc_id", F.sha2(F.concat_ws("|", "unit_id", F.array_join("block_ids", ",")), 256).alias("chunk_id"), "unit_id", "block_ids", *[c for c in ("text",) if c in u.columns], "semantic_role", "page_start")


def share(a: Column, b: Column) -> Column:
    """a / b to four places; nothing to cover counts as covered."""
    return F.when(b > 0, round_half_up(a / b)).otherwise(F.lit(1.0))


def unit_coverage(units_: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Per unit: its chunks, how many are embedded, and whether all are (none at all is no)."""
    n = scratch.parts(units_, chunks_)
    held = chunks_.select(F.explode("block_ids").alias("block_id"), F.struct("chunk_id", "embedded").alias("chunk"), F.lit(True).alias("is_chunk"))
    at = units_.select("doc_id", "unit_id", "page_start", "page_end", "should_index", F.posexplode_outer("block_ids").alias("block_no", "block_id"), F.lit(False).alias("is_chunk"))
    # Units and chunks meet by block, then a unit's blocks by document, where pages and documents stay: no other exchange.
    both = at.unionByName(held, allowMissingColumns=True).repartition(n, "block_id")
    at = both.withColumn("held", F.when(F.col("block_id").isNotNull(), F.collect_set("chunk").over(Window.partitionBy("block_id")))).where("not is_chunk").drop("chunk", "is_chunk").repartition(n, "doc_id")
    own = F.array_distinct(F.flatten(F.collect_list("held").over(Window.partitionBy("doc_id", "unit_id"))))
    out = at.withColumn("own", F.when(F.col("doc_id").isNotNull() & F.col("unit_id").isNotNull(), own)).where("coalesce(block_no, 0) = 0")
    out = out.withColumns({"chunks": F.size(F.coalesce("own", F.array().cast(at.schema["held"].dataType))).cast("long"), "embedded": F.size(F.coalesce(F.filter("own", lambda x: x["embedded"]), F.array().cast(at.schema["held"].dataType))).cast("long")})
    c, e = F.col("chunks"), F.col("embedded")
    reason = F.when(~F.col("should_index"), None).when(c == 0, "no_chunk").when(e < c, "not_embedded")
    return out.select("doc_id", "unit_id", "page_start", "page_end", "should_index", c.alias("chunks"), e.alias("embedded"), ((c > 0) & (e == c)).alias("all_embedded"), reason.alias("missing_reason"))


def page_coverage(coverage: DataFrame) -> DataFrame:
    """Per page of a unit's span: units, indexable, chunked and embedded units, and the page's gap."""
    p = coverage.withColumn("page_number", F.explode(F.sequence("page_start", "page_end")))
    i = F.col("should_index")
    g = p.groupBy("doc_id", "page_number").agg(F.count("*").alias("units"), F.count_if(i).alias("indexable"), F.count_if(i & (F.col("chunks") > 0)).alias("chunked"), F.count_if(i & F.col("all_embedded")).alias("embedded"))
    gap = F.when(F.col("indexable") == 0, "no_indexable_unit").when(F.col("chunked") < F.col("indexable"), "missing_chunks").when(F.col("embedded") < F.col("indexable"), "not_embedded")
    return g.withColumn("gap", gap)


def summary(pages: DataFrame) -> DataFrame:
    """Per document: pages, gaps of each kind, and the ratios."""
    g = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("gap").isNotNull()).alias("pages_with_gaps"), F.count_if(F.col("gap") == "missing_chunks").alias("pages_missing_chunks"),
        F.count_if(F.col("gap") == "not_embedded").alias("pages_not_embedded"), F.sum("indexable").alias("indexable"), F.sum("chunked").alias("chunked"), F.sum("embedded").alias("embedded"),
    )
    return g.select("*", share(F.col("pages") - F.col("pages_with_gaps"), F.col("pages")).alias("page_ratio"), share(F.col("chunked"), F.col("indexable")).alias("chunk_ratio"), share(F.col("embedded"), F.col("indexable")).alias("embedded_ratio"))


# The least ratios and confidence that pass, and the flag of each.
GATE_LIMITS = [
    ("text_ratio", 0.98, "text_page_coverage_below_threshold"), ("table_ratio", 0.95, "table_unit_coverage_below_threshold"),
    ("chunk_ratio", 0.98, "unit_chunk_coverage_below_threshold"), ("order_confidence", 0.75, "reading_order_confidence_below_threshold"),
]


def quality_gate(rag: DataFrame, allow_review: bool = True, allow_rerun: bool = True) -> DataFrame:
    """Gate, action and flags of each document from its ratios and its coverage quality (``rag.quality``).

    Input: doc_id, text_ratio, table_ratio, chunk_ratio, order_confidence (or null), rag_flags, rag_gate, rag_action (or null).
    A review or rerun that the configuration does not allow becomes a warning. An unknown ratio counts as 1."""
    low = [F.when(F.coalesce(F.col(c) < least, F.lit(False)), F.lit(flag)) for c, least, flag in GATE_LIMITS]
    flags = F.array_distinct(F.concat(F.filter(F.array(*low), lambda f: f.isNotNull()), F.coalesce("rag_flags", F.array().cast("array<string>"))))
    s = rag.withColumn("flags", flags)
    has = lambda f: F.array_contains("flags", f)
    review, rerun, warn = ("manual_review" if allow_review else "accept_with_warning"), ("local_rerun" if allow_rerun else "accept_with_warning"), "accept_with_warning"
    rules = [  # condition, gate, the action if coverage quality has none
        (has("rag_empty_text_page") | (F.col("rag_gate") == "manual_review"), review, "review_parse_ir"),
        (has("rag_table_without_unit"), rerun, "local_provider_rerun"),
        (has("reading_order_confidence_below_threshold"), rerun, "local_provider_rerun"),
        (has("text_page_coverage_below_threshold") | has("table_unit_coverage_below_threshold"), rerun, "local_provider_rerun"),
        (has("rag_figure_caption_missing"), warn, "review_parse_ir"),
        (has("unit_chunk_coverage_below_threshold") | has("rag_units_without_chunks"), warn, "rechunk_document"),
        (has("rag_chunks_not_embedded"), warn, "reembed_document"),
        ((F.size("flags") > 0) | (F.col("rag_gate") == "accept_with_warning"), warn, None),
    ]
    gate, action = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for holds, g, a in rules:
        gate, action = gate.when(holds, g), action.when(holds, F.coalesce("rag_action", F.lit(a)))
    gate = gate.otherwise("accept")
    return s.select("doc_id", gate.alias("gate"), action.alias("action"), "flags", gate.isin("accept", "accept_with_warning").alias("passed"))


# What an action on a document offers, and how it is asked for.
OFFERS = {
    "rechunk_document": ["rechunk_document"], "reembed_document": ["reembed_document"], "review_parse_ir": ["review_parse_ir"],
    "local_provider_rerun": ["inspect_provider_route_plan", "reparse_document"],
}


def offers(doc_id: Column, gate: Column, action: Column, flags: Column, eligible_parts: Column) -> Column:
    """The ordered ids of the actions to offer: none for an accepted or disabled gate; what the action means, first the rerun of warning
    parts if there are any that allow it; a review of the quality wherever there are flags.  Null arrays are empty."""
    none = F.array().cast("array<string>")
    known = F.create_map(*[x for k, v in OFFERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    act = F.trim(F.coalesce(action, F.lit("")))
    parts = F.when((act == "local_provider_rerun") & (F.size(F.coalesce(eligible_parts, none)) > 0), F.array(F.lit("rerun_warning_parts"))).otherwise(none)
    meant = F.when(act == "", none).otherwise(F.coalesce(F.element_at(known, act), F.array(act)))
    review = F.when(F.size(F.coalesce(flags, none)) > 0, F.array(F.lit("review_quality"))).otherwise(none)
    return F.when(gate.isin("accept", "disabled") | doc_id.isNull(), none).otherwise(F.array_distinct(F.concat(parts, meant, review)))


def traceability(chunks_: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per chunk: traceable iff it names blocks and all of them exist and have a page."""
    e = chunks_.select("chunk_id", F.explode_outer("block_ids").alias("block_id"))
    j = e.join(blocks.select("block_id", F.col("page_number").isNotNull().alias("paged")).distinct(), "block_id", "left")
    return j.groupBy("chunk_id").agg(F.bool_and(F.coalesce("paged", F.lit(False))).alias("traceable"), F.count("block_id").alias("blocks"))


def signals_in_range(signals: DataFrame, parts: DataFrame) -> DataFrame:
    """Signals of each part's page range. A signal meets few parts, so pages are the equi-join key."""
    pages = parts.select("doc_id", "part_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    return signals.join(pages, ["doc_id", "page_number"])


# The cascade's stages: key parts, status, reason, confidence; the last two pair what is ambiguous by place.
DIFF_STAGES = [
    (["unit"], "unchanged", "unit_fingerprint_equal", 1.0), (["content", "structure"], "unchanged", "content_and_structure_equal_across_source_version", 0.99),
    (["content"], "relocated", "content_equal_structure_changed", 0.95), (["structure"], "changed", "structure_equal_content_changed", 0.9),
    (["content"], "unknown", "ambiguous_duplicate_content_fingerprint", 0.4), (["structure"], "unknown", "ambiguous_duplicate_structure_fingerprint", 0.4),
]


def diff_units(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One-to-one mapping of two versions' units of each document, by a cascade of unique keys.

    Each stage counts its key among the rows that the stages before left open, on both sides, and pairs the keys that are
    single on both; a key with an empty part pairs nothing.  What stays ambiguous is paired in order but marked unknown,
    the rest is added or removed.  Both versions' slim rows are dealt by document once; every stage is a window there.
    Input of both: doc_id, unit_id, position, unit_fingerprint, content_fingerprint, structure_fingerprint."""
    cols = ["doc_id", "unit_id", "position", "unit_fingerprint", "content_fingerprint", "structure_fingerprint"]
    rows = previous.select(*cols).withColumn("old", F.lit(True)).unionByName(current.select(*cols).withColumn("old", F.lit(False))).repartition("doc_id")
    null = F.lit(None).cast("string")
    rows = rows.withColumns({"mate": null, "stage": F.lit(None).cast("int")})
    for k, (parts, status, _, _) in enumerate(DIFF_STAGES):
        open_ = F.col("stage").isNull()
        for p in parts:
            open_ = open_ & (F.coalesce(f"{p}_fingerprint", F.lit("")) != "")
        rows = rows.withColumn("key", F.when(open_, F.concat_ws("|", *[f"{p}_fingerprint" for p in parts])))
        if status == "unknown":
            nth = F.row_number().over(Window.partitionBy("doc_id", "key", "old").orderBy("position", "unit_id"))
            rows = rows.withColumn("nth", nth)
            w = Window.partitionBy("doc_id", "key", "nth")
        else:
            w = Window.partitionBy("doc_id", "key")
        of = lambda old: F.when(F.col("old") if old else ~F.col("old"), F.col("unit_id"))
        rows = rows.withColumns({"n0": F.count(of(True)).over(w), "n1": F.count(of(False)).over(w), "id0": F.max(of(True)).over(w), "id1": F.max(of(False)).over(w)})
        hit = F.col("key").isNotNull() & (F.col("n0") == 1) & (F.col("n1") == 1)
        mate = F.when(F.col("old"), F.col("id1")).otherwise(F.col("id0"))
        rows = rows.withColumns({"mate": F.when(hit, mate).otherwise(F.col("mate")), "stage": F.when(hit, k).otherwise(F.col("stage"))}).select(*cols, "old", "mate", "stage")
    told = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), F.lit(c).alias("confidence")) for _, s, r, c in DIFF_STAGES])
    alone = F.when(F.col("old"), F.struct(F.lit("removed").alias("status"), F.lit("no_current_match").alias("reason"), F.lit(1.0).alias("confidence"))).otherwise(
        F.struct(F.lit("added").alias("status"), F.lit("no_previous_match").alias("reason"), F.lit(1.0).alias("confidence"))
    )
    out = rows.where(F.col("old") | F.col("mate").isNull())  # a pair is told by its old row
    return out.select("doc_id", F.when(F.col("old"), F.col("unit_id")).alias("p_unit_id"), F.when(F.col("old"), F.col("mate")).otherwise(F.col("unit_id")).alias("c_unit_id"), F.coalesce(F.get(told, F.col("stage")), alone).alias("r")).select("doc_id", "p_unit_id", "c_unit_id", "r.*")


def compare_records(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Full outer comparison by key on a hash of the other columns: same, changed, missing, extra."""
    h = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256).alias(n))
    j = h(a, "ha").join(h(b, "hb"), key, "full_outer")
    return j.select(key, F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").when(F.col("ha") == F.col("hb"), "same").otherwise("changed").alias("status"))
