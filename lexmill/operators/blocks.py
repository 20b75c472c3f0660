"""Texts to lines and blocks; pages; per-page and per-document quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import roles, text

LINES_PER_PAGE = 20


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_number, line): lines numbered from 0; a page is LINES_PER_PAGE lines."""
    out = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return out.withColumn("page_number", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int"))


def line_blocks(docs: DataFrame, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """Non-empty lines as paragraph blocks with deterministic ids, roles and positions; ``only`` those whose content it
    accepts, so that roles are worked out for no others."""
    rows = lines(docs).withColumn("content", text.inline_space(F.col("line"))).where("content <> ''")
    if only is not None:
        rows = rows.where(only(F.col("content")))
    return rows.select(
        "doc_id", F.col("line_no").alias("position"), F.concat_ws("-", F.col("doc_id").cast("string"), F.lit("p"), F.col("line_no").cast("string")).alias("block_id"),
        F.lit("paragraph").alias("type"), "content", "page_number", roles.semantic_role(F.col("content")).alias("semantic_role"),
    )


def paragraphs(docs: DataFrame, separator: str = r"\n[ \t]*\n") -> DataFrame:
    """Stripped, non-empty paragraphs between blank lines, after a title block with the document's name."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), separator)).alias("k", "content"))
    w = Window.partitionBy("doc_id").orderBy("k")
    return parts.withColumn("content", F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).where("content <> ''").select("doc_id", (F.row_number().over(w) - 1).alias("position"), "content")


def page_quality(blocks: DataFrame) -> DataFrame:
    """Per page: block count, median and greatest length, counts of very short, furniture-like and numeric-heavy blocks."""
    n = F.char_length("content")
    return blocks.groupBy("doc_id", "page_number").agg(
        F.count("*").alias("blocks"), F.percentile(n, F.lit(0.5)).alias("median_length"), F.count_if(n < 10).alias("very_short"),
        F.count_if(text.header_footer_like(F.col("content"))).alias("furniture"), F.count_if(text.numeric_heavy(F.col("content"))).alias("numeric_heavy"),
        F.max(n).alias("max_length"), F.count_if(n >= 2000).alias("long_blocks"),
    )


def noisy_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    """The n pages with the greatest share of very short blocks, then most furniture and numeric-heavy ones together; ties by page."""
    ratio = F.when(F.col("blocks") > 0, F.col("very_short") / F.col("blocks")).otherwise(0.0)
    ranked = pages.withColumns({"very_short_ratio": ratio, "noise": F.col("furniture") + F.col("numeric_heavy")})
    return ranked.orderBy(F.desc("very_short_ratio"), F.desc("noise"), "doc_id", "page_number").limit(n)


def page_projection(blocks: DataFrame) -> DataFrame:
    """Per page its text, roles and type; title blocks and artifacts are no part of the text."""
    shown = F.when(~F.col("semantic_role").isin("title", "parse_artifact"), F.struct("position", "content"))
    pages = blocks.groupBy("doc_id", "page_number").agg(
        F.array_sort(F.collect_list(shown)).alias("parts"), F.array_sort(F.collect_set("semantic_role")).alias("roles"), F.bool_or(F.col("semantic_role") == "title").alias("has_title"), F.count("*").alias("blocks")
    )
    pages = pages.withColumn("page_text", F.array_join("parts.content", "\n\n"))
    kind = roles.page_type(F.col("page_number"), F.col("roles"), F.col("page_text"), F.col("has_title"))
    return pages.select("doc_id", "page_number", "blocks", F.array_join("roles", ",").alias("roles"), F.char_length("page_text").alias("text_chars"), kind.alias("page_type"))


def document_summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_distinct("page_number").alias("pages"), F.sum(F.char_length("content")).alias("chars"), F.count_distinct("semantic_role").alias("roles")
    )


def document_quality(docs: DataFrame) -> DataFrame:
    """Garbling counts of a whole document, the penalties they cost, flags and what to do about them."""
    g = docs.select("doc_id", text.garble(F.col("text")).alias("g"))
    x, n = lambda k: F.col(f"g.{k}"), F.col("g.chars")
    rules = [  # fixed values: flag, condition, penalty
        ("cid_garble", x("cid_tokens") >= 50, 0.35), ("cid_warn", (x("cid_tokens") >= 10) & (x("cid_tokens") < 50), 0.15),
        ("pdf_name_garble", x("name_tokens") >= 50, 0.25), ("pdf_name_warn", (x("name_tokens") >= 10) & (x("name_tokens") < 50), 0.1),
        ("control_char_dense", (n > 0) & (x("control_chars") >= 0.03 * n), 0.1), ("low_printable_ratio", (n > 0) & (x("printable_chars") < 0.75 * n), 0.1),
        ("repeated_short_tokens", (x("components") > 0) & (x("repeated_short") >= 0.35 * x("components")), 0.05), ("empty_output", n == 0, 0.5),
    ]
    flags = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c, _ in rules]), lambda f: f.isNotNull())
    penalty = sum((F.when(c, p).otherwise(0.0) for _, c, p in rules), F.lit(0.0))
    severe = F.arrays_overlap(flags, F.array(*map(F.lit, ("cid_garble", "pdf_name_garble", "control_char_dense", "low_printable_ratio"))))
    return g.select(
        "doc_id", F.greatest(F.lit(0.0), text.round_half_up(1.0 - penalty)).alias("score"), F.array_join(flags, ",").alias("flags"), F.when(severe, "retry_with_ocr").alias("action"), text.garble_reason(F.col("g")).alias("reason")
    )


def contract_text(c: Column) -> Column:
    """NFKC, white space folded, ends stripped: the text that fingerprints are taken of."""
    nfkc = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.trim(F.regexp_replace(nfkc, r"(?U)[\s\x1c-\x1f\x85]+", " "))


def canonical_json(**fields: Column) -> Column:
    """An object with its keys in order and without spaces; strings are escaped as JSON asks, numbers stand as they are."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(row, {"ignoreNullFields": "false"})


def fingerprints(blocks: DataFrame) -> DataFrame:
    """Content, structure and unit fingerprints: SHA-256 of canonical JSON, and a stable id from the unit's.

    Content is the contract text alone; structure is type, role and page; the unit holds document and both."""
    content = F.sha2(canonical_json(text=contract_text(F.col("content"))), 256)
    structure = F.sha2(canonical_json(page=F.col("page_number"), role=F.col("semantic_role"), type=F.col("type")), 256)
    b = blocks.select("doc_id", "position", content.alias("content_fingerprint"), structure.alias("structure_fingerprint"))
    unit = F.sha2(canonical_json(content=F.col("content_fingerprint"), doc_id=F.col("doc_id").cast("string"), structure=F.col("structure_fingerprint")), 256)
    return b.withColumn("unit_fingerprint", unit).withColumn("stable_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("kuf"), F.substring("unit_fingerprint", 1, 20)))
