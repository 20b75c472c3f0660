"""What a manual is made of and how usable its structure is; page types with confidence; layout sums; report deltas.

Items: doc_id, position, kind (form of the content), semantic_role, text, page_number, and where known page_type, table_type, title,
section_heading (boolean), page_label, index_policy, missing_reason.  Rows of a document are judged in order of position; missing
columns count as null.  A null role is a paragraph, a null text is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.extract import audit_placeholder
from lexmill.functions.roles import NUMERALS
from lexmill.functions.text import round_half_up

ARTIFACTS = ("header_footer", "parse_artifact", "version_cell", "page_ref_cell")
ANCHORS = ("front_matter", "body_section", "appendix")
LISTS = ("toc_entry", "lep_entry", "revision_record", "distribution_list")
# Names of front matter by what they stand for, and the roles of tables by their type.
NAMES = {
    "lep_entry": [r"list\s+of\s+effective\s+pages", "有效页清单"],
    "revision_record": [r"record\s+of\s+revisions", r"revision(?:\s+record|\s+history)?", "修订记录", "版次表"],
    "distribution_list": [r"distribution\s+list", "分发清单", r"release\s+personnel\s+list", r"outsourced\s+vendor\s+list"],
}
OTHER_FRONT = [r"table\s+of\s+contents", "contents", "目录", "目次", "signature", "approval", "highlights"]
TABLE_TYPES = {
    "effective_page_list": "lep_entry", "revision_record": "revision_record", "distribution_list": "distribution_list", "release_personnel_list": "distribution_list",
    "outsourced_vendor_list": "distribution_list", "appendix_table": "appendix",
}
BULLETIN_MARK, BULLETIN_BRANCH = r"(?iU)^(?:R\s+)?(?:PRE|POST|END)\s+SB\s+\d{2}-\d{3}$", r'(?iU)^(?:R\s+)?\d+(?:\.[A-Z])?\.?\s+Branch\s+"[^"\r\n]+"\.?(?:\s+R)?$'
PRODUCT_NUMBER, ANNEX, CAPITALS = r"^\d{3}-\d{3}-\d{3}-\d(?=\s|$)\s*", r"(?iU)^(?:appendix|annex|附录|附件)\b", "^[A-Z][A-Z0-9/&() .,-]{2,80}$"


def _any(words: list[str]) -> str:
    return "(?iU)(?:" + "|".join(words) + ")"


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def heading_lines(text: Column) -> Column:
    """The lines of a text, white space folded and a leading product number cut off; empty ones go."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]")
    folded = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")), PRODUCT_NUMBER, "")))
    return F.filter(folded, lambda x: x != "")


def heading_like(line: Column, numbered: str) -> Column:
    """A line of up to 90 characters that names an appendix, is numbered (``numbered``) or in capitals."""
    return (line != "") & (F.char_length(line) <= 90) & (line.rlike(ANNEX) | line.rlike(numbered) | line.rlike(CAPITALS))


# Words that stay small in a title, and the forms of a numbered heading.
CONNECTIVES = ["and", "or", "of", "the", "to", "for", "in", "on", "with"]
_WORD = "[A-Z][A-Za-z0-9'/-]*"
_TITLE = rf"(?-i:{_WORD}(?:\s+(?:{_WORD}|{'|'.join(CONNECTIVES)}))*)$"
NUMBERED = "(?iU)^(?:" + "|".join([r"\d+(?:\.\d+)*[.)](?=\s|$)", r"\d+(?:\.\d+)+(?=\s|$)", rf"第[\d{NUMERALS}]+[章节条款]", r"(?:chapter|section)\s+[a-z0-9]+\b", rf"\d+\s+{_TITLE}"]) + ")"


def with_columns(items: DataFrame) -> DataFrame:
    for c, kind in (("page_type", "string"), ("table_type", "string"), ("title", "string"), ("section_heading", "boolean"), ("page_label", "string"), ("index_policy", "string"), ("missing_reason", "string")):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast(kind))
    return items


def manual_role(items: DataFrame, numbered: str = NUMBERED) -> DataFrame:
    """``items`` with ``manual_role``: the part of a manual that an item belongs to, or null."""
    i = with_columns(items)
    role = F.when(_low(F.col("semantic_role")) == "", "paragraph").otherwise(_low(F.col("semantic_role")))
    text = F.trim(F.coalesce(F.when(F.col("title") != "", F.col("title")), "text", F.lit("")))
    flat = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    first = F.coalesce(F.get(heading_lines(text), F.lit(0)), F.lit(""))
    front = _any([w for words in NAMES.values() for w in words] + OTHER_FRONT)
    kind, page = _low(F.col("kind")), _low(F.col("page_type"))

    def by_name(chain: Column, c: Column) -> Column:
        for name, words in NAMES.items():
            chain = chain.when(c.rlike(_any(words)), name)
        return chain.when(c.rlike(front), "front_matter")

    types = F.create_map(*[F.lit(x) for pair in TABLE_TYPES.items() for x in pair])
    table = by_name(F.when(F.element_at(types, _low(F.col("table_type"))).isNotNull(), F.element_at(types, _low(F.col("table_type")))), text)
    heads = heading_like(first, numbered)
    running = by_name(F.when(flat.rlike(BULLETIN_MARK), "revision_record").when(flat.rlike(BULLETIN_BRANCH), None), flat)
    running = running.when((first.rlike(ANNEX) | (page == "appendix")) & heads, "appendix").when(page.isin("toc", "signature"), F.when(heads, "front_matter")).when(heads, "body_section")
    found = (
        F.when(role.isin(*ARTIFACTS), None).when(F.coalesce("section_heading", F.lit(False)) & role.isin(*ANCHORS), role).when(role.isin(*LISTS), role).when(text == "", None)
        .when(kind == "table", table).when((role == "title") & (kind == "title"), None).otherwise(running)
    )
    return i.withColumns({"role": role, "manual_role": found})


def anatomy(items: DataFrame) -> DataFrame:
    """Per document the number of items of front matter, sections, tables and appendices, noise; and the titles of its chapters in order.
    Items: as of ``manual_role``."""
    m = F.col("manual_role")
    front = F.col("role").isin("front_matter", *LISTS) | F.coalesce(m.isin("front_matter", "lep_entry", "revision_record", "distribution_list"), F.lit(False))
    chapter = F.when(m.isin("body_section", "appendix"), F.struct("position", F.coalesce(F.get(heading_lines(F.col("text")), F.lit(0)), F.lit("")).alias("title")))
    return items.groupBy("doc_id").agg(
        F.count_if(front).alias("front_matter_items"), F.count_if(m == "body_section").alias("body_sections"), F.count_if(F.coalesce(m == "appendix", F.lit(False)) | (_low(F.col("kind")) == "table")).alias("tables_and_appendices"),
        F.count_if(F.col("role").isin(*ARTIFACTS)).alias("suspected_noise"), F.array_sort(F.collect_list(chapter))["title"].alias("chapters"),
    )


def structure_quality(items: DataFrame, numbered: str = NUMBERED) -> DataFrame:
    """Per document five rates and their mean: directory lines recognised, headings that open chapters, items that are no noise, headings
    with a body, headings and tables that can be located.  Items: as of ``manual_role``; placeholders for empty pages do not count.

    A heading has a body if lines of its own follow it in the same item, or if an item with content comes before the next heading."""
    rows = items.withColumn("audit", audit_placeholder(F.col("semantic_role"), F.col("index_policy"), F.col("missing_reason")))
    m, role, table = F.col("manual_role"), F.col("role"), _low(F.col("kind")) == "table"
    opens = F.coalesce(m.isin("body_section", "appendix"), F.lit(False))
    located = (F.trim(F.coalesce("page_label", F.lit(""))) != "") | F.coalesce(F.col("page_number") > 0, F.lit(False))
    lines = heading_lines(F.col("text"))
    told = F.coalesce("section_heading", F.lit(False)) & role.isin(*ANCHORS)
    body = F.exists(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~heading_like(x, numbered) & ~x.rlike(BULLETIN_MARK) & ~x.rlike(BULLETIN_BRANCH) & (F.char_length(x) >= 12) & (F.size(F.split(x, " ")) >= 2))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    inline = (F.size(lines) >= 2) & heading_like(first, numbered) & (told | first.rlike(r"[.!?:)]$")) & body
    binds = ~role.isin(*ARTIFACTS, "front_matter", *LISTS) & ~F.coalesce(m.isin("front_matter", *LISTS), F.lit(False)) & ((F.trim(F.coalesce("text", F.lit(""))) != "") | table)
    q = rows.where(~F.col("audit")).withColumns({"opens": opens, "inline": opens & inline, "follows": ~opens & binds, "is_table": table, "located": located})
    w = Window.partitionBy("doc_id").orderBy("position")
    # The first item after a heading that can be its body, if no other heading comes before it.
    section = q.withColumn("section", F.sum(F.col("opens").cast("int")).over(w))
    one = section.groupBy("doc_id", "section").agg(
        F.bool_or("opens").alias("headed"), F.bool_or("inline").alias("inline"), F.bool_or(F.col("opens") & F.col("located")).alias("head_located"),
        F.min(F.when(F.col("follows"), F.struct("position", "is_table", "located"))).alias("body"),
        F.count("*").alias("items"), F.count_if(m.isin(*ANCHORS)).alias("headings"), F.count_if(role.isin(*ARTIFACTS)).alias("noise"),
        F.count_if(role.isin("toc_entry", "lep_entry")).alias("toc"), F.count_if(role.isin("toc_entry", "lep_entry") | (_low(F.col("page_type")) == "toc")).alias("toc_candidates"),
    )
    by_table = F.col("headed") & ~F.col("inline") & F.coalesce(F.col("body.is_table"), F.lit(False))
    d = one.groupBy("doc_id").agg(
        F.sum("items").alias("items"), F.sum("headings").alias("heading_items"), F.count_if("headed").alias("body_like_headings"), F.sum("noise").alias("noise_items"), F.sum("toc").alias("toc_items"), F.sum("toc_candidates").alias("toc_candidates"),
        F.count_if(F.col("headed") & (F.col("inline") | F.col("body").isNotNull())).alias("bound"), (F.count_if("headed") + F.count_if(by_table)).alias("relevant"),
        (F.count_if(F.col("headed") & F.col("head_located")) + F.count_if(by_table & F.col("body.located"))).alias("evident"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rates = {
        "directory_recognition_rate": share("toc_items", "toc_candidates"), "chapter_coverage_rate": share("body_like_headings", "heading_items"), "noise_ratio": share("noise_items", "items"),
        "heading_body_binding_rate": share("bound", "body_like_headings"), "evidence_binding_strength": share("evident", "relevant"),
    }
    score = sum((1.0 - r if k == "noise_ratio" else r for k, r in rates.items()), F.lit(0.0)) / 5.0
    return d.select("doc_id", *[round_half_up(r).alias(k) for k, r in rates.items()], round_half_up(score).alias("score"), "items", "heading_items", "body_like_headings", "noise_items", "toc_items")


# Headers of a page that is there for signatures.
SIGNATURE_HEADERS = ("signature page", "signed by:", "approved by:", "审批人：", "审批人:", "签字栏", "signature block", "authorized signature")


def page_type_with_confidence(page_number: Column, roles: Column, text: Column, has_title: Column, body: Column) -> Column:
    """struct(page_type, confidence): by the share of blocks with a special role (.4, high from .7), by signature headers, by the word
    appendix, a first page with a title and no body, else body.  ``roles`` is an array with a role for each block."""
    n = F.greatest(F.size(roles), F.lit(1))
    low = F.lower(F.coalesce(text, F.lit("")))

    def share(*names: str) -> Column:
        return F.size(F.filter(roles, lambda r: r.isin(*names))) / n

    def made(name: str, confidence: Column | str) -> Column:
        return F.struct(F.lit(name).alias("page_type"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"))

    toc, front = share("toc_entry", "lep_entry"), share("front_matter", "revision_record", "distribution_list")
    sure = lambda s: F.when(s >= 0.7, "high").otherwise("medium")
    signed = F.greatest(*[F.contains(low, F.lit(t)) for t in SIGNATURE_HEADERS])
    return (
        F.when(toc >= 0.4, made("toc", sure(toc))).when(front >= 0.4, made("front_matter", sure(front))).when(signed, made("signature", "high")).when(low.rlike("appendix|annex|附录"), made("appendix", "medium"))
        .when((page_number == 1) & has_title & (F.trim(F.coalesce(body, F.lit(""))) == ""), made("cover", "high")).otherwise(made("body", "high"))
    )


def layout_signals(blocks: DataFrame, timings: list[str]) -> DataFrame:
    """Per document: pages with a layout, of several columns, stripped, tried, used and failed by OCR, with their blocks; and for each
    timing or counter its greatest value on a page (not above 0 counts as none) summed over pages.

    Blocks: doc_id, page_number, layout_source, page_width, page_height, columns, stripped, ocr_attempted, ocr_fallback, ocr_error, and the timings."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    flags = {
        "layout": some("layout_source") | F.col("page_width").isNotNull() | F.col("page_height").isNotNull(), "multi_column": F.coalesce("columns", F.lit(1)) > 1,
        "stripped": yes("stripped"), "attempted": yes("ocr_attempted"), "fallback": yes("ocr_fallback"), "failed": some("ocr_error"),
    }
    page = blocks.groupBy("doc_id", "page_number").agg(
        *[F.bool_or(c).alias(k) for k, c in flags.items()], *[F.count_if(flags[k]).alias(f"{k}_n") for k in ("stripped", "attempted", "fallback", "failed")],
        *[F.max(F.when(F.col(t) > 0, F.col(t).cast("double"))).alias(t) for t in timings],
    )
    return page.groupBy("doc_id").agg(
        *[F.count_if(k).alias(f"{k}_pages") for k in flags], *[F.sum(f"{k}_n").alias(f"{k}_blocks") for k in ("stripped", "attempted", "fallback", "failed")],
        *[F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in timings], *[F.coalesce(F.max(t), F.lit(0.0)).alias(f"most_{t}") for t in timings],
    )


def report_delta(baseline: DataFrame, candidate: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Candidate less baseline for each measure of two reports on the same documents."""
    b = baseline.select(*key, *[F.col(m).alias(f"{m}_0") for m in measures])
    return candidate.join(b, key).select(*key, *[(F.col(m) - F.col(f"{m}_0")).alias(m) for m in measures])
