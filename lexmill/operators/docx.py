"""Paragraphs of word-processor manuals: page labels, numbered headings, noise, and roles that depend on what came before.

The running state (body begun, inside a table of contents, inside a list of effective pages) only ever changes at rows that can be told
without it, so it is worked out by windows over a document's rows and no row is folded one by one.  Rows are ordered by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import roles
from lexmill.functions.text import inline_space

# Page references, words that name front matter, noise, and headings' marks.
ROMAN = "[IVXLCDMⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]{1,10}"
PAGE = rf"(?:[A-Z]?\d+(?:[-./]\d+)+|{ROMAN}(?:\s*至\s*{ROMAN})?|[{roles.NUMERALS}]+/\d+)"
FRONT = {
    "toc": r"^\s*(?:目录|目次|contents?|table of contents)\s*$", "lep": "有效页清单|list of effective pages", "revision": r"修订记录|修订页|版次表|版次/修订|record of revisions|revision(?:\s+record|\s+history)?",
    "distribution": "分发清单|放行人员清单|外委单位清单|distribution list|authorized release|vendor list", "signature": "签字|签署|批准|审批|signature|approval",
}
NOISE = {
    "parse_artifact": r"^\s*tmp[\\/_ .-].*", "version_cell": r"^\s*(?:R\d+(?:TR?\d+)?|Rev(?:ision)?\s*[A-Z0-9.-]+|版次(?:/修订)?|修订(?:记录)?|版本(?:号)?|版号)\s*$",
    "page_ref_cell": rf"^\s*(?:页码\s*[:：]\s*)?{PAGE}\s*$", "header_footer": r"^\s*(?:(?:页码\s*[:：]\s*)?(?:第\s*\d+\s*页|Page\s+\d+|[A-Z]{2,}\s+\d+(?:\.\d+)*)|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\s*$",
}
MARKS = {
    "appendix": rf"(?iU)^\s*((?:附录|附件|Appendix|Annex)\s*[A-Z0-9{roles.STEP_NUMERALS}]*)\s*(.*)$", "chapter": rf"(?U)^\s*(第[\d{roles.NUMERALS}]+[章节条款])\s*(.+?)\s*$", "number": r"(?U)^\s*(\d+(?:\.\d+)+|\d+)[.、)]?\s*(.+?)\s*$",
}
KEPT_EARLY = ("toc_entry", "lep_entry", "note", "warning", "caution")


def _is(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iU)(?:{pattern})")


def _label_of(s: Column) -> Column:
    whole, end = F.regexp_extract(s, rf"(?iU)^\s*(?:页码\s*[:：]\s*)?({PAGE})\s*$", 1), F.regexp_extract(s, rf"(?iU)({PAGE})\s*$", 1)
    return roles._let(whole, lambda w: F.when(w != "", w).otherwise(roles._let(end, lambda e: F.when((e != "") & (e != s), e))))


def _flat(c: Column) -> Column:
    return inline_space(F.coalesce(c, F.lit("")))


def page_label(c: Column) -> Column:
    """The page that a text refers to: the whole of it, or its end if something stands before; else null."""
    return roles._let(_flat(c), _label_of)


def numbered_heading(c: Column) -> Column:
    """struct(content, role, label, level): an appendix, chapter or number before a title, without the page it refers to; null if it is none.
    Each of its texts is worked out once: patterns are matched far more slowly than anything else here."""

    def cut(s: Column, label: Column) -> Column:
        at = F.char_length(F.regexp_extract(s, rf"(?iU)({PAGE}\s*)$", 1))
        return F.when(label.isNull(), s).otherwise(roles._let(at, lambda n: F.when((n > 0) & (n < F.char_length(s)), F.rtrim(F.substring(s, F.lit(1), F.char_length(s) - n))).otherwise(s)))

    def of(text: Column, label: Column) -> Column:
        def made(kind: str, role: str, level: Column) -> Column:
            number, title = (inline_space(F.regexp_extract(text, MARKS[kind], i)) for i in (1, 2))
            content = roles._let(title, lambda t: F.trim(F.concat_ws(" ", number, F.when(t != "", t))))
            return F.struct(content.alias("content"), F.lit(role).alias("role"), label.alias("label"), level.cast("int").alias("level"))

        depth = F.size(F.split(F.regexp_extract(text, MARKS["number"], 1), r"\."))
        is_ = lambda kind: text.rlike(MARKS[kind])
        return F.when(is_("appendix"), made("appendix", "appendix", F.lit(1))).when(is_("chapter"), made("chapter", "body_section", F.lit(1))).when(is_("number"), made("number", "body_section", depth))

    def found(s: Column) -> Column:
        heading = roles._let(_label_of(s), lambda label: roles._let(cut(s, label), lambda text: of(text, label)))
        return F.when((s != "") & ~_is(s, NOISE["page_ref_cell"]), heading)

    return roles._let(_flat(c), found)


def noise(c: Column) -> Column:
    """The role of a line that is no content: artifacts, version cells, page references, running heads and dates; else null."""

    def of(s: Column) -> Column:
        out = F.when(s == "", None)
        for name, pattern in NOISE.items():
            out = out.when(_is(s, pattern), name)
        return out

    return roles._let(_flat(c), of)


def classify(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with type, semantic_role, content, page_type, label and level.  Input: doc_id, position, text, style, outline_level; null or
    empty texts are empty body paragraphs and change nothing."""
    s = F.trim(F.coalesce("text", F.lit("")))
    styled = _is(F.coalesce("style", F.lit("")), "heading|标题")
    front = F.when(s == "", None)
    for name, pattern in FRONT.items():
        if name != "signature":
            front = front.when(_is(s, pattern), name)
    p = paragraphs.select("*", s.alias("s"), styled.alias("styled"), front.alias("front"), _is(s, FRONT["signature"]).alias("signs"), numbered_heading(s).alias("h"), noise(s).alias("noise"), roles.semantic_role(s).alias("own"), page_label(s).alias("page"))
    before = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("s") != ""
    # Until the body begins, only titles of front matter and signatures change the list that a row stands in.
    early = F.when(filled, F.when(F.col("front").isNotNull(), F.col("front")).when(F.col("signs"), "signature"))
    p = p.withColumn("early", F.last(early, ignorenulls=True).over(before))

    def listed(state: str) -> Column:
        return F.when((F.col("own") == "paragraph") & (F.coalesce(state, F.lit("")) == "toc") & F.col("page").isNotNull(), "toc_entry").when((F.col("own") == "paragraph") & (F.coalesce(state, F.lit("")) == "lep"), "lep_entry").otherwise(F.col("own"))

    free = filled & F.col("front").isNull()
    sure = F.col("h").isNotNull() & (F.col("styled") | (F.col("h.role") == "appendix") | F.col("h.label").isNull())
    by_style = F.col("h").isNull() & F.col("noise").isNull() & F.col("styled")
    opens = free & ~F.col("signs") & (sure | (by_style & (listed("early") == "paragraph")))
    p = p.withColumn("started", F.coalesce(F.max(opens.cast("int")).over(before), F.lit(0)) == 1)
    signed = free & ~F.col("started") & F.col("signs")
    headed = free & ~signed & F.col("h").isNotNull() & (F.col("started") | sure)
    state = F.when(filled, F.when(F.col("front").isNotNull(), F.col("front")).when(signed | headed, "none"))
    p = p.withColumns({"signed": signed, "headed": headed}).withColumn("state", F.last(state, ignorenulls=True).over(before))
    p = p.withColumn("role", listed("state"))
    named = by_style & (F.col("role") == "paragraph")
    flat = inline_space(F.col("s"))
    begun = F.col("started")
    plain = F.when(begun | F.col("role").isin(*KEPT_EARLY), F.col("role")).otherwise("paragraph")
    plain_page = F.when(F.col("role") == "toc_entry", "toc").when((F.col("role") == "lep_entry") | ~begun, "front_matter").when(F.col("s").rlike(MARKS["appendix"]), "appendix").otherwise("body")

    def row(kind: str, role: Column, content: Column, page_type: Column, label: Column | None = None, level: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(kind).alias("type"), role.alias("semantic_role"), content.alias("content"), page_type.alias("page_type"), (none.cast("string") if label is None else label).alias("label"), (none.cast("int") if level is None else level.cast("int")).alias("level"))

    out = (
        F.when(~filled, row("paragraph", F.lit("paragraph"), F.lit(""), F.lit("body")))
        .when(F.col("front").isNotNull(), row("title", F.lit("front_matter"), F.when(F.col("front") == "toc", F.col("s")).otherwise(flat), F.lit("front_matter")))
        .when(F.col("signed"), row("title", F.lit("front_matter"), flat, F.lit("signature")))
        .when(F.col("headed"), row("title", F.col("h.role"), F.col("h.content"), F.when(F.col("h.role") == "appendix", "appendix").otherwise("body"), F.col("h.label"), F.coalesce("outline_level", "h.level")))
        .when(F.col("h").isNotNull(), row("paragraph", F.lit("toc_entry"), F.col("h.content"), F.lit("toc"), F.col("h.label")))
        .when(F.col("noise").isNotNull(), row("paragraph", F.col("noise"), flat, F.when(begun, "body").otherwise("front_matter"), F.col("page")))
        .when(named, row("title", F.lit("body_section"), flat, F.lit("body"), F.col("page"), F.col("outline_level")))
        .otherwise(row("paragraph", plain, F.col("s"), plain_page, F.col("page")))
    )
    return p.select(*paragraphs.columns, out.alias("c")).select(*paragraphs.columns, "c.*")
