"""Semantic roles, headings and page types of lines.

The rules are data: labels, list marks and heading forms with their words, number alphabets and levels.  Expressions are made
from the data; a line's heading is worked out once, and only where its first character can open one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role names and the search weight of each.
ROLE_WEIGHTS = {
    "title": 1.35, "body_section": 1.3, "warning": 1.25, "caution": 1.15, "note": 1.1, "table": 1.05, "paragraph": 1.0,
    "appendix": 0.95, "highlights_entry": 0.95, "front_matter": 0.8, "revision_record": 0.75, "distribution_list": 0.75,
    "toc_entry": 0.7, "lep_entry": 0.55, "header_footer": 0.3, "parse_artifact": 0.2, "version_cell": 0.2, "page_ref_cell": 0.2,
}
NOT_INDEXED = ("header_footer", "parse_artifact", "version_cell", "page_ref_cell")
HIGH_PRECISION = ("title", "body_section", "warning", "caution", "note", "table")

# Numerals, and the words that label a line, before a colon of either width.
NUMERALS = "一二三四五六七八九十百千"
STEP_NUMERALS = "一二三四五六七八九十"
LABELS = {"note": ["note", "注意"], "warning": ["warning", "警告"], "caution": ["caution", "小心"], "definition": ["definition", "定义"], "procedure": ["procedure", "程序", "流程"]}
COLONS = "[:：]"
# A definition's verbs, how long its term may be, and what a term cannot hold.
DEFINES, TERM_LENGTH, TERM_STOPS, QUOTES = ["means", r"refers\s+to"], 48, "。；;:：", "“”\"'"
BULLETS = "-•·▪◦"
# Words that end a table-of-contents entry, and what a page of changes opens its entries with.
STATUSES = [r"not\s+applicable", "n/a", "tbd"]
CHANGES = ["changed", "added", "updated", "corrected", "revised", "removed", "this page is identified", "the pages of this repair are identified"]
SIGNED, ANNEXED = ["signature", "signed by", "approved by", "签字", "签名", "审批"], ["appendix", "annex", "附录"]
CONTENTS = ["目录", "目次", "contents?", r"table\s+of\s+contents"]


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


DECIMAL = r"\d+(?:\.\d+)*"
CHINESE_NUMBER = rf"(?:\d+(?:[.\-]\d+)*|[{NUMERALS}]+)"
#: Dot leaders, then a page number, a lettered or Roman page, or a status.
TOC_TERMINATOR = r"(?iU)(?:\.\s*){2,}\s*" + any_of([r"\d+", r"[A-Z]-?\d+(?:[-./][A-Z0-9]+)*", "[IVXLCDM]{1,7}", *STATUSES]) + r"\b"
LIST_MARK = rf"(?U)^(?:[{BULLETS}]\s+|[（(](?:\d+|[{STEP_NUMERALS}]+)[）)]|\d+[）)])"
STEP = rf"(?iU)^(?:step\s+\d+|步骤\s*[{STEP_NUMERALS}\d]+|第\s*[{STEP_NUMERALS}\d]+\s*步)\b"
DEFINITION = rf"(?iU)^[{QUOTES}&&[^”]]?[^{TERM_STOPS}]{{1,{TERM_LENGTH}}}[{QUOTES}&&[^“]]?\s+{any_of(DEFINES)}\b"
CODE = r"(?iU)^(?:(?:[A-Z0-9]+\.)+[A-Z0-9]+|\d+(?:\.\d+){1,5})[.、)]?\s+\S"
EFFECTIVE_PAGE = r"(?iU)list of effective pages|\bpage\s+[A-Z0-9.\-/]+"
HIGHLIGHTS_HEAD = r"(?i)chapter/section/page\s+description of change"

#: Heading forms in the order in which they are tried: each takes (mark, number, title) of a first line.
FORMS = {
    "chinese": rf"^第\s*({CHINESE_NUMBER})\s*([章节条款])(?:\s+|$)(.*)$",
    "annex": r"(?i)^(附录|附件|appendix|annex)\s*" + rf"([A-Z0-9{STEP_NUMERALS}]*)\s*[-:：.]?\s*(.*)$",
    "english": r"(?i)^(chapter|section)\s+([A-Z0-9.-]+)\s*[-:：.]?\s*(.*)$",
    "enumerated": rf"^([{NUMERALS}]+)()[、.]\s*(.+)$",
    "numbered": rf"^({DECIMAL})([.)、]|\s)\s*(.+)$",
}
# The role and level of each unit of a Chinese document, the longest first line, and what no title holds.
UNITS = {"章": ("body_section", 1), "节": ("body_section", 2), "条": ("clause", 2), "款": ("clause", 3)}
LONGEST, SENTENCE = 120, "[。；;]"
HEADS = rf"^(?:[0-9第附aAcCsS{NUMERALS}]|[^\x00-\x7f])"


def _let(value: Column, then: object) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def role_weight(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(role))), F.lit(1.0))


def _title_like(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9'/-]*"), F.lit(0))
    n = F.size(words)
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    upper, letters = F.regexp_count(c, F.lit(r"\p{Lu}")), F.regexp_count(c, F.lit(r"\p{L}"))
    return (n > 0) & ~c.rlike(r"[.?!;]\s*$") & ((upper >= 0.7 * F.greatest(letters, F.lit(1))) | (capital >= 0.7 * n) | (n <= 3))


def first_line(c: Column) -> Column:
    """The first line, in compatibility form, white space folded."""
    line = F.trim(F.get(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), F.lit(0)))
    nfkc = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), line, F.lit(True))
    plain = F.octet_length(line) == F.char_length(line)
    return F.trim(F.regexp_replace(F.when(plain, line).otherwise(nfkc), "[ \\t\u3000]+", " "))


_NONE = "cast(null as struct<role:string,section_no:string,title:string,level:int>)"


def _heading_of(s: Column) -> Column:
    """The heading of a first line, or null."""
    part = lambda form, i: F.trim(F.regexp_extract(s, FORMS[form], i))
    is_ = lambda form: s.rlike(FORMS[form])

    def made(role: Column, number: Column, title: Column, level: Column) -> Column:
        return F.struct(role.alias("role"), number.alias("section_no"), F.trim(title).alias("title"), level.cast("int").alias("level"))

    def chosen(table: dict[str, object], key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    unit = part("chinese", 2)
    count = F.concat(F.lit("第"), F.regexp_extract(s, rf"^第(\s*{CHINESE_NUMBER}\s*)[章节条款]", 1), unit)
    annex = F.trim(F.concat_ws(" ", part("annex", 1), part("annex", 2)))
    english = F.upper(F.concat_ws(" ", part("english", 1), part("english", 2)))
    number, closed, rest = part("numbered", 1), F.regexp_extract(s, FORMS["numbered"], 2), part("numbered", 3)
    chinese, deep = rest.rlike(r"[\x{3400}-\x{9fff}]"), F.contains(number, F.lit("."))
    code = (closed == ".") & rest.rlike(r"(?i)^[A-Z0-9]+\.\d+\s+\S")
    bare = ~deep & (F.trim(closed) == "") & (~chinese | rest.startswith("年") | (F.char_length(rest) > 40))
    numbered = is_("numbered") & (rest != "") & ~rest.rlike(SENTENCE) & ~code & ~bare & (deep | chinese | _title_like(rest))
    none = F.expr(_NONE)
    return (
        F.when((s == "") | (F.char_length(s) > LONGEST) | s.rlike(TOC_TERMINATOR), none)
        .when(is_("chinese"), made(chosen({k: r for k, (r, _) in UNITS.items()}, unit), count, F.concat_ws(" ", count, part("chinese", 3)), chosen({k: n for k, (_, n) in UNITS.items()}, unit)))
        .when(is_("annex"), made(F.lit("appendix"), annex, F.concat_ws(" ", annex, part("annex", 3)), F.lit(1)))
        .when(is_("english"), made(F.lit("body_section"), english, F.concat_ws(" ", english, part("english", 3)), F.when(english.startswith("CHAPTER"), 1).otherwise(2)))
        .when(is_("enumerated") & ~part("enumerated", 3).rlike(SENTENCE), made(F.lit("body_section"), part("enumerated", 1), F.concat_ws("、", part("enumerated", 1), part("enumerated", 3)), F.lit(1)))
        .when(numbered, made(F.when(deep, "clause").otherwise("body_section"), number, F.concat_ws(" ", number, rest), F.size(F.split(number, r"\."))))
        .otherwise(none)
    )


def heading(c: Column) -> Column:
    """struct(role, section_no, title, level) of the heading that a text's first line is; null if it is none."""
    s = F.trim(c)
    return F.when(s.rlike(HEADS), _let(first_line(s), _heading_of))


def semantic_role(c: Column, highlights: Column | None = None) -> Column:
    """The first rule that holds: labels, definitions, steps, list marks, headings, codes, contents, effective pages; entries of a page
    of changes if ``highlights`` says it is one; else a paragraph."""
    s = F.trim(c)
    role = F.when(s == "", "paragraph")
    for name, words in LABELS.items():
        holds = s.rlike(rf"(?iU)^{any_of(words)}\s*{COLONS}")
        role = role.when(holds | (s.rlike("(?i)means|refers") & s.rlike(DEFINITION)) if name == "definition" else holds, name)
    role = role.when(s.rlike(STEP), "procedure_step").when(s.rlike(LIST_MARK), "list_item")
    page = F.lit(False) if highlights is None else highlights
    entry = page & ~s.rlike(HIGHLIGHTS_HEAD) & (s.rlike(rf"(?i)^{any_of(CHANGES)}\b") | s.rlike(r"(?i)\bpages?\s+\d"))

    def rest(h: Column) -> Column:
        return (
            F.when(h.isNotNull(), h["role"]).when(s.rlike(CODE), "clause").when(F.contains(s, F.lit(".")) & s.rlike(TOC_TERMINATOR), "toc_entry")
            .when(s.rlike(EFFECTIVE_PAGE), "lep_entry").when(entry, "highlights_entry").otherwise("paragraph")
        )

    return role.otherwise(_let(heading(s), rest))


def page_type(page_number: Column, roles: Column, text: Column, has_title: Column) -> Column:
    low = F.lower(text)
    contents = rf"(?iU)\A\s*{any_of(CONTENTS)}(?:\s+|\z)|(?m)^\s*{any_of(CONTENTS)}\s*$"
    return (
        F.when(F.arrays_overlap(roles, F.array(F.lit("toc_entry"), F.lit("lep_entry"))) | text.rlike(contents), "toc")
        .when(low.rlike("|".join(SIGNED)), "signature")
        .when(low.rlike("|".join(ANNEXED)), "appendix")
        .when((page_number == 1) & has_title & (F.trim(text) == ""), "cover")
        .otherwise("body")
    )


def indexable(role: Column, text: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & ~F.coalesce(role, F.lit("")).isin(*NOT_INDEXED)


def high_precision(role: Column, text: Column) -> Column:
    return role.isin(*HIGH_PRECISION) | (F.char_length(text) >= 120)


def task_like(role: Column, tags: Column, text: Column) -> Column:
    by_text = F.trim(text).rlike(r"(?i)^(?:\d+(?:\.\d+)*[.)]|\([a-z]\)|step\s+\d+|task\s+\d+)")
    toc = F.exists(tags, lambda t: F.lower(F.trim(t)).startswith("page:toc"))
    return F.lower(F.trim(role)).isin("warning", "caution", "note") | (~toc & by_text)
