"""Sequence operators on ordered lines and blocks: stripping, splitting, merging, stacks and islands.

Pure window rules are windows per document; rules that look at already merged
text are folds (``aggregate``) over a document's ordered array of blocks, so a
task never holds more than one document's blocks at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import roles, scratch, text

HEAD, TAIL, LEAST_LENGTH, SHARE = 3, 3, 4, 0.5


def strip_repeated(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, line) without the lines that are among the first or last
    three non-blank lines on at least max(2, half) of a document's non-empty pages; a document
    needs three non-empty pages.  Every equal line of a page goes."""
    s = F.trim("line")
    some = lines.where(s != "").select("doc_id", "page_number", "line_no", s.alias("s"))
    pages = some.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages")).where("pages >= 3")
    up, down = Window.partitionBy("doc_id", "page_number").orderBy("line_no"), Window.partitionBy("doc_id", "page_number").orderBy(F.desc("line_no"))
    ranked = some.withColumn("first", F.row_number().over(up)).withColumn("last", F.row_number().over(down)).where(F.char_length("s") >= LEAST_LENGTH)
    head = ranked.where(F.col("first") <= HEAD).select("doc_id", "page_number", "s", F.lit("h").alias("side"))
    tail = ranked.where(F.col("last") <= TAIL).select("doc_id", "page_number", "s", F.lit("t").alias("side"))
    counted = head.unionByName(tail).distinct().groupBy("doc_id", "s", "side").agg(F.count("*").alias("n")).join(pages, "doc_id")
    furniture = counted.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * SHARE))).select("doc_id", "s").distinct()
    return lines.withColumn("s", s).join(furniture, ["doc_id", "s"], "left_anti").drop("s")


def merge_short(blocks: DataFrame, least: int = 10) -> DataFrame:
    """Blocks below ``least`` characters that are no headings join the block before them (a first one stays)."""
    w = Window.partitionBy("doc_id").orderBy("position")
    kept = blocks.where(F.trim("content") != "")
    starts = (F.char_length(F.trim("content")) >= least) | text.heading_like(F.col("content")) | (F.row_number().over(w) == 1)
    island = kept.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("position", "content")))
    return island.groupBy("doc_id", "island").agg(F.min("position").alias("position"), F.count("*").alias("merged"), F.array_join(parts["content"], "\n").alias("content")).drop("island")


def split_toc(c: Column, least: int = 3) -> Column:
    """A paragraph with ``least`` or more dot-leader entries, cut after each; what is left stays with the last, on a line of its own."""
    whole = lambda p: p.rlike(roles.TOC_TERMINATOR + "$")
    cut = F.filter(F.transform(F.split(F.regexp_replace(c, f"({roles.TOC_TERMINATOR})", "$1\u0000"), "\u0000"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda p: p != "")

    def glued(parts: Column) -> Column:
        n = F.size(parts)
        last = F.concat_ws("\n", F.get(parts, n - 2), F.get(parts, n - 1))
        return F.when((n < 2) | whole(F.get(parts, n - 1)), parts).otherwise(F.concat(F.slice(parts, F.lit(1), n - 2), F.array(last)))

    return F.when(F.regexp_count(c, F.lit(roles.TOC_TERMINATOR)) >= least, roles._let(cut, glued)).otherwise(F.array(c))


#: What opens a structural item, by kind: a marker, then what has to follow it.
ITEM_KINDS = {
    "chinese part": (rf"第\s*(?:\d+(?:[.．-]\d+)*|[{roles.NUMERALS}]+)\s*[章节条款]", r"(?:\s+|$)"),
    "chinese numeral": (f"[{roles.NUMERALS}]+、", r"\s*\S"),
    "decimal": (r"\d+(?:[.．]\d+)+[.．、)]?", r"\s+\S"),
    "number and point": (r"\d+[.．、]", r"\s*\S"),
    "number before chinese": (r"\d+", r"\s+[\x{3400}-\x{9fff}]"),
    "letter in brackets": (r"\([a-zA-Z]\)", r"\s"),
    "number in brackets": (r"\(\d+\)", r"\s"),
    "number and bracket": (r"\d+[）)]", ""),
    "label": (roles.any_of([w for name in ("note", "warning", "caution") for word in roles.LABELS[name] for w in dict.fromkeys((word.upper(), word.capitalize()))]), rf"\s*{roles.COLONS}"),
}
STRUCTURAL_ITEM = r"(?U)^\s*" + roles.any_of([mark + after for mark, after in ITEM_KINDS.values()])


def split_structural(c: Column, least_lines: int = 10, least_items: int = 2) -> Column:
    """A paragraph of many lines with several item openings, cut before each of them."""
    parts = F.split(c, "\n")
    opens = F.size(F.filter(parts, lambda p: p.rlike(STRUCTURAL_ITEM)))
    joined = F.aggregate(parts, F.lit(""), lambda a, p: F.when(a == "", p).when(p.rlike(STRUCTURAL_ITEM), F.concat(a, F.lit("\u0000"), p)).otherwise(F.concat(a, F.lit("\n"), p)))
    return F.when((F.size(parts) >= least_lines) & (opens >= least_items), F.split(joined, "\u0000")).otherwise(F.array(c))


def split_inline(c: Column, least_length: int = 120, least_items: int = 2) -> Column:
    """A long paragraph with inline markers such as (5) or (a), cut before each that follows a blank."""
    marker = r"\s(\((?:\d+|[A-Za-z])\))"
    parts = F.transform(F.split(F.regexp_replace(c, marker, "\u0000$1"), "\u0000"), lambda x: F.trim(x))
    return F.when((F.char_length(c) >= least_length) & (F.regexp_count(c, F.lit(marker)) >= least_items), parts).otherwise(F.array(c))


# What ends a sentence, what may close after it, and what opens a paragraph of its own on the next page.
SENTENCE_ENDS, CLOSERS = "。！？.!?", "\"'”’）)\\]\\s"
TERMINAL = f"[{SENTENCE_ENDS}][{CLOSERS}]*$"
OPENERS = [rf"第\s*[\d{roles.NUMERALS}]+\s*[章节条款]", r"\d+(?:\.\d+)*[.)、]?\s+\S", r"[A-Z]\.\s+\S", r"\([0-9A-Z]\)\s+\S", r"[•·\-–—]\s+\S", "(?:note|warning|caution)[:：]"]
REJECT = r"(?iU)^\s*" + roles.any_of(OPENERS)


def merge_across_pages(blocks: DataFrame) -> DataFrame:
    """Paragraphs that a page break cut are put together again: a fold over a document's blocks,
    because each decision looks at the text merged so far.

    Input: doc_id, position, page_number, semantic_role, content.  Output: doc_id, position,
    page_start, page_end, merged, content."""
    block = F.struct("position", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.lit(1).alias("merged"), "semantic_role", "content")
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    kind = "array<struct<position:int,page_start:int,page_end:int,merged:int,semantic_role:string,content:string>>"

    def joins(a: Column, b: Column) -> Column:
        left, right = F.trim(a["content"]), F.trim(b["content"])
        ends = F.substring(left, -1, 1).isin(",", "，", "、", ";", "；", ":", "：", "-", "‑", "–", "—", "/")
        cjk = left.rlike(f"[{text.CJK}]$") & right.rlike(f"^[{text.CJK}]")
        body = (a["semantic_role"] == "paragraph") & (b["semantic_role"] == "paragraph") & (b["page_start"] == a["page_end"] + 1)
        fits = (F.char_length(left) >= 12) & (F.char_length(right) >= 2) & ~left.rlike(TERMINAL) & ~right.rlike(REJECT) & roles.heading(right).isNull()
        return body & fits & (right.rlike(r"^\p{Ll}") | ends | cjk)

    def step(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(
            last["position"].alias("position"), last["page_start"].alias("page_start"), b["page_end"].alias("page_end"), (last["merged"] + 1).alias("merged"),
            last["semantic_role"].alias("semantic_role"), text.join_boundary(F.trim(last["content"]), F.trim(b["content"])).alias("content"),
        )
        return F.when((F.size(done) > 0) & joins(last, b), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(b)))

    folded = docs.select("doc_id", F.explode(F.aggregate(F.col("blocks").cast(kind), F.array().cast(kind), step)).alias("b"))
    return folded.select("doc_id", "b.position", "b.page_start", "b.page_end", "b.merged", "b.content")


def caption_pairs(blocks: DataFrame) -> DataFrame:
    """A figure label takes the paragraph after it as its caption; a consumed paragraph takes none.

    Labels and captions alternate within a run of labels, so the odd ones of a run are the openers."""
    w = Window.partitionBy("doc_id").orderBy("position")
    label = F.col("content").rlike(r"(?i)^\s*(?:figure|fig\.?|图)\s*\d+[\w.-]*\s*$")
    rows = blocks.withColumn("label", label.cast("int"))
    rows = rows.withColumn("breaks", (F.col("label") == 0).cast("int")).withColumn("run", F.sum("breaks").over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "run", "label").orderBy("position"))
    rows = rows.withColumn("opens", (F.col("label") == 1) & (place % 2 == 1)).withColumn("consumed", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    rows = rows.withColumn("next", F.lead("content").over(w))
    return rows.where(~F.col("consumed")).select("doc_id", "position", F.when(F.col("opens") & F.col("next").isNotNull(), F.concat_ws("\n", "content", "next")).otherwise(F.col("content")).alias("content"))


def section_paths(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """(doc_id, position, level, title) with ``path``: titles of the open sections, outermost first.

    The section stack pops while the top's level is not smaller; so the open title of level k is the
    last title of level k unless a heading of a smaller level came after it."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    out = headings
    for k in range(1, deepest + 1):
        out = out.withColumn(f"last_{k}", F.last(F.when(F.col("level") == k, F.struct("position", "title")), ignorenulls=True).over(w))
        out = out.withColumn(f"low_{k}", F.max(F.when(F.col("level") < k, F.col("position"))).over(w))
    open_titles = [F.when((F.col("level") >= k) & (F.col(f"low_{k}").isNull() | (F.col(f"last_{k}.position") > F.col(f"low_{k}"))), F.col(f"last_{k}.title")) for k in range(1, deepest + 1)]
    return out.select("doc_id", "position", "level", "title", F.array_join(F.filter(F.array(*open_titles), lambda t: t.isNotNull()), " > ").alias("path"))


def structure_signals(headings: DataFrame) -> DataFrame:
    """Signals on a document's headings: level jumps, duplicates among siblings, empty sections."""
    w = Window.partitionBy("doc_id").orderBy("position")
    h = headings.withColumn("before", F.lag("level").over(w)).withColumn("after", F.lead("position").over(w))
    h = h.withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "level", "title")))
    codes = F.filter(F.array(
        F.when(F.col("level") > F.coalesce("before", F.lit(0)) + 1, "heading_level_jump"),
        F.when(F.col("same") > 1, "duplicate_heading"),
        F.when(F.col("after") == F.col("position") + 1, "empty_section"),
    ), lambda c: c.isNotNull())
    return h.select("doc_id", "position", F.explode(codes).alias("code"))


def section_chunks(blocks: DataFrame) -> DataFrame:
    """Runs of blocks from one heading to the next as one chunk, with a deterministic id."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.col("semantic_role").isin("body_section", "appendix", "title", "clause").cast("int")
    runs = blocks.withColumn("section", F.sum(anchor).over(w))
    parts = F.array_sort(F.collect_list(F.struct("position", "block_id", "content")))
    out = runs.groupBy("doc_id", "section").agg(parts.alias("parts"), F.count("*").alias("blocks"))
    return out.select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.array_join("parts.block_id", ",")), 256).alias("chunk_id"), F.col("parts.block_id").alias("block_ids"), F.array_join("parts.content", "\n").alias("text"), "blocks")


# The header of a page's tool table, a note under it, the header and first words of a page of changes, and the words
# that make a long paragraph worth a closer look.
TOOL_HEADER = r"(?iU)^\s*Index\s+Name\s+P/N\s+or\s+Type\s+Manufacturer\s*$"
TOOL_NOTE = r"(?iU)^\s*NOTE\s*[:：]"
CHANGE_HEADER = r"(?iU)CHAPTER/Section/Page\s+Description of Change(?:\s+Check)?"
CHANGE_START = rf"(?iU)^\s*{roles.any_of(roles.CHANGES)}\b"
CHANGE_PAGE = r"(?iU)\bPages?\s+\d"
#: Bytes of the input's files for a task of a page's paragraphs: an input row may give many.
A_PART = 1 << 20
REFINE_WORDS = r"(?iU)\b(?:NOTE|WARNING|CAUTION|SB|Service\s+Bulletin|Step|Procedure)\b"


def _folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def merge_table_rows(blocks: DataFrame) -> DataFrame:
    """On pages with a tool table's header, and more than four paragraphs, what follows a row's begin joins it; rows, notes and what follows a
    note begin anew.  Other pages stay as they are.  Empty paragraphs of a page with a table go.

    A row begins with 24 characters or more, a capital on its own among the first 20, and two words in small letters.
    Input and output: doc_id, page_number, position, content."""
    key = ["doc_id", "page_number"]
    w = Window.partitionBy(*key).orderBy("position")
    page = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flat = _folded(F.col("content"))

    def marks(flat: Column) -> Column:
        header, note = flat.rlike(TOOL_HEADER), flat.rlike(TOOL_NOTE)
        row = (F.char_length(flat) >= 24) & ~header & ~note & F.substring(flat, 1, 20).rlike(r"\b[A-Z]\b") & (F.regexp_count(flat, F.lit(r"\b[a-z]{3,}\b")) >= 2)
        return F.struct(header.alias("header"), row.alias("row"))

    # Rows are dealt by document once and sorted once: all windows have one order.
    b = blocks.select(*key, "position", "content", roles._let(flat, marks).alias("m"), F.trim("content").rlike(TOOL_NOTE).alias("note")).select(*key, "position", "content", "note", "m.header", "m.row")
    b = b.repartition(scratch.parts(blocks, a_part=A_PART), "doc_id")
    b = b.withColumn("table", (F.count("*").over(page) > 4) & F.bool_or("header").over(page)).where(~F.col("table") | (F.trim("content") != ""))
    seen = F.coalesce(F.bool_or("header").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    starts = ~F.col("table") | ~seen | F.col("note") | F.col("row") | F.coalesce(F.lag("note").over(w), F.lit(True))
    b = b.withColumn("island", F.sum(starts.cast("int")).over(w))
    parts = F.sort_array(F.collect_list(F.struct("position", "content")))
    return b.groupBy(*key, "island").agg(F.min("position").alias("position"), F.array_join(parts["content"], "\n").alias("content")).drop("island")


def merge_changes(blocks: DataFrame) -> DataFrame:
    """On pages of changes (the word HIGHLIGHTS and the list's header; more than two paragraphs) a page reference takes the change that
    follows it, and a change the one after it, if that names no page, or if both add something and name one page each.

    A fold over a page's paragraphs, since each decision looks at the text merged so far.  Input and output: doc_id, page_number, position, content."""
    refs = lambda c: F.regexp_count(c, F.lit(CHANGE_PAGE))

    def told(flat: Column) -> Column:
        """What the rules ask of a folded text, once for each text."""
        return F.struct(
            flat.rlike(CHANGE_HEADER).alias("head"), flat.rlike(CHANGE_START).alias("change"), refs(flat).alias("refs"), (F.char_length(flat) <= 80).alias("short"), F.lower(flat).startswith("added ").alias("added"),
            F.contains(F.upper(flat), F.lit("HIGHLIGHTS")).alias("named"),
        )

    def with_told(position: Column, content: Column) -> Column:
        return F.struct(position.cast("int").alias("position"), content.alias("content"), roles._let(_folded(content), told).alias("t"))

    def joins(a: Column, c: Column) -> Column:
        anchor = ~a["change"] & (a["refs"] >= 1) & a["short"]
        added = a["added"] & c["added"] & (a["refs"] == 1) & (c["refs"] == 1)
        return ~a["head"] & ~c["head"] & c["change"] & (anchor | (a["change"] & (added | ((c["refs"] == 0) & (a["refs"] >= 1)))))

    def step(done: Column, x: Column) -> Column:
        def then(last: Column) -> Column:
            both = with_told(last["position"], F.concat_ws("\n", last["content"], x["content"]))
            return F.when(joins(last["t"], x["t"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.array_append(done, x))

        return F.when(F.size(done) > 0, roles._let(F.element_at(done, -1), then)).otherwise(F.array(x))

    # Texts are looked at where they are, before the one exchange by document.
    rows = blocks.select("doc_id", "page_number", with_told(F.col("position"), F.col("content")).alias("x")).repartition(scratch.parts(blocks, a_part=A_PART), "doc_id")
    page = rows.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list("x")).alias("b"))
    kind = page.schema["b"].dataType
    gate = (F.size("b") > 2) & F.exists("b", lambda x: x["t"]["named"]) & F.exists("b", lambda x: x["t"]["head"])
    merged = F.when(gate, F.aggregate("b", F.array().cast(kind), step)).otherwise(F.col("b"))
    return page.select("doc_id", "page_number", F.explode(merged).alias("x")).select("doc_id", "page_number", "x.position", "x.content")


def worth_refining(c: Column, least_length: int, least_markers: int) -> Column:
    """A long paragraph with several structural markers (kinds of item that it opens with, and brackets after blanks) that names a procedure."""
    kinds = sum((c.rlike(rf"(?U)^\s*(?:{mark}{after})").cast("int") for mark, after in ITEM_KINDS.values()), F.lit(0))
    inline = F.regexp_count(c, F.lit(r"(?U)(?:^|\s)(?:\(\d+\)|\([A-Za-z]\))"))
    return (F.char_length(c) >= least_length) & (kinds + inline >= least_markers) & c.rlike(REFINE_WORDS)
