"""Structure of units, lists, tables and pages: signals, list parents, table notes, content order, sheets, locators.

Rows of a document (or page, or sheet) are ordered by position; ties by id.  Nulls: a null text is empty, a null level 0, a null
flag false, a null array empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles that head a section, and roles of which a unit without text is an error.
SECTION_ROLES = ("title", "body_section", "appendix", "front_matter")
FILLED_ROLES = ("clause", "definition", "procedure", "list_item")
#: What opens a note under a table: a short mark, a sign, or a word for a note or source.
NOTE_MARK = r"(?iU)^\s*(?:[（(]?[a-z0-9]{1,3}[)）.、]|[*†‡§]|注\s*[:：]|注\s*\d|Note\s*[:：]|Notes?\s*\d|Source\s*[:：]|来源\s*[:：])"


def number_path(section_no: Column) -> Column:
    """1.2-3 as [1, 2, 3]; null for what is no such number."""
    plain = F.regexp_replace(F.trim(F.coalesce(section_no, F.lit(""))), r"[.）)]+$", "")
    return F.when(plain.rlike(r"^\d+(?:[.\-]\d+)*$"), F.transform(F.split(plain, r"[.\-]"), lambda x: x.cast("long")))


def unit_signals(units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, page_start, code, severity): what is odd about units and the headings among them.

    Units: doc_id, position, unit_id, stable_unit_id, semantic_role, heading (whether it opens its section), section_id, parent_section_id, section_level, section_no,
    title_path (array), list_level, list_parent, text, page_start, page_end, continuity_kind, continues_from, continuity_required."""
    at = Window.partitionBy("doc_id").orderBy("position", "unit_id")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    head = F.coalesce("heading", F.lit(False)) & ~blank("section_id")
    level = F.coalesce("section_level", F.lit(0))
    u = units.withColumns({"head": head, "level": level, "path": F.when(head, number_path(F.col("section_no")))})
    u = u.withColumn("heads_before", F.last(F.when(F.col("head"), F.col("level")), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1)))
    siblings = Window.partitionBy("doc_id", F.coalesce("parent_section_id", F.lit("")), "level", "head").orderBy("position", "unit_id")
    u = u.withColumn("sibling", F.last("path", ignorenulls=True).over(siblings.rowsBetween(Window.unboundedPreceding, -1)))
    u = u.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "stable_unit_id").orderBy("position", "unit_id")))
    n, m = F.size("path"), F.size("sibling")
    gap = F.col("head") & (n == m) & (F.slice("path", F.lit(1), n - 1) == F.slice("sibling", F.lit(1), m - 1)) & (F.element_at("path", -1) > F.element_at("sibling", -1) + 1)
    role = F.lower(F.trim(F.coalesce("semantic_role", F.lit(""))))
    kind, no_source = F.coalesce("continuity_kind", F.lit("")), blank("continues_from")
    needs = F.coalesce("continuity_required", F.lit(False)) & (kind != "spans_pages") & no_source
    rules = [
        ("structure_unit_identity_invalid", "error", blank("stable_unit_id") | (F.col("nth") > 1)), ("structure_section_parent_missing", "warning", F.col("head") & (F.col("level") > 1) & blank("parent_section_id")),
        ("structure_title_path_missing", "warning", F.col("head") & (F.size(F.coalesce("title_path", F.array().cast("array<string>"))) == 0)), ("structure_heading_level_jump", "warning", F.col("head") & (F.col("level") > F.col("heads_before") + 1)),
        ("structure_section_number_jump", "warning", gap), ("structure_list_parent_missing", "warning", (role == "list_item") & (F.coalesce("list_level", F.lit(0)) > 1) & blank("list_parent")),
        ("structure_semantic_unit_empty", "error", role.isin(*FILLED_ROLES) & blank("text")), ("structure_cross_page_table_break", "warning", needs & (role == "table")), ("structure_cross_page_continuity_missing", "warning", needs & (role != "table")),
        ("structure_cross_page_continuity_missing", "warning", (F.col("page_end") > F.col("page_start")) & ~kind.isin("spans_pages", "continues")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]), lambda r: r.isNotNull())
    return u.select("doc_id", "unit_id", "page_start", F.inline(found))


def list_parents(units: DataFrame, deepest: int = 9) -> DataFrame:
    """``units`` with ``list_parent``: the last item one level up, if neither a heading nor an item of a level in between closed it.

    A heading closes all lists, an item those of its level and below.  Units: doc_id, position, unit_id, semantic_role, list_level."""
    level = F.when(F.coalesce(F.col("semantic_role") == "list_item", F.lit(False)), F.coalesce("list_level", F.lit(0))).otherwise(0)
    before = Window.partitionBy("doc_id").orderBy("position", "unit_id").rowsBetween(Window.unboundedPreceding, -1)
    u = units.withColumn("_level", level).withColumn("_head", F.coalesce(F.col("semantic_role").isin(*SECTION_ROLES), F.lit(False)))
    parent = F.lit(None).cast("string")
    for k in range(2, deepest + 1):
        up = F.max(F.when(F.col("_level") == k - 1, F.struct("position", "unit_id"))).over(before)
        shut = F.max(F.when(F.col("_head") | ((F.col("_level") > 0) & (F.col("_level") < k - 1)), F.col("position"))).over(before)
        parent = F.when((F.col("_level") == k) & (shut.isNull() | (up["position"] > shut)), up["unit_id"]).otherwise(parent)
    return u.withColumn("list_parent", parent).drop("_level", "_head")


def table_notes(blocks: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, table_block, n, note_block, text): the notes right after a table on its page, in order, three at most; a table, another page or
    any text without a note's mark ends them, blocks without text do not.  Blocks: doc_id, position, block_id, type, page_number, content."""
    w = Window.partitionBy("doc_id").orderBy("position")
    table = F.col("type") == "table"
    b = blocks.where(table | (F.trim(F.coalesce("content", F.lit(""))) != "")).withColumn("is_table", table)
    b = b.withColumn("t", F.last(F.when(F.col("is_table"), F.struct("block_id", "page_number")), ignorenulls=True).over(w)).where("t is not null")
    run = Window.partitionBy("doc_id", "t.block_id").orderBy("position")
    note = ~F.col("is_table") & (F.coalesce("page_number", F.col("t.page_number")) == F.col("t.page_number")) & F.trim("content").rlike(NOTE_MARK)
    b = b.withColumn("broken", F.sum((~note & ~F.col("is_table")).cast("int")).over(run)).where(note & (F.col("broken") == 0))
    return b.withColumn("n", F.row_number().over(run)).where(F.col("n") <= most).select("doc_id", F.col("t.block_id").alias("table_block"), "n", F.col("block_id").alias("note_block"), F.trim("content").alias("text"))


def tables_of_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Each block with its table, or null: one to one by block id."""
    return blocks.join(tables.where("block_id is not null").select("doc_id", "block_id", "table_id"), ["doc_id", "block_id"], "left")


def unindexed_tables(tables: DataFrame, units: DataFrame) -> DataFrame:
    """Tables that no indexable unit names.  Units: doc_id, should_index, table_ids."""
    named = units.where("should_index").select("doc_id", F.explode("table_ids").alias("table_id")).distinct()
    return tables.where(F.coalesce("table_id", F.lit("")) != "").join(named, ["doc_id", "table_id"], "left_anti")


def locator_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per section: expected places, those found (by row, or by a page-wide candidate without a row) and their share.
    Both: section, page, row (or null)."""
    f = found.select(F.col("section").alias("fs"), F.col("page").alias("fp"), F.col("row").alias("fr")).distinct()
    hit = expected.join(f, (F.col("section") == F.col("fs")) & (F.col("page") == F.col("fp")) & (F.col("fr").isNull() | F.col("row").eqNullSafe(F.col("fr"))), "left_semi").groupBy("section").agg(F.count("*").alias("matched"))
    n = expected.groupBy("section").agg(F.count("*").alias("expected"))
    m = F.coalesce("matched", F.lit(0))
    return n.join(hit, "section", "left").select("section", "expected", m.alias("matched"), (m / F.col("expected")).alias("recall"))


def content_sequence(paragraphs: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """A page's paragraphs, tables and figures in order: a region stands before the paragraph that its top's share of the height
    names (half to even), at the end if the height is unknown, or where its anchor says; regions of one place by top, then kind and index.

    Paragraphs: doc_id, page_number, idx; regions: doc_id, page_number, kind (image or table), idx, top, anchor (or null); pages: doc_id, page_number, height."""
    page = ["doc_id", "page_number"]
    n = paragraphs.groupBy(*page).agg(F.count("*").alias("n"))
    r = regions.join(pages, page, "left").join(n, page, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = F.coalesce("top", F.lit(0.0))
    place = F.when(F.coalesce(F.col("height") > 0, F.lit(False)), F.bround(F.greatest(F.lit(0.0), F.least(top, F.col("height"))) / F.col("height") * F.col("n"))).otherwise(F.col("n"))
    placed = r.select(*page, F.coalesce("anchor", place).cast("int").alias("place"), F.lit(0).alias("after"), top.alias("top"), "kind", "idx")
    own = paragraphs.select(*page, F.col("idx").alias("place"), F.lit(1).alias("after"), F.lit(0.0).alias("top"), F.lit("paragraph").alias("kind"), "idx")
    w = Window.partitionBy(*page).orderBy("place", "after", "top", "kind", "idx")
    return placed.unionByName(own).withColumn("n", F.row_number().over(w)).select(*page, "n", "kind", "idx")


def trimmed_sheet(cells: DataFrame) -> DataFrame:
    """Cells from a sheet's first to last filled row and column, counted from 0 again, with where they begin (from 1)."""
    filled = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    box = filled.groupBy("sheet").agg(F.min("row_index").alias("r0"), F.max("row_index").alias("r1"), F.min("col_index").alias("c0"), F.max("col_index").alias("c1"))
    inside = cells.join(box, "sheet").where("row_index between r0 and r1 and col_index between c0 and c1")
    return inside.select("sheet", (F.col("row_index") - F.col("r0")).alias("row_index"), (F.col("col_index") - F.col("c0")).alias("col_index"), "text", (F.col("r0") + 1).alias("first_row"), (F.col("c0") + 1).alias("first_col"))


def layers_of(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Index rows of the layers after an upsert: those of the documents in ``chunks`` are replaced, all others stay.  A chunk is in the primary
    layer, and in the high-precision one if it says so; chunks without a vector are in none.

    Chunks: doc_id, chunk_id, embedding, high_precision.  Kept: layer, doc_id, chunk_id, embedding."""
    some = chunks.where("embedding is not null")
    layers = F.filter(F.array(F.lit("primary"), F.when(F.coalesce("high_precision", F.lit(False)), F.lit("high_precision"))), lambda x: x.isNotNull())
    new = some.select(F.explode(layers).alias("layer"), "doc_id", "chunk_id", "embedding")
    return kept.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("layer", "doc_id", "chunk_id", "embedding").unionByName(new)


# --- boxes ------------------------------------------------------------------------------------------------------------


def horizontal_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared width over the lesser width (1 at least)."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))
