"""Table cells, grids, records: everything keyed by (table_id, row, column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text


def stable_headers(cells: DataFrame) -> DataFrame:
    """Header names of row 0: a blank becomes col_n, the k-th repeat of a name gets the suffix _k."""
    name = F.trim(F.coalesce("text", F.lit("")))
    head = cells.where("row_index = 0").withColumn("base", F.when(name == "", F.concat(F.lit("col_"), (F.col("col_index") + 1).cast("string"))).otherwise(name))
    k = F.row_number().over(Window.partitionBy("table_id", "base").orderBy("col_index"))
    return head.select("table_id", "col_index", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), k.cast("string"))).alias("header"))


def records(cells: DataFrame) -> DataFrame:
    """One row per data row: record_id, fields (header to value), raw and normalised text."""
    named = cells.where("row_index > 0").join(stable_headers(cells), ["table_id", "col_index"])
    pairs = F.array_sort(F.collect_list(F.struct("col_index", "header", F.coalesce("text", F.lit("")).alias("value"))))
    rows = named.groupBy("table_id", "row_index").agg(pairs.alias("p"))
    raw = F.array_join("p.value", " | ")
    return rows.select("table_id", "row_index", F.concat(F.col("table_id").cast("string"), F.lit(":r"), F.col("row_index").cast("string")).alias("record_id"), F.map_from_arrays("p.header", "p.value").alias("fields"), raw.alias("raw_text"), text.record_text(raw).alias("normalized_text"))


def search_text(r: DataFrame) -> Column:
    """What a record's query looks through: id, both texts and all field values."""
    return F.lower(F.concat_ws(" ", "record_id", "raw_text", "normalized_text", F.array_join(F.map_values("fields"), " ")))


def filter_records(recs: DataFrame, query: str = "", table_id: str | None = None, signal: str | None = None, fields: dict[str, str] | None = None, page_start: int | None = None, page_end: int | None = None) -> DataFrame:
    """All conditions hold: substring of the search text, table, signal, fields (an empty value asks for
    a non-blank field), page overlap (missing pages read as start 1, end = start)."""
    if page_start and page_end and page_start > page_end:
        raise ValueError("invalid_page_range")
    tests: list[Column] = []
    if query:
        tests.append(F.instr(search_text(recs), query.lower()) > 0)
    if table_id is not None:
        tests.append(F.col("table_id").cast("string") == table_id)
    if signal:
        tests.append(F.array_contains("quality_signal_codes", signal))
    for name, value in (fields or {}).items():
        got = F.lower(F.coalesce(F.element_at("fields", name), F.lit("")))
        tests.append(F.map_contains_key("fields", name) & ((F.instr(got, value.lower()) > 0) if value else (F.trim(got) != "")))
    if page_start or page_end:
        first = F.coalesce("page_start", F.lit(1))
        last = F.coalesce("page_end", first)
        tests += [last >= page_start] if page_start else []
        tests += [first <= page_end] if page_end else []
    return recs.where(reduce(Column.__and__, tests)) if tests else recs


def page_of(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> tuple[int, DataFrame]:
    """(total matches, one page in order)."""
    if offset < 0 or limit is not None and limit < 1:
        raise ValueError("offset >= 0 and limit >= 1 are asked for")
    page = df.orderBy(*order).offset(offset)
    return df.count(), page.limit(limit) if limit else page


def shapes(cells: DataFrame) -> DataFrame:
    """Per table (doc_id, table_id): rows, cols (of the widest row), the widths of its non-empty rows, cells, empty cells,
    and whether the first row has no text. A null text is empty."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = cells.groupBy("doc_id", "table_id", "row_index").agg(F.count("*").alias("width"), F.count_if(blank).alias("empty"))
    return rows.groupBy("doc_id", "table_id").agg(
        F.count("*").alias("rows"), F.max("width").alias("cols"), F.array_sort(F.collect_set("width")).alias("widths"), F.sum("width").alias("cells"), F.sum("empty").alias("empty_cells"),
        F.min_by(F.col("width") == F.col("empty"), "row_index").alias("header_blank"),
    )


def warnings(tables: DataFrame) -> DataFrame:
    """``tables`` (as of ``shapes``) with the array ``warnings``. A column ``declared`` (array of widths that the source
    declares, or null) goes before the grid's own widths; a width of 0 disagrees with none."""
    own = F.col("widths")
    widths = F.when(F.size(F.coalesce("declared", F.array().cast("array<int>"))) > 0, F.col("declared").cast("array<bigint>")).otherwise(own) if "declared" in tables.columns else own
    kinds = F.size(F.array_distinct(F.filter(widths, lambda w: w > 0)))
    codes = F.array(
        F.when((F.col("rows") == 0) | (F.col("cols") == 0), "table_empty"), F.when((F.col("rows") > 0) & F.col("header_blank"), "table_header_missing"),
        F.when(kinds > 1, "table_ragged_rows"), F.when((F.col("cells") > 0) & (F.col("empty_cells") / F.col("cells") > 0.5), "table_empty_ratio_high"),
    )
    return tables.withColumn("warnings", F.filter(codes, lambda c: c.isNotNull()))


def common_columns(tables: DataFrame) -> DataFrame:
    """Per document the commonest number of columns of its tables (the smaller of a tie); tables without columns do not count."""
    n = tables.where("cols > 0").groupBy("doc_id", "cols").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("cols", F.struct("n", -F.col("cols"))).alias("common_cols"))


def signals(tables: DataFrame) -> DataFrame:
    """A row for each thing to note of a table: its warnings (an empty table is an error), a width other than the document's
    common one, and what optional columns tell: truncated cells or source, hidden sheets, merged or formula cells,
    blank or repeated header names (``header``, an array; all blank is the warning above).

    Input: as of ``warnings``, and optionally cells_truncated, truncated, hidden_sheet, merged_cells (array), has_formula, header."""
    t = tables.join(common_columns(tables), "doc_id", "left")

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in tables.columns else F.lit(False)

    found = F.transform("warnings", lambda w: F.struct(w.alias("code"), F.when(w == "table_empty", "error").otherwise("warning").alias("severity")))
    rules = [
        ("table_col_count_changed", "warning", F.coalesce((F.col("cols") > 0) & (F.col("cols") != F.col("common_cols")), F.lit(False))), ("table_cells_truncated", "warning", flag("cells_truncated")),
        ("table_source_truncated", "warning", flag("truncated")), ("table_hidden_sheet", "info", flag("hidden_sheet")),
        ("table_merged_cells", "info", F.size(F.coalesce("merged_cells", F.array().cast("array<string>"))) > 0 if "merged_cells" in tables.columns else F.lit(False)), ("table_formula_cells", "info", flag("has_formula")),
    ]
    if "header" in tables.columns:
        names = F.transform(F.coalesce("header", F.array().cast("array<string>")), lambda h: F.trim(F.coalesce(h, F.lit(""))))
        filled = F.filter(names, lambda h: h != "")
        rules += [
            ("table_header_blank_cells", "warning", (F.size(filled) > 0) & (F.size(filled) < F.size(names))),
            ("table_header_duplicate_values", "warning", F.size(F.array_distinct(F.transform(filled, lambda h: F.lower(h)))) < F.size(filled)),
        ]
    rest = F.filter(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]), lambda r: r.isNotNull())
    return t.select("doc_id", "table_id", F.inline(F.concat(found, rest)))


def expand_spans(cells: DataFrame) -> DataFrame:
    """Every grid position that a merged cell covers, with its text and whether it continues another."""
    rows = cells.withColumn("r", F.explode(F.sequence("row_index", F.col("row_index") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1)))
    both = rows.withColumn("c", F.explode(F.sequence("col_index", F.col("col_index") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)) - 1)))
    own = (F.col("r") == F.col("row_index")) & (F.col("c") == F.col("col_index"))
    return both.select("table_id", F.col("r").alias("row_index"), F.col("c").alias("col_index"), "text", (~own).alias("continuation"))


def render(cells: DataFrame) -> DataFrame:
    """Markdown and TSV of each table; rows without any text are dropped, rows are padded to the widest."""
    clean = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), "\t", " ")
    rows = cells.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", clean.alias("v")))).alias("p"))
    rows = rows.select("table_id", "row_index", F.col("p.v").alias("v")).where(F.exists("v", lambda x: x != ""))
    width = F.max(F.size("v")).over(Window.partitionBy("table_id"))
    rows = rows.withColumn("w", width).withColumn("v", F.concat("v", F.array_repeat(F.lit(""), (F.col("w") - F.size("v")).cast("int"))))
    md = F.concat(F.lit("| "), F.array_join(F.transform("v", lambda x: F.regexp_replace(F.replace(x, F.lit("|"), F.lit("\\|")), "\n", "<br>")), " | "), F.lit(" |"))
    tsv = F.array_join(F.transform("v", lambda x: F.regexp_replace(x, "\n", " ")), "\t")
    out = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", md.alias("md"), tsv.alias("tsv")))).alias("lines"), F.max("w").alias("w"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("w").cast("int")))
    body = F.concat(F.slice("lines.md", 1, 1), F.array(rule), F.slice("lines.md", F.lit(2), F.size("lines")))
    return out.select("table_id", F.array_join(body, "\n").alias("markdown"), F.array_join("lines.tsv", "\n").alias("tsv"))


def header_paths(cells: DataFrame, header_rows: int) -> DataFrame:
    """Per column the header rows' names from the top, without repeats of the one above."""
    head = cells.where(F.col("row_index") < header_rows).groupBy("table_id", "col_index").agg(F.array_sort(F.collect_list(F.struct("row_index", F.trim(F.coalesce("text", F.lit(""))).alias("v")))).alias("p"))
    path = F.aggregate("p.v", F.array().cast("array<string>"), lambda a, v: F.when((v == "") | (F.get(a, F.size(a) - 1) == v), a).otherwise(F.concat(a, F.array(v))))
    return head.select("table_id", "col_index", F.array_join(path, " / ").alias("path"))


def continuations(tables: DataFrame) -> DataFrame:
    """Links a document's tables to the one before: column continuation (equal labels, other header,
    gap up to two pages) or row continuation (equal header, other labels, next page); groups chain.

    Input: doc_id, table_id, page, header array<string>, labels array<string>, rows."""
    w = Window.partitionBy("doc_id").orderBy("page", "table_id")
    t = tables.withColumn("before", F.lag(F.struct("table_id", "page", "header", "labels", "rows")).over(w))
    gap = F.col("page") - F.col("before.page")
    column = (gap <= 2) & (F.size("labels") >= 2) & (F.col("labels") == F.col("before.labels")) & (F.col("rows") == F.col("before.rows")) & (F.col("header") != F.col("before.header"))
    row = (gap == 1) & (F.size("header") >= 2) & F.exists("header", lambda h: h != "") & (F.col("header") == F.col("before.header")) & (F.col("labels") != F.col("before.labels"))
    kind = F.when(gap <= 0, None).when(column, "column_continuation").when(row, "row_continuation")
    t = t.withColumn("kind", kind).withColumn("island", F.sum(F.col("kind").isNull().cast("int")).over(w))
    g = Window.partitionBy("doc_id", "island")
    many = F.count("*").over(g) > 1
    group = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("tblgrp"), F.concat(F.lit("p"), F.min("page").over(g).cast("string")))
    return t.select("doc_id", "table_id", "page", "kind", F.when(many, group).alias("group_id"), F.when(F.col("kind").isNotNull(), F.col("before.table_id")).alias("continues_from"), F.min("page").over(g).alias("span_start"), F.max("page").over(g).alias("span_end"))


def stack_logical(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Row continuations as one logical table: later parts lose their repeated header row, rows are renumbered."""
    parts = cells.join(groups.where("group_id is not null").select("table_id", "group_id", "page"), "table_id")
    first = F.min(F.struct("page", "table_id")).over(Window.partitionBy("group_id"))
    parts = parts.where((F.struct("page", "table_id") == first) | (F.col("row_index") > 0))
    n = F.dense_rank().over(Window.partitionBy("group_id").orderBy("page", "table_id", "row_index")) - 1
    return parts.select("group_id", n.alias("row_index"), "col_index", "text")


def join_columns(left: DataFrame, right: DataFrame, page: int) -> DataFrame:
    """Column continuation of records of one group: joined by row; a field name that both have gets the page as suffix."""
    other = right.select("group_id", "row_index", F.col("fields").alias("more"))
    renamed = F.transform_keys("more", lambda k, v: F.when(F.map_contains_key("fields", k), F.concat(k, F.lit(f"__p{page}"))).otherwise(k))
    return left.join(other, ["group_id", "row_index"]).withColumn("fields", F.map_concat("fields", renamed)).drop("more")


def inherit_merged(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Blank values take the last one above within a run of consecutive rows of one key."""
    w = Window.partitionBy(key).orderBy(order)
    run = rows.withColumn("jump", F.coalesce((F.col(order) != F.lag(order).over(w) + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("jump").over(w))
    filled = F.last(F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.col(value)), ignorenulls=True).over(Window.partitionBy(key, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn(value, filled).drop("jump", "run")


def text_records(lines: DataFrame) -> DataFrame:
    """Records in running text: a line that opens with a row number starts one, other lines continue it."""
    start = F.col("line").rlike(r"^\s*\d{1,5}[.)、]?\s+\S")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.trim("line") != "").withColumn("rec", F.sum(start.cast("int")).over(w)).where("rec > 0")
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line"))))
    out = rows.groupBy("doc_id", "rec").agg(parts.alias("p"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    body = F.array_join("p.line", "\n")
    return out.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("text"), F.concat(F.lit("r"), F.col("rec").cast("string"))).alias("record_id"), F.regexp_extract(body, r"^(\d{1,5})", 1).cast("int").alias("row_number"), text.record_text(F.regexp_replace(body, r"^\d{1,5}[.)、]?\s+", "")).alias("text"), text.last_date(body).alias("latest_date"), "page_start", "page_end")


def regions(rows: DataFrame) -> DataFrame:
    """Sheet rows to regions: a blank row splits; a one-cell row before a wider one opens a titled region.

    Input: sheet, row, cells (number of filled cells)."""
    w = Window.partitionBy("sheet").orderBy("row")
    r = rows.withColumn("before", F.lag("cells").over(w)).withColumn("after", F.lead("cells").over(w))
    opens = (F.col("cells") > 0) & (F.coalesce("before", F.lit(0)) == 0) | (F.col("cells") == 1) & (F.coalesce("after", F.lit(0)) >= 2) & (F.coalesce("before", F.lit(0)) > 0)
    r = r.withColumn("region", F.sum(opens.cast("int")).over(w)).where("cells > 0")
    return r.groupBy("sheet", "region").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.max("cells").alias("width"), F.min_by("cells", "row").alias("first_width"))
