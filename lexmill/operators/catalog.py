"""Catalogue pages: sections, row anchors, contiguous partition by dynamic programming, audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_spans(headers: DataFrame) -> DataFrame:
    """A section runs to the page before the next header; the last one ends on its own page."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    return headers.select("doc_id", "section", F.col("page_number").alias("first_page"), F.greatest(F.coalesce(F.lead("page_number").over(w) - 1, F.col("page_number")), F.col("page_number")).alias("last_page"))


def row_anchors(words: DataFrame) -> DataFrame:
    """Words of the first column that stand alone on their line (tops rounded to 2.5 points) and are a number of up to five digits."""
    b = words.where("column_index = 0").withColumn("bucket", F.bround(F.col("top") / 2.5))
    g = b.groupBy("doc_id", "page_number", "bucket").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return g.where("n = 1").where(F.col("text").rlike(r"^\d{1,5}$")).select("doc_id", "page_number", F.col("text").cast("int").alias("row_number"), ((F.col("top") + F.col("bottom")) / 2).alias("centre"))


def best_partition(anchors: list[float], centres: list[float]) -> list[int] | None:
    """The anchor of each line: contiguous non-empty runs of lines, in order, whose mean centres lie nearest to their
    anchors (squares of the distance over .6 of the usual gap, 4 points at least). None where the lines do not tell: fewer
    lines than anchors, or an anchor without a line within three quarters of the usual gap (5 to 18 points)."""
    m, n = len(anchors), len(centres)
    if not m or not n:
        return None
    steps = sorted(b - a for a, b in zip(anchors, anchors[1:], strict=False) if b > a)
    gap = steps[len(steps) // 2] if steps else 12.0
    near = max(5.0, min(18.0, 0.75 * gap))
    if n < m or any(min(abs(c - a) for c in centres) > near for a in anchors):
        return None
    sums = np.concatenate(([0.0], np.cumsum(centres)))
    # best[e]: least cost of the first e lines for the anchors so far; one anchor more at each step.
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    begins = []
    for a in anchors:
        at, end = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
        size = np.maximum(end - at, 1)
        cost = np.where(end > at, (((sums[None, :] - sums[:, None]) / size - a) / max(0.6 * gap, 4.0)) ** 2 + best[:, None], np.inf)
        begins.append(cost.argmin(axis=0))
        best = cost.min(axis=0)
    owner, end = [0] * n, n
    for i in range(m - 1, -1, -1):
        begin = int(begins[i][end])
        owner[begin:end] = [i] * (end - begin)
        end = begin
    return owner


#: Pages whose lines are Python objects at a time.
PAGES = 64


def assign_rows(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines to row anchors per page; a page whose lines do not tell gives none. A page's rows are few; the dynamic program is
    sequential, so Python per page."""
    a = anchors.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("centre", "row_number"))).alias("anchors"))
    b = lines.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("centre", "text"))).alias("lines"))

    kinds = [("doc_id", pa.int64()), ("page_number", pa.int32()), ("row_number", pa.int32()), ("line_no", pa.int32()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Objects are made for a few pages at a time, not for a whole batch.
        for b in batches:
            for first in range(0, b.num_rows, PAGES):
                rows = []
                for r in b.slice(first, PAGES).to_pylist():
                    owner = best_partition([x["centre"] for x in r["anchors"]], [x["centre"] for x in r["lines"]])
                    rows += [(r["doc_id"], r["page_number"], r["anchors"][o]["row_number"], k, x["text"]) for k, (o, x) in enumerate(zip(owner, r["lines"], strict=True))] if owner else []
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return a.join(b, ["doc_id", "page_number"]).mapInArrow(run, "doc_id long, page_number int, row_number int, line_no int, text string")


def row_gaps(records: DataFrame, key: str, number: str, most: int = 100) -> DataFrame:
    """Missing row numbers within a key, the first hundred (a report's limit)."""
    w = Window.partitionBy(key).orderBy(number)
    nxt = records.select(key, number).distinct().withColumn("next", F.lead(number).over(w)).where(F.col("next") > F.col(number) + 1)
    gaps = nxt.select(key, F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias("missing"))
    return gaps.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("missing"))).where(F.col("rn") <= most).drop("rn")


def audit(records: DataFrame, key: str, row: str, date: str, evidence: str) -> DataFrame:
    """Per section: records, duplicate ids and rows, date parse and evidence rates as counts."""
    ids = records.groupBy(key, row).agg(F.count("*").alias("n"), F.count(date).alias("dates"), F.count(evidence).alias("evidence"))
    return ids.groupBy(key).agg(F.sum("n").alias("records"), F.count_if(F.col("n") > 1).alias("duplicate_rows"), F.sum("dates").alias("dated"), F.sum("evidence").alias("with_evidence"), F.min(row).alias("first_row"), F.max(row).alias("last_row"))


def ledger(parts: DataFrame) -> DataFrame:
    """A run's state from its parts' states (a null or empty one is pending), how many parts each state has, and the counts
    (a map, or null) of the done parts summed by name."""
    state = F.when(F.coalesce("state", F.lit("")) == "", "pending").otherwise(F.col("state"))
    p = parts.withColumn("state", state)
    c = lambda s: F.count_if(F.col("state") == s)
    by_state = p.groupBy("run_id", "state").agg(F.count("*").alias("n"))
    states = by_state.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("part_states"))
    g = p.groupBy("run_id").agg(F.count("*").alias("parts"), c("done").alias("done"), c("failed").alias("failed"), c("running").alias("running"))
    run = F.when(F.col("done") == F.col("parts"), "completed").when(F.col("running") > 0, "running").when((F.col("done") > 0) | (F.col("failed") > 0), "partial").otherwise("planned")
    out = g.withColumn("state", run).join(states, "run_id")
    if "counts" in parts.columns:
        done = p.where("state = 'done'").select("run_id", F.explode("counts").alias("name", "n")).groupBy("run_id", "name").agg(F.sum("n").alias("n"))
        sums = done.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("completed_counts"))
        out = out.join(sums, "run_id", "left")
    return out


def omissions(missing: DataFrame, reviews: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(missing values with their review, reviews that no missing value uses)."""
    return missing.join(reviews, key, "left"), reviews.join(missing.select(key), key, "left_anti")


# The more specific names come first; a section is named by any of its texts or by its mark.
SECTIONS = [
    ("pma_holder", ["零部件制造人批准书", "PMA制造人", "PMA持证人"], None),
    ("foreign_tso_recognition", ["获得国外当局认可的技术标准规定项目"], None),
    ("foreign_product_recognition", ["获得国外认可的民用航空产品"], None),
    ("ctsoa", ["技术标准规定项目批准书"], r"\bCTSOA\b"),
    ("vstc", ["补充型号认可证"], r"\bVSTC\b"),
    ("vtc", ["型号认可证"], r"(?<!VS)\bVTC\b"),
    ("vda", ["设计批准认可证"], r"\bVDA\b"),
    ("stc", ["补充型号合格证"], r"\bSTC\b"),
    ("mda", ["改装设计批准书"], r"\bMDA\b"),
    ("tda", ["型号设计批准书"], r"\bTDA\b"),
    ("pc", ["生产许可证"], r"\bPC\b"),
    ("tc", ["型号合格证"], r"(?<!V)\bTC\b"),
]


def first_line(page_text: Column) -> Column:
    """The first line that is not empty, white space folded; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(page_text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def section_of(header: Column) -> Column:
    """The section that a page header names, else null."""
    has = lambda s: F.contains(header, F.lit(s))
    section = F.when(has("已获批准的") & has("PMA") & has("产品"), "pma_item")
    for name, texts, mark in SECTIONS:
        named = header.rlike(f"(?iU){mark}") if mark else F.lit(False)
        for s in texts:
            named = named | has(s)
        section = section.when(named, name)
    return section


def furniture_word(text: Column, top: Column, page_height: Column) -> Column:
    """Cutoff labels, and page labels such as TC-1 within 80 points of the page's bottom."""
    label = F.coalesce((top >= page_height - 80.0) & text.rlike(r"^[A-Z]{2,8}-[0-9]{1,3}\z"), F.lit(False))
    return F.contains(text, F.lit("截至")) | F.contains(text, F.lit("数据截止")) | label


def cell_text(words: DataFrame, key: list[str], tolerance: float = 2.5) -> DataFrame:
    """Text of each cell (``key``): visual lines, opened by a word more than ``tolerance`` from the line's first one, then by x0."""
    w = words.select(*key, F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text").alias("w")).where("w.top is not null and w.x0 is not null")
    g = w.groupBy(*key).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    tops = F.aggregate("ws", F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) > 0) & (x["top"] - F.element_at(s, -1) <= tolerance), s).otherwise(F.array_append(s, x["top"])))
    g = g.withColumn("tops", tops)
    line = lambda x: F.size(F.filter("tops", lambda t: t <= x["top"]))
    placed = F.array_sort(F.transform("ws", lambda x: F.struct(line(x).alias("line"), x["x0"].alias("x0"), x["top"].alias("top"), x["text"].alias("text"))))
    return g.select(*key, F.trim(F.array_join(F.transform(placed, lambda x: x["text"]), " ")).alias("text"))


def row_bands(anchors: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """The band [start, end) of each row anchor: the rules around it if they hold no other anchor and lie within 120 points,
    else from and to the midpoints of neighbouring anchors, the last row down to its rule or the page's bottom.

    Anchors: doc_id, page_number, row_number, top; rules: doc_id, page_number, top, bottom, width; pages: doc_id, page_number, header_bottom, page_bottom."""
    page = ["doc_id", "page_number"]
    w = Window.partitionBy(*page).orderBy("top", "row_number")
    lines = rules.where("width >= 500 and bottom - top <= 3").groupBy(*page).agg(F.collect_set("top").alias("tops"))
    a = anchors.withColumn("before", F.lag("top").over(w)).withColumn("after", F.lead("top").over(w)).withColumn("all", F.collect_list("top").over(Window.partitionBy(*page)))
    a = a.join(pages, page).join(lines, page, "left")
    a = a.withColumn("r0", F.array_max(F.filter("tops", lambda t: t <= F.col("top") + 0.5)) + 0.5).withColumn("r1", F.array_min(F.filter("tops", lambda t: t > F.col("top") + 0.5)) - 0.5)
    held = F.size(F.filter("all", lambda t: (t >= F.col("r0")) & (t < F.col("r1"))))
    sane = F.coalesce((F.col("r1") > F.col("r0")) & (F.col("r1") - F.col("r0") <= 120) & (held <= 1), F.lit(False))
    start = F.coalesce((F.col("before") + F.col("top")) / 2, F.col("header_bottom") + 1.5)
    last = F.coalesce(F.col("after").isNull() & F.col("r0").isNotNull() & (F.col("r1") > start), F.lit(False))
    end = F.when(sane | last, F.col("r1")).otherwise(F.coalesce((F.col("top") + F.col("after")) / 2, F.col("page_bottom")))
    return a.select(*page, "row_number", F.when(sane, F.col("r0")).otherwise(start).alias("start"), end.alias("end"))


def header_columns(words: DataFrame, aliases: DataFrame, tolerance: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(columns, fields without a header) of each page: the words level with the serial-number header (tops within ``tolerance``), each the
    first from the left of those that an alias of the section's field names; a word serves one field, fields in their order.

    Words: doc_id, page_number, section, text, x0, x1, top, bottom.  Aliases: section, field_no, field, alias (a fixed few)."""
    page = ["doc_id", "page_number", "section"]
    label = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s　]+", ""))
    w = words.where("x0 is not null and top is not null").withColumn("label", label(F.col("text")))
    serial = w.where(F.col("label") == "序号").groupBy(*page).agg(F.min(F.struct("top", "x0", "x1", "bottom")).alias("s"))
    level = w.join(serial, page).where((F.abs(F.col("top") - F.col("s.top")) <= tolerance) & (F.col("label") != "序号"))
    known = aliases.select("section", "field_no", "field", label(F.col("alias")).alias("label")).distinct()
    fits = level.join(F.broadcast(known), ["section", "label"])
    # Two fields of one section share no alias in one table, so the leftmost fitting word is each field's own.
    best = fits.groupBy(*page, "field_no", "field").agg(F.min(F.struct("x0", "x1", "top", "bottom", "text")).alias("w"))
    first = serial.select(*page, F.lit("rowNumber").alias("field"), F.lit("序号").alias("text"), F.col("s.x0").alias("x0"), F.col("s.x1").alias("x1"), F.col("s.top").alias("top"), F.col("s.bottom").alias("bottom"))
    columns = first.unionByName(best.select(*page, "field", "w.text", "w.x0", "w.x1", "w.top", "w.bottom"))
    asked = serial.select(*page).join(F.broadcast(aliases.select("section", "field_no", "field").distinct()), "section")
    return columns, asked.join(best.select(*page, "field"), [*page, "field"], "left_anti").select(*page, "field")


# Per section, the field whose words go back to another one when they begin left of their header; and the sections
# in which words of any field go back to the column before it.
OVERFLOWS = [
    ("stc", "attributes.originalApprovalNumber", "attributes.originalModel"), ("vtc", "item.productTypeOriginal", "holder.nameOriginal"), ("tda", "item.modelOriginal", "holder.nameOriginal"),
]
TO_THE_LEFT = ("mda", "vstc", "vda")
REQUIRED = ("approval.numberOriginal", "holder.nameOriginal")


def overflow(placed: DataFrame, columns: DataFrame, margin: float = 1.0, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Words with the field that they belong to: one that begins more than ``margin`` points left of its header's left edge returns to
    the field that the section's rule names, or to the column before it; fields without a rule or a header keep their words.

    Placed: doc_id, page_number, section, field, text, x0, ...; columns: as of ``header_columns``."""
    page = ["doc_id", "page_number", "section"]
    spark = placed.sparkSession
    moves = F.broadcast(spark.createDataFrame(rules or OVERFLOWS, "section string, field string, back string"))
    heads = columns.select(*page, "field", F.col("x0").alias("edge")).dropDuplicates([*page, "field"])
    edges = heads.withColumn("before", F.lag("field").over(Window.partitionBy(*page).orderBy("edge")))
    j = placed.join(moves, ["section", "field"], "left").join(edges, [*page, "field"], "left")
    j = j.withColumn("back", F.coalesce("back", F.when(F.col("section").isin(*TO_THE_LEFT), F.col("before")))).drop("before")
    back = F.col("back").isNotNull() & F.coalesce(F.col("x0") < F.col("edge") - margin, F.lit(False))
    return j.withColumn("field", F.when(back, F.col("back")).otherwise(F.col("field"))).drop("back", "edge").select(*placed.columns)


def candidate_rows(words: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of each row by field, words that no band holds).  A word belongs to the band that holds its top, half open.

    Words: doc_id, page_number, field, text, x0, top; bands: as of ``row_bands``."""
    page = ["doc_id", "page_number"]
    w = words.withColumn("word_id", F.xxhash64(*page, "field", "text", "x0", "top"))
    held = w.join(bands, page).where((F.col("top") >= F.col("start")) & (F.col("top") < F.col("end")))
    cells = cell_text(held, [*page, "row_number", "field"])
    rows = cells.groupBy(*page, "row_number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "text")))).alias("fields"))
    return rows, w.join(held.select(*page, "word_id").distinct(), [*page, "word_id"], "left_anti").drop("word_id")


def build_records(rows: DataFrame, source: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows as records: the fields that are missing reject a row; a record's identity is the SHA-256 of its canonical fields, its id holds the
    source's first sixteen digits, section, page and row.  Of rows with one id the first by page and position stays.

    Rows: section, page_number, row_number, fields (map)."""
    value = lambda f: F.trim(F.coalesce(F.element_at("fields", f), F.lit("")))
    lacks = F.filter(F.array(*[F.when(value(f) == "", F.lit(f)) for f in required]), lambda f: f.isNotNull())
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")))))
    digest = F.sha2(F.concat_ws("|", "section", canonical), 256)
    rid = F.concat_ws(":", F.lit(source[:16]), "section", F.concat(F.lit("p"), F.col("page_number").cast("string")), F.concat(F.lit("r"), F.col("row_number").cast("string")))
    out = rows.select("section", "page_number", "row_number", "fields", lacks.alias("missing"), digest.alias("identity"), rid.alias("record_id")).withColumn("rejected", F.size("missing") > 0)
    w = Window.partitionBy("section", "identity", "rejected").orderBy("page_number", "row_number")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rejected") | (F.col("rn") == 1)).drop("rn")


def owned_records(records: DataFrame, parts: DataFrame) -> DataFrame:
    """Records of the pages that each part owns; its context pages give none.  Parts: part_id, first, last (owned pages)."""
    pages = parts.select("part_id", F.explode(F.sequence("first", "last")).alias("page_number"))
    return records.join(pages, "page_number")
