"""Sources: text, markdown, HTML, conversations, delimited files, DOCX and XLSX, to typed block DataFrames.

Text, markdown, HTML and conversations are Catalyst plans; only the zipped
office formats are decoded in Python, file by file (``binaryFile`` rows).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "doc string, position int, type string, content string, level int, row_index int, col_index int, row_span int, col_span int"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row per file; the id is the file's stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(stem.alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("text"))


def dispatch(files: DataFrame, registrations: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``parser``: the first registration (name, media type, suffix) that fits by type or by suffix; else null."""
    parser = F.lit(None).cast("string")
    for name, media, suffix in reversed(registrations):
        parser = F.when((F.col("media_type") == media) | F.lower("path").endswith(suffix), name).otherwise(parser)
    return files.withColumn("parser", parser)


def strip_front_matter(c: Column) -> Column:
    """Without a YAML block between --- and --- or ... at the start; one that is not closed is an error."""
    t = F.regexp_replace(c, "^﻿", "")
    opened = t.rlike(r"^---[ \t]*\r?\n")
    closed = t.rlike(r"(?s)^---[ \t]*\r?\n.*?\r?\n?(?:---|\.\.\.)[ \t]*(?:\r?\n|$)")
    body = F.regexp_replace(t, r"(?s)^---[ \t]*\r?\n(?:.*?\r?\n)?(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", "")
    return F.when(opened & ~closed, F.raise_error(F.lit("front matter is not closed")).cast("string")).when(opened, body).otherwise(t)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Headings (with level), tables (runs of pipe lines) and paragraphs of markdown texts, by islands of lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(strip_front_matter(F.coalesce("text", F.lit(""))), "\r\n?", "\n"), "\n")).alias("n", "line"))
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s+.+?\s*$"), "title").when((F.instr("line", "|") > 0) & (F.size(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|")) >= 2) & (F.size(cells) > 0), "table").otherwise("paragraph")
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.withColumn("type", kind).withColumn("opens", ((F.col("type") == "title") | (F.col("type") != F.lag("type", 1, "").over(w))).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(w)).where("type <> 'blank'")
    text = F.when(F.col("type") == "title", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))).otherwise(F.col("line"))
    level = F.when(F.col("type") == "title", F.char_length(F.regexp_extract("line", "^(#+)", 1)))
    out = rows.groupBy("doc_id", "island", "type").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("p"), F.max(level).alias("level"))
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1).alias("position"), "type", F.array_join("p.t", "\n").alias("content"), "level")


def markdown_cells(blocks: DataFrame) -> DataFrame:
    """Cells of markdown table blocks; separator rows go."""
    rows = blocks.where("type = 'table'").select("doc_id", "position", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    parts = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("parts", parts).where(~F.forall("parts", lambda c: c.rlike("^:?-{3,}:?$")))
    w = Window.partitionBy("doc_id", "position").orderBy("n")
    rows = rows.withColumn("row_index", F.row_number().over(w) - 1)
    return rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("t"), F.col("position").cast("string")).alias("table_id"), "row_index", F.posexplode("parts").alias("col_index", "text"))


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
_TAGS = "h1|h2|h3|h4|h5|h6|p|li|td|th|pre|blockquote"


def unescape(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items and cells of HTML pages, in order; scripts, styles, comments and
    page furniture (nav, header, footer, aside) are left out."""
    body = F.coalesce("html", F.lit(""))
    for dead in ("script", "style", "nav", "header", "footer", "aside", "noscript", "template"):
        body = F.regexp_replace(body, f"(?is)<{dead}\\b[^>]*>.*?</{dead}\\s*>", " ")
    body = F.regexp_replace(body, "(?s)<!--.*?-->", " ")
    found = F.regexp_extract_all(body, F.lit(rf"(?is)<((?:{_TAGS})\b[^>]*>.*?)</(?:{_TAGS})\s*>"), F.lit(1))
    rows = pages.select(F.col("page_id").alias("doc_id"), "url", F.posexplode(found).alias("position", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^(\w+)", 1))
    text = F.trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_replace("raw", r"^[^>]*>", ""), "(?s)<[^>]+>", " ")), r"[\s\p{Z}]+", " "))
    kind = F.when(tag.rlike("^h[1-6]$"), "title").when(tag.isin("td", "th"), "table").when(tag == "li", "list_item").otherwise("paragraph")
    return rows.select("doc_id", "url", "position", kind.alias("type"), F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"), text.alias("content")).where("content <> ''")


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """One block per turn in order; who speaks is its role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("position"), "role", F.trim(F.coalesce("text", F.lit(""))).alias("content"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Cells of delimited files: (table_id, row_index, col_index, text), all text; the table is the file."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)(?:\.[^./]*)?$", 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for f in frames:
            for t, raw in zip(f["table_id"], f["content"], strict=True):
                rows = [(t, i, j, v) for i, row in enumerate(csv.reader(io.StringIO(bytes(raw).decode("utf-8-sig")), delimiter=sep)) for j, v in enumerate(row)]
                yield pd.DataFrame(rows, columns=["table_id", "row_index", "col_index", "text"])

    return spark.read.format("binaryFile").load(path).select(stem.alias("table_id"), "content").mapInPandas(run, "table_id string, row_index int, col_index int, text string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_rows(doc: str, data: bytes) -> list[tuple]:
    """Paragraphs and table cells (with spans) of a DOCX file in document order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(e: ElementTree.Element) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in e.iter())

    rows: list[tuple] = []
    for position, e in enumerate(body):
        if e.tag == f"{_W}p" and text(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            rows.append((doc, position, "title" if m else "paragraph", text(e).strip(), int(m[1]) if m else None, None, None, None, None))
        elif e.tag == f"{_W}tbl":
            open_cells: dict[int, int] = {}
            for r, tr in enumerate(e.iter(f"{_W}tr")):
                c = 0
                for tc in tr.iter(f"{_W}tc"):
                    span = tc.find(f"{_W}tcPr/{_W}gridSpan")
                    wide = int(span.get(f"{_W}val", "1")) if span is not None else 1
                    merge = tc.find(f"{_W}tcPr/{_W}vMerge")
                    if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and c in open_cells:
                        k = open_cells[c]
                        rows[k] = (*rows[k][:7], rows[k][7] + 1, rows[k][8])
                    else:
                        open_cells[c] = len(rows)
                        rows.append((doc, position, "table", "\n".join(text(p) for p in tc.iter(f"{_W}p")).strip(), None, r, c, 1, wide))
                    c += wide
    return rows


def xlsx_rows(doc: str, data: bytes) -> list[tuple]:
    """Filled cells of the visible sheets of an XLSX file; the position is the sheet's number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"))
        rows: list[tuple] = []
        for n, sheet in enumerate(sheets):
            if sheet.get("state") in ("hidden", "veryHidden") or f"xl/worksheets/sheet{n + 1}.xml" not in names:
                continue
            for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{n + 1}.xml")).iter(f"{_S}c"):
                letters, number = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                v = c.find(f"{_S}v")
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else v.text if v is not None else ""
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") is None and value and re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                if value:
                    rows.append((doc, n, "table", value, None, int(number) - 1, column_number(letters), 1, 1))
    return rows


def column_number(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n - 1


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of DOCX and XLSX files below a path."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, raw in zip(f["doc"], f["content"], strict=True):
                rows = (docx_rows if doc.lower().endswith(".docx") else xlsx_rows)(doc, bytes(raw))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({c: "Int32" for c in ("position", "level", "row_index", "col_index", "row_span", "col_span")})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx}").load(path).select(stem.alias("doc"), "content").mapInPandas(run, BLOCKS)
