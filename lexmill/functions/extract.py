"""Values taken from texts of records, catalogues, sheets and file names.  Null texts read as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import record_text, text_or_empty

# What a certificate or project number begins with, and the characters around one that are not of it.
CERTIFICATES = ("TC", "STC", "PMA", "MDA", "CTSOA", "VTC", "VSTC", "VDA", "TDA", "TSOA")
AROUND = " ,;；，。:："
RECORD_DATE = r"(?U)\b(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])\b"
CATALOG_DATE = r"(?<![0-9])([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?(?![0-9])"
DATE_RESIDUE = " ,;、，；:：()（）[]【】"
CTSO = r"(?iU)\bCTSO[-\s]?C[0-9]{1,4}[A-Z]?\b"


def strip_of(c: Column, chars: str) -> Column:
    """``c`` without the characters at either end."""
    return F.btrim(c, F.lit(chars))


def certificate(c: Column) -> Column:
    """The first certificate or project number: one of the known kinds, else the first token of four characters or more
    that holds both a digit and a letter, without the punctuation around it; else null."""
    t = text_or_empty(c)
    named = F.regexp_extract(t, rf"(?iU)\b(?:{'|'.join(CERTIFICATES)})[A-Z0-9-]*\b", 0)
    tokens = F.transform(F.split(record_text(t), " "), lambda w: strip_of(w, AROUND))
    mixed = F.filter(tokens, lambda w: (F.char_length(w) >= 4) & w.rlike(r"\p{Nd}") & w.rlike(r"\p{L}"))
    return F.coalesce(F.nullif(named, F.lit("")), F.get(mixed, F.lit(0)))


def _without_first(c: Column, part: Column) -> Column:
    at = F.instr(c, part)
    return F.when(part.isNull() | (part == "") | (at == 0), c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.char_length(part), F.char_length(c))))


def holder(c: Column, certificate_: Column, date: Column, most: int = 120) -> Column:
    """What is left of a record without its certificate, its date and all other dates: the holder or the name's begin, at most
    ``most`` characters; null if nothing is left."""
    rest = F.regexp_replace(_without_first(_without_first(text_or_empty(c), certificate_), date), RECORD_DATE, "")
    return F.nullif(F.substring(record_text(rest), 1, most), F.lit(""))


def catalog_date(c: Column) -> Column:
    """struct(date, signal): the greatest of the dates in a cell as YYYY-MM-DD, and what is odd about it: no date in a filled cell, several
    dates, or text beside the date."""
    t = record_text(F.replace(text_or_empty(c), F.lit("　"), F.lit(" ")))
    part = lambda i: F.regexp_extract_all(t, F.lit(CATALOG_DATE), F.lit(i))
    dates = F.transform(F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), lambda p: F.concat_ws("-", p["y"], F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0")))
    n = F.size(dates)
    rest = record_text(strip_of(F.regexp_replace(t, CATALOG_DATE, " "), DATE_RESIDUE))
    signal = F.when(t == "", None).when(n == 0, "date_parse_failed").when(n > 1, "date_multiple_candidates").when(rest != "", "date_text_contains_extra")
    return F.struct(F.array_max(dates).alias("date"), signal.alias("signal"))


def explicit_codes(c: Column) -> Column:
    """The standard codes that a text names, in upper case without blanks, each once in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(record_text(text_or_empty(c)), F.lit(CTSO), F.lit(0)), lambda m: F.replace(F.upper(m), F.lit(" "), F.lit(""))))


def without_wrap_blanks(c: Column) -> Column:
    """White space folded, and none between Chinese characters, where only the layout put it."""
    return F.regexp_replace(record_text(text_or_empty(c)), r"(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])", "")


def sheet_value(c: Column) -> Column:
    """A sheet's number as text: whole numbers without a point."""
    whole = c == F.floor(c)
    return F.when(c.isNull(), "").when(whole, F.floor(c).cast("string")).otherwise(F.trim(c.cast("string")))


def sheet_column(index: Column) -> Column:
    """Letters of a column counted from 1 (less counts as 1): A, ..., Z, AA, ...; any length, by a fold over base-26 digits."""
    n = F.greatest(index.cast("long"), F.lit(1))
    step = lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).alias("n"), F.concat(F.char(F.lit(65) + (s["n"] - 1) % 26), s["t"]).alias("t"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.alias("n"), F.lit("").alias("t")), step, lambda s: s["t"])


def sheet_range(row0: Column, col0: Column, row1: Column, col1: Column) -> Column:
    return F.concat(sheet_column(col0), row0.cast("string"), F.lit(":"), sheet_column(col1), row1.cast("string"))


def ranges_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two ranges (least row, least column, greatest row, greatest column) share a cell."""
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def part_doc_id(parent: Column, index: Column) -> Column:
    """An id for a document's part that is safe as a file name: other characters become hyphens, and an id that changed or is longer than
    80 gets twelve digits of its hash."""
    p = text_or_empty(parent)
    safe = strip_of(F.regexp_replace(p, "[^A-Za-z0-9._-]+", "-"), "-._")
    digest = F.substring(F.sha1(F.encode(p, "utf-8")), 1, 12)
    name = F.when(safe == "", F.concat(F.lit("doc-"), digest)).when((safe != p) | (F.char_length(safe) > 80), F.concat_ws("-", strip_of(F.substring(safe, 1, 67), "-._"), digest)).otherwise(safe)
    return F.concat(name, F.lit("-part-"), index.cast("string"))


# What opens a line that keeps a line of its own in the reader, and what ends a paragraph.
READER_WORDS = ["SECTION", "SUBPART", "APPENDIX", "MODULE", "Article", r"AMC\d*", r"GM\d*", r"ED\s+Decision", r"Regulation\s+\(EU\)", r"[A-Z]{1,6}(?:\.[A-Z0-9]+){1,4}\s+"]
READER_MARKS = [r"(?:[-*•·−–—]|\d+[.)、])\s+", r"[（(]\s*(?:\d+|[a-z]{1,4})\s*[)）]\s+", r"\d{1,2}(?:\.\d+){1,5}\s+\S", rf"(?:{'|'.join(READER_WORDS)})\b"]
READER_ITEM = rf"(?i)^(?:{'|'.join(READER_MARKS)})"


def reader_text(c: Column) -> Column:
    """Wrapped lines put together to paragraphs, with blank lines between; a line that opens an item begins a paragraph of its own.

    A fold over the lines: a hyphen before a small letter joins a word; a paragraph that is no item ends with its sentence, an item's
    where a sentence has ended and the next line begins with a capitalised word."""
    lines = F.filter(F.transform(F.split(text_or_empty(c), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"), F.lit("").alias("last"), F.lit(False).alias("item"))

    def state(done: Column, open_: Column, last: Column, item: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), last.alias("last"), item.alias("item"))

    def closed(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))

    def step(s: Column, line: Column) -> Column:
        item = line.rlike(READER_ITEM)
        after = s["item"] & s["last"].rlike(r"[。！？.!?；;]$") & line.rlike("^[A-Z][a-z]")
        word = s["open"].rlike("[A-Za-z]-$") & line.rlike("^[a-z]")
        joined = F.when(s["open"] == "", line).when(word, F.concat(F.substring(s["open"], F.lit(1), F.char_length(s["open"]) - 1), line)).otherwise(F.concat(s["open"], F.lit(" "), line))
        text, inside = F.when(after, line).otherwise(joined), s["item"] & ~after
        done = F.when(after, closed(s)).otherwise(s["done"])
        ends = ~inside & line.rlike(r"[。！？.!?；;:]$")
        return F.when(item, state(closed(s), line, line, F.lit(True))).when(ends, state(F.array_append(done, text), F.lit(""), F.lit(""), F.lit(False))).otherwise(state(done, text, line, inside))

    def whole(lines: Column) -> Column:
        folded = F.aggregate(lines, start, step, lambda s: F.array_join(closed(s), "\n\n"))
        return F.when(F.size(lines) < 2, F.coalesce(F.get(lines, F.lit(0)), F.lit(""))).otherwise(folded)

    return F.get(F.transform(F.array(lines), whole), F.lit(0))  # the lines are cut once


def tags(role: Column, page_type: Column, parser: Column, kind: Column) -> Column:
    """Structure tags of an entry, each once; empty values give none."""
    pairs = [("role", role), ("page", page_type), ("parser", parser), ("kind", kind)]
    return F.array_distinct(F.filter(F.array(*[F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{k}:"), v)) for k, v in pairs]), lambda t: t.isNotNull()))


def audit_placeholder(role: Column, index_policy: Column, missing_reason: Column) -> Column:
    """A row that stands for a page without content, not for parsed content."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (low(role) == "parse_artifact") & (low(index_policy) == "skip") & low(missing_reason).isin("ocr_empty_text", "page_without_extractable_content")
