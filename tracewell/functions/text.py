"""Text and document features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as Unicode has it, which is wider than Java's plain \\s.
SPACE = r"(?U)\s+"
# How list items begin.
_BULLETS = ("- ", "* ", "• ", "1.", "2.", "3.", "(a)", "(1)")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column) -> Column:
    """White space runs become one blank, letters lower, ends stripped; null is empty."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " ")))


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), SPACE), lambda w: w != "")


def keywords(x: Column) -> Column:
    """Sorted distinct lower-case words of four letters or more, outer punctuation stripped."""
    edge = r"""^[.,!?;:()\[\]"']+|[.,!?;:()\[\]"']+$"""
    bare = F.transform(words(x), lambda w: F.regexp_replace(F.lower(w), edge, ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$"))))


def page_keywords(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words(x), lambda w: F.lower(w))))


def page_paragraphs(x: Column) -> Column:
    return F.split(x, "\n", -1)


def ref_codes(x: Column) -> Column:
    """Sorted distinct reference codes: hyphenated groups, or a letter and 7 to 10 digits."""
    up = F.upper(F.coalesce(x, F.lit("")))
    grouped = F.regexp_extract_all(up, F.lit(r"(?U)\b[A-Z0-9]{2,10}(?:-[A-Z0-9]{2,10})+\b"), F.lit(0))
    plain = F.regexp_extract_all(up, F.lit(r"(?U)\b[A-Z][0-9]{7,10}\b"), F.lit(0))
    return F.array_sort(F.filter(F.array_union(grouped, plain), lambda c: F.length(c) >= 5))


def matched_codes(codes: Column, filename: Column, full_text: Column) -> Column:
    """The codes that occur anywhere in a document's name or text."""
    hay = F.upper(F.concat(F.coalesce(filename, F.lit("")), F.lit(" "), F.coalesce(full_text, F.lit(""))))
    return F.filter(codes, lambda c: F.contains(hay, c))


def front_text(pages: Column, full_text: Column) -> Column:
    first = F.try_element_at(pages, F.lit(1))["text"]
    return F.when(F.length(strip(first)) > 0, first).otherwise(full_text)


def page_count_estimate(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n_words / 300.0).cast("int"))


def section_count(headings: Column) -> Column:
    return F.greatest(F.lit(1), F.size(headings) + 1)


def is_scanned(text: Column, images: Column) -> Column:
    return ((F.length(text) < 150) & (images > 0)) | (F.length(text) < 20)


def merge_ocr(text: Column, ocr: Column) -> Column:
    """A longer recognised text replaces the page's own; a shorter one is appended."""
    return F.when(F.length(ocr) > F.length(text), ocr).when(F.length(ocr) > 0, strip(F.concat(text, F.lit("\n"), ocr))).otherwise(text)


def _starts(x: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def classify_block(text: Column, max_font: Column, bold: Column) -> Column:
    """heading, list or paragraph, by font and leading characters."""
    heading = (max_font >= 13) | (bold & (F.size(words(text)) < 12))
    return F.when(heading, F.lit("heading")).when(_starts(text, _BULLETS), F.lit("list")).otherwise(F.lit("paragraph"))


def classify_line(text: Column) -> Column:
    """heading, list or paragraph of a plain line without layout."""
    upper = (text == F.upper(text)) & (text != F.lower(text))
    numbered = (F.length(text) > 2) & text.rlike(r"^[0-9][.):]")
    return (
        F.when(upper & (F.size(words(text)) < 10), F.lit("heading"))
        .when(_starts(text, _BULLETS[:3]) | numbered, F.lit("list"))
        .otherwise(F.lit("paragraph"))
    )


def classify_styled(text: Column, style: Column) -> Column:
    """blank, heading, list or paragraph by a paragraph's style name and start."""
    s = F.lower(F.coalesce(style, F.lit("")))
    listed = s.contains("list") | _starts(text, _BULLETS[:3]) | ((F.length(text) > 2) & text.rlike(r"^[0-9][.):]"))
    return (
        F.when(F.length(strip(text)) == 0, F.lit("blank"))
        .when(s.rlike("heading|title"), F.lit("heading"))
        .when(listed, F.lit("list"))
        .otherwise(F.lit("paragraph"))
    )


def assemble_text(headers: Column, body: Column, cells: Column, footers: Column) -> Column:
    """Header parts, body texts, table cells that are not empty and footer parts, by blank lines."""
    return F.array_join(F.concat(headers, body, F.filter(cells, lambda c: F.length(c) > 0), footers), "\n\n")


def one_decimal(x: Column) -> Column:
    """A number >= 0 with one decimal, rounded by its exact binary value, halves to even.

    Java rounds the shortest decimal form, halves up. Here twenty times the
    number is taken exactly, as a sum of two doubles and its rounding error, and
    compared with the odd number that marks the half.
    """
    x = x.cast("double")
    a, b = x * 16.0, x * 4.0
    total = a + b
    lost = (a - (total - (total - a))) + (b - (total - a))
    tenths = F.floor(x * 10.0)
    beyond = (total - (tenths * 2 + 1).cast("double")) + lost
    up = (beyond > 0) | ((beyond == 0) & (tenths % 2 == 1))
    rounded = tenths + F.when(up, 1).otherwise(0)
    return F.when(x.isNotNull(), F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string")))


def file_size_label(n: Column) -> Column:
    out = F.when(n <= 0, F.lit("0 B"))
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(n < 1024 ** (i + 1), F.concat(one_decimal(n / float(1024**i)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(n / float(1024**4)), F.lit(" TB")))


def content_hash(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def fingerprint(full_text: Column, headings: Column, paragraphs: Column, lists: Column, headers_footers: Column, tables: Column, page_count: Column, sections: Column) -> Column:
    """SHA-256 of the normalised content, part by part, and the two counts."""
    def part(tag: str, items: Column) -> Column:
        return F.concat(F.lit(tag), F.array_join(F.transform(items, normalize_text), "|"))

    flat = F.transform(tables, lambda t: t["flat_text"])
    parts = [
        normalize_text(full_text), part("H:", headings), part("P:", paragraphs), part("L:", lists), part("HF:", headers_footers),
        part("T:", flat), F.concat(F.lit("PAGES:"), page_count.cast("string")), F.concat(F.lit("SECTIONS:"), sections.cast("string")),
    ]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def canonical_path(p: Column) -> Column:
    """A path without long-path prefix, doubled separators, '.' and '..' steps; null stays null."""
    p = F.regexp_replace(p, r"^\\\\\?\\", "")
    root = F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit(""))

    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        # '..' at the root stays there, at the start of a relative path it is kept
        keep = ~s.isin("", ".") & ~((s == "..") & (root == "/"))
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(keep, F.concat(done, F.array(s))).otherwise(done)

    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    out = F.concat(root, F.array_join(parts, "/"))
    return F.when(p == "", p).when(out == "", F.lit(".")).otherwise(out)


def unreadable(name: Column) -> Column:
    return F.concat(F.lit("[Unreadable Document: "), name, F.lit("]"))


def modified_label(epoch: Column) -> Column:
    """Minute of a time in seconds, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm")


def flat_table(cells: Column) -> Column:
    """The struct of a table from its rows of cells; the first row holds the headers."""
    trimmed = F.transform(cells, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    width = F.coalesce(F.array_max(F.transform(trimmed, lambda r: F.size(r))), F.lit(0))
    flat = F.array_join(F.filter(F.flatten(trimmed), lambda c: c != ""), " ")
    return F.struct(
        F.size(trimmed).alias("rows"), width.alias("cols"), F.coalesce(F.try_element_at(trimmed, F.lit(1)), F.array().cast("array<string>")).alias("headers"),
        trimmed.alias("cell_text"), flat.alias("flat_text"),
    )


def page_scope(pages: Column, full_text: Column, page: Column) -> Column:
    """A query document rewritten to one of its pages (from 1, clamped)."""
    at = F.least(F.greatest(page, F.lit(1)), F.size(pages))
    p = F.element_at(pages, at)
    return F.struct(
        F.concat(p["text"], F.lit("\n\n"), full_text).alias("full_text"), p["headings"].alias("headings"), p["tables"].alias("tables"),
        page_paragraphs(p["text"]).alias("paragraphs"), page_keywords(p["text"]).alias("keywords"), F.array().cast("array<string>").alias("lists"),
        F.lit(1).alias("page_count"), F.lit(1).alias("section_count"), F.array(p).alias("pages"),
    )


def prefix(x: Column, n: int) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, n)


