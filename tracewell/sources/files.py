"""Document files: directory scans, Word packages and pluggable page parsers."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.constants import EXTENSIONS, LOCK_PREFIX
from tracewell.functions import text as T
from tracewell.schema import PAGE, TABLE
from tracewell.workers import prepare

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(filepath, filename, folder_name, file_size, last_modified, content) of Word files.

    Lock files are left out; a missing folder gives no rows. Content is read only
    where a later step asks for it.
    """
    endings = "|".join(e[1:] for e in EXTENSIONS)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("filename", name).where(F.lower("filename").rlike(rf"\.({endings})$") & ~F.startswith("filename", F.lit(LOCK_PREFIX)))
    return files.select(
        T.canonical_path(F.regexp_replace("path", "^file:/+", "/")).alias("filepath"), "filename", F.element_at(F.split("path", "/"), -2).alias("folder_name"),
        F.col("length").alias("file_size"), F.col("modificationTime").cast("double").alias("last_modified"), "content",
    )


#: What elements of a run stand for.
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _text(node: ET.Element) -> str:
    """The text of a paragraph's runs, tabs and breaks included; tab stops of its style are none."""
    runs = (e for r in node.iter(f"{_W}r") for e in r)
    return "".join((e.text or "") if e.tag == f"{_W}t" else _MARKS.get(e.tag, "") for e in runs)


def _table(node: ET.Element) -> list[list[str]]:
    """Rows of cell texts; a cell over several columns or rows stands in each of them."""
    out: list[list[str]] = []
    for row in node.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(map(_text, cell.findall(f"{_W}p"))).strip()
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and out and len(cells) < len(out[-1]):
                text = out[-1][len(cells)]
            cells += [text] * (int(span.get(f"{_W}val")) if span is not None else 1)
        out.append(cells)
    return out


def read_docx(content: bytes) -> dict:
    """Paragraphs with style names, tables, and header and footer texts of a package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        titles = {}
        if "word/styles.xml" in names:
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                label = s.find(f"{_W}name")
                titles[s.get(f"{_W}styleId")] = label.get(f"{_W}val") if label is not None else ""
        out: dict = {"paragraphs": [], "tables": [], "header": [], "footer": []}
        for node in body:
            if node.tag == f"{_W}p":
                style = node.find(f"{_W}pPr/{_W}pStyle")
                key = style.get(f"{_W}val") if style is not None else ""
                out["paragraphs"].append({"text": _text(node).strip(), "style": titles.get(key, key)})
            elif node.tag == f"{_W}tbl":
                out["tables"].append(_table(node))
        for name in sorted(names):
            found = re.fullmatch(r"word/(header|footer)\d*\.xml", name)
            if found:
                words = [t.text for t in ET.fromstring(z.read(name)).iter(f"{_W}t") if t.text]
                joined = " ".join(words).strip()
                if joined and joined not in out[found[1]]:
                    out[found[1]].append(joined)
    return out


_RAW = "filepath string, paragraphs array<struct<text:string,style:string>>, cells array<array<array<string>>>, header array<string>, footer array<string>, readable boolean"


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([
        ("filepath", pa.string()), ("paragraphs", pa.list_(pa.struct([("text", pa.string()), ("style", pa.string())]))),
        ("cells", pa.list_(pa.list_(pa.list_(pa.string())))), ("header", pa.list_(pa.string())), ("footer", pa.list_(pa.string())), ("readable", pa.bool_()),
    ])
    for batch in it:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                d = read_docx(content)
                rows.append((path, d["paragraphs"], d["tables"], d["header"], d["footer"], True))
            except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, TypeError):
                rows.append((path, [], [], [], [], False))
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)


def docx_documents(files: DataFrame) -> DataFrame:
    """All document columns of scanned Word files; an unreadable file keeps a row that says so."""
    prepare(files.sparkSession)
    facts = files.select("filepath", "filename", "folder_name", "file_size", "last_modified", T.content_hash(F.col("content")).alias("file_hash"))
    raw = files.select("filepath", "content").mapInArrow(_parse, _RAW).join(facts, "filepath")
    kind = lambda p: T.classify_styled(p["text"], p["style"])
    of = lambda k: F.transform(F.filter("paragraphs", lambda p: kind(p) == k), lambda p: p["text"])
    body = F.transform(F.filter("paragraphs", lambda p: kind(p) != "blank"), lambda p: p["text"])
    tables = F.transform("cells", T.flat_table)
    cells = F.flatten(F.transform(tables, lambda t: F.flatten(t["cell_text"])))
    out = raw.withColumn("__body", body).withColumn("__cells", F.filter(cells, lambda c: c != "")).withColumn("tables", tables)
    text = F.when(F.col("readable"), T.assemble_text(F.col("header"), F.col("__body"), F.col("__cells"), F.col("footer"))).otherwise(T.unreadable(F.col("filename")))
    words = F.size(T.words(F.array_join(F.concat("__body", "__cells"), " ")))
    out = out.withColumn("full_text", text).withColumn("headings", of("heading")).withColumn("lists", of("list")).withColumn("__par", of("paragraph"))
    page = F.struct(F.lit(1).alias("page_num"), F.col("full_text").alias("text"), F.col("headings"), F.col("tables"), F.lit(False).alias("is_scanned"))
    out = out.select(
        "filepath", "filename", "folder_name", "file_size", "last_modified", "file_hash", "full_text", "headings", F.col("__par").alias("paragraphs"),
        F.col("tables").cast(f"array<{TABLE}>").alias("tables"), "lists", F.concat("header", "footer").alias("headers_footers"), T.keywords(F.col("full_text")).alias("keywords"),
        T.page_count_estimate(words).alias("page_count"), T.section_count(F.col("headings")).alias("section_count"),
        F.array(page).cast(f"array<{PAGE}>").alias("pages"), F.lit(False).alias("is_scanned_pdf"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    return out.withColumn("fingerprint", T.fingerprint(*[F.col(c) for c in ("full_text", "headings", "paragraphs", "lists", "headers_footers", "tables", "page_count", "section_count")]))


def page_documents(blocks: DataFrame, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(filepath, full_text, headings, lists, paragraphs, keywords, pages, is_scanned_pdf) from page rows.

    ``blocks`` has one row for each page that a parser read: filepath, page_num,
    text, images (a number), image (bytes), blocks (array of text, max_font,
    bold) and cells (array of tables of rows of cells). ``ocr`` turns the image
    of a scanned page into text; without it such pages keep theirs.
    """
    prepare(blocks.sparkSession)
    recognise = ocr or (lambda _: "")

    @F.arrow_udf("string")
    def read(image: pa.Array) -> pa.Array:
        return pa.array([recognise(b) if b else "" for b in image.to_pylist()], pa.string())

    scanned = T.is_scanned(F.col("text"), F.col("images"))
    text = F.when(scanned, T.merge_ocr(F.col("text"), read("image"))).otherwise(F.col("text"))
    kinds = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), T.classify_block(b["text"], b["max_font"], b["bold"]).alias("kind")))
    pages = blocks.select("filepath", "page_num", text.alias("text"), scanned.alias("is_scanned"), kinds.alias("kinds"), F.transform("cells", T.flat_table).alias("tables"))
    of = lambda c, k: F.transform(F.filter(c, lambda b: b["kind"] == k), lambda b: b["text"])
    page = F.struct("page_num", "text", of("kinds", "heading").alias("headings"), F.col("tables").cast(f"array<{TABLE}>").alias("tables"), "is_scanned", "kinds")
    # A file's pages are one row in the end; files are bounded by what a parser reads at once.
    docs = pages.groupBy("filepath").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page_num"] - b["page_num"]).alias("p"))
    full = F.array_join(F.transform(F.filter("p", lambda x: F.length(T.strip(x["text"])) > 0), lambda x: x["text"]), "\n\n")
    every = F.flatten(F.transform("p", lambda x: x["kinds"]))
    return docs.select(
        "filepath", full.alias("full_text"), of(every, "heading").alias("headings"), of(every, "list").alias("lists"), of(every, "paragraph").alias("paragraphs"),
        T.keywords(full).alias("keywords"), F.transform("p", lambda x: x.dropFields("kinds")).alias("pages"), F.exists("p", lambda x: x["is_scanned"]).alias("is_scanned_pdf"),
    )


def _escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _tagged(name: Column, x: Column) -> Column:
    return F.concat(F.lit("<"), name, F.lit(">"), _escape(x), F.lit("</"), name, F.lit(">"))


def html_of(paragraphs: Column, cells: Column, full_text: Column) -> Column:
    """A document as HTML: paragraphs in order, each heading by its level, then tables.

    ``paragraphs`` are structs of text and style, ``cells`` tables of rows of cells,
    the first row a head. Without either the lines of the text are paragraphs.
    """
    def tag(style: Column) -> Column:
        s = F.lower(F.coalesce(style, F.lit("")))
        return F.when(s.contains("heading 1") | s.contains("title"), F.lit("h1")).when(s.contains("heading 2"), F.lit("h2")).when(s.contains("heading"), F.lit("h3")).otherwise(F.lit("p"))

    def row(cells: Column, i: Column) -> Column:
        kind = F.when(i == 0, F.lit("th")).otherwise(F.lit("td"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: _tagged(kind, T.strip(c))), ""), F.lit("</tr>"))

    body = F.transform(F.filter(paragraphs, lambda p: F.length(T.strip(p["text"])) > 0), lambda p: _tagged(tag(p["style"]), T.strip(p["text"])))
    tables = F.transform(cells, lambda t: F.concat(F.lit("<table>"), F.array_join(F.transform(t, row), ""), F.lit("</table>")))
    lines = F.filter(F.transform(F.split(F.coalesce(full_text, F.lit("")), "\n"), T.strip), lambda x: F.length(x) > 0)
    plain = F.transform(lines, lambda x: _tagged(F.lit("p"), x))
    chunks = F.concat(body, tables)
    chunks = F.when(F.size(paragraphs) + F.size(cells) > 0, chunks).otherwise(plain)
    return F.when(F.size(chunks) > 0, F.array_join(chunks, "\n")).otherwise(F.lit("<p>[No extractable content]</p>"))


def render_html(docs: DataFrame) -> DataFrame:
    """(filepath, html) of documents, which keep no order: headings, paragraphs, lists if there are any, tables."""
    each = lambda name, c: F.transform(c, lambda x: _tagged(F.lit(name), x))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(each("td", r), ""), F.lit("</tr>"))
    tables = F.transform("tables", lambda t: F.concat(F.lit("<table>"), F.array_join(F.transform(t["cell_text"], row), ""), F.lit("</table>")))
    lists = [each("li", F.col("lists"))] if "lists" in docs.columns else []
    return docs.select("filepath", F.array_join(F.concat(each("h2", F.col("headings")), each("p", F.col("paragraphs")), *lists, tables), "").alias("html"))


def render_files(files: DataFrame) -> DataFrame:
    """(filepath, html) of scanned Word files, in order and by style; an unreadable one shows its text, which says so."""
    prepare(files.sparkSession)
    names = files.select("filepath", "filename")
    raw = files.select("filepath", "content").mapInArrow(_parse, _RAW).join(names, "filepath")
    return raw.select("filepath", html_of(F.col("paragraphs"), F.col("cells"), F.when(~F.col("readable"), T.unreadable(F.col("filename")))).alias("html"))


def plain_path(path: str) -> str:
    """A path without long-path prefix, '.' and '..' steps."""
    return posixpath.normpath(re.sub(r"^\\\\\?\\", "", path)) if path else ""
