"""The given tables as documents of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.schema import PAGE, TABLE


def _empty(kind: str):
    return F.array().cast(kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as corpus rows; a paragraph is a line that is not blank."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return as_documents(d.select(F.col("doc_id"), F.col("text"), F.col("source"), F.col("n_chars")))


def as_documents(d: DataFrame) -> DataFrame:
    """(doc_id, text, source, n_chars) with all document columns."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda p: F.length(T.strip(p)) > 0)
    page = F.struct(F.lit(1).alias("page_num"), text.alias("text"), _empty("array<string>").alias("headings"), _empty(f"array<{TABLE}>").alias("tables"), F.lit(False).alias("is_scanned"))
    n_words = F.size(T.words(text))
    return d.select(
        "doc_id", F.col("doc_id").cast("string").alias("filepath"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("source").alias("folder_name"), F.col("n_chars").alias("file_size"), F.col("doc_id").cast("double").alias("last_modified"),
        F.sha2(text.cast("binary"), 256).alias("file_hash"), text.alias("full_text"), _empty("array<string>").alias("headings"), lines.alias("paragraphs"),
        _empty(f"array<{TABLE}>").alias("tables"), _empty("array<string>").alias("lists"), _empty("array<string>").alias("headers_footers"),
        T.keywords(text).alias("keywords"), T.page_count_estimate(n_words).alias("page_count"), F.lit(1).alias("section_count"),
        F.array(page).cast(f"array<{PAGE}>").alias("pages"), F.lit(False).alias("is_scanned_pdf"), F.lit(None).cast("array<double>").alias("embedding"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` passages as query documents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    d = as_documents(b.select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source"), F.length("text").cast("long").alias("n_chars")))
    return d.withColumnRenamed("doc_id", "query_id")


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, full_text, pages): each turn is a page."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    page = F.struct((F.col("turn") + 1).cast("int").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"), _empty("array<string>").alias("headings"), _empty(f"array<{TABLE}>").alias("tables"), F.lit(False).alias("is_scanned"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return g.select("conv_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("full_text"), "pages")


def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as documents with headings, paragraphs, lists, tables and headers, and a page for each part under a heading.

    A table has one row for each ``tr``, its cells are ``th`` and ``td``; parts
    without a heading belong to the first page. A null page is an empty document.
    """
    html = F.coalesce("html", F.lit(""))
    bare = lambda x: T.strip(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"(?U)\s+", " "))
    # Scripts and styles are no text.
    body = F.regexp_replace(html, r"(?s)<(script|style)(?: [^>]*)?>.*?</\1>", " ")

    def found(x, tags: str):
        return F.regexp_extract_all(x, F.lit(rf"(?s)<(?:{tags})(?: [^>]*)?>(.*?)</(?:{tags})>"), F.lit(1))

    def texts(x, tags: str):
        return F.filter(F.transform(found(x, tags), bare), lambda t: t != "")

    def table(x):
        rows = F.transform(found(x, "tr"), lambda r: F.transform(found(r, "th|td"), bare))
        head = F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>"))
        wide = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
        return F.struct(F.size(rows).alias("rows"), wide.alias("cols"), head.alias("headers"), rows.alias("cell_text"), F.array_join(F.flatten(rows), " ").alias("flat_text"))

    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", body.alias("body"))
    d = d.select(
        "page_id", "url", "body", texts(F.col("body"), "h[1-6]").alias("headings"), texts(F.col("body"), "p").alias("paragraphs"), texts(F.col("body"), "li").alias("lists"),
        F.transform(found(F.col("body"), "table"), table).cast(f"array<{TABLE}>").alias("tables"), texts(F.col("body"), "header|footer|nav").alias("headers_footers"),
        bare(F.col("body")).alias("full_text"), F.split("body", r"(?=<h[1-6][ >])").alias("parts"),
    )
    part = lambda x, i: F.struct((i + 1).alias("page_num"), bare(x).alias("text"), texts(x, "h[1-6]").alias("headings"), F.transform(found(x, "table"), table).cast(f"array<{TABLE}>").alias("tables"), F.lit(False).alias("is_scanned"))
    return d.select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("filepath"), F.element_at(F.split(F.coalesce("url", F.lit("")), "/"), -1).alias("filename"), F.lit("pages").alias("folder_name"),
        F.length("body").cast("long").alias("file_size"), F.col("page_id").cast("double").alias("last_modified"), F.sha2(F.col("full_text").cast("binary"), 256).alias("file_hash"),
        "full_text", "headings", "paragraphs", "tables", "lists", "headers_footers", T.keywords(F.col("full_text")).alias("keywords"),
        F.size("parts").alias("page_count"), T.section_count(F.col("headings")).alias("section_count"), F.transform("parts", part).cast(f"array<{PAGE}>").alias("pages"),
        F.lit(False).alias("is_scanned_pdf"), F.lit(None).cast("array<double>").alias("embedding"),
    )


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, headings, lists, paragraphs, headers_footers) of web pages, by tag."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def texts(tag: str):
        found = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))
        return F.transform(found, lambda x: T.strip(F.regexp_replace(x, "<[^>]*>", "")))

    return p.select("page_id", texts("h1").alias("headings"), texts("li").alias("lists"), texts("p").alias("paragraphs"), texts("footer").alias("headers_footers"))
