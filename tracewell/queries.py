"""Registered queries of the document engine, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import scores as S
from tracewell.functions import text as T
from tracewell.operators import store
from tracewell.operators.inverted import best_cosines, hashed, terms
from tracewell.operators.retrieve import keyword_top_k, retrieve
from tracewell.operators.semantic import pair_tfidf, tfidf_scores, vector_top_k
from tracewell.plans import search as P
from tracewell.sources import files, testdata as D
from tracewell.tables import cut, held_by
from tracewell.workers import spread, spread_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# DuckDB's spelling of Unicode white space and of the word rules.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = f"trim(lower(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g')), ' ')"
_KW = rf"""
list_sort(list_distinct(list_filter(list_transform(string_split_regex(coalesce(text, ''), '{_WS}+'),
  lambda w: regexp_replace(lower(w), '^[.,!?;:()\[\]"'']+|[.,!?;:()\[\]"'']+$', '', 'g')),
  lambda w: length(w) >= 4 AND regexp_full_match(w, '\p{{L}}+'))))"""
_UPPER = r"regexp_replace(upper(replace(text, 'ß', 'ss')), '[^\x00-\x7F]', '_', 'g')"
_CODES = rf"""
list_sort(list_distinct(list_filter(list_concat(
  regexp_extract_all({_UPPER}, '\b[A-Z0-9]{{2,10}}(?:-[A-Z0-9]{{2,10}})+\b'), regexp_extract_all({_UPPER}, '\b[A-Z][0-9]{{7,10}}\b')), lambda c: length(c) >= 5)))"""


@query(f"SELECT doc_id, {_NORM} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, CAST(len(k) AS INT) AS n_keywords, array_to_string(k, ' ') AS keywords FROM (SELECT doc_id, {_KW} AS k FROM documents)")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.keywords(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").alias("n_keywords"), F.array_join("k", " ").alias("keywords"))


@query(
    f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '{_WS}+'), lambda w: lower(w)), lambda w: w <> ''))), ' ') AS words, "
    "CAST(len(string_split(text, chr(10))) AS INT) AS n_paragraphs FROM conversations"
)
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.array_join(T.page_keywords(F.col("text")), " ").alias("words"), F.size(T.page_paragraphs(F.col("text"))).alias("n_paragraphs"))


@query(f"SELECT doc_id, array_to_string(c, ' ') AS codes FROM (SELECT doc_id, {_CODES} AS c FROM documents) WHERE len(c) > 0")
def ref_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", T.ref_codes(F.col("text")).alias("c"))
    return d.where(F.size("c") > 0).select("doc_id", F.array_join("c", " ").alias("codes"))


@query(
    f"""SELECT doc_id, sha256(concat_ws(chr(10), {_NORM}, 'H:',
      'P:' || coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '[^ \\s]')), lambda p: trim(lower(regexp_replace(p, '{_WS}+', ' ', 'g')), ' ')), '|'), ''),
      'L:', 'HF:', 'T:', 'PAGES:' || greatest(1, CAST(round_even(len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')) / 300.0, 0) AS INT)), 'SECTIONS:1')) AS fingerprint
    FROM documents"""
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.documents(spark, sf_dir)
    parts = ("full_text", "headings", "paragraphs", "lists", "headers_footers", "tables", "page_count", "section_count")
    return d.select("doc_id", T.fingerprint(*[F.col(c) for c in parts]).alias("fingerprint"))


@query(
    f"""SELECT doc_id, CAST(n AS INT) AS n_words, CAST(greatest(1, round_even(n / 300.0, 0)) AS INT) AS page_count, sha256(text) AS file_hash,
      CASE WHEN s <= 0 THEN '0 B' WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS size_label
    FROM (SELECT doc_id, text, n_chars AS s, len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')) AS n FROM documents)"""
)
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    return _docs(spark, sf_dir).select(
        "doc_id", n.alias("n_words"), T.page_count_estimate(n).alias("page_count"), T.content_hash(F.col("text").cast("binary")).alias("file_hash"),
        T.file_size_label(F.col("n_chars")).alias("size_label"),
    )


@query(
    r"""SELECT kind, count(*) AS n FROM (
      SELECT CASE WHEN line = upper(line) AND line <> lower(line) AND len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) < 10 THEN 'heading'
                  WHEN starts_with(line, '- ') OR starts_with(line, '* ') OR starts_with(line, '• ') OR (length(line) > 2 AND regexp_matches(line, '^[0-9][.):]')) THEN 'list'
                  ELSE 'paragraph' END AS kind
      FROM (SELECT unnest(string_split(replace(text, 'ß', 's'), chr(10))) AS line FROM documents)) GROUP BY kind"""
)
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # upper('ß') differs between engines; the kind of a line does not depend on it
    lines = _docs(spark, sf_dir).select(F.explode(F.split(F.replace("text", F.lit("ß"), F.lit("s")), "\n")).alias("line"))
    return lines.groupBy(T.classify_line(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, (len(text) < 150 AND turn % 2 > 0) OR len(text) < 20 AS scanned,
      CASE WHEN len(role) > len(text) THEN role WHEN len(role) > 0 THEN trim(text || chr(10) || role, chr(10) || ' ') ELSE text END AS merged, turn FROM conversations"""
)
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", T.is_scanned(F.col("text"), F.col("turn") % 2).alias("scanned"), T.merge_ocr(F.col("text"), F.col("role")).alias("merged"))


@query(
    """SELECT conv_id, p[1] || chr(10) || chr(10) || array_to_string(p, chr(10) || chr(10)) AS full_text,
      CASE WHEN length(trim(p[1])) > 0 THEN p[1] ELSE array_to_string(p, chr(10) || chr(10)) END AS front, CAST(len(string_split(p[1], chr(10))) AS INT) AS n_paragraphs
    FROM (SELECT conv_id, list(text ORDER BY turn) AS p FROM conversations GROUP BY conv_id)"""
)
def page_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.conversation_documents(spark, sf_dir)
    d = d.withColumn("s", T.page_scope(F.col("pages"), F.col("full_text"), F.lit(1)))
    return d.select("conv_id", "s.full_text", T.front_text(F.col("pages"), F.col("full_text")).alias("front"), F.size("s.paragraphs").alias("n_paragraphs"))


@query(
    """SELECT arg_min(doc_id, doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)"""
)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(
    """SELECT doc_id, file_hash FROM (SELECT doc_id, sha256(text) AS file_hash,
      row_number() OVER (PARTITION BY sha256(text) ORDER BY length(text) DESC, doc_id DESC, CAST(doc_id AS VARCHAR)) AS r FROM documents) WHERE r = 1"""
)
def dedup_keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keep_longest(D.documents(spark, sf_dir)).select("doc_id", "file_hash")


@query(
    """SELECT d.doc_id, d.source AS folder_name, d.n_chars AS file_size, length(d.text) AS text_chars, e.label AS label
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
)
def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("filepath", F.col("doc_id"))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("filepath"), "label")
    index = d.select("filepath", F.col("source").alias("folder_name"), F.col("n_chars").alias("file_size"))
    out = store.join_index(index, d.select("filepath", F.length("text").cast("long").alias("text_chars")), e)
    return out.select(F.col("filepath").alias("doc_id"), "folder_name", "file_size", "text_chars", "label")


@query(
    """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS kept FROM documents"""
)
def prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("filepath"))
    keep, gone = store.prune(d, spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("filepath")))
    out = keep.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
    return out.select(F.col("filepath").alias("doc_id"), "kept")


@query(
    """WITH i AS (SELECT doc_id, n_chars + (doc_id % 3 = 0)::INT AS size, doc_id + (doc_id % 5 = 0)::INT * 2.0 AS mtime FROM documents WHERE doc_id % 7 <> 0),
      s AS (SELECT doc_id, n_chars AS size, doc_id::DOUBLE AS mtime FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN i.doc_id IS NULL THEN 'insert'
      WHEN abs(s.mtime - i.mtime) < 1.0 THEN 'skip' ELSE 'update' END AS action FROM s FULL JOIN i ON s.doc_id = i.doc_id"""
)
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated scan and index over all documents: files that are new, gone, touched or resized."""
    d = _docs(spark, sf_dir)
    h = F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")
    scan = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("filepath"), F.col("n_chars").alias("file_size"), F.col("doc_id").cast("double").alias("last_modified"), h)
    size = (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("file_size")
    time = (F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 2.0).otherwise(0.0)).alias("last_modified")
    index = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("filepath"), size, time, h)
    return store.plan_index(scan, index).select(F.col("filepath").alias("doc_id"), "action")


@query(
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return store.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", ["ts", "event_id"])


@query(
    """SELECT a.page_id, CASE WHEN len(a.f) = 0 AND len(b.f) = 0 THEN 100.0::DOUBLE WHEN len(a.f) = 0 OR len(b.f) = 0 THEN 0.0::DOUBLE
      ELSE len(list_intersect(a.f, b.f)) * 100.0::DOUBLE / len(list_distinct(list_concat(a.f, b.f))) END AS score
    FROM (SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?s)<footer(?: [^>]*)?>(.*?)</footer>', 1), lambda x: trim(lower(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))), lambda x: x <> '')) AS f FROM pages) a
    JOIN (SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?s)<footer(?: [^>]*)?>(.*?)</footer>', 1), lambda x: trim(lower(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))), lambda x: x <> '')) AS f FROM pages) b
    ON b.page_id = a.page_id + 1""".replace("\\\\s", "\\s")
)
def header_footer_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.page_documents(spark, sf_dir).select("page_id", "headers_footers")
    other = p.select((F.col("page_id") - 1).alias("page_id"), F.col("headers_footers").alias("o"))
    return p.join(other, "page_id").select("page_id", S.header_footer_ratio(F.col("headers_footers"), F.col("o")).alias("score"))


_PAIR_SQL = f"""
WITH q AS (SELECT item_id, {_KW} AS k FROM benchmark), d AS (SELECT doc_id, {_KW} AS k FROM documents),
qs AS (SELECT item_id, len(k) AS nq, unnest(k) AS w FROM q), ds AS (SELECT doc_id, len(k) AS nd, unnest(k) AS w FROM d),
p AS (SELECT item_id AS query_id, doc_id, count(*) * 100.0::DOUBLE / (nq + nd - count(*)) AS keyword_score FROM qs JOIN ds USING (w) GROUP BY item_id, doc_id, nq, nd)
"""


@query(
    _PAIR_SQL
    + """SELECT query_id, doc_id, keyword_score, CAST(r AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, doc_id) AS r FROM p) WHERE r <= 5"""
)
def keyword_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_top_k(D.benchmark_queries(spark, sf_dir), D.documents(spark, sf_dir), 5, boost=False)


@query(
    f"""WITH q AS (SELECT doc_id, unnest({_CODES}) AS code FROM documents), c AS (SELECT DISTINCT code FROM q),
    h AS (SELECT doc_id, 'DOC-' || doc_id || ' ' || upper(replace(text, 'ß', 'ss')) AS hay FROM documents), m AS (SELECT doc_id, code FROM h JOIN c ON contains(hay, code))
    SELECT q.doc_id AS query_id, m.doc_id AS doc_id, least(40.0::DOUBLE, count(*) * 20.0::DOUBLE) AS boost FROM q JOIN m USING (code) GROUP BY 1, 2"""
)
def ref_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a reference code of a document, and the boost of their pair."""
    from tracewell.operators.retrieve import code_boosts

    d = D.documents(spark, sf_dir)
    return code_boosts(d.withColumnRenamed("doc_id", "query_id"), d)


@query(
    """SELECT query_id, doc_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
          greatest(0.0, least(100.0, 100.0::DOUBLE * list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
            / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(d.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))) AS score
        FROM embeddings q JOIN embeddings d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)) WHERE r <= 10"""
)
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = vector_top_k(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id"), 10)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_TFIDF = r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(substring(text, 1, 4000)), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    n AS (SELECT count(*) + 1 AS n FROM documents),
    qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(substring(text, 1, 4000)), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark) GROUP BY 1, 2),
    w AS (SELECT item_id, term, qt.tf AS qtf, ln((1 + n) / (1 + coalesce(df, 0) + 1)::DOUBLE) + 1 AS w FROM qt LEFT JOIN df USING (term) CROSS JOIN n),
    b AS (SELECT doc_id, term, tf, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS w0 FROM tf JOIN df USING (term) CROSS JOIN n),
    dn AS (SELECT doc_id, sum((tf * w0) ** 2) AS sq FROM b GROUP BY 1), qn AS (SELECT item_id, sum((qtf * w) ** 2) AS qsq FROM w GROUP BY 1),
    p AS (SELECT item_id, doc_id, sum(qtf * w * tf * w) AS dot, sum((tf * w) ** 2 - (tf * w0) ** 2) AS more FROM w JOIN b USING (term) GROUP BY 1, 2)
    """
# Scores of 0 to 100.
_COSINE = "greatest(0.0, least(100.0, 100.0 * dot / sqrt(qsq * (sq + more))))"


@query(_TFIDF + f"SELECT item_id AS query_id, doc_id, round({_COSINE}, 4) AS semantic FROM p JOIN dn USING (doc_id) JOIN qn USING (item_id)")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tfidf_scores(D.benchmark_queries(spark, sf_dir), D.documents(spark, sf_dir))
    return out.select("query_id", "doc_id", F.round("semantic", 4).alias("semantic"))


@query(
    _TFIDF
    + f"""SELECT query_id, doc_id, round(s, 4) AS semantic, CAST(r AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM (
        SELECT item_id AS query_id, doc_id, round({_COSINE}, 9) AS s FROM p JOIN dn USING (doc_id) JOIN qn USING (item_id))) WHERE r <= 10"""
)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the largest TF-IDF cosine of each passage, common words read for candidates alone."""
    out = best_cosines(D.benchmark_queries(spark, sf_dir), D.documents(spark, sf_dir), 10)
    return out.select("query_id", "doc_id", F.round("semantic", 4).alias("semantic"), "rank")


_NUM = "CASE WHEN {a} <= 0 OR {b} <= 0 THEN CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 100.0::DOUBLE * least({a}, {b}) / greatest({a}, {b}) END"


@query(
    f"""WITH p AS (SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS a, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INT) AS b,
      CAST(len(regexp_extract_all(html, '<h1[ >]')) AS INT) AS c, CAST(len(regexp_extract_all(html, '<table[ >]')) AS INT) AS d FROM pages)
    SELECT page_id, round((x + y + z + t) / 4.0::DOUBLE, 6) AS structure,
      CASE WHEN a <= 0 OR b <= 0 THEN 0.0::DOUBLE ELSE greatest(60.0::DOUBLE, round(x, 6)) END AS page_sequence,
      CASE WHEN x >= 95 THEN '95-99% Match (Near-Identical Document)' WHEN x >= 90 THEN '90-94% Match (Highly Similar Document)' ELSE 'Standard Match' END AS category
    FROM (SELECT *, {_NUM.format(a='a', b='b')} AS x, {_NUM.format(a='b', b='c')} AS y, {_NUM.format(a='c', b='d')} AS z, {_NUM.format(a='d', b='d')} AS t FROM p)"""
)
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = [F.regexp_count("html", F.lit(f"<{t}[ >]")) for t in ("p", "li", "h1", "table")]
    p = p.select("page_id", *[c.alias(x) for c, x in zip(n, "abcd", strict=True)])
    x, y, z, t = (S.count_ratio(F.col(u), F.col(v)) for u, v in ("ab", "bc", "cd", "dd"))
    seq = S.page_sequence_similarity(F.col("a"), F.col("b"))
    return p.select("page_id", F.round(S.structure_score(x, y, z, t), 6).alias("structure"), F.round(seq, 6).alias("page_sequence"), S.match_category(x, F.lit(False)).alias("category"))


@query(
    """SELECT doc_id, round((e * 0.35 + CASE WHEN q THEN p * 0.25 ELSE 0 END + e * 0.15) / (0.5 + CASE WHEN q THEN 0.25 ELSE 0 END), 6) AS content FROM (
      SELECT doc_id, (n_chars % 101)::DOUBLE AS e, (doc_id % 101)::DOUBLE AS p, doc_id % 2 = 0 AS q FROM documents)"""
)
def weighted_content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted, renormalised mean over synthetic part scores of all documents."""
    e, p, zero = (F.col("n_chars") % 101).cast("double"), (F.col("doc_id") % 101).cast("double"), F.lit(0.0)
    parts = {"text": e, "paragraphs": p, "headings": zero, "tables": zero, "lists": zero, "headers_footers": zero, "front_page": e}
    on = {"paragraphs": F.col("doc_id") % 2 == 0} | {k: F.lit(False) for k in ("headings", "tables", "lists", "headers_footers")}
    return _docs(spark, sf_dir).select("doc_id", F.round(S.content_score(parts, on), 6).alias("content"))


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page paired with the next one."""
    p = D.page_documents(spark, sf_dir)
    other = p.select((F.col("page_id") - 1).alias("page_id"), *[F.col(c).alias(f"o_{c}") for c in ("headings", "lists", "paragraphs", "headers_footers")])
    # Few bytes, each pair of them dear: spread them over all cores.
    return p.join(other, "page_id").repartition(spread(spark), "page_id")


@query()
def fuzzy_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent structural scores of adjacent pages."""
    s = S.scorer
    return _adjacent(spark, sf_dir).select(
        "page_id", s("heading_similarity")("headings", "o_headings").alias("headings"), s("list_similarity")("lists", "o_lists").alias("lists"),
        s("header_footer_similarity")("headers_footers", "o_headers_footers").alias("headers_footers"),
        s("section_sequence_similarity")("headings", "o_headings").alias("sections"), s("paragraph_similarity")("paragraphs", "o_paragraphs").alias("paragraphs"),
    )


@query()
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjacent(spark, sf_dir).select("page_id", S.list_ratio(F.col("paragraphs"), F.col("o_paragraphs"), 60.0).alias("score"))


@query()
def ordered_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered coverage of each passage in all its candidates."""
    q, d = D.benchmark_queries(spark, sf_dir), D.documents(spark, sf_dir)
    found = cut(retrieve(q, d, C.MAX_CANDIDATES).select("query_id", "doc_id"))
    d = held_by(d, found, "doc_id")
    pairs = found.join(q.select("query_id", F.col("full_text").alias("a")), "query_id").join(d.select("doc_id", F.col("full_text").alias("b")), "doc_id")
    pairs = pairs.repartition(spread(spark), "query_id", "doc_id")
    return pairs.select("query_id", "doc_id", S.scorer("ordered_coverage")("a", "b").alias("coverage"), S.scorer("text_similarity")("a", "b").alias("similarity"))


@query()
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(D.benchmark_queries(spark, sf_dir), D.documents(spark, sf_dir), 5)


@query()
def deep_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All verdict columns of the candidates of each passage, as a search compares them."""
    return P.search(D.benchmark_queries(spark, sf_dir), D.documents(spark, sf_dir))


@query()
def structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with headings, tables, lists and headers compared in depth: those with an id divisible by 20 as queries
    against all pages, by the first of their parts (the front page) and as a whole."""
    d = D.structured_documents(spark, sf_dir)
    q = d.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return P.search(q, d, max_candidates=5)


@query()
def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: accepted sources of each passage, best five, as report lines."""
    top = P.best(P.accepted(deep_compare(spark, sf_dir), 70.0))
    line = P.report(top).select("query_id", "doc_id", "line")
    return top.select("query_id", "doc_id", "place", "overall_score", "confidence_score", "text_coverage", "match_category").join(line, ["query_id", "doc_id"])


@query()
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary(deep_compare(spark, sf_dir))


# --- Operators over rows that are derived from the given tables -----------------------------

# Starts and style names that the classes depend on.
_STARTS = ("", "- ", "* ", "• ", "1. ", "2) ", "(a) ", "(1) ", "9: ", "A")
_STYLES = ("Heading 1", "Title", "heading 2", "List Bullet", "Normal", None, "Subtitle", "Heading 3")


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks: text with a start, font size, weight and style by place."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.col("conv_id") * 7 + F.col("turn")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    text = F.when(n % 11 == 3, F.lit(" \n ")).otherwise(F.concat(pick(_STARTS), F.substring("text", 1, 60)))
    return c.select("conv_id", "turn", "role", text.alias("text"), pick(_STYLES).alias("style"), (F.lit(9.0) + n % 6).alias("font"), (n % 3 == 0).alias("bold"))


_TURNS = f"""SELECT conv_id, turn, role, n, CASE WHEN n % 11 = 3 THEN ' ' || chr(10) || ' ' ELSE {_sql_list(_STARTS)}[n % {len(_STARTS)} + 1] || substring(text, 1, 60) END AS text,
  {_sql_list(_STYLES)}[n % {len(_STYLES)} + 1] AS style, 9.0 + n % 6 AS font, n % 3 = 0 AS bold FROM (SELECT *, conv_id * 7 + turn AS n FROM conversations)"""
_N_WORDS = f"len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> ''))"
_BULLET = "(starts_with(text, '- ') OR starts_with(text, '* ') OR starts_with(text, '• '))"


@query(
    f"""SELECT conv_id, turn, CASE WHEN font >= 13 OR (bold AND {_N_WORDS} < 12) THEN 'heading'
      WHEN {_BULLET} OR starts_with(text, '1.') OR starts_with(text, '2.') OR starts_with(text, '3.') OR starts_with(text, '(a)') OR starts_with(text, '(1)') THEN 'list' ELSE 'paragraph' END AS kind FROM ({_TURNS})"""
)
def block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.classify_block(F.col("text"), F.col("font"), F.col("bold")).alias("kind"))


_STYLED = f"""CASE WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN 'blank' WHEN regexp_matches(lower(coalesce(style, '')), 'heading|title') THEN 'heading'
  WHEN contains(lower(coalesce(style, '')), 'list') OR {_BULLET} OR (length(text) > 2 AND regexp_matches(text, '^[0-9][.):]')) THEN 'list' ELSE 'paragraph' END"""


@query(f"SELECT conv_id, turn, {_STYLED} AS kind FROM ({_TURNS})")
def styled_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.classify_styled(F.col("text"), F.col("style")).alias("kind"))


@query(
    f"""SELECT conv_id, array_to_string(list_concat(list_concat(['H'], list(text ORDER BY turn)), list_concat(list_filter(list(CASE WHEN turn % 2 = 0 THEN role ELSE '' END ORDER BY turn), lambda c: c <> ''), ['F'])), chr(10) || chr(10)) AS full_text
    FROM ({_TURNS}) GROUP BY conv_id"""
)
def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(""))
    g = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", cell.alias("cell")))).alias("b"))
    return g.select("conv_id", T.assemble_text(F.array(F.lit("H")), F.col("b.text"), F.col("b.cell"), F.array(F.lit("F"))).alias("full_text"))


@query(
    r"""SELECT page_id, CAST(greatest(1, len(regexp_extract_all(html, '(?s)<h1(?: [^>]*)?>(.*?)</h1>', 1)) + 1) AS INT) AS sections FROM pages"""
)
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_documents(spark, sf_dir).select("page_id", T.section_count(F.col("headings")).alias("sections"))


@query(
    """SELECT conv_id, CAST(count(*) AS INT) AS n_rows, CAST(max(len(list_slice(string_split(text, ' '), 1, (turn + 2)))) AS INT) AS n_cols,
      arg_min(array_to_string(list_transform(list_slice(string_split(text, ' '), 1, turn + 2), lambda c: trim(c, ' ' || chr(10) || chr(9))), '|'), turn) AS headers,
      string_agg(nullif(array_to_string(list_filter(list_transform(list_slice(string_split(text, ' '), 1, turn + 2), lambda c: trim(c, ' ' || chr(10) || chr(9))), lambda c: c <> ''), ' '), ''), ' ' ORDER BY turn) AS flat_text
    FROM conversations GROUP BY conv_id"""
)
def flat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a table: a row for each turn, its first words as cells."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    row = F.slice(F.split("text", " "), F.lit(1), (F.col("turn") + 2).cast("int"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("cells")))).alias("r"))
    g = g.select("conv_id", T.flat_table(F.col("r.cells")).alias("t"))
    return g.select("conv_id", F.col("t.rows").alias("n_rows"), F.col("t.cols").alias("n_cols"), F.array_join("t.headers", "|").alias("headers"), "t.flat_text")


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query(
    f"""SELECT conv_id, coalesce(string_agg(CASE WHEN t <> '' THEN '<' || tag || '>' || {_esc('t')} || '</' || tag || '>' END, chr(10) ORDER BY turn) || chr(10), '')
        || '<table>' || string_agg('<tr>' || c.cell || '</tr>', '' ORDER BY turn) || '</table>' AS html
    FROM (SELECT *, trim(text, ' ' || chr(10) || chr(9)) AS t, CASE WHEN regexp_matches(lower(coalesce(style, '')), 'heading 1|title') THEN 'h1' WHEN contains(lower(coalesce(style, '')), 'heading 2') THEN 'h2'
        WHEN contains(lower(coalesce(style, '')), 'heading') THEN 'h3' ELSE 'p' END AS tag, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM ({_TURNS})),
      LATERAL (SELECT CASE WHEN r = 1 THEN '<th>' || {_esc('role')} || '</th>' ELSE '<td>' || {_esc('role')} || '</td>' END AS cell) c GROUP BY conv_id"""
)
def rendered_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with styles, and a table of their roles."""
    g = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "style", "role"))).alias("b"))
    paragraphs = F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["style"].alias("style")))
    return g.select("conv_id", files.html_of(paragraphs, F.array(F.transform("b", lambda x: F.array(x["role"]))), F.lit(None)).alias("html"))


@query("SELECT doc_id, '[Unreadable Document: ' || 'doc-' || doc_id || ']' AS full_text FROM documents")
def unreadable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.unreadable(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("full_text"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/' || source || '/b/' || doc_id WHEN 1 THEN 'b/' || doc_id WHEN 2 THEN '/' || doc_id ELSE '../' || source END AS filepath FROM documents"""
)
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    p = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("//"), F.col("source"), F.lit("/a/../b//./"), i, F.lit("/")))
    p = p.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\\\\?\\./a/../b/"), i)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/../../"), i))
    return _docs(spark, sf_dir).select("doc_id", T.canonical_path(p.otherwise(F.concat(F.lit("x/../../"), F.col("source")))).alias("filepath"))


@query(
    f"""SELECT conv_id, p[k] || chr(10) || chr(10) || everything AS full_text, CAST(len(string_split(p[k], chr(10))) AS INT) AS n_paragraphs, h[k] AS heading,
      array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p[k]), '{_WS}+'), lambda w: w <> ''))), ' ') AS keywords, CAST(1 AS INT) AS page_count, CAST(0 AS INT) AS n_lists
    FROM (SELECT conv_id, least(greatest(conv_id % 5, 1), len(p)) AS k, p, h, array_to_string(p, chr(10) || chr(10)) AS everything FROM (
      SELECT conv_id, list(text ORDER BY turn) AS p, list(role ORDER BY turn) AS h FROM conversations GROUP BY conv_id))"""
)
def page_scope_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten to one of their pages; a page's heading is its role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    none = F.array().cast(f"array<{D.TABLE}>")
    page = F.struct((F.col("turn") + 1).cast("int").alias("page_num"), "text", F.array("role").alias("headings"), none.alias("tables"), F.lit(False).alias("is_scanned"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page_num"] - b["page_num"]).alias("pages"))
    full = F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n")
    s = T.page_scope(F.col("pages"), full, (F.col("conv_id") % 5).cast("int"))
    g = g.select("conv_id", s.alias("s"))
    return g.select(
        "conv_id", "s.full_text", F.size("s.paragraphs").alias("n_paragraphs"), F.col("s.headings")[0].alias("heading"),
        F.array_join("s.keywords", " ").alias("keywords"), "s.page_count", F.size("s.lists").alias("n_lists"),
    )


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    return store.delete(_docs(spark, sf_dir).select("doc_id", "n_chars"), gone, "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def looked_up_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("filepath"))
    return store.lookup(_docs(spark, sf_dir).select(F.col("doc_id").alias("filepath"), "n_chars"), keys).select(F.col("filepath").alias("doc_id"), "n_chars")


@query("SELECT CAST(max(n_chars) AS INT) AS stored, CAST(6 AS INT) AS updated, CAST(0 AS INT) AS missing, CAST(0 AS INT) AS unreadable FROM documents")
def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index version read from key-value rows: stored, after an update, missing, and no number."""
    top = _docs(spark, sf_dir).agg(F.max("n_chars").cast("string").alias("value"))
    meta = top.select(F.lit("index_version").alias("key"), "value").unionByName(top.select(F.lit("other").alias("key"), "value"))
    got = [
        store.index_version(m).withColumnRenamed("index_version", n)
        for n, m in (("stored", meta), ("updated", store.set_index_version(meta, C.INDEX_VERSION)), ("missing", meta.where("key = 'other'")), ("unreadable", meta.withColumn("value", F.lit("x1"))))
    ]
    return got[0].join(got[1]).join(got[2]).join(got[3])  # one row each


@query(
    """SELECT vec_id, greatest(1, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END) AS version, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN label + 100 ELSE label END AS embedding FROM embeddings"""
)
def sticky_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of every third row; where it has no value in the sticky column, the older one stays."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.lit(1).alias("version"), F.col("label").alias("embedding"))
    new = e.where("vec_id % 3 = 0").withColumn("version", F.lit(2)).withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding") + 100))
    return store.upsert(e, new, "vec_id", ["version"])


@query(
    """SELECT doc_id, h AS file_hash FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY coalesce(h, '') ORDER BY n_chars // 500 DESC, doc_id % 5 DESC, doc_id) AS r FROM (
      SELECT doc_id, n_chars, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '' ELSE 'h' || (n_chars % 97) END AS h FROM documents)) WHERE r = 1"""
)
def longest_of_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keep-longest rule with ties of length and time, and with null hashes."""
    h = F.when(F.col("doc_id") % 29 == 0, F.lit(None)).when(F.col("doc_id") % 31 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), (F.col("n_chars") % 97).cast("string")))
    text = F.repeat(F.lit("x"), F.floor(F.col("n_chars") / 500).cast("int"))
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("filepath"), h.alias("file_hash"), text.alias("full_text"), (F.col("doc_id") % 5).alias("last_modified"))
    return store.keep_longest(d).select(F.col("filepath").alias("doc_id"), "file_hash")


@query(
    """SELECT s.doc_id, CASE WHEN i.doc_id IS NULL THEN 'insert' WHEN s.n % 3 = 0 THEN 'update' WHEN s.n % 2 = 0 OR s.n % 5 <> 0 THEN 'skip' ELSE 'update' END AS action
    FROM (SELECT doc_id, doc_id AS n FROM documents) s LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) i USING (doc_id)"""
)
def index_plan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning by time (every third differs), then size (odd ones differ), then hash (every fifth differs)."""
    n = F.col("doc_id")
    d = _docs(spark, sf_dir).select(n.alias("filepath"), F.col("n_chars").alias("file_size"), n.cast("double").alias("last_modified"), F.lit("same").alias("file_hash"))
    n = F.col("filepath")
    old = d.where("filepath % 7 <> 0").select(
        "filepath", (F.col("file_size") + n % 2).alias("file_size"), (F.col("last_modified") + F.when(n % 3 == 0, 1.0).otherwise(0.5)).alias("last_modified"),
        F.when(n % 5 == 0, F.lit("old")).otherwise(F.lit("same")).alias("file_hash"),
    )
    return store.plan_index(d, old).select(F.col("filepath").alias("doc_id"), "action")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'insert' ELSE 'update' END AS action FROM documents")
def forced_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an older version: all its documents are updated, unchanged ones too."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("filepath"), F.col("n_chars").alias("file_size"), F.lit(1.0).alias("last_modified"), F.lit("h").alias("file_hash"))
    return store.plan_index(d, d.where("filepath % 7 <> 0"), stored_version=C.INDEX_VERSION - 1).select(F.col("filepath").alias("doc_id"), "action")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars % 50 DESC, CAST(doc_id AS VARCHAR)) AS pos FROM documents")
def corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("filepath"), (F.col("n_chars") % 50).alias("last_modified"))
    return store.positions(d).select("doc_id", "pos")


_MATCHES = """SELECT doc_id % 40 AS query_id, doc_id, doc_id AS rank, 'f' || doc_id AS filename, (n_chars * 37 % 10001) / 100.0::DOUBLE AS overall_score, (n_chars * 53 % 10001) / 100.0::DOUBLE AS confidence_score,
  (n_chars % 5)::DOUBLE AS content_score, (n_chars % 3)::DOUBLE AS structure_score, n_chars % 4 = 0 AND doc_id % 40 <> 3 OR doc_id % 40 = 5 AS rejected, n_chars % 9 = 0 AS verified_source,
  CASE WHEN n_chars % 9 = 0 THEN 'best page' ELSE '' END AS match_basis, (n_chars * 3 % 101)::DOUBLE AS front_coverage FROM documents"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compared candidates of forty queries, with made-up scores; one query has rejected ones only."""
    n, q = F.col("n_chars"), F.col("doc_id") % 40
    verified = n % 9 == 0
    return _docs(spark, sf_dir).select(
        q.alias("query_id"), "doc_id", F.col("doc_id").alias("rank"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"),
        (n * 37 % 10001 / 100.0).alias("overall_score"), (n * 53 % 10001 / 100.0).alias("confidence_score"), (n % 5).cast("double").alias("content_score"),
        (n % 3).cast("double").alias("structure_score"), (((n % 4 == 0) & (q != 3)) | (q == 5)).alias("rejected"), verified.alias("verified_source"),
        F.when(verified, F.lit("best page")).otherwise(F.lit("")).alias("match_basis"), (n * 3 % 101).cast("double").alias("front_coverage"),
    )


_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rejected, overall_score DESC, CASE WHEN rejected THEN 0 ELSE content_score END DESC, CASE WHEN rejected THEN 0 ELSE structure_score END DESC, rank) AS position FROM ({_MATCHES})"""
_BEST = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overall_score DESC, position) AS place FROM (SELECT *, bool_or(NOT rejected) OVER (PARTITION BY query_id) AS ok FROM ({_RANKED})) WHERE NOT rejected OR NOT ok"""


@query(f"SELECT query_id, doc_id, CAST(position AS INT) AS position FROM ({_RANKED})")
def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ranked(_matches(spark, sf_dir)).select("query_id", "doc_id", "position")


@query(f"SELECT query_id, doc_id, overall_score FROM ({_MATCHES}) WHERE NOT rejected AND (overall_score >= 70 OR verified_source)")
def accepted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accepted(_matches(spark, sf_dir), 70.0).select("query_id", "doc_id", "overall_score")


@query(f"SELECT query_id, doc_id FROM ({_MATCHES}) WHERE NOT rejected AND verified_source AND front_coverage >= 85")
def front_page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accepted(_matches(spark, sf_dir), 70.0, front_page_only=True).select("query_id", "doc_id")


@query(f"SELECT query_id, doc_id, CAST(place AS INT) AS place FROM ({_BEST}) WHERE place <= 5")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best(P.ranked(_matches(spark, sf_dir))).select("query_id", "doc_id", "place")


@query(
    f"""SELECT query_id, doc_id FROM (SELECT *, bool_or(overall_score >= 97) OVER (PARTITION BY query_id) AS high FROM ({_BEST}) WHERE place <= 20)
    WHERE CASE WHEN high THEN overall_score >= 97 ELSE place <= 5 END"""
)
def shown_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shown(P.best(P.ranked(_matches(spark, sf_dir)), 20), 97.0).select("query_id", "doc_id")


@query(
    f"""SELECT query_id, doc_id, printf('Match: %.1f%% | Confidence: %.1f%% | File: %s', overall_score, confidence_score, filename) || CASE WHEN verified_source THEN ' [VERIFIED SOURCE - ' || upper(match_basis) || ']' ELSE '' END AS line FROM ({_MATCHES})"""
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.report(_matches(spark, sf_dir))


@query(f"SELECT query_id, count(*) AS compared, count_if(rejected)::BIGINT AS n_rejected, count_if(verified_source)::BIGINT AS n_verified FROM ({_MATCHES}) GROUP BY query_id")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary(_matches(spark, sf_dir))


@query(
    f"""SELECT doc_id, CASE WHEN verified_source THEN 'PERFECT ORIGINAL SOURCE MATCH (Verified)' WHEN overall_score >= 95 THEN '95-99% Match (Near-Identical Document)'
      WHEN overall_score >= 90 THEN '90-94% Match (Highly Similar Document)' ELSE 'Standard Match' END AS category FROM ({_MATCHES})"""
)
def match_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("doc_id", S.match_category(F.col("overall_score"), F.col("verified_source")).alias("category"))


_PARTS = (("text", 0.35, 1), ("paragraphs", 0.25, 2), ("headings", 0.2, 3), ("tables", 0.1, 5), ("lists", 0.05, 7), ("headers_footers", 0.05, 11), ("front_page", 0.15, 1))


@query(
    "SELECT doc_id, round((" + " + ".join(f"CASE WHEN doc_id % {m} = 0 THEN (n_chars % {90 + i}) * {w} ELSE 0 END" for i, (_, w, m) in enumerate(_PARTS))
    + ")::DOUBLE / (" + " + ".join(f"CASE WHEN doc_id % {m} = 0 THEN {w} ELSE 0 END" for _, w, m in _PARTS) + ")::DOUBLE, 6) AS content FROM documents"
)
def content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renormalised mean over all seven parts, each of which some documents lack."""
    parts = {p: (F.col("n_chars") % (90 + i)).cast("double") for i, (p, _, _) in enumerate(_PARTS)}
    on = {p: F.col("doc_id") % m == 0 for p, _, m in _PARTS if m > 1}
    return _docs(spark, sf_dir).select("doc_id", F.round(S.content_score(parts, on), 6).alias("content"))


@query(
    r"""WITH p AS (SELECT item_id AS query_id, doc_id, coalesce(b.text, '') AS a, coalesce(d.text, '') AS b FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40),
    t AS (SELECT query_id, doc_id, 0 AS side, unnest(regexp_extract_all(lower(substring(a, 1, 4000)), '[\p{L}\p{N}_]{2,}')) AS term FROM p
      UNION ALL SELECT query_id, doc_id, 1, unnest(regexp_extract_all(lower(substring(b, 1, 4000)), '[\p{L}\p{N}_]{2,}')) FROM p),
    c AS (SELECT query_id, doc_id, term, count_if(side = 0) AS x, count_if(side = 1) AS y FROM t GROUP BY ALL),
    w AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS w FROM c),
    s AS (SELECT query_id, doc_id, sum(x * y) AS xy, sum((x * w) ** 2) AS xx, sum((y * w) ** 2) AS yy FROM w GROUP BY ALL)
    SELECT p.query_id, p.doc_id, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 100 WHEN xx > 0 AND yy > 0 THEN 100.0 * xy / sqrt(xx * yy) ELSE 0 END::DOUBLE, 4) AS semantic
    FROM p LEFT JOIN s USING (query_id, doc_id)"""
)
def pair_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF similarity fitted on each pair alone; a passage is paired with every fortieth document."""
    words = hashed(terms(F.col("text")))  # of each text once, below the join
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("a"), words.alias("a_terms"), (F.col("item_id") % 40).alias("k"))
    d = spread_rows(_docs(spark, sf_dir), "doc_id").select("doc_id", F.col("text").alias("b"), words.alias("b_terms"), (F.col("doc_id") % 40).alias("k"))
    return pair_tfidf(b.join(d, "k")).select("query_id", "doc_id", F.round("semantic", 4).alias("semantic"))
