"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import embed_dedup, lang_id, line_dedup, lm_score, media, mixing, near_dedup, packing, passages, pii, quality, schema_drift, spelling
from tracewell.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), "tracewell")
    return out.select("row.doc_id", F.size("kinds").cast("long").alias("n_entities"), "kinds", "row.text")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    ranking = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return quality.rate(docs, ranking, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = lang_id.fit(docs.where(~held_out))
    return lang_id.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = schema_drift.with_digests(schema_drift.rewrite_clients(_table(spark, sf_dir, "clients")))
    version = F.crc32(F.concat(F.lit("7:"), F.col("file_no").cast("string")).cast("binary")) % 24
    return files.select(
        "file_no", F.when(version > 15, 0).otherwise(version).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256",
        "start_columns", "columns", "path", "rewritten", "drift",
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = (
    op1_pii_surrogates,
    op2_embedding_near_dedup,
    op3_best_fit_packing,
    op4_minhash_near_dedup,
    op5_lm_scoring,
    op6_quality_classifier,
    op7_language_id,
    op8_source_mixing,
    op9_media_columns,
    op10_substring_dedup,
    op11_schema_drift,
    op12_line_dedup,
    op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: The mix as SQL: water-filling over sources, then each source's documents in
#: the order of their hash.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size,
             CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio,
             sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN f IS NULL THEN cap ELSE least(cap, w * f) END AS target
      FROM (SELECT *, max(CASE WHEN level < ratio THEN level END) OVER () AS f FROM l)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
p AS (SELECT *, CAST(round(target) AS BIGINT) - passes * source_size AS rest FROM g),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.rest,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
             CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS tied
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + CASE WHEN upto <= rest THEN size WHEN upto - tied >= rest THEN 0
                                 ELSE floor(size * (rest - (upto - tied)) / greatest(tied, 1)) END AS BIGINT) AS taken
FROM o
"""


#: Lines of each document in order, the keys in three documents or more, and what is left of each text.
LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT r, doc_id, line, i,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.doc_id, k.line, k.i, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mixing": MIX_SQL, "op12_line_dedup": LINES_SQL}
