"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again before the next stage; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, near_dedup, packing, pii, quality
from tracewell.llm.common import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Secret of the surrogates; a real run passes its own.
KEY = "corpus-pipeline"


def drop_poor_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = quality.fit(docs, labels, F.lit(True))
    rated = quality.rate(docs, ranking, {c: F.col(c) for c in COLUMNS})
    return rated.where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8).

    Rows of one id and text count as one; a row without an id stays.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return once.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data in all texts."""
    out = pii.pseudonymise(docs.select(*COLUMNS), KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all words, sources weighted 5, 2, 1 and never repeated.

    A document of which the mix takes less than half its words stays out; that
    is one document of a source at most. A row without an id stays.
    """
    mixed = mixing.mix(docs, share=0.9, most=1.0, seed="pipeline")
    taken = mixed.where((F.col("taken") * 2 >= F.col("size")) & ((F.col("taken") > 0) | (F.col("size") == 0))).select("doc_id").distinct()
    return docs.join(taken, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; one row for each piece, with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_poor_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the trained classifier, so the chain has none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
