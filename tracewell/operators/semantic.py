"""TF-IDF and vector similarity of queries and documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.constants import SEMANTIC_CHARS
from tracewell.operators.inverted import build_index, cosines, hashed, lists, terms
from tracewell.workers import prepare, spread_rows


def tfidf_scores(queries: DataFrame, corpus: DataFrame, query_key: str = "query_id", doc_key: str = "doc_id", text: str = "full_text", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_key, doc_key, semantic) for pairs that share a term.

    Weights are fitted for each query over that query and the whole corpus: a
    term's document frequency is the corpus's, plus one where the query holds it.
    idf is ln((1 + n) / (1 + df)) + 1 with n documents, vectors have length one,
    and the cosine is times 100. A document's length depends on the query only
    by the terms they share, so the corpus is weighted once and corrected.
    """
    return cosines(queries, build_index(corpus, doc_key, text, stop_words), None, query_key, doc_key, text)


def _pair_scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, semantic) of (query_id, doc_id, fixed, a, b): ``fixed`` or the cosine of words a and b."""
    alone = math.log(1.5) + 1
    for batch in it:
        sides = [lists(batch.column(c)) for c in ("a", "b")]
        pair, word = (np.concatenate(x) for x in zip(*sides, strict=True))
        side = np.repeat([0, 1], [len(w) for _, w in sides])
        order = np.lexsort((word, pair))
        pair, word, side = pair[order], word[order], side[order]
        new = np.r_[True, (pair[1:] != pair[:-1]) | (word[1:] != word[:-1])][: len(pair)]
        term, of = np.cumsum(new) - 1, pair[new]
        y = np.bincount(term, side, minlength=len(of))
        x = np.bincount(term, minlength=len(of)) - y
        w = np.where((x > 0) & (y > 0), 1.0, alone)
        xy, xx, yy = (np.bincount(of, v, minlength=batch.num_rows) for v in (x * y, (x * w) ** 2, (y * w) ** 2))
        score = np.where((xx > 0) & (yy > 0), 100.0 * xy / np.sqrt(np.maximum(xx * yy, 1e-300)), 0.0)
        fixed = batch.column("fixed").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.where(np.isnan(fixed), score, fixed))], ["query_id", "doc_id", "semantic"])


def pair_tfidf(pairs: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, semantic) of pairs with texts a and b, TF-IDF fitted on the two texts alone.

    An empty text gives 0, equal texts 100, two texts without terms 0. A term of one text has
    document frequency 1 of 2, a common one 2 of 2. Each pair is counted where it is:
    nothing is shuffled. Columns a_terms and b_terms, if there, are the texts' hashed terms.
    """
    prepare(pairs.sparkSession)
    a, b = (F.coalesce(c, F.lit("")) for c in "ab")
    fixed = F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 100.0)
    found = [F.col(f"{c}_terms") if f"{c}_terms" in pairs.columns else hashed(terms(F.col(c), stop_words)) for c in "ab"]
    base = pairs.select("query_id", "doc_id", fixed.alias("fixed"), found[0].alias("a"), found[1].alias("b"))
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id"))
    return base.mapInArrow(_pair_scores, f"{kinds}, semantic double")


#: Query vectors of a block, which each task of the corpus gets once.
QUERY_BLOCK = 512


def _against(block, k: int | None, distinct: bool):
    """Scores of a task's vectors for a block of queries, a matrix product a batch; the best ``k`` of each query leave the task.

    ``block`` broadcasts {dimension: (query ids, vectors of length one or zero)};
    ``distinct`` leaves out vectors whose id is the query's.
    """

    def rows(ids: np.ndarray, docs: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(score, pa.float64())], ["query_id", "doc_id", "score"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        best = {dim: [(np.zeros(0, np.int64), np.zeros(0))] * len(ids) for dim, (ids, _) in queries.items()}
        for batch in it:
            doc, col = batch.column("doc_id").to_numpy(), batch.column("dv")
            flat, at = col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.diff(col.offsets.to_numpy()))]
            size = np.diff(at)
            for dim, (ids, unit) in queries.items():
                mine = np.flatnonzero(size == dim)
                if not len(mine):
                    continue
                y = flat[at[mine][:, None] + np.arange(dim)]
                norm = np.linalg.norm(y, axis=1)
                score = (100.0 * (unit @ y.T) / np.where(norm == 0, 1e-9, norm)).clip(0.0, 100.0)
                found = doc[mine]
                for i, own in enumerate(ids):
                    ok = found != own if distinct else slice(None)
                    d, x = found[ok], score[i][ok]
                    if k is None:
                        yield rows(np.full(len(d), own), d, x)
                        continue
                    d, x = np.concatenate([best[dim][i][0], d]), np.concatenate([best[dim][i][1], x])
                    first = np.lexsort((d, -x))[:k]
                    best[dim][i] = d[first], x[first]
        for dim, (ids, _) in queries.items():
            for own, (d, x) in zip(ids, best[dim], strict=True):
                yield rows(np.full(len(d), own), d, x)

    return run


def _by_blocks(queries: DataFrame, corpus: DataFrame, k: int | None, distinct: bool) -> DataFrame:
    """(query_id, doc_id, score) of (query_id, qv) and (doc_id, dv), all in long and array<double>.

    The driver sees a block of QUERY_BLOCK query vectors at a time and sends it to
    each task once; the corpus is read once a block.
    """
    spark = corpus.sparkSession
    prepare(spark)
    q = queries.where(F.size("qv") > 0)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    found = []
    for i in range(blocks):
        some = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow().to_pylist()
        by_dim: dict[int, tuple[list, list]] = {}
        for r in some:
            ids, vectors = by_dim.setdefault(len(r["qv"]), ([], []))
            ids.append(r["query_id"])
            vectors.append(r["qv"])
        sent = {}
        for dim, (ids, vectors) in by_dim.items():
            x = np.array(vectors, float)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            sent[dim] = ids, x / np.where(norm == 0, 1.0, norm)
        found.append(corpus.where(F.size("dv") > 0).mapInArrow(_against(spark.sparkContext.broadcast(sent), k, distinct), "query_id long, doc_id long, score double"))
    return reduce(DataFrame.unionByName, found)


def _vectors(df: DataFrame, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(names[0]), F.col(vector).cast("array<double>").alias(names[1]))


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_key: str = "query_id", doc_key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """The k corpus vectors of the largest cosine for each query vector, other than the vector of its own id.

    Queries are a stated set, taken in blocks. A query without a vector or with an
    empty one has no rows; vectors of other lengths are not compared.
    """
    q, d = _vectors(queries, query_key, vector, ("query_id", "qv")), _vectors(corpus, doc_key, vector, ("doc_id", "dv"))
    return top_k(_by_blocks(q, spread_rows(d, "doc_id"), k, True), k)


def top_k(pairs: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Rows with a rank up to k in each query; ties go to the smaller doc_id.

    Spark turns the rank filter into a limit on each partition before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def embed(docs: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, text: str = "full_text") -> DataFrame:
    """Adds ``embedding``: the model's vector of each text's first characters.

    The model takes a batch of texts; without one all vectors are empty.
    """
    prepare(docs.sparkSession)
    encode = model or (lambda texts: [[] for _ in texts])

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(map(float, v)) for v in encode([t or "" for t in texts.to_pylist()])], pa.list_(pa.float64()))

    return docs.withColumn("embedding", run(F.substring(F.coalesce(text, F.lit("")), 1, SEMANTIC_CHARS)))


def vector_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, semantic) from embedding columns, in place of TF-IDF; an empty vector has no rows."""
    keyed = queries.select("query_id", F.xxhash64("query_id").alias("key"), "embedding")  # query ids of any type
    q, d = _vectors(keyed, "key", "embedding", ("query_id", "qv")), _vectors(corpus, "doc_id", "embedding", ("doc_id", "dv"))
    found = _by_blocks(q, d, None, False).withColumnRenamed("query_id", "key")
    return found.join(keyed.select("query_id", "key"), "key").select("query_id", "doc_id", F.col("score").alias("semantic"))
