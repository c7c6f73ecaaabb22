"""Near-duplicate vectors by spherical-cap filters from random product codes.

A filter is a direction: one random unit codeword from each of two halves of a
randomly rotated space. With C codewords a half there are C**2 filters, and the
best one of a vector is the pair of its best codewords. Each vector is
list-decoded to all filters within ``slack`` of its best score, and asks the
bucket of its best filter alone (Becker, Ducas, Gama and Laarhoven, 2016). Two
independent codes do this, so a pair is lost only where both miss it.

How likely is that? For unit vectors x and y of cosine 0.98 the difference has
length 0.2; on a random direction in 64 dimensions it has deviation 0.025. y
misses x's filter only if its score there is the slack below its own best score:
two such differences, of deviation 0.035 together. The slack is 3.7 of these
(1e-4), and two codes make it 1e-8. A 64-bit sign sketch drops pairs whose signs
differ in more places than expected at the threshold and six deviations (4 and 6
times 2 at 0.98) before vectors are fetched; all that remain are verified in
double precision. Slack and signs follow from the threshold and the dimension.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, prepare
from tracewell.llm.components import connected_components

CODES, CODEWORDS = 2, 128
_SEED = 20_240_101


def slack_of(least: float, dim: int) -> float:
    """How far below its best score a vector's filters reach."""
    return 3.7 * math.sqrt(2.0) * math.sqrt(max(0.0, 2.0 - 2.0 * least) / max(1, dim))


def signs_of(least: float) -> int:
    """How many of 64 random signs may differ."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(64 * p + 6 * math.sqrt(64 * p * (1 - p)))


class ProductCode:
    """A rotation and a random codebook for each half of the rotated space."""

    def __init__(self, dim: int, words: int, seed: int):
        rng = np.random.default_rng([_SEED, dim, words, seed])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = (dim + 1) // 2
        self.books = [self._unit(rng.standard_normal((words, n))) for n in (self.half, dim - self.half)]
        self.words = words

    @staticmethod
    def _unit(a: np.ndarray) -> np.ndarray:
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)

    def decode(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best filter of each row; (row, filter) of all filters within slack of it."""
        z = x @ self.rotation
        s = z[:, : self.half] @ self.books[0].T
        t = z[:, self.half :] @ self.books[1].T
        best = s.argmax(1) * self.words + t.argmax(1)
        least = s.max(1) + t.max(1) - slack * np.sqrt(2.0)
        row, a = np.nonzero(s >= (least - t.max(1))[:, None])
        k, b = np.nonzero(t[row] >= (least[row] - s[row, a])[:, None])
        return best, row[k], a[k] * self.words + b


def _unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v) -> bool:
    if not v or any(c is None for c in v):
        return False
    a = np.array(v, np.float64)
    return bool(np.isfinite(a).all() and a.any())


def _decode(codes: int, words: int, least: float):
    names = ["node", "filter", "asks", "label", "sketch"]

    def run(it):
        books: dict = {}
        for batch in it:
            node, label, vec = (batch.column(i).to_pylist() for i in range(3))
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vec):
                by.setdefault(len(v), []).append(i)
            for dim, mine in by.items():
                if dim not in books:
                    rng = np.random.default_rng([_SEED, dim])
                    books[dim] = [ProductCode(dim, words, c) for c in range(codes)], rng.standard_normal((dim, 64))
                codebooks, planes = books[dim]
                for lo in range(0, len(mine), 512):
                    part = mine[lo : lo + 512]
                    x = _unit_rows([vec[i] for i in part])
                    bits = (x @ planes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)
                    sketch = bits.sum(1, dtype=np.uint64).astype(np.int64)
                    nodes, labels = np.array([node[i] for i in part]), np.array([label[i] for i in part])
                    for c, code in enumerate(codebooks):
                        best, row, filt = code.decode(x, slack_of(least, dim))
                        asks = best[row] == filt
                        key = (filt + words * words * (c + codes * dim)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (nodes[row], key, asks, labels[row], sketch[row])], names)

    return run


def _confirm(least: float):
    """Verifies pairs. For each class of a batch: how many vectors link to it there, and
    the least class that links of the batch reach; so rows never count pairs."""

    def run(it):
        for batch in it:
            a, b, m, n = (batch.column(c).to_pylist() for c in ("a", "b", "m", "n"))
            links: dict[int, int] = {}
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = v = root[root[v]]
                return v

            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if len(x) == len(y):
                    u, v = np.array(x, np.float64), np.array(y, np.float64)
                    c = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v))
                    if not np.isfinite(c):  # squares beyond the range of doubles
                        u, v = _unit_rows([x])[0], _unit_rows([y])[0]
                        c = u @ v
                    if c >= least:
                        links[a[i]] = links.get(a[i], 0) + n[i]
                        links[b[i]] = links.get(b[i], 0) + m[i]
                        p, q = find(a[i]), find(b[i])
                        root[max(p, q)] = min(p, q)
            nodes = sorted(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([links[x] for x in nodes], pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "others", "root"]
            )

    return run


def _mark(it):
    for batch in it:
        ok = [_usable(v) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok)], [*batch.schema.names, "usable"])


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    codes: int = CODES,
    codewords: int = CODEWORDS,
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Linked are vectors of one label with cosine >= ``least`` in double precision.
    n_links counts the other rows linked directly, component_id is the smallest
    id that links reach, kept marks it.

    Labels may be of any type that Spark compares. Vectors that are null, empty,
    zero or hold a null or non-finite component, rows with a null label and rows
    with a null id are linked with nothing (n_links 0, component_id their own id;
    kept is false for a null id). Vectors of different lengths are not linked.
    Copies of one vector are one class and are never paired. Rows that repeat an
    id count each, with equal vectors or others. Other columns play no part.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    label = base.schema["label"].dataType.simpleString()
    marked = base.mapInArrow(_mark, f"vec_id long, label {label}, vector array<double>, usable boolean")
    key = F.when(F.col("usable") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("vector"))
    rows = cut(marked.withColumn("key", key))
    # A class is one label and vector; its node is a number of its own, as ids may repeat.
    classes = rows.where("key is not null").groupBy("label", "key", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("hash", F.xxhash64("label")))
    decoded = cut(
        classes.select("node", "hash", "vector").mapInArrow(
            _decode(codes, codewords, least), "node long, filter long, asks boolean, label long, sketch long"
        )
    )
    asks = decoded.where("asks").select("label", "filter", F.col("node").alias("p"), F.col("sketch").alias("sp"))
    held = decoded.select("label", "filter", F.col("node").alias("q"), F.col("sketch").alias("sq"))
    near = F.bit_count(F.col("sp").bitwiseXOR(F.col("sq"))) <= signs_of(least)
    pairs = asks.join(held, ["label", "filter"]).where((F.col("p") != F.col("q")) & near)
    pairs = cut(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    left = classes.select(F.col("node").alias("a"), F.col("label").alias("la"), F.col("vector").alias("x"), F.col("size").alias("m"))
    right = classes.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("y"), F.col("size").alias("n"))
    both = pairs.join(left, "a").join(right, "b").where("la = lb").select("a", "b", "x", "y", "m", "n")
    links = cut(both.mapInArrow(_confirm(least), "node long, others long, root long"))
    comps = connected_components(links, "node", "root")
    degree = links.groupBy("node").agg(F.sum("others").alias("others"))
    facts = classes.join(degree, "node", "left").join(comps, "node", "left").withColumn("group", F.coalesce("component_id", "node"))
    facts = cut(facts.select("label", "key", "vector", "least", "group", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links")))
    ids = facts.groupBy("group").agg(F.min("least").alias("component"))
    facts = facts.join(ids, "group").select("label", "key", "vector", "links", "component")
    out = rows.join(facts, ["label", "key", "vector"], "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
