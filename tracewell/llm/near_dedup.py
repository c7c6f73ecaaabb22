"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

One permutation scatters the shingles; a second one, circularly shifted by one
more step for each coordinate, gives every coordinate of the signature (Li and
Li, "C-MinHash", 2022). Both act on the 64-bit numbers, where a circular shift
is an addition.

Texts with equal shingle sets are one class from the start. In each band's
bucket every class is first compared with the bucket's smallest class, and the
links found are contracted to components. Where a bucket still holds several
components, the classes that could be linked across them are tested in blocks
with matrix products, and only links that join components become rows. So each
link between different texts is either found or implied by found ones, and
groups of near copies never turn into rows for all their pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, hashed, lean, mix64, ngram_hashes, prepare, text_blocks
from tracewell.llm.components import connected_components

#: Bands and coordinates a band: a pair of similarity 0.8 shares no band with
#: a chance of 5e-8, one of 0.85 with a chance of 6e-11.
BANDS, ROWS = 32, 4

_SCATTER = np.uint64(0x5851F42D4C957F2D)
_SHIFT = np.uint64(0x2545F4914F6CDD1D)


def signature_bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each set and band; sets must not be empty."""
    out = np.empty((len(sets), bands), np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    with np.errstate(over="ignore"):
        x = mix64(flat ^ _SCATTER)  # the first permutation
        for b in range(bands):
            value = np.full(len(sets), b + 1, np.uint64)
            for r in range(rows):
                step = np.uint64(b * rows + r + 1) * _SHIFT
                # the second permutation, shifted by as many steps as the coordinate
                least = np.minimum.reduceat(mix64(x + step), starts)
                value = mix64(value + least)
            out[:, b] = value
    return out


def _sketch(shingle: int, bands: int, rows: int):
    def run(it):
        for batch in it:
            for lo, hi, texts in text_blocks(batch.column(1)):
                sets = [np.unique(ngram_hashes(h, shingle)) for _, h in hashed(texts)]
                full = [i for i, s in enumerate(sets) if len(s)]
                got = signature_bands([sets[i] for i in full], bands, rows) if full else []
                row = {i: g.astype(np.int64) for i, g in zip(full, got, strict=True)}
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([row.get(i) for i in range(len(sets))], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return lean(run)


def _sets(shingle: int):
    def run(it):
        for batch in it:
            for lo, hi, texts in text_blocks(batch.column(1)):
                out = [np.unique(ngram_hashes(h, shingle)).tobytes() for _, h in hashed(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], ["node", "members"])

    return lean(run)


def _views(col: pa.Array) -> list[np.ndarray]:
    """The 64-bit numbers of each binary value, without a copy."""
    if not len(col):
        return []
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1] // 8
    flat = np.frombuffer(data, np.uint64, at[-1]) if data is not None else np.zeros(0, np.uint64)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _verify(percent: int):
    def run(it):
        for batch in it:
            keep = np.zeros(batch.num_rows, bool)
            for i, (s, t) in enumerate(zip(_views(batch.column(2)), _views(batch.column(3)), strict=True)):
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return lean(run)


def _tokens(it):
    for batch in it:
        nodes, comps, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _views(batch.column(2))
        for lo in range(0, len(sets), 256):
            part = sets[lo : lo + 256]
            n = np.array([len(t) for t in part])
            cols = [np.concatenate(part).view(np.int64), np.repeat(nodes[lo : lo + 256], n), np.repeat(comps[lo : lo + 256], n), np.repeat(n, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "node", "c", "n"])


def common_counts(x: list[np.ndarray], y: list[np.ndarray], dense: int = 32) -> np.ndarray:
    """Sizes of all intersections of sets x[i] and y[j].

    Elements in more than ``dense`` sets are counted by matrix products, the
    others by their few pairs.
    """
    out = np.zeros((len(x), len(y)))
    flat = np.concatenate([*x, *y])
    own = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in [*x, *y]])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    df = np.diff(np.append(first, len(flat)))
    column = np.repeat(np.arange(len(first)), df)
    often = np.flatnonzero(df > dense)
    for lo in range(0, len(often), 2048):
        part = often[lo : lo + 2048]
        at = np.full(len(first), -1)
        at[part] = np.arange(len(part))
        keep = at[column] >= 0
        m = np.zeros((len(x) + len(y), len(part)), np.float32)
        m[own[keep], at[column[keep]]] = 1
        out += m[: len(x)] @ m[len(x) :].T
    for size in range(2, dense + 1):
        at = first[df == size]
        if len(at):
            group = own[at[:, None] + np.arange(size)]  # rows: the sets that hold one element
            for p in range(size):
                for q in range(size):
                    i, j = group[:, p], group[:, q] - len(x)
                    both = (i < len(x)) & (j >= 0)
                    out += np.bincount(i[both] * len(y) + j[both], minlength=out.size).reshape(out.shape)
    return out


def _test_block(percent: int):
    """Links across components in one pair of blocks, as few as join what they join."""

    def run(table: pa.Table) -> pa.Table:
        node, c, block = (table.column(n).to_numpy() for n in ("node", "c", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = [np.frombuffer(m, np.int64) for m in table.column("members").to_pylist()]
        p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                v = root[v]
            return v

        for lo in range(0, len(p), 256):
            mine = p[lo : lo + 256]
            for at in range(0, len(q), 256):
                other = q[at : at + 256]
                differ = c[mine][:, None] != c[other][None, :]
                if not differ.any():
                    continue
                both = common_counts([sets[k] for k in mine], [sets[k] for k in other])
                size = np.array([len(sets[k]) for k in mine])[:, None] + np.array([len(sets[k]) for k in other])[None, :]
                for x, y in zip(*np.nonzero(differ & (100 * both >= percent * (size - both))), strict=True):
                    u, v = find(int(c[mine[x]])), find(int(c[other[y]]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        a.append(int(node[mine[x]]))
                        b.append(int(node[other[y]]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


#: Sets in a block at most, and their shingles.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000


def _across(members: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """All links between different components of classes that share a bucket.

    A class can be linked across components only if ``percent`` of its shingles
    occur in classes of other components; the few classes left are tested
    against those of their family (what buckets connect) block by block.
    """
    placed = members.select("bucket", "node").join(comps, "node", "left")
    placed = cut(placed.select("bucket", "node", F.coalesce("component_id", "node").alias("c")))

    def mixed(rows: DataFrame) -> DataFrame:
        held = rows.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("node").alias("centre"))
        return cut(held.where("lo < hi").select("bucket", "centre"))

    nodes = placed.join(mixed(placed), "bucket").select("node", "c").distinct()
    held = cut(nodes.join(sets, "node").select("node", "c", "members"))
    tokens = held.mapInArrow(lean(_tokens), "token long, node long, c long, n long")
    tokens = cut(tokens)
    common = tokens.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    able = tokens.join(common, "token").groupBy("node", "n").agg(F.count("*").alias("s")).where(F.lit(100) * F.col("s") >= F.lit(percent) * F.col("n"))
    able = cut(able.select("node", "n"))
    placed = placed.join(able.select("node").distinct(), "node", "left_semi")
    ties = placed.join(mixed(placed), "bucket").select("centre", "node").where("centre <> node").distinct()
    family = cut(connected_components(ties, "centre", "node").withColumnRenamed("component_id", "family"))
    rows = held.join(family, "node").withColumn("n", F.length("members") / 8)
    sized = rows.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    rows = rows.join(sized.select("family", parts.alias("parts")), "family")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "n"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c", "members")
    return cut(rows.groupBy("family", "i", "j").applyInArrow(_test_block(percent), "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Linked are documents with ``100 * |A & B| >= percent * |A | B|`` over their
    sets of distinct shingles. component_id is the smallest doc_id that links
    reach; kept marks that document.

    A null or empty text, or one without words, has an empty set and is linked
    with nothing. A row with a null id is returned with a null component and
    kept = false, and is linked with nothing. Rows that repeat an id are all
    returned. Other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = cut(
        base.mapInArrow(
            _sketch(shingle, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"
        )
    )
    # A class is the set of texts with one shingle set; its node is its least id.
    # Equal sets have equal bands, so any row's serve; copies meet before the shuffle.
    classes = cut(
        sketch.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    # Two classes can share a node when rows repeat an id with other texts: they are linked by it.
    members = cut(classes.select("node", "n", F.explode("bands").alias("bucket")))
    shared = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("far"))
    # Written, so that the join shuffles both sides and AQE can split a hot bucket.
    shared = cut(shared.where("centre < far").select("bucket", "centre"))
    members = cut(members.join(shared, "bucket"))
    texts = base.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(_sets(shingle), "node long, members binary"))

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        held = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return held.mapInArrow(_verify(percent), "a long, b long")

    def sized(pairs: DataFrame) -> DataFrame:
        near = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
        return pairs.where(near).select("a", "b").distinct()

    sizes = classes.select("node", "n").distinct()
    star = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    links = cut(confirm(sized(star.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a"))))
    comps = cut(connected_components(links))
    more = _across(members, sets, comps, percent)
    if not more.isEmpty():
        comps = cut(connected_components(links.unionByName(more)))
    placed = (
        classes.select("set_key", "node")
        .join(comps, "node", "left")
        .select("set_key", F.coalesce("component_id", "node").alias("component_id"))
    )
    out = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = out.join(placed, "set_key", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )
