import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, components, embed_dedup, near_dedup
from tracewell.llm.queries import op4_minhash_near_dedup


def union(pairs, nodes):
    par = {n: n for n in nodes}

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    inv, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in inv[x])
            inv[x].append(i)
    links = [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return {i: (len(sets[i]), c, c == i) for i, c in union(links, sets).items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def cases():
    """Families of near copies around the threshold, exact copies, chains, short and empty texts."""
    rng, out = random.Random(4), []
    for _ in range(4):
        base = [f"b{rng.randrange(5000)}" for _ in range(90)]
        out += [edited(rng, base, rng.randrange(9)) for _ in range(30)]
        out += [" ".join(base)] * 3
    out += ["", "one", "One", "two words", "\t \n", " ".join(f"x{i}" for i in range(3000))]
    return list(enumerate(out))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, k, percent):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, shingle=k, percent=percent).collect()}
    assert got == brute(docs, k, percent)


def test_query_equals_brute_force_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op4_minhash_near_dedup(spark, sf).collect()}
    assert got == brute(docs, 3, 85)


def test_odd_rows(spark):
    kind = "doc_id long, text string, component_id string, kept int, bands int"
    rows = [(1, None, "a", 1, 1), (2, "", "a", 1, 1), (None, "a b c", "a", 1, 1), (4, "a b c", "a", 1, 1), (4, "a b c", "a", 1, 1), (5, "A B  C", None, None, None)]
    got = sorted(near_dedup.near_duplicates(spark.createDataFrame(rows, kind)).collect(), key=str)
    assert len(got) == 6
    by = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by == {(1, 0, 1, True), (2, 0, 2, True), (None, 1, None, False), (4, 1, 4, True), (5, 1, 4, False)}
    assert near_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    bands = near_dedup.signature_bands([x, np.concatenate([x[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])], 400, 1)
    assert abs((bands[0] == bands[1]).mean() - 900 / 1100) < 0.08


def test_common_counts():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 60, 40)) for _ in range(50)]
    y = [np.unique(rng.integers(0, 60, 40)) for _ in range(45)]
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    for dense in (2, 32, 1000):
        assert (near_dedup.common_counts(x, y, dense) == want).all()


def test_word_hashes_do_not_depend_on_the_block():
    a, b = "Ein Wort  und\nnoch EINS ".encode(), "x\ty".encode()
    together = [h.tolist() for _, h in common.hashed([a, None, b, b""])]
    assert together == [next(common.hashed([t]))[1].tolist() for t in (a, None, b, b"")]
    assert [len(h) for h in together] == [5, 0, 2, 0]
    assert next(common.hashed([b"ABC"]))[1][0] == next(common.hashed([b"abc"]))[1][0]


def test_word_hashes_do_not_depend_on_the_segment(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab \tÉ") * rng.randrange(9) for _ in range(60)).encode() for _ in range(200)] + [b"x" * 500, b"", b"y"]
    whole = common.hash_words(texts, suffixes=True)
    assert whole[1].tolist() == [len(t.split()) for t in texts]
    for size in (1, 16, 37):
        monkeypatch.setattr(common, "SEGMENT_BYTES", size)
        monkeypatch.setattr(common, "_POWERS", [])
        assert all((a == b).all() for a, b in zip(whole, common.hash_words(texts, suffixes=True), strict=True))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = union(real, {x for e in real for x in e})
    got = {r["node"]: r["component_id"] for r in components.connected_components(df).collect()}
    assert got == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows = []
    for i in range(600):
        v = base[i % 60] + rng.standard_normal(64) * rng.choice([0.05, 0.1, 0.14, 0.2])
        rows.append((i, [float(x) for x in np.float32(v)], i % 3))
    rows += [(600 + i, rows[0][1], 0) for i in range(5)] + [(700, [2 * x for x in rows[1][1]], 1), (701, rows[1][1], None)]
    bad = [(800, None, 0), (801, [0.0] * 64, 0), (802, [float("nan")] * 64, 0), (803, [None] * 64, 0), (804, [], 0), (805, [1.0, 2.0], 0), (806, [float("inf")] * 64, 0)]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos, links = x @ x.T, []
    for i in range(len(rows)):
        links += [(rows[i][0], rows[j][0]) for j in np.flatnonzero(cos[i] >= 0.98) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2]]
    n, comp = Counter(a for a, _ in links), union(links, [r[0] for r in rows])
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df).collect()}
    want = {i: (n[i], c, i == c) for i, c in comp.items()} | {r[0]: (0, r[0], True) for r in bad}
    assert len(links) > 500 and got == want
    null = spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1)], df.schema)
    assert {tuple(r) for r in embed_dedup.near_vectors(null).collect()} == {(None, 0, None, False), (3, 0, 3, True)}
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "double"])
def test_vectors_with_repeated_ids_and_labels_of_any_type(spark, kind):
    v = [[1.0, 0.0, 0.01 * i] for i in range(4)]
    label = {"string": lambda x: f"l{x}", "double": lambda x: x + 0.5}[kind]
    rows = [(1, v[0], label(0)), (1, v[1], label(0)), (2, v[2], label(0)), (2, v[2], label(0)), (3, v[3], label(1)), (9, v[0], None)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").repartition(3)
    got = sorted(tuple(r) for r in embed_dedup.near_vectors(df).collect())
    assert got == [(1, 3, 1, True)] * 2 + [(2, 3, 1, False)] * 2 + [(3, 0, 3, True), (9, 0, 9, True)]
    if kind == "double":
        near = df.withColumn("label", F.when(F.col("vec_id") == 3, 0.7).otherwise(F.col("label")))
        assert {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(near).collect()}[3] == 0


def test_vectors_at_a_lower_threshold(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 32))
    x = np.repeat(base, 12, 0) + rng.standard_normal((144, 32)) * 0.42
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.8).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(df, least=0.8).collect()}
    assert links.sum() > 300 and [got[i] for i in range(len(x))] == links.tolist()
