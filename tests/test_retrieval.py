"""Searches by bounds against ranking everything."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracewell.functions import fuzzy
from tracewell.operators import inverted
from tracewell.operators import retrieve as R
from tracewell.operators.retrieve import code_boosts, keyword_top_k, retrieve
from tracewell.operators.semantic import pair_tfidf, tfidf_scores, top_k
from tracewell.sources.testdata import as_documents, benchmark_queries, documents

SF = "/root/testdata/sf0.001"


def made(spark, rows, key="doc_id"):
    d = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    return as_documents(d).withColumnRenamed("doc_id", key)


def invented(seed, n, longest):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["AB-12", "X1234567", "well-known,", "(Word)", "the", "of"]
    texts = [" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, longest))) for _ in range(n)]
    return [*enumerate(texts), (n, texts[3]), (n + 1, texts[3]), (n + 2, ""), (n + 3, None), (n + 4, "!"), (n + 5, " ".join(texts)[:12_000])]


def plans(df):
    return df._jdf.queryExecution().toString()


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(map(tuple, want))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a - b) < 1e-9 for x, y in zip(got, want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))


def test_top_documents_are_the_first_of_all(spark):
    q, d = made(spark, invented(1, 12, 25), "query_id"), made(spark, invented(2, 60, 60))
    cols = ["query_id", "doc_id", "rank", "retrieval_score", "semantic"]
    every = retrieve(q, d, None).select(cols).collect()
    assert len(every) == 18 * 66
    for k in (1, 4, 1000):
        top = retrieve(q, d, k)
        assert "Cartesian" not in plans(top) and "NestedLoop" not in plans(top)
        same(top.select(cols).collect(), [r for r in every if r["rank"] <= k])


def test_a_first_page_of_its_own_and_given_similarities(spark):
    q, d = made(spark, invented(3, 6, 25), "query_id"), made(spark, invented(4, 40, 50))
    page = F.transform("pages", lambda p: p.withField("text", F.concat(F.lit("Front abc "), F.substring(p["text"], 1, 20))))
    q = q.withColumn("pages", page)
    sem = q.select("query_id").crossJoin(d.select("doc_id").where("doc_id % 3 = 0")).withColumn("semantic", (F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(1000)) / 10).cast("double"))
    cols = ["query_id", "doc_id", "rank", "retrieval_score", "semantic"]
    for given in (None, sem):
        every = retrieve(q, d, None, given).where("rank <= 3").select(cols).collect()
        same(retrieve(q, d, 3, given).select(cols).collect(), every)


def test_blocks_of_queries_and_ids_of_another_type_change_nothing(spark, monkeypatch):
    q, d = made(spark, invented(5, 9, 20), "query_id"), made(spark, invented(6, 30, 40))
    cols = ["query_id", "doc_id", "rank", "retrieval_score"]
    whole = retrieve(q, d, 2).select(cols).collect()
    monkeypatch.setattr("tracewell.operators.retrieve.QUERY_BLOCK", 4)
    named = q.withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    got = retrieve(named, d, 2).select(cols).collect()
    same([(int(r[0][1:]), *r[1:]) for r in got], whole)


def test_best_cosines_are_the_first_of_all(spark):
    for q, d in ((made(spark, invented(7, 12, 25), "query_id"), made(spark, invented(8, 60, 60))), (benchmark_queries(spark, SF), documents(spark, SF))):
        every = top_k(tfidf_scores(q, d).withColumn("semantic", F.round("semantic", 9)), 5, "semantic").where("semantic > 0")
        got = inverted.best_cosines(q, d, 5).withColumn("semantic", F.round("semantic", 9))
        a, b = ({(r["query_id"], r["rank"]): r["semantic"] for r in x.collect()} for x in (got, every))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-8 for k in a)


def test_cosines_leave_a_task_as_k_rows_a_query_and_near_ties_go_by_id(spark):
    # pairs were joined with both vectors; and sums in another order told equal vectors apart.
    words = [f"w{i}" * (i % 3 + 1) for i in range(40)]
    rng = random.Random(9)
    texts = [" ".join(rng.sample(words, 40)) for _ in range(30)]
    q, d = made(spark, [(0, " ".join(words[:25]))], "query_id"), made(spark, list(enumerate(texts)))
    got = inverted.best_cosines(q, d, 10)
    assert "Join" not in plans(got)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(10))


def test_rows_of_one_id_are_one_document(spark):
    q, d = made(spark, [(0, "alpha beta")], "query_id"), made(spark, [(1, "alpha"), (1, "alpha beta"), (2, "gamma")])
    whole = made(spark, [(1, "alpha alpha beta"), (2, "gamma"), (3, None)])
    a, b = ([(r["doc_id"], round(r["semantic"], 9)) for r in tfidf_scores(q, x).collect()] for x in (d, whole))
    assert a == b and len(a) == 1


def test_pairs_are_counted_where_they_are(spark):
    # every word of every pair went through a shuffle.
    pairs = spark.createDataFrame([(1, 1, "aa bb bb", "bb cc"), (1, 2, "", "aa"), (2, 1, "x", "x"), (2, 2, "!", "aa"), (3, 1, None, None), (3, 2, "aa", "bb")], "query_id long, doc_id long, a string, b string")
    got = pair_tfidf(pairs)
    assert "Exchange" not in plans(got)
    w = math.log(1.5) + 1
    want = 100 * 2 / math.sqrt((w * w + 4) * (1 + w * w))
    assert {(r[0], r[1]): round(r[2], 9) for r in got.collect()} == {(1, 1): round(want, 9), (1, 2): 0, (2, 1): 100, (2, 2): 0, (3, 1): 0, (3, 2): 0}


def test_a_frequent_code_makes_each_pair_once(spark, monkeypatch):
    # all pairs of a code were held to count them.
    monkeypatch.setattr("tracewell.operators.retrieve.CODE_QUERIES", 3)
    d = made(spark, [(i, "AB-12 and " + ("CD-34 EF-56" if i % 2 else "xAB-129")) for i in range(20)])
    got = code_boosts(d.withColumnRenamed("doc_id", "query_id"), d)
    assert "Aggregate" not in plans(got).split("Join")[0]
    rows = {(r[0], r[1]): r[2] for r in got.collect()}
    assert got.count() == len(rows) == 400
    assert rows[1, 3] == 40 and rows[1, 2] == 20 and rows[2, 1] == 20


def test_keyword_rows_leave_a_task_as_k_of_a_query(spark):
    # all pairs that share a word went through a shuffle.
    q, d = made(spark, [(0, "alpha beta gamma"), (1, "")], "query_id"), made(spark, [(i, "alpha beta " + "delta" * (i > 2)) for i in range(6)])
    got = keyword_top_k(q, d, 2, boost=False)
    assert "Join" not in plans(got)
    assert [(r["query_id"], r["doc_id"], round(r["keyword_score"], 6)) for r in got.orderBy("rank").collect()] == [(0, 0, 66.666667), (0, 1, 66.666667)]


def test_adjacent_pages_are_spread_over_all_cores(spark):
    # the scorers of all pairs ran in one task.
    from tracewell.queries import QUERIES

    for name in ("fuzzy_structure", "ordered_lists"):
        assert "RepartitionByExpression" in plans(QUERIES[name](spark, SF)), name


def test_letters_bound_scores():
    rng = random.Random(8)
    texts = ["", " ", *(" ".join(rng.choices(["cat", "Mat", "hat", "sits", "é", "\U0001f600", "of", "x9"], k=rng.randint(1, 30))) for _ in range(40))]
    held = [R.Counted(t) for t in texts]
    counts = R.Counts(held)
    at = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    x, y = (np.array(c) for c in zip(*at, strict=True))
    both = [held[i].text.set & held[j].text.set for i, j in at]
    sect = np.array([sum(map(len, b)) + max(0, len(b) - 1) for b in both])
    sets = counts.set_limit(x, counts, y, sect, np.array([len(b) for b in both]))
    plain, by_order = counts.ratio_limits(x, counts, y)
    for n, (i, j) in enumerate(at):
        low, _ = held[i].text.bounds(held[j].text)
        assert max(low, sets[n]) >= fuzzy.token_set_ratio(texts[i], texts[j]) - 1e-9
        if texts[i].strip() and texts[j].strip():
            assert plain[n] >= fuzzy.ratio(texts[i], texts[j]) - 1e-9 and by_order[n] >= fuzzy.token_sort_ratio(texts[i], texts[j]) - 1e-9
    assert plain.min() < 80
