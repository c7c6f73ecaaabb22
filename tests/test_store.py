from pyspark.sql import functions as F

from tracewell.operators import store
from tracewell.streaming.watch import IndexSink, live, watch


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_keep_longest_breaks_ties_by_time_and_path(spark):
    d = spark.createDataFrame(
        [("a", "h", "xx", 1.0), ("b", "h", "xx", 1.0), ("c", "h", "x", 9.0), ("d", None, "long", 1.0), ("e", "", "s", 1.0)],
        "filepath string, file_hash string, full_text string, last_modified double",
    )
    assert [r[0] for r in rows(store.keep_longest(d), "filepath")] == ["a", "d"]


def test_prune_delete_lookup(spark):
    index = spark.createDataFrame([("a",), ("b",)], "filepath string")
    keep, gone = store.prune(index, spark.createDataFrame([("a",)], "filepath string"))
    assert rows(keep, "filepath") == [("a",)] and rows(gone, "filepath") == [("b",)]
    assert rows(store.delete(index, keep), "filepath") == [("b",)]
    assert rows(store.lookup(index, keep), "filepath") == [("a",)]


def test_upsert_keeps_an_older_embedding(spark):
    kind = "filepath string, v int, text string, embedding array<double>"
    old = spark.createDataFrame([("a", 1, "x", [1.0]), ("b", 1, "y", None)], kind)
    new = spark.createDataFrame([("a", 2, None, None), ("c", 1, "z", [2.0])], kind)
    got = rows(store.upsert(old, new, "filepath", ["v"]), "filepath")
    assert got == [("a", 2, None, [1.0]), ("b", 1, "y", None), ("c", 1, "z", [2.0])]


def test_plan_actions(spark):
    kind = "filepath string, file_size long, last_modified double, file_hash string"
    scan = spark.createDataFrame([("same", 1, 1.0, "h"), ("new", 1, 1.0, "h"), ("late", 1, 9.0, "h"), ("size", 2, 1.0, "h"), ("body", 2, 1.0, "g")], kind)
    index = spark.createDataFrame([("same", 1, 1.5, "h"), ("late", 1, 1.0, "h"), ("size", 1, 1.0, "h"), ("body", 1, 1.0, "h"), ("gone", 1, 1.0, "h")], kind)
    got = dict(rows(store.plan_index(scan, index), "filepath"))
    assert got == {"same": "skip", "new": "insert", "late": "update", "size": "skip", "body": "update", "gone": "delete"}
    assert dict(rows(store.plan_index(scan, index, stored_version=1), "filepath"))["same"] == "update"


def test_index_version(spark):
    meta = spark.createDataFrame([], "key string, value string")
    assert store.index_version(meta).first()[0] == 0
    assert store.index_version(store.set_index_version(meta, 6)).first()[0] == 6


def test_stream_state_equals_batch(spark, tmp_path):
    kind = "k string, version int, text string, action string"
    first = spark.createDataFrame([("a", 1, "x", "upsert"), ("b", 1, "y", "upsert")], kind)
    second = spark.createDataFrame([("a", 2, "", "delete"), ("b", 0, "old", "upsert"), ("c", 1, "z", "upsert")], kind)
    source, sink = str(tmp_path / "in"), IndexSink(str(tmp_path / "state"), "k", ["version"])
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        q = watch(stream, sink, str(tmp_path / "ck"), once=True)
        assert q.awaitTermination(120) and q.exception() is None
    assert rows(live(sink.state(spark)).select("k", "text"), "k") == [("b", "y"), ("c", "z")]
    sink(spark.read.schema(kind).parquet(source), 99)  # a repeated delivery changes nothing
    assert rows(live(sink.state(spark)).select("k", "text"), "k") == [("b", "y"), ("c", "z")]


def test_join_index_keeps_documents_without_embedding(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "filepath string, size int")
    t = spark.createDataFrame([("a", "x"), ("b", "y")], "filepath string, text string")
    e = spark.createDataFrame([("a", [1.0])], "filepath string, embedding array<double>")
    assert rows(store.join_index(a, t, e), "filepath") == [("a", 1, "x", [1.0]), ("b", 2, "y", None)]
    assert rows(store.keep_longest(t.withColumn("file_hash", F.lit("h")).withColumnRenamed("text", "full_text").withColumn("last_modified", F.lit(1.0))), "filepath")[0][0] == "a"


def test_a_stored_index_opens_only_changed_files(spark, tmp_path, monkeypatch):
    import os
    import zipfile

    from tracewell.plans import indexing

    def docx(name, text):
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        with zipfile.ZipFile(tmp_path / "docs" / name, "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>")

    (tmp_path / "docs").mkdir()
    for n in "abc":
        docx(f"{n}.docx", f"text of {n}")
    target, told = f"file://{tmp_path}/index", []
    run = lambda: {r["filename"]: r["full_text"] for r in indexing.refresh(spark, str(tmp_path / "docs"), target, progress=lambda *x: told.append(x)).collect()}
    assert run() == {f"{n}.docx": f"text of {n}" for n in "abc"} and told[0][1] == 3
    state = indexing.Store(spark, target).last()
    told.clear()
    assert len(run()) == 3 and told == [(0, 0, "All document indexes are up to date.")] and indexing.Store(spark, target).last() == state
    docx("a.docx", "another text, longer than before")
    os.utime(tmp_path / "docs" / "a.docx", (2e9, 2e9))
    (tmp_path / "docs" / "b.docx").unlink()
    told.clear()
    assert run() == {"a.docx": "another text, longer than before", "c.docx": "text of c"} and told[0][1] == 1
    monkeypatch.setattr(indexing, "INDEX_VERSION", indexing.INDEX_VERSION + 1)
    told.clear()
    assert len(run()) == 2 and told[0][1] == 2


def changes(spark, batch, keys, action="upsert"):
    return spark.createDataFrame([(k, batch, f"v{batch}", action) for k in keys], "k int, version int, value string, action string")


def test_bytes_written_follow_the_batches_and_a_repeated_batch_writes_nothing(spark, tmp_path):
    folder = tmp_path / "index"
    sink, want, written = IndexSink(f"file://{folder}", "k", ["version"]), {}, []

    def files():
        return {p: p.stat().st_size for p in folder.rglob("*.parquet")}

    for batch in range(9):
        keys = range(4000) if not batch else [batch, batch + 1, batch + 1, 5000 + batch]
        before = set(files()) if batch else set()
        sink(changes(spark, batch, keys), batch)
        written.append(sum(size for p, size in files().items() if p not in before))
        want |= dict.fromkeys(keys, f"v{batch}")
        assert len(sink.runs(spark)) <= 5
    assert {r["k"]: r["value"] for r in live(sink.state(spark)).collect()} == want
    assert max(written[1:]) < written[0] / 2
    before = files()
    sink(changes(spark, 99, range(10)), 8)
    assert files() == before and {r["k"]: r["value"] for r in live(sink.state(spark)).collect()} == want
    sink(changes(spark, 100, [1, 2, 5001], "delete"), 9)
    assert {r["k"] for r in live(sink.state(spark)).collect()} == set(want) - {1, 2, 5001}


def test_a_batch_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    sink = IndexSink(f"file://{tmp_path}/index", "k", ["version"])
    sink(changes(spark, 0, [1, 2]), 0)
    held = sink.state(spark)
    with monkeypatch.context() as m:
        m.setattr(sink, "_publish", lambda *a: 1 / 0)
        try:
            sink(changes(spark, 1, [2, 3]), 1)
        except ZeroDivisionError:
            pass
    assert {r["k"]: r["value"] for r in sink.state(spark).collect()} == {1: "v0", 2: "v0"}
    sink(changes(spark, 1, [2, 3]), 1)
    assert {r["k"]: r["value"] for r in sink.state(spark).collect()} == {1: "v0", 2: "v1", 3: "v1"}
    # A reader that opened the version before still finds its files.
    assert {r["k"]: r["value"] for r in held.collect()} == {1: "v0", 2: "v0"}
