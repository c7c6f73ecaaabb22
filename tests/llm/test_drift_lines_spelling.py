import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.llm import line_dedup, perfect_hash, queries, schema_drift, spelling

SF = "/root/testdata/sf0.001"


# --- schema drift


def local(uri):
    return uri.removeprefix("file://")


def want_files(rows, files=1000):
    """{file_no: (version, rows)} of rows as dicts."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    out = defaultdict(list)
    for r, row in enumerate(rows):
        out[r // (1 + len(rows) // files)].append(row)
    found = {}
    for no, mine in out.items():
        v = zlib.crc32(f"7:{no}".encode()) % 24
        v = 0 if v > 15 else v
        for row in mine:
            if v & 4:
                row |= {"nation_id": -1, "city": "none"}
            if v & 8 and row["balance"] is not None:
                row["balance"] = float(np.float32(row["balance"]))
        found[no] = v, mine
    return found


def shown(x, name):
    if x is None:
        return "?"
    return str(math.floor(1048576 * x)) if name == "balance" else str(x)


def clients_of(path):
    table = pq.read_table(path)
    return table.set_column(3, "updated_at", table["updated_at"].cast(pa.int64())).to_pylist()


def test_rewritten_clients_equal_brute_force(spark):
    path = f"{SF}/clients.parquet"
    names = pq.read_schema(path).names
    want = want_files(clients_of(path))
    got = {r["file_no"]: r for r in queries.op11_schema_drift(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert {v for v, _ in want.values()} == set(range(16))
    for no, (version, rows) in want.items():
        r = got[no]
        ids = ",".join(str(x["client_id"]) for x in rows)
        text = "\n".join("|".join(shown(x[n], n) for n in names) for x in rows)
        assert (r["version"], r["n_rows"], r["rewritten"], r["drift"]) == (version, len(rows), version > 0, version)
        assert r["n_nulls"] == sum(x[n] is None for x in rows for n in names)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert r["rows_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        start = [n for n in names if not (version & 4 and n in ("city", "nation_id"))]
        if version & 1:
            start = [{"name": "email", "email": "name"}.get(n, n) for n in start]
        if version & 2:
            start = start[:1] + start[:0:-1]
        assert r["start_columns"] == ",".join(start) and r["columns"] == ",".join(names)
        schema = pq.read_schema(local(r["path"]))
        assert schema.equals(schema_drift.CLIENTS) and [schema_drift.field_id(f) for f in schema] == list(range(1, 11))
    folder = local(got[0]["path"]).rpartition("/")[0]
    import os

    assert {f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")} == {local(r["path"]) for r in got.values()}


def test_rewrite_of_odd_rows(spark):
    kinds = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, file_no string, extra int"
    row = (3, None, None, None, "n|x", "é\ny", None, None, None, 0.1, "clash", 1)
    rows = [row, row, (None, *row[1:9], None, "c", 2), (None, *row[1:9], -1e300, "c", 2), (-5, *row[1:9], float("nan"), "c", 2), *[(i, *row[1:]) for i in range(10, 60)]]
    df = spark.createDataFrame(rows, kinds).repartition(5)
    out = schema_drift.with_digests(schema_drift.rewrite_clients(df, files=20)).collect()
    assert sum(r["n_rows"] for r in out) == len(rows) and all(r["columns"] == ",".join(schema_drift.CLIENTS.names) for r in out)
    assert schema_drift.rewrite_clients(df.limit(0)).count() == 0


def test_rewriting_again_finds_nothing_to_do_and_keeps_files(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/clients.parquet")
    folder = f"file://{tmp_path}/c"
    first = schema_drift.rewrite_clients(df, files=30, folder=folder)
    before = {r["path"]: hashlib.sha256(open(local(r["path"]), "rb").read()).digest() for r in first.collect()}
    again = schema_drift.migrate(first.select("file_no", "path"), folder, schema_drift.CLIENTS, schema_drift.CLIENT_FILLS)
    assert not again.where("rewritten or drift <> 0").count()
    assert before == {r["path"]: hashlib.sha256(open(local(r["path"]), "rb").read()).digest() for r in again.collect()}


def test_transforms_compose_in_any_order_and_reject_narrowing():
    target, fills = schema_drift.CLIENTS, schema_drift.CLIENT_FILLS
    for version in range(16):
        have = schema_drift.drifted(target, version, schema_drift.CLIENT_SWAP, schema_drift.CLIENT_MISSING, schema_drift.CLIENT_NARROW)
        # A file without nation_id has only its balance to widen.
        assert schema_drift.drift_of(have, target) == version
        batch = pa.RecordBatch.from_arrays([pa.array([None, None], f.type) for f in have], schema=have)
        out = schema_drift.chain(version, target, fills)(batch)
        assert out.schema.equals(target)
        steps = [schema_drift.rename(target), schema_drift.add(target, fills), schema_drift.widen(target), schema_drift.reorder(target)]
        random.Random(version).shuffle(steps)
        for s in steps:
            batch = s(batch)
        assert batch.schema.equals(target) and batch.equals(out)
    wide = schema_drift.evolved([(1, "client_id", pa.float64())])
    with pytest.raises(ValueError, match="cannot be widened"):
        schema_drift.widen(target)(pa.RecordBatch.from_arrays([pa.array([1.5])], schema=wide))


def test_columns_that_the_evolved_schema_lacks_go(spark, tmp_path):
    have = schema_drift.evolved([(77, "x", pa.int64()), (1, "client_id", pa.int64())])
    schema = pa.schema([*have, pa.field("no_id", pa.string())])
    pq.write_table(pa.table([[5], [1], ["z"]], schema=schema), tmp_path / "a.parquet")
    files = spark.createDataFrame([(0, f"file://{tmp_path}/a.parquet")], "file_no int, path string")
    r = schema_drift.migrate(files, f"file://{tmp_path}/new", schema_drift.CLIENTS).first()
    assert r["drift"] & schema_drift.FOREIGN and pq.read_table(local(r["path"])).to_pylist() == [{n: 1 if n == "client_id" else None for n in schema_drift.CLIENTS.names}]


# --- lines


def slow_lines(docs, least_docs=3, least_chars=20):
    def key(line):
        line = line.strip(" \t\n\v\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    lost = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= least_docs}
    out = Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if lost.get(key(x), i) == i]
        out[(i, len(lines), len(lines) - len(left), "\n".join(left))] += 1
    return out


A, B, C = "This line is in many documents.", "ünïcödé — żółć, twenty and more", "x" * 40
ODD_LINES = [
    (1, f"{A}\n\n  {A.upper()} \t\nshort\n{B}"), (2, f"{A}\r\n{A}"), (3, f"\n{A}\n{C}\n"), (None, f"{A}\n{B}"), (None, C), (4, None), (5, ""), (5, "\n"),
    (6, f"{B}\n{C}"), (6, f"{B}\n{C}"), (7, B.replace("Ż", "ż")), (8, "  " + "é" * 19 + "  "), (9, "é" * 19), (10, "é" * 19), (11, "é" * 20), (12, "é" * 20), (13, "é" * 20),
    (-9, f"{'y' * 300000}\n{A}\n" + "z\n" * 5000), (20, "A b" * 10 + "\x0b" + A), (21, "\x1c" + A), (22, "\x1c" + A), (23, "\x1c" + A), (9_000_000_000, f"{C} \n{A}"),
]


def test_lines_equal_brute_force_both_ways(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (docs, ODD_LINES):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("hi", F.lit(1)).repartition(3)
        want = slow_lines(rows)
        for limit in (line_dedup.INDEX_BYTES, -1):
            got = line_dedup.drop_repeated_lines(df, index_bytes=limit).collect()
            assert Counter(map(tuple, got)) == want
    assert any(r[2] for r in want) and line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_lines_in_small_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE_BYTES", 7)
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 100)
    for _, t in ODD_LINES:
        joined = [x for lines in line_dedup._pieces((t or "").encode()) for x in lines]
        assert joined == (t or "").encode().split(b"\n")


def test_lines_sql(spark, tmp_path):
    queries.op12_line_dedup(spark, SF).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = "doc_id, n_lines, n_dropped, kept_sha256"
    a = c.execute(f"select {cols} from '{tmp_path}/out/*.parquet' order by all").fetchall()
    assert a == c.execute(f"select {cols} from ({queries.LINES_SQL}) order by all").fetchall()


def test_perfect_hash_numbers_each_key_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        hi, lo = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        hi[: n // 2] = 5  # told apart by the second half alone
        h = perfect_hash.PerfectHash.of(hi, lo)
        assert len(h) == n and sorted(h.number(hi, lo).tolist()) == list(range(n))
        assert len(h.words) * 64 < 6 * n + 1000
        other = h.number(lo, hi)
        assert ((other >= -1) & (other < max(n, 1))).all()


def test_shards_hold_what_was_put_in(tmp_path):
    rng = np.random.default_rng(4)
    index = line_dedup.Index(f"file://{tmp_path}", 7)
    hi, lo = rng.integers(0, 1 << 63, (2, 500)).astype(np.uint64) * np.uint64(2)
    order = np.argsort(hi)
    hi, lo = hi[order], lo[order]
    some = np.arange(500) % 2 == 0
    for s in range(6):  # the last shard has no file
        mine = some & (index.shard_of(hi) == s)
        index.write(s, hi[mine], lo[mine], np.full(mine.sum(), 3), lo[mine].astype(np.int64) // 2)
    found, keeper = index.look_up(hi, lo)
    assert (found == (some & (index.shard_of(hi) < 6))).all() and (keeper[found] == lo[found].astype(np.int64) // 2).all()


# --- spelling


def slow_spelling(docs, least_chars=5, least_count=3, factor=2, every=97):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}
    near, by = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[(k, w[:k] + w[k + 1 :])].add(w)
            if (v := w[:k] + w[k + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for same in by.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= factor * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return out


def odd_words(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda: " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, range(len(words), 0, -1), k=700))
    return [(1, text()), (1, text()), (None, text()), (2, None), (3, ""), (4, "1234 _ Ābcdefg×÷ß"), (5, "w" * 3000 + " " + "w" * 2999 + " " + "w" * 3000), (6, ("w" * 3000 + " " + "w" * 2999 + "1") * 4)]


def test_spelling_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for rows, most in ((docs, None), (odd_words(1), None), (odd_words(2), 200), (odd_words(3), 1)):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("clash")).repartition(3)
        out = spelling.spelling_variants(df, **({} if most is None else {"frame_chars": most}))
        got = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in out.collect()]
        want = slow_spelling(rows)
        assert len(got) == len(want) and set(got) == want and any(r[3] for r in want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_forms_are_followed_to_the_end(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzzz": 3}
    df = spark.createDataFrame([(1, " ".join(w for w, c in n.items() for _ in range(c)))], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(df, every=0).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbb") and got["bbbbb"] == (None, "bbbbb") and got["zzzzz"] == (None, "zzzzz")


def test_trie_emits_all_pairs_at_distance_one():
    rng = random.Random(9)
    for _ in range(30):
        words = list({bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(40)})

        def near(a, b):
            a, b = sorted((a, b), key=len)
            return a != b and any(a == b[:k] + b[k + 1 :] or (len(a) == len(b) and a[:k] + a[k + 1 :] == b[:k] + b[k + 1 :]) for k in range(len(b)))

        got = list(spelling.Trie(words).near())
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
