import math
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import lang_id, lm_score, media, mixing, packing, passages, pii, quality
from tracewell.llm.common import fold
from tracewell.llm.queries import MIX_SQL, op8_source_mixing

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def slow_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((i for i in range(len(bins)) if bins[i] >= n), key=lambda i: bins[i], default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins[fit] -= n
    return len(bins)


def test_histogram_packing_equals_best_fit_one_by_one():
    rng = random.Random(5)
    for _ in range(40):
        cap = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(1, 300))]
        runs, bins = packing.best_fit_decreasing(Counter(lengths), cap)
        assert bins == slow_best_fit(lengths, cap)
        used = defaultdict(list)
        for n, mine in runs.items():
            assert sum(r[1] for r in mine) == lengths.count(n)
            for _, count, first, each, offset in mine:
                for i in range(count):
                    used[first + i // each].append((offset + i % each * n, n))
        for places in used.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            assert end <= cap
        assert len(used) == bins


def check_packing(rows, docs, capacity=2048):
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    assert len(used) == slow_best_fit([r["length"] for r in rows], capacity)


def test_packing(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(None, "no id"), (1, None), (2, ""), (2, ""), (3, "Don't STOP.,  İst straße É <|endoftext|> x" + " y" * 5000), (4, "A" * 300 + ". b c")]
    for rows in (docs, odd):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("chunk", F.lit(1))
        check_packing(packing.pack(df.repartition(3), TOKENIZER).collect(), rows)
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_mixing_equals_its_sql(spark, tmp_path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = op8_source_mixing(spark, SF).collect()
    want = c.execute(MIX_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) <= 20


def water(sizes, share, most):
    """Reshare the excess by weight until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = left - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        full |= set(over)


def test_mixing_targets_and_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "a", "a", "b", "c", "Ä", None])) for i in range(400)]
    rows += [(500, None, "empty"), (None, "x y", "a"), (7, "x", "a"), (7, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes, 1.5, 2.0)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 2
    assert mixing.mix(df.limit(0)).count() == 0


def test_media_round_trip(spark, tmp_path):
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "x" * 576), (6, "é" * 5000), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).repartition(3)
    root = f"file://{tmp_path}/shards"
    got = media.media_columns(df, root, limit=1000).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(pay), zlib.crc32(pay[-32:]))
        assert media.decode_png(media.encode_png(pay)) == pay
        assert (r["width"], r["height"]) == (576, len(pay) // 576)
        stored = media.extract(root, r["shard"])[f"{r['digest']}.png"]
        assert media.decode_png(stored) == pay and len(stored) == r["media_bytes"]
    same = [tuple(by[i])[1:] for i in (1, 2)]
    assert same[0] == same[1] and by[3]["payload_sha256"] == by[4]["payload_sha256"]
    with tarfile.open(next((tmp_path / "shards").glob("*.tar"))) as tar:
        assert all(m.name.endswith(".png") for m in tar.getmembers())
    spots = media.places(media.write_shards(df, root + "2"))
    assert {r["bits"] for r in media.header_columns(spots, root + "2").collect()} == {8}
    assert media.media_columns(df.limit(0), root + "3").count() == 0


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = fold(F.col("doc_id"), 3) == 1
    model = lang_id.fit(docs.where(~out))
    got = lang_id.identify(docs.where(out), model, {"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "der die und"), (4, "der die und")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = lang_id.identify(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert [r["lang_pred"] for r in sorted(rows, key=lambda r: r["doc_id"])] == ["und", "und", "und", "de", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = lang_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(odd, empty, {"doc_id": F.col("doc_id")}).collect()} == {"und"}


def test_language_table_against_plain_counts():
    texts = ["Ab c", "b"]
    grams = [Counter(), Counter()]
    for n in (1, 2):
        for k, t in enumerate(texts):
            t = f" {t.lower()} "
            grams[k].update(t[i : i + n] for i in range(len(t) - n + 1))
    keys = [[], []]
    for key, room, _ in lang_id._grams(texts, (1, 2), 1 << 15):
        at = np.concatenate([[0], np.cumsum(room)])
        for k in range(2):
            keys[k] += key[at[k] : at[k + 1]].tolist()
    assert [sorted(Counter(k).values()) for k in keys] == [sorted(g.values()) for g in grams]


def test_quality_held_out_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranking = quality.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    rated = quality.rate(docs, ranking, {"doc_id": F.col("doc_id")}).join(labels, "doc_id").where(fold(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rated]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "Some text.")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    assert all(0 <= r["score"] <= 1 for r in quality.rate(odd, ranking, {"doc_id": F.col("doc_id")}).collect())
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert quality.rate(odd, none, {"doc_id": F.col("doc_id")}).count() == 4


def test_bradley_terry_learns_a_preference():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 3))
    y = (x[:, 0] - 2 * x[:, 1] + rng.standard_normal(2000) * 0.3 > -1).astype(int)
    r = quality.fit_ranking(x, y)
    assert ((r.score(x) >= 0.5) == y).mean() > 0.9
    assert abs(r.weights[1] / r.weights[0] + 2) < 0.3
    assert quality.fit_ranking(x, np.ones(2000)).score(x).min() >= 0.5


def test_lm_base_counts_and_proper_probabilities(spark):
    rows = [(i, f"the cat {w} on the mat {w}") for i, w in enumerate(["sat", "SAT", "ran", "lay", "xyzzy", "sat"])]
    rows += [(20, None), (21, ""), (None, "the the"), (30, "twice"), (30, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    held = F.coalesce(F.col("doc_id") == 4, F.lit(False))
    got = lm_score.score(df, held).collect()
    train = Counter()
    for i, t in rows:
        if i != 4:
            train.update([*(t or "").lower().split(), "</s>"])
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        words = [*(t or "").lower().split(), "</s>"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), n)
        assert abs(r["base_score"] - base) < 1e-9 and r["score"] < 0
    assert lm_score.score(df.limit(0), held).count() == 0


def test_lm_normalises_over_classes():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2**60, 3000)
    n = np.sort(rng.integers(1, 500, 3000))[::-1]
    low = keys & (lm_score.GROUPS - 1)
    vocab = lm_score.Vocabulary(int(n.sum()), 3000, keys, n, np.bincount(low, n, lm_score.GROUPS).astype(int), np.bincount(low, minlength=lm_score.GROUPS))
    m = lm_score.Model(vocab, lm_score.start_parameters(vocab.class_n))
    k = vocab.classes
    p = 10 ** m.log10_probability(np.arange(k), np.full(k, 3), np.full(k, k))
    assert abs(p.sum() - 1) < 1e-3


def test_lm_beats_word_frequencies_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_score.score(docs, fold(F.col("doc_id"), 10) == 0).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.96 * got[0]


def test_lm_sums_equal_additions_one_by_one():
    rng = np.random.default_rng(4)
    at, rows, plain = rng.integers(0, 9, 200), rng.standard_normal((200, 5)).astype(np.float32), np.zeros((11, 5))
    np.add.at(plain, at, rows)
    assert np.allclose(lm_score._sums(at, rows, 11), plain, atol=1e-5)


def test_lm_parts_of_a_shard_do_not_depend_on_blocks(monkeypatch):
    """A shard beyond what a task holds is passed over in parts, all of it, at the same places however it comes."""
    monkeypatch.setattr(lm_score, "HELD_TOKENS", 1000)
    tokens = np.random.default_rng(2).integers(0, 40, (3, 3300))
    got, seen = [], []
    for size in (3300, 170):
        trainer = lm_score.Trainer(lm_score.start_parameters(np.ones(40)), np.ones(40), 3)
        batch, n = trainer._batch, []
        monkeypatch.setattr(trainer, "_batch", lambda *x, batch=batch, n=n: (n.append(len(x[0])), batch(*x)))
        for lo in range(0, 3300, size):
            trainer.train(*tokens[:, lo : lo + size])
        got.append(lm_score.pack_parameters(trainer.finish()))
        seen.append(n)
    assert got[0] == got[1] and seen[0] == seen[1] and sum(seen[0]) == lm_score.PASSES * 3300


def test_passages_find_exact_and_edited_repeats_only(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared, edited = text(60), text(120)
    docs = {i: text(200) for i in range(30)}
    for i in (3, 9, 21):
        docs[i][50:50] = shared
    for i in (5, 17):
        copy = list(edited)
        for at in range(7 + i, 120, 17):
            copy[at] = f"e{i}{at}"
        docs[i][80:80] = copy
    docs[25] = text(20) + shared[:30] + text(20)
    docs[26] = list(docs[27])
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(None, " ".join(shared)), (40, None), (41, ""), (3, " ".join(docs[3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(4)
    got = passages.repeated_passages(df).collect()
    pairs = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in got}
    assert {x for p in pairs for x in p} == {3, 9, 21, 5, 17, 26, 27}
    assert (5, 17) in pairs and (26, 27) in pairs
    for r in got:
        a, b = docs[r["doc_id"]][r["start_word"] : r["end_word"]], docs[r["other_id"]][r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 50 and passages.lcs_length(a, b) >= r["words"] >= 0.8 * max(len(a), len(b))
        if {r["doc_id"], r["other_id"]} <= {3, 9, 21}:
            assert a == b and len(a) >= 60
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_passages_made_of_frequent_lines_are_found(spark):
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    docs = {}
    for g in range(5):
        lines = [text(20) for _ in range(3)]
        for i in range(2):
            docs[1000 + 2 * g + i] = text(40) + lines[0] + lines[1] + lines[2] + text(40)
        for line in lines:
            for _ in range(60):
                docs[len(docs)] = text(30) + line + text(30)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    assert {tuple(sorted((r["doc_id"], r["other_id"]))) for r in got} == {(1000 + 2 * g, 1001 + 2 * g) for g in range(5)}
    assert all((r["start_word"], r["end_word"], r["words"]) == (40, 100, 60) for r in got) and len(got) == 5


def test_passages_that_stand_twice_and_periodic_lines_are_found(spark):
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    line = text(7)
    want = {3: [(30, 90)], 4: [(30, 113)], 5: [(30, 100)], 6: [(30, 130)]}
    docs = {3: text(30) + ["la"] * 60 + text(30), 4: text(30) + ["la"] * 83 + text(30)}
    docs |= {5: text(30) + line * 10 + text(30), 6: text(30) + (line * 15)[:100] + text(30)}
    for g in range(10, 26, 2):  # once in one document and twice in the other, without an equal run of 50 words
        part = text(81)
        once, twice = ([f"e{g}" if i % 40 == at else w for i, w in enumerate(part)] for at in (18, 38))
        docs |= {g: text(20) + once + text(20), g + 1: text(20) + twice + text(40) + twice + text(20)}
        want |= {g: [(20, 101)], g + 1: [(20, 101), (141, 222)]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    covered = defaultdict(set)
    for r in passages.repeated_passages(df).collect():
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        covered[r["other_id"]].update(range(r["other_start"], r["other_end"]))
    for i, places in want.items():
        for lo, hi in places:
            assert len(covered[i] & set(range(lo, hi))) >= hi - lo - 5, (i, lo, hi)
    assert all(len(covered[i]) <= sum(hi - lo + 10 for lo, hi in places) for i, places in want.items())


def test_passages_with_many_edits_are_found(spark):
    rng = random.Random(23)
    text = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    docs, kinds = {}, ((52, 10), (60, 8), (80, 6), (100, 5))
    for g in range(80):
        n, every = kinds[g % 4]
        part = text(n)
        copy = [f"e{g}" if i % every == every - 1 and i < n - 1 else w for i, w in enumerate(part)]
        docs |= {2 * g: text(70) + part + text(70), 2 * g + 1: text(40) + copy + text(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    pairs = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in passages.repeated_passages(df).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in pairs)
    found = Counter(a // 2 % 4 for a, _ in pairs)
    assert [found[i] for i in range(3)] == [20, 20, 20] and found[3] >= 15


def test_short_passages_with_random_edits_are_found(spark):
    rng = random.Random(29)
    text = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]

    def edited(part, rate):
        while True:
            out = []
            for w in part:
                kind = rng.randrange(3) if rng.random() < rate else 3
                out += {0: [f"e{rng.randrange(10**6)}"], 1: [], 2: [w, f"e{rng.randrange(10**6)}"], 3: [w]}[kind]
            if len(out) >= 50 and passages.lcs_length(part, out) >= 0.81 * max(len(part), len(out)):
                return out

    docs, rates = {}, (0.05, 0.10, 0.15)
    for g in range(120):
        part = text(60)
        docs |= {2 * g: text(60) + part + text(60), 2 * g + 1: text(40) + edited(part, rates[g % 3]) + text(50)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(4)
    pairs = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in passages.repeated_passages(df).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in pairs)
    found = Counter(a // 2 % 3 for a, _ in pairs)
    assert min(found[i] for i in range(3)) >= 36, found


def test_all_places_of_shared_seeds_meet_first_and_last_document():
    rng = np.random.default_rng(3)
    seed, doc = rng.integers(0, 60, 400).astype(np.uint64), np.sort(rng.integers(0, 25, 400))
    w = np.arange(400)
    at = {}
    for s, d, i in zip(seed.tolist(), doc.tolist(), w.tolist(), strict=True):
        at.setdefault(s, {}).setdefault(d, []).append(i)
    want = []
    for of in (of for of in at.values() if len(of) > 1):
        lo, hi = of[min(of)], of[max(of)]
        for d, places in of.items():
            for n, i in enumerate(places):
                to_hi = n >= len(hi) if d == min(of) else d != max(of)
                first = i if d == min(of) else lo[n % len(lo)]
                want.append((d, i, min(of), first, max(of) if to_hi else -1, hi[n % len(hi)] if to_hi else 0, len(lo) == 1))
    order = rng.permutation(400)
    got = passages.meet(seed[order], doc[order], w[order])
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)
    # every seed that is there twice is kept, whatever shares its slot
    keep = set(passages.repeats(seed, 4).tolist())
    assert keep >= {i for i, s in enumerate(seed.tolist()) if (seed == s).sum() > 1}
    words = rng.integers(0, 1 << 63, 9).astype(np.uint64)
    assert passages.unpacked_words(passages.packed_words(words)).tolist() == [int(x) & (1 << 48) - 1 for x in words]


def test_documents_of_a_seed_that_few_hold_all_meet():
    rng = np.random.default_rng(4)
    seed, doc = rng.integers(0, 60, 400).astype(np.uint64), rng.integers(0, 25, 400)
    w = np.arange(400)
    at = {}
    for s, d, i in sorted(zip(seed.tolist(), doc.tolist(), w.tolist(), strict=True)):
        at.setdefault(s, {}).setdefault(d, []).append(i)
    want = []
    for of in (of for of in at.values() if len(of) <= 6):
        for p, q in ((p, q) for p in sorted(of)[1:-1] for q in sorted(of)[1:-1] if p > q):
            x, y = of[p], of[q]
            want += [(p, x[n % len(x)], q, y[n % len(y)]) for n in range(max(len(x), len(y)))]
    assert sorted(zip(*(x.tolist() for x in passages.between(seed, doc, w, 6)), strict=True)) == sorted(want) != []
    assert not len(passages.between(seed[:0], doc[:0], w[:0])[0])


def test_pairs_that_a_common_first_document_stands_for_are_told():
    pos = np.r_[np.arange(100, 160), np.arange(200, 260)]
    lo = np.where(pos < 160, 1, np.where(pos < 230, 2, 3))
    i = {5: np.arange(100, 160, 5), 6: np.arange(100, 140, 5), 7: np.r_[np.arange(100, 160, 5), 210], 8: np.arange(200, 260, 5)}
    q = np.concatenate([np.full(len(x), n) for n, x in i.items()])
    at = np.concatenate(list(i.values()))
    got = passages.told(np.full(len(q), 9), q, at, pos, lo, pos + 7, 4, 50)
    # 6 spans few words, 7 goes on elsewhere, 8 crosses from one first document to another.
    assert set(q[got].tolist()) == {5} and got[q == 5].all()
    assert not passages.told(np.full(len(q), 1), q, at, pos, lo, pos, 4, 50).any()


def test_edited_passages_whose_parts_stand_in_many_documents_are_found(spark):
    # a seed joined its documents to its first and last one only.
    rng = random.Random(31)
    text = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    docs = {}
    for g in range(12):
        part = text(80)
        copy = [f"e{rng.randrange(10**6)}" if rng.random() < 0.08 else w for w in part]
        for lo in range(0, 80, 20):
            for n in range(24):
                docs[n % 2 * 10_000 + len(docs)] = text(30) + part[lo : lo + 20] + text(30)
        docs |= {5000 + 2 * g: text(40) + part + text(40), 5001 + 2 * g: text(40) + copy + text(40)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(4)
    pairs = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in passages.repeated_passages(df).collect()}
    assert pairs == {(5000 + 2 * g, 5001 + 2 * g) for g in range(12)}


def test_chains_equal_quadratic_dynamic_programming():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(1, 30)
        a, b = [rng.randrange(40) for _ in range(n)], [rng.randrange(40) for _ in range(n)]
        order, best = sorted(range(n), key=lambda i: a[i]), {}
        for i in order:
            before = [best[j] - passages.GAP * (a[i] - a[j] + b[i] - b[j]) for j in best if a[j] < a[i] and b[j] < b[i]]
            best[i] = passages.K + max([0, *before])
        got = passages.chains(a, b)
        assert sorted(i for c in got for i in c) == list(range(n))
        top = got[0]
        value = passages.K * len(top) - passages.GAP * (a[top[-1]] - a[top[0]] + b[top[-1]] - b[top[0]])
        assert abs(value - max(best.values())) < 1e-9


def luhn(s):
    d = [int(x) for x in s[::-1]]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def test_surrogates_keep_kind_format_and_coreference(spark):
    rows = [
        (1, "Mail ann.b7@mail.example.com or ANN.B7@MAIL.EXAMPLE.COM, call +1 (555) 123-4567."),
        (2, "Card 4539 1488 0343 6467 and 4539148803436467, not 4539148803436468. IBAN GB82 WEST 1234 5698 7654 32."),
        (3, "Frau Anna Schmidt met Herr Schmidt and Mrs Smith; Господин Иванов too. 10.20.30.40 and 555-123-4567, SSN 123-45-6789."),
        (4, None), (5, ""), (6, "clean text, nothing 42 here"), (6, "clean text, nothing 42 here"), (None, "x@y.org"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit("clash")).withColumn("id", F.lit(1))
    got = pii.surrogates(df, "key").select("row.doc_id", "row.text", "row.kinds", F.col("kinds").alias("found")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[1]["kinds"] == "clash"
    assert by[1]["found"] == ["email", "email", "phone"] and by[2]["found"] == ["card", "card", "iban"]
    assert by[3]["found"] == ["name", "name", "name", "name", "ip", "phone", "ssn"]
    assert (by[4]["text"], by[5]["text"], by[6]["text"]) == (None, "", "clean text, nothing 42 here")
    w = by[1]["text"].replace(",", "").split()
    assert w[1].upper() == w[3] and w[1] != "ann.b7@mail.example.com" and "." in w[1].split("@")[0]
    phone = by[1]["text"].split("call ")[1]
    assert phone.startswith("+1 (") and phone[4:7].isdigit() and phone[7:9] == ") "
    digits = "".join(c for c in phone if c.isdigit())[1:]
    assert digits != "5551234567" and f"{digits[:3]}-{digits[3:6]}-{digits[6:]}" in by[3]["text"]
    words = by[2]["text"].split()
    card = "".join(words[1:5])
    assert luhn(card) == 0 and words[6].rstrip(",") == card and "4539148803436468" in by[2]["text"]
    iban = by[2]["text"].split("IBAN ")[1].rstrip(".").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban.startswith("GB") and len(iban) == 22
    t = by[3]["text"].split()
    assert t[0] == "Frau" and t[2] == t[5] and t[2] != "Schmidt" and t[8].rstrip(";") != t[2] and t[1][0].isupper()
    assert any("Ѐ" <= c <= "ӿ" for c in t[10]) and t[9] == "Господин"
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "key").collect()}
    assert all(again[i] == by[i]["text"] for i in by)
    assert {r["text"] for r in pii.pseudonymise(df, "other").where("doc_id = 1").collect()} != {by[1]["text"]}
    assert pii.pseudonymise(df.limit(0), "key").count() == 0


def test_surrogates_of_long_names_and_compact_numbers(spark):
    cards = ("4222222222222", "30569309025904", "3056 930902 5904", "6304000000000000000", "6304 0000 0000 0000 000")
    phones = ("+442071838750", "5551234567", "+33 6 12 34 56 78", "+49 30 1234567")
    names = ("Dr Anna Maria Schmidt", "Mr John F. Kennedy", "Mr J. Smith", "Herr Ludwig van der Berg", "Herr Dr. Schmidt", "Mr J.R. Smith")
    texts = [*cards, *phones, *names, "4539 1488 0343 6467 12"]
    df = spark.createDataFrame([(i, f"see {t}, please") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(df, "k").select("row.doc_id", "row.text", F.col("kinds").alias("found")).collect()}
    new = [got[i]["text"][4:-8] for i in range(len(texts))]
    assert all(got[i]["text"].endswith(", please") for i in got)
    for i, (t, n) in enumerate(zip(texts, new, strict=True)):
        kind = "card" if i < 5 or i == len(texts) - 1 else "phone" if i < 9 else "name"
        assert got[i]["found"] == [kind] and n != t, (t, n)
        if kind != "name":
            assert [c if c.isdigit() else "" for c in t].count("") == [c if c.isdigit() else "" for c in n].count("") and len(n) == len(t)
    assert all(luhn("".join(c for c in n if c.isdigit())) == 0 for n in new[:5])
    assert new[-1].endswith(" 12") and luhn(new[-1][:19].replace(" ", "")) == 0
    for t, n in zip(names, new[9:-1], strict=True):
        old, now = t.split(), n.split()
        assert len(old) == len(now) and old[0] == now[0] and old[-1] != now[-1] and not {"Anna", "Maria", "John", "Ludwig"} & set(now)
    assert new[12].split()[2:4] == ["van", "der"] and new[13].split()[1] == "Dr." and new[10].split()[2][1:] == new[11].split()[1][1:] == "."
    assert new[9].split()[3] == new[13].split()[2] and new[11].split()[2] == new[14].split()[2]


def test_surrogates_are_distinct_and_never_entities(spark):
    units = spark.range(20_000).select(F.lit("ssn").alias("kind"), F.lpad((F.col("id") % 9999).cast("string"), 4, "0").alias("canonical"))
    got = pii.dictionary(units.where("canonical < '4000'"), "k").collect()
    new = [r["surrogate"] for r in got]
    assert len(got) == 4000 == len(set(new)) and all(x >= "4000" for x in new)


def test_open_starts_leave_out_only_runs_that_one_document_explains():
    # 25 seeds each four words: one document at one distance explains all runs of 50 words
    pos = np.arange(0, 100, 4)
    before, after = np.append(-1, pos[:-1]), np.append(pos[1:], 101)
    assert not len(passages.open_starts(pos, before, after, np.zeros(25, np.int64), pos + 7, 4, 50))
    # a change of document in the middle opens the runs that hold two seeds and more of both sides
    lo = np.repeat([5, 6], [12, 13])
    got = passages.open_starts(pos, before, after, lo, pos + 7, 4, 50).tolist()
    assert got == [s for s in range(55) if ((pos >= s) & (pos < 48)).sum() > 1 and ((pos >= 48) & (pos <= s + 46)).sum() > 1]
    # so does a change of distance, and no run holds a seed that is not shared
    assert passages.open_starts(pos, before, after, lo * 0, pos + lo, 4, 50).tolist() == got
    before[12] = after[11] = 46
    assert passages.open_starts(pos, before, after, np.arange(25), pos, 4, 51).min() == 47


def test_language_needs_letters_and_equals_plain_naive_bayes(spark):
    rows = [(1, "ab ba", "x"), (2, "ba bb", "x"), (3, "cd dc Cd", "y"), (4, "ab", None), (5, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df)
    odd = ["½ ² ①", "Ⅷ", "٣ 12_", "ª", "Ab dc", "dd"]
    got = lang_id.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model, {"doc_id": F.col("doc_id")}).collect()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in range(4)] == ["und", "und", "und", by[3]["lang_pred"]] and by[3]["lang_pred"] != "und"

    def grams(t):
        t = f" {t.lower()} "
        return [t[i : i + n] for n in lang_id.ORDERS for i in range(len(t) - n + 1)]

    counts = {"x": Counter(g for t in ("ab ba", "ba bb") for g in grams(t)), "y": Counter(grams("cd dc Cd"))}
    for i in (4, 5):
        joint = []
        for lang, prior in (("x", 2 / 3), ("y", 1 / 3)):
            c, n = counts[lang], sum(counts[lang].values())
            joint.append(math.log(prior) + sum(math.log((c[g] + 0.5) / (n + 0.5 * lang_id.BUCKETS)) for g in grams(odd[i])))
        best = max(joint)
        assert by[i]["lang_pred"] == "xy"[joint.index(best)]
        assert abs(by[i]["score"] - 1 / sum(math.exp(v - best) for v in joint)) < 1e-6


def test_quality_fit_with_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, "Good text, this is."), (2, "$$$ WIN !!!")] + [(1, "Good text, this is.")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.rate(docs, quality.fit(docs, labels, F.lit(True)), {"doc_id": F.col("doc_id")}).where("doc_id = 1 and predicted = 1").count() == 51


def test_media_orphans_go(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, "d")], "doc_id long, text string")
    root = f"file://{tmp_path}/shards"
    rows = media.write_shards(df, root)
    (tmp_path / "shards" / "shard-000000-lost-0000.tar").write_bytes(b"x")
    assert media.drop_orphans(rows, root) == 1 and media.drop_orphans(rows, root) == 0
    assert media.header_columns(media.places(rows), root).count() == 2


def test_surrogates_are_one_for_a_person_and_a_host(spark):
    texts = ["Dr. Anna Meier", "Mrs Anna Meier", "Prof Anna Roth", "Dr Jan-Peter Maier", "a@acme.com", "b@acme.com", "c@other.com", "2001:db8:0:1:2:3:4:5", "fe80:0:1::9"]
    df = spark.createDataFrame([(i, f"with {t} today") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(df, "secret key").select("row.doc_id", "row.text", F.col("kinds").alias("found")).collect()}
    new = [got[i]["text"][5:-6] for i in range(len(texts))]
    assert [got[i]["found"] for i in range(len(texts))] == [["name"]] * 4 + [["email"]] * 3 + [["ipv6"]] * 2
    assert new[0].split()[1:] == new[1].split()[1:] and new[2].split()[1] == new[0].split()[1] and new[2].split()[2] != new[0].split()[2]
    assert new[3].count("-") == 1 and all(p[0].isupper() for p in new[3].split()[1].split("-"))
    hosts = [x.split("@")[1] for x in new[4:7]]
    assert hosts[0] == hosts[1] != hosts[2] and all(h.endswith(".example.com") for h in hosts)
    assert all(a != b and a.count(":") == b.count(":") and len(a) == len(b) for a, b in zip(texts[7:], new[7:], strict=True))
    plan = pii.surrogates(df, "secret key")._jdf.queryExecution().toString()
    assert "secret key" not in plan


def test_lm_does_not_depend_on_partitions(spark):
    rows = [(i, " ".join(random.Random(i % 7).choices("the cat sat on a mat".split(), k=30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 10 == 0
    got = [{r["doc_id"]: r["score"] for r in lm_score.score(df.repartition(n), held).collect()} for n in (1, 5)]
    assert all(abs(got[0][i] - got[1][i]) < 1e-6 * abs(got[0][i]) for i in got[0])


def test_runs_of_names_hosts_digits_and_signs_of_megabytes_return(spark):
    n = 200_000
    texts = ["Dr " + "Anna " * n, "x@" + "b." * n + "com", "x@" + "ab." * n + "com", "1" * 5 * n, "@" * 5 * n, "+1 " * n, "Dr " * n, "a:" * n, "1.2." * n, "A-" * n + "A", "Mr A." + "B." * n, "Dr A" + "a" * 5 * n, "4111 " * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    out = {r["row"]["doc_id"]: (r["row"]["text"], r["kinds"]) for r in pii.surrogates(df, "k").collect()}
    assert len(out) == len(texts) and out[0][1] == ["name"] and out[0][0].endswith("Anna Anna ") and out[1] == (texts[1], [])


def test_names_in_capitals(spark):
    df = spark.createDataFrame([(1, "MR. JOHN SMITH met Mr Smith, MS Word and DR Meier")], "doc_id int, text string")
    r = pii.surrogates(df, "k").first()
    assert r["kinds"] == ["name", "name"] and "SMITH" not in r["row"]["text"] and "MS Word and DR Meier" in r["row"]["text"]
    first, second = r["row"]["text"].split(" met ")
    assert first.startswith("MR. ") and first.split()[-1] == second.split(",")[0].split()[-1].upper()


def test_features_of_texts_that_span_segments(monkeypatch):
    texts = [b"Ab 1!\n", None, b"", b"x" * 5000 + b" \xc3\xa9", b"? <a>", b"9" * 64]
    want = quality.features(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(quality, "SEGMENT_BYTES", size)
        assert (quality.features(texts) == want).all()
    lens = np.array([len(t or b"") for t in texts])
    got = quality._class_counts(np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), lens)
    assert got.sum(1).tolist() == lens.tolist() and got[0].tolist()[:5] == [1, 1, 1, 1, 1]


def test_grams_of_a_long_text_piece_by_piece(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abÉ ß1.,\n½") for _ in range(n)) for n in (0, 1, 5, 60, 400)] + ["x" * 300, " " * 50, "1 2 3", "a"]
    for text in texts:
        want = Counter(k for key, _, _ in lang_id._grams([text], lang_id.ORDERS, 1 << 15) for k in key.tolist())
        for size in (1, 3, 10):
            monkeypatch.setattr(lang_id, "SEGMENT_CHARS", size)
            assert "".join(lang_id._pieces(text)) == text
            got = Counter(k for key in lang_id._long_grams(text, lang_id.ORDERS, 1 << 15) for k in key.tolist())
            # A text without letters is two blanks for one and a blank for the other; neither is scored.
            assert got == want or not lang_id._has_letter(text)


def test_a_long_text_scores_as_its_short_form(spark, monkeypatch):
    df = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    model = lang_id.fit(df)
    texts = ["und die und der " * 200, "the dog " * 300]
    want = model.posteriors(texts)
    monkeypatch.setattr(lang_id, "SEGMENT_CHARS", 50)
    assert np.allclose(model.posteriors(texts), want) and want.argmax(1).tolist() == [0, 1]


def test_quality_learns_from_every_labelled_row(spark):
    # All rows but the ones of one id say that shouting is good; there are more of them than any sample held.
    n = 21_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "calm text, as it is.").otherwise("BUY!!! $$$ now").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    first = labels.orderBy(F.xxhash64("doc_id")).limit(20_000).select("doc_id").withColumn("first", F.lit(True))
    labels = labels.join(first, "doc_id", "left").select("doc_id", F.when(F.col("first"), F.lit(1)).otherwise(F.col("quality")).alias("quality"))
    ranking = quality.fit(docs, labels, F.lit(True))
    assert np.abs(ranking.weights).max() > 0
