"""Log-probabilities of texts under a log-bilinear neural language model.

The model predicts the next token's class from the two tokens before it: the
context vector is a sum of matrices times the context tokens' vectors, and a
class's energy is its vector's product with the context vector plus a bias
(Mnih and Hinton, 2007). Classes are the most frequent words, the end of text,
and groups of all other words by their last two bytes; within a group a word has
its smoothed relative frequency. So each text, with words never seen in training
too, has a proper probability.

Counts cover all training documents. Training is noise-contrastive estimation
(Mnih and Teh, 2012) in numpy: each round deals its share of the training
documents by the hash of their rows to shards of about SHARD_TOKENS tokens. Each
shard reads its documents in the order of their hashes and passes PASSES times
over them, all shards start from the same parameters, and the results are
averaged by the number of tokens, in a tree; the rounds together see every
training document. So the model does not depend on how the input is partitioned.
Normalisers of all contexts come from batched matrix products, once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, hash_words, lean, partition_id, prepare, text_blocks

#: Words with a class of their own, the end of text among them; groups of others.
HEAD, GROUPS = 960, 64
#: Words whose counts the executors hold; the counts of others come by a join.
HELD_WORDS = 1 << 17
DIM, BATCH, NOISE, ROUNDS, RATE, PASSES = 32, 512, 64, 3, 0.15, 2
#: Tokens of a shard, which one model passes over in a round.
SHARD_TOKENS = 1_000_000
#: Tokens that a task holds to pass over them again; a larger shard is passed over in such parts.
HELD_TOKENS = 1 << 21
SMOOTH = 0.1
#: The end of text as a key; the low bits of a word's key are its group.
END = np.int64(-1)


def _keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's end included, and tokens in each text."""
    h, n, tail = hash_words(texts, suffixes=True)
    keys = ((h & ~np.uint64(GROUPS - 1)) | (tail & np.uint64(GROUPS - 1))).view(np.int64)
    out = np.insert(keys, np.cumsum(n), END)
    return out, n + 1


def _count(it):
    for batch in it:
        found = [np.unique(_keys(texts)[0], return_counts=True) for _, _, texts in text_blocks(batch.column(0))]
        if found:
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


class Vocabulary:
    """Corpus totals, the classes, and counts of the held words. Its size is fixed by HEAD, GROUPS and HELD_WORDS."""

    def __init__(self, tokens: int, distinct: int, held: np.ndarray, held_n: np.ndarray, group_n: np.ndarray, group_v: np.ndarray):
        """held: keys by falling count; group_n, group_v: tokens and distinct words of all keys by low bits."""
        self.tokens, self.distinct = tokens, distinct
        head = held[held != END][: HEAD - 1]
        head_n = held_n[held != END][: HEAD - 1]
        ends = int(held_n[held == END].sum())
        low = head & (GROUPS - 1)
        group_n = group_n - np.bincount(low, head_n, GROUPS)
        group_v = group_v - np.bincount(low, minlength=GROUPS)
        if ends:  # the end of text is no word of a group
            group_n[END & (GROUPS - 1)] -= ends
            group_v[END & (GROUPS - 1)] -= 1
        self.group_norm = np.log10(group_n + SMOOTH * (group_v + 1))
        self.head = np.sort(np.append(head, END))
        n = dict(zip(head.tolist(), head_n.tolist(), strict=True)) | {int(END): ends}
        self.class_n = np.concatenate([[n[int(k)] for k in self.head], group_n]).astype(float) + SMOOTH
        order = np.argsort(held)
        self.held, self.held_log = held[order], np.log10(held_n[order] + SMOOTH)
        self.base_norm = np.log10(tokens + SMOOTH * (distinct + 1))

    @property
    def classes(self) -> int:
        return len(self.head) + GROUPS

    def classify(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
        return np.where(self.head[at] == keys, at, len(self.head) + (keys & (GROUPS - 1)))


def _contexts(classes: np.ndarray, lens: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each; ``start`` before a text."""
    one, two = np.empty_like(classes), np.empty_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    first = np.cumsum(lens) - lens
    one[first], two[first] = start, start
    second = first[lens > 1] + 1
    two[second] = start
    return one, two


def _sums(at: np.ndarray, rows: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``rows`` by their numbers ``at``, of 0..n-1; into ``out`` where given."""
    dim = rows.shape[1]
    out = np.empty((n, dim), np.float32) if out is None else out
    out.fill(0)
    np.add.at(out.reshape(-1), (at.astype(np.int64)[:, None] * dim + np.arange(dim)).ravel(), rows.ravel())
    return out


NAMES = ("R", "C1", "C2", "Q", "b")


def start_parameters(class_n: np.ndarray, dim: int = DIM, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = len(class_n)
    out = {
        "R": rng.standard_normal((k + 1, dim)) * 0.3,
        "C1": np.eye(dim) + rng.standard_normal((dim, dim)) * 0.05,
        "C2": 0.5 * np.eye(dim) + rng.standard_normal((dim, dim)) * 0.05,
        "Q": rng.standard_normal((k, dim)) * 0.1,
        "b": np.log(class_n / class_n.sum()),
    }
    return {n: v.astype(np.float32) for n, v in out.items()}


def pack_parameters(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(p[n], np.float32).tobytes() for n in NAMES)


def unpack_parameters(raw: bytes, classes: int, dim: int = DIM) -> dict[str, np.ndarray]:
    shapes = {"R": (classes + 1, dim), "C1": (dim, dim), "C2": (dim, dim), "Q": (classes, dim), "b": (classes,)}
    flat, at, out = np.frombuffer(raw, np.float32), 0, {}
    for n in NAMES:
        size = int(np.prod(shapes[n]))
        out[n], at = flat[at : at + size].reshape(shapes[n]).copy(), at + size
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad steps.

    Parameters, their summed squares and gradients lie in one array each, so a step
    is a few operations on whole arrays.
    """

    def __init__(self, params: dict[str, np.ndarray], class_n: np.ndarray, seed: int):
        self.flat = np.concatenate([params[n].ravel() for n in NAMES]).astype(np.float32)
        self.sq, self.grad, self.work = np.full_like(self.flat, 1e-2), np.zeros_like(self.flat), np.empty_like(self.flat)
        self.p, self.g, at = {}, {}, 0
        for n in NAMES:
            size = params[n].size
            self.p[n], self.g[n] = (x[at : at + size].reshape(params[n].shape) for x in (self.flat, self.grad))
            at += size
        q = class_n / class_n.sum()
        self.cum, self.log_kq = np.cumsum(q), np.log(NOISE * q).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.held: list[tuple[np.ndarray, ...]] = []

    def train(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Take tokens and their contexts; parts have HELD_TOKENS, so blocks of texts play no part."""
        self.held.append(tuple(x.astype(np.int16) for x in (w, one, two)))
        if sum(len(x[0]) for x in self.held) >= HELD_TOKENS:
            self._pass(HELD_TOKENS)

    def finish(self) -> dict[str, np.ndarray]:
        self._pass(1)
        return self.p

    def _pass(self, least: int) -> None:
        """Pass over the tokens held, in parts of at most HELD_TOKENS, until less than ``least`` remain."""
        if not self.held:
            return
        cols = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        while len(cols[0]) >= least:
            part, cols = [x[:HELD_TOKENS] for x in cols], [x[HELD_TOKENS:] for x in cols]
            starts = range(0, len(part[0]), BATCH)
            for _ in range(PASSES):
                for at in range(0, len(starts), 256):  # noise for many batches at once
                    some = starts[at : at + 256]
                    noise = np.minimum(np.searchsorted(self.cum, self.rng.random((len(some), NOISE))), len(self.cum) - 1)
                    for lo, x in zip(some, noise, strict=True):
                        self._batch(*(c[lo : lo + BATCH] for c in part), x)
        self.held = [tuple(x.copy() for x in cols)]

    def _batch(self, w, one, two, noise) -> None:
        p, g = self.p, self.g
        r1, r2 = p["R"][one], p["R"][two]
        hat = r1 @ p["C1"]
        hat += r2 @ p["C2"]
        qw, qx = p["Q"][w], p["Q"][noise]
        pos = np.einsum("ij,ij->i", hat, qw) + p["b"][w] - self.log_kq[w]
        neg = hat @ qx.T
        neg += p["b"][noise] - self.log_kq[noise]
        # gradients of log sigmoid(pos) + sum log sigmoid(-neg), averaged over the batch
        gp = (1 / (1 + np.exp(np.clip(pos, -30, 30)))) / len(w)
        gn = _logistic(neg)
        gn *= np.float32(-1 / len(w))
        d_hat = gp[:, None] * qw
        d_hat += gn @ qx
        target = np.concatenate([w, noise])
        _sums(np.concatenate([one, two]), np.concatenate([d_hat @ p["C1"].T, d_hat @ p["C2"].T]), len(p["R"]), g["R"])
        np.matmul(r1.T, d_hat, out=g["C1"])
        np.matmul(r2.T, d_hat, out=g["C2"])
        _sums(target, np.concatenate([gp[:, None] * hat, gn.T @ hat]), len(p["Q"]), g["Q"])
        g["b"][:] = np.bincount(target, np.concatenate([gp, gn.sum(0)]), len(p["b"]))
        np.multiply(self.grad, self.grad, out=self.work)
        self.sq += self.work
        np.sqrt(self.sq, out=self.work)
        np.divide(self.grad, self.work, out=self.work)
        self.work *= np.float32(RATE)
        self.flat += self.work


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place, x within -30 to 30."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _train(vocab, params: bytes, seed: int):
    """One model for each shard; rows (shard, text) come sorted by shard."""

    def run(it):
        v, at, trainer, seen = vocab.value, None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([float(seen)]), pa.array([pack_parameters(trainer.finish())])], ["part", "weight", "params"])

        for batch in it:
            shards = batch.column(0).to_numpy()
            for lo, _, texts in text_blocks(batch.column(1)):
                cuts = np.flatnonzero(np.diff(shards[lo : lo + len(texts)])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                    if shards[lo + a] != at:
                        if trainer is not None:
                            yield done()
                        at, seen = int(shards[lo + a]), 0
                        trainer = Trainer(unpack_parameters(params, v.classes), v.class_n, seed * 1_000_003 + at)
                    keys, lens = _keys(texts[a:b])
                    w = v.classify(keys)
                    trainer.train(w, *_contexts(w, lens, v.classes))
                    seen += len(w)
        if trainer is not None:
            yield done()

    return lean(run)


_PARTS = "part long, weight double, params binary"


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    weight = np.array(table.column("weight").to_pylist())
    total = sum(w * np.frombuffer(p, np.float32).astype(np.float64) for w, p in zip(weight, table.column("params").to_pylist(), strict=True))
    mean = (total / weight.sum()).astype(np.float32).tobytes()
    part = table.column("part").to_pylist()[0] // 8
    return pa.table([pa.array([part], pa.int64()), pa.array([weight.sum()]), pa.array([mean])], ["part", "weight", "params"])


def _merged(parts: DataFrame, count: int) -> bytes | None:
    """The weighted mean; eight models meet at a time, the driver sees at most eight."""
    while count > 8:
        parts = parts.groupBy(F.floor(F.col("part") / 8).cast("long").alias("g")).applyInArrow(_average, _PARTS)
        count = -(-count // 8)
    got = parts.toArrow()
    return _average(got).column("params")[0].as_py() if got.num_rows else None


class Model:
    """Tables for scoring: energies by each context position, and all normalisers."""

    def __init__(self, vocab: Vocabulary, params: dict[str, np.ndarray]):
        p = {n: v.astype(np.float64) for n, v in params.items()}
        self.vocab = vocab
        self.one = (p["R"] @ p["C1"] @ p["Q"].T + p["b"]).astype(np.float32)
        self.two = (p["R"] @ p["C2"] @ p["Q"].T).astype(np.float32)
        self.norm = np.empty((vocab.classes + 1, vocab.classes + 1), np.float32)
        e1, e2 = np.exp(np.clip(self.one, -80, 20)), np.exp(np.clip(self.two, -20, 20))
        # sum over classes of exp(one[a] + two[b]) for all pairs: a matrix product
        self.norm[:] = np.log(e1 @ e2.T)
        self.one, self.two = np.log(e1), np.log(e2)

    def log10_probability(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities of classes after their contexts."""
        return (self.one[one, w].astype(np.float64) + self.two[two, w] - self.norm[one, two]) / np.log(10)


_ROW = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>, times array<long>"


def _score(model):
    def run(it):
        m, pid, row = model.value, partition_id(), 0
        v = m.vocab
        for batch in it:
            cols: list[list] = [[] for _ in range(6)]
            for _, _, texts in text_blocks(batch.column("text")):
                keys, lens = _keys(texts)
                w = v.classify(keys)
                first = np.cumsum(lens) - lens
                at = np.minimum(np.searchsorted(v.held, keys), max(0, len(v.held) - 1))
                held = v.held[at] == keys if len(v.held) else np.zeros(len(keys), bool)
                logs = np.where(held, v.held_log[at], 0.0) if len(v.held) else np.zeros(len(keys))
                grouped = w >= len(v.head)
                lm = m.log10_probability(w, *_contexts(w, lens, v.classes))
                lm += np.where(grouped, logs - v.group_norm[np.maximum(w - len(v.head), 0)], 0.0)
                cols[0] += lens.tolist()
                cols[1] += np.add.reduceat(held, first, dtype=np.int64).tolist()
                cols[2] += np.add.reduceat(logs - v.base_norm, first).tolist()
                cols[3] += np.add.reduceat(lm, first).tolist()
                rest = np.flatnonzero(~held)
                cuts = np.searchsorted(rest, np.append(first, len(keys)))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key, n = np.unique(keys[rest[a:b]], return_counts=True)
                    cols[4].append(key)
                    cols[5].append(n)
            n = batch.num_rows
            rows = np.arange(row, row + n) + (pid << 40)
            row += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "times"],
            )

    return lean(run)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Score all documents; learn from those that ``held_out`` is false for.

    Columns: doc_id, held_out, n_tokens and n_known (tokens with a training
    count), train_tokens, base_score (log10 probability by smoothed word
    frequencies) and score (log10 probability by the model).

    A text's tokens are its words and one end, so a null or empty text has one
    token. Repeated rows are scored each, and counted each in training. Without
    training documents all words are equally new: base_score is 0 for each.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    train = base.where(~F.col("held_out"))
    counts = cut(train.select("text").mapInArrow(lean(_count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    by_group = counts.groupBy(F.col("key").bitwiseAND(GROUPS - 1).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pylist()
    group_n, group_v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in by_group:
        group_n[r["g"]], group_v[r["g"]] = r["n"], r["v"]
    top = counts.orderBy(F.desc("n"), "key").limit(HELD_WORDS).toArrow()
    held, held_n = top.column("key").to_numpy(), top.column("n").to_numpy()
    end = counts.where(F.col("key") == int(END)).first()
    if end is not None and not (held == END).any():
        held, held_n = np.append(held, END), np.append(held_n, end["n"])
    vocab = Vocabulary(int(group_n.sum()), int(group_v.sum()), held.copy(), held_n.copy(), group_n, group_v)
    sent = spark.sparkContext.broadcast(vocab)
    params = pack_parameters(start_parameters(vocab.class_n))
    shards = max(1, round(vocab.tokens / (rounds * SHARD_TOKENS)))
    for i in range(rounds):
        share = train.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.pmod("h", F.lit(rounds)) == i)
        share = share.select(F.pmod(F.floor(F.col("h") / rounds).cast("long"), F.lit(shards)).alias("shard"), "h", "text")
        dealt = share.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
        parts = cut(dealt.mapInArrow(_train(sent, params, i), _PARTS))
        last = parts.agg(F.max("part")).first()[0]
        params = _merged(parts, (last or 0) + 1) or params
    model = Model(vocab, unpack_parameters(params, vocab.classes))
    scored = cut(base.mapInArrow(_score(spark.sparkContext.broadcast(model)), _ROW))
    # A word comes once a row with its number there; one that only held-out rows have may be in many, and AQE splits it.
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("key"), F.col("r.times").alias("t"))
    rest = rest.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("t"))).alias("more")
    )
    out = scored.drop("rest", "times").join(rest, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
