"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in surface features of its whole text. The weights
are learned from preference pairs (a document labelled 1 is preferred to one
labelled 0): the logistic loss of the difference of their features. The cut
between accepted and rejected is a quantile of the training documents' scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import SEGMENT_BYTES, Tables, blocks, hash_words, lean, prepare, text_blocks
from tracewell.workers import spread

#: Preference pairs that few labelled rows make; more rows make PARTNERS pairs a row.
FIT_PAIRS, PARTNERS = 200_000, 4
#: Labelled rows a task has at least: rows of one block prefer to each other.
BLOCK_ROWS = 5_000
#: Steps of the fit, and bins by which quantiles of scores are found.
STEPS, BINS = 25, 1 << 14

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:'",
    "shout": b"!?",
    "mark": b"#$%&*+=@^~_",
    "bracket": b"<>|{}[]()/\\\"",
    "high": bytes(range(128, 256)),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _i

FEATURES = (
    *(f"share_{k}" for k in _CLASSES),
    *(f"some_{k}" for k in ("upper", "digit", "line", "shout", "mark", "bracket")),
    "share_other", "log_words", "word_length", "short_text", "distinct_words", "repeats", "many_repeats", "top_word", "marked_words",
)


def _class_counts(buf: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text; ``buf`` holds texts of ``lens`` bytes one after the other.

    Counted segment by segment, so a long text takes no more memory than its own.
    """
    k, ends = len(_CLASSES) + 1, np.cumsum(lens)
    out = np.zeros(len(lens) * k, np.int64)
    for lo in range(0, len(buf), SEGMENT_BYTES):
        hi = min(lo + SEGMENT_BYTES, len(buf))
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        held = np.minimum(ends[first:last], hi) - np.maximum(ends[first:last] - lens[first:last], lo)
        code = np.repeat(np.arange(last - first) * k, held) + _CLASS_OF[buf[lo:hi]]
        out[first * k : last * k] += np.bincount(code, minlength=(last - first) * k)
    return out.reshape(len(lens), k)


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros but for short_text."""
    out = np.zeros((len(texts), len(FEATURES)))
    k = len(_CLASSES)
    for lo, hi in blocks(texts):
        part = texts[lo:hi]
        lens = np.fromiter((len(t) if t else 0 for t in part), np.int64, hi - lo)
        buf = np.frombuffer(b"".join([t or b"" for t in part]), np.uint8)
        counts = _class_counts(buf, lens)
        share = counts / np.maximum(lens, 1)[:, None]
        names = list(_CLASSES)
        some = [np.minimum(share[:, names.index(c)] / 0.03, 1) for c in ("upper", "digit", "line", "shout", "mark", "bracket")]
        h, n = hash_words(part)
        word_of = np.repeat(np.arange(hi - lo), n)
        letters = counts[:, :k].sum(1) + counts[:, k] - counts[:, names.index("space")] - counts[:, names.index("line")]
        same = np.zeros(hi - lo)
        if len(h) > 1:
            again = (h[1:] == h[:-1]) & (word_of[1:] == word_of[:-1])
            same = np.bincount(word_of[1:][again], minlength=hi - lo)
        distinct, top = np.zeros(hi - lo), np.zeros(hi - lo)
        if len(h):
            order = np.lexsort((h, word_of))
            hs, ws = h[order], word_of[order]
            new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
            first = np.flatnonzero(new)
            run = np.diff(np.append(first, len(hs)))
            distinct = np.bincount(ws[first], minlength=hi - lo)
            np.maximum.at(top, ws[first], run)
        m = np.maximum(n, 1)
        marks = counts[:, names.index("mark")] + counts[:, names.index("shout")] + counts[:, names.index("bracket")]
        out[lo:hi] = np.column_stack(
            [share[:, :k], *some, share[:, k], np.log1p(n), np.minimum(letters / m, 20) / 10, n < 5,
             distinct / m, same / m, np.minimum(same / m / 0.1, 1), top / m, np.minimum(marks / m, 1)]
        )
    return out


class Ranking:
    """Standardisation, Bradley-Terry weights, the cut and the scale of scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, at least 0.5 exactly where the raw score is at or above the cut."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut), -30, 30)))


#: A function of the features and labels of a block, and the sum of its results over all blocks.
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
Total = Callable[[Part], np.ndarray]


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(y), (y == 0).sum()], x.sum(0)])


def _squares(mean: np.ndarray) -> Part:
    return lambda x, y: ((x - mean) ** 2).sum(0)


def _preferences(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, partners: int) -> Part:
    """Pairs, loss, gradient and second derivatives of a block: each row meets ``partners`` rows of the other label."""

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = len(w)
        z = ((x - mean) / scale).clip(-8, 8)
        good, bad = z[y == 1], z[y == 0]
        out = [np.zeros(2 + k + k * k)]
        m = max(len(good), len(bad)) if len(good) and len(bad) else 0
        i = np.arange(m)
        for s in range(min(partners, len(good), len(bad)) if m else 0):
            # Shifting the shorter side gives other pairs each time.
            shift = s * max(1, min(len(good), len(bad)) // partners)
            ahead = (shift, 0) if len(good) < len(bad) else (0, shift)
            d = good[(i + ahead[0]) % len(good)] - bad[(i + ahead[1]) % len(bad)]
            t = d @ w
            p = 1 / (1 + np.exp(np.clip(t, -30, 30)))  # chance of the other order
            out.append(np.concatenate([[m, np.logaddexp(0, -t).sum()], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()]))
        return np.sum(out, 0)

    return part


def _histogram(r: Ranking, lo: float, hi: float) -> Part:
    """Rows of label 0 and of label 1 in each bin of raw scores between lo and hi, with what is below and above."""

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(np.floor((r.raw(x) - lo) / (hi - lo) * BINS).astype(np.int64) + 1, 0, BINS + 1)
        return np.bincount(np.minimum(y, 1) * (BINS + 2) + at, minlength=2 * (BINS + 2)).astype(float)

    return part


def _learn(total: Total, l2: float = 1e-4) -> Ranking:
    """Bradley-Terry by Newton's method on the preference pairs of all rows.

    The cut is the quantile of training scores at the share of rows labelled 0.
    With one label only there are no pairs: the weights are 0, and all rows
    score 1 (or 0.0 where only label 0 was seen).
    """
    n, bad, *sums = total(_moments)
    k = len(sums)
    if not n:
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), -1.0, 30.0)
    mean = np.array(sums) / n
    scale = np.maximum(np.sqrt(total(_squares(mean)) / n), 1e-6)
    if bad in (0, n):
        return Ranking(mean, scale, np.zeros(k), 1.0 if bad else -1.0, 30.0)
    partners = int(np.clip(FIT_PAIRS // n, PARTNERS, 64))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The regular mean loss and its derivatives."""
        pairs, loss, *rest = total(_preferences(mean, scale, w, partners))
        pairs = max(pairs, 1.0)
        g, h = np.array(rest[:k]) / pairs - l2 * w, np.array(rest[k:]).reshape(k, k) / pairs + l2 * np.eye(k)
        return loss / pairs + l2 / 2 * w @ w, g, h

    w, step = np.zeros(k), 1.0
    loss, g, h = at(w)
    for _ in range(STEPS):
        move = step * np.linalg.solve(h, g)
        new = at(w + move)
        if new[0] > loss:
            step /= 2
            continue
        near, w, step = loss - new[0] < 1e-7, w + move, min(1.0, 2 * step)
        loss, g, h = new
        if near:
            break
    r = Ranking(mean, scale, w, 0.0, 1.0)
    reach = 8 * np.abs(w).sum() + 1e-9
    whole = total(_histogram(r, -reach, reach)).reshape(2, -1)

    def place(rank: float) -> float:
        """The raw score of a rank, found in a bin of a bin."""
        lo, hi, counts = -reach, reach, whole
        for more in (True, False):
            bin_ = int(np.clip(np.searchsorted(np.cumsum(counts.sum(0)), rank, "right") - 1, 0, BINS - 1))
            lo, hi = (lo + (hi - lo) / BINS * i for i in (bin_, bin_ + 1))
            if more:
                counts = total(_histogram(r, lo, hi)).reshape(2, -1)
        return (lo + hi) / 2

    before, after = place(bad - 1), place(bad)
    cut = before + (1 - bad / n) * (after - before)
    # the slope makes scores probabilities: logistic fit of the label on raw - cut
    raw = -reach + (np.arange(BINS + 2) - 0.5) * 2 * reach / BINS - cut
    slope, rows = 1.0, whole.sum(0)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * raw, -30, 30)))
        g = ((whole[1] - rows * q) * raw).sum() / n
        hess = (rows * q * (1 - q) * raw**2).sum() / n + 1e-6
        slope = float(np.clip(slope + g / hess, 0.05, 50))
    return Ranking(mean, scale, w, cut, slope)


def fit_ranking(x: np.ndarray, y: np.ndarray) -> Ranking:
    """``_learn`` from rows that are at hand."""
    return _learn(lambda part: part(x, np.asarray(y)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Ranking:
    """Learn from all labelled documents for which ``train`` (on the labels) holds.

    Null ids and labels are left out. Documents meet their labels as features, which
    are written once; each step of the fit is a pass over them, of which a task
    returns sums. Of documents that share an id the least features count, so
    there are no more rows than labels, however often an id repeats.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = Tables(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train)
    known = known.select(F.col(id_col).cast("long").alias("id"), F.least(F.col(label_col).cast("int"), F.lit(1)).alias("y")).distinct()

    def counted(it):
        for batch in it:
            for lo, hi, texts in text_blocks(batch.column("text")):
                x = features(texts)
                held = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), held], ["id", "x"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    read = read.mapInArrow(lean(counted), "id long, x array<double>").join(known, "id")
    rows = tables.cut(read.groupBy("id", "y").agg(F.min("x").alias("x")))
    n = max(1, min(spread(spark), rows.count() // BLOCK_ROWS))
    rows = tables.cut(rows.repartition(n, F.xxhash64("id")).sortWithinPartitions(F.xxhash64("id"), "id", "y"))

    def total(part: Part) -> np.ndarray:
        def run(it):
            sums = part(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64))
            for batch in it:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                sums = sums + part(x, batch.column("y").to_numpy(zero_copy_only=False))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

        size = len(part(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64)))
        got = rows.select("x", "y").mapInArrow(lean(run), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size)
        out[got.column("at").to_numpy()] = got.column("n").to_numpy()
        return out

    ranking = _learn(total)
    tables.drop(rows)
    return ranking


def rate(docs: DataFrame, ranking: Ranking, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score, predicted for each document.

    A null text scores as an empty one. Equal texts score alike; every row is
    returned. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    base = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("__text"))

    def run(it):
        for batch in it:
            for lo, hi, texts in text_blocks(batch.column(-1)):
                s, rows = ranking.score(features(texts)), batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(lean(run), f"{schema}, score double, predicted int")
