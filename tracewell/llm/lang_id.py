"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to four characters are hashed into a fixed number of
buckets. Training counts buckets by language over all training documents; the
matrix of log probabilities (buckets x languages) has a fixed size and goes to
the executors, which score a block of texts at once with numpy.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import lean, mix64, prepare, text_blocks

#: Hash buckets; the n-gram lengths; the most languages that a model holds.
BUCKETS, ORDERS, MAX_LANGS = 1 << 15, (1, 2, 3, 4), 1000
UNKNOWN = "und"

#: Numbers that \\w takes beside letters, decimal digits and "_", such as a half or a Roman eight.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKS = str.maketrans(dict.fromkeys(_NUMBERS, " "))
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+")


def _plain(text: str) -> str:
    """The text with a blank for each such number."""
    return text if text.isascii() or _NUMBERS.isdisjoint(text) else text.translate(_BLANKS)


def _grams(texts: list[str], orders: tuple[int, ...], buckets: int):
    """(bucket ids, lengths in grams) of a block of texts, n-grams by order.

    Characters are lower-cased; each run of other characters than letters is one
    blank. N-grams do not cross from one text into the next.
    """
    cleaned = [f" {' '.join(_WORDS.findall(_plain(t.lower())))} " for t in texts]
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(c) for c in cleaned), np.int64, len(cleaned))
    ends = np.cumsum(lens)
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(orders)):
            # h[i] covers the k+1 characters from i on
            h = h[: len(codes) - k] * np.uint64(0x100000001B3) + codes[k:]
            if k + 1 in orders:
                key = (mix64(h + np.uint64(k + 1)) & np.uint64(buckets - 1)).astype(np.int64)
                # A gram that starts in the last k characters of a text leaves it.
                room = np.maximum(lens - k, 0)
                first = ends - lens
                keep = np.ones(len(key) + k, bool)
                for j in range(1, k + 1):
                    at = ends - j
                    keep[at[lens >= j]] = False
                yield key[keep[: len(key)]], room, first


#: Characters of a longer text that are cleaned and hashed at once.
SEGMENT_CHARS = 1 << 18
_SPACE = re.compile(r"\s")


def _pieces(text: str) -> Iterator[str]:
    """A text in parts that end at white space, or whole where it has none behind SEGMENT_CHARS."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + SEGMENT_CHARS)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _long_grams(text: str, orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Bucket ids of one long text, the same n-grams as ``_grams`` has, piece by piece.

    A piece is hashed behind the last characters of what came before it, and those
    n-grams count that end in the piece.
    """
    carry = np.zeros(0, np.uint64)
    for part in chain([" "], (" ".join([*_WORDS.findall(_plain(p.lower())), ""]) for p in _pieces(text)), [""]):
        codes = np.concatenate([carry, np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)])
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(max(orders), len(codes))):
                h = h[: len(codes) - k] * np.uint64(0x100000001B3) + codes[k:]
                if k + 1 in orders:
                    new = h[max(0, len(carry) - k) :]
                    yield (mix64(new + np.uint64(k + 1)) & np.uint64(buckets - 1)).astype(np.int64)
        carry = codes[max(0, len(codes) - max(orders) + 1) :]


def _has_letter(text: str) -> bool:
    return any(_LETTER.search(_plain(p)) for p in _pieces(text))


def _texts(col: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first, last + 1, texts) of blocks of rows; a null is an empty text. A long text is alone in its block."""
    for lo, hi, raw in text_blocks(col):
        yield lo, hi, [t.decode("utf-8", "replace") if t else "" for t in raw]


def _counts(orders: tuple[int, ...], buckets: int):
    def run(it):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for lo, hi, texts, column in ((*x, batch.column(1)) for batch in it for x in _texts(batch.column(0))):
            langs = column.slice(lo, hi - lo).to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(buckets, np.int64))
                docs[lang] = docs.get(lang, 0) + len(mine)
                short = [t for t in mine if len(t) <= SEGMENT_CHARS]
                for key, _, _ in _grams(short, orders, buckets) if short else ():
                    total += np.bincount(key, minlength=buckets)
                for t in mine:
                    for key in _long_grams(t, orders, buckets) if len(t) > SEGMENT_CHARS else ():
                        total += np.bincount(key, minlength=buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs[lang]))],
                ["lang", "bucket", "n"],
            )

    return run


class Model:
    """Languages, log priors and log probabilities [bucket, language]."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray, orders: tuple[int, ...]):
        self.langs, self.prior, self.table, self.orders = langs, prior, table, orders

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Log joint probability of each text and language."""
        out = np.tile(self.prior, (len(texts), 1))
        for i, t in enumerate(texts):
            if len(t) > SEGMENT_CHARS:
                for key in _long_grams(t, self.orders, len(self.table)):
                    # As many rows of the table as there are buckets, however long the text.
                    out[i] += np.bincount(key, minlength=len(self.table)) @ self.table
        short = [i for i, t in enumerate(texts) if len(t) <= SEGMENT_CHARS]
        if short:
            out[short] += self._short([texts[i] for i in short])
        return out

    def _short(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for key, room, _ in _grams(texts, self.orders, len(self.table)):
            starts = np.concatenate([[0], np.cumsum(room)[:-1]])
            full = room > 0
            if full.any():
                for j in range(len(self.langs)):
                    out[full, j] += np.add.reduceat(self.table[key, j], starts[full])
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, alpha: float = 0.5) -> Model:
    """Learn from all rows with a text and a language.

    Counts are summed in tasks, then by Spark. What comes to the driver are
    at most ``buckets`` numbers for each language; more than MAX_LANGS languages
    are an error.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    if base.select("lang").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = base.mapInArrow(lean(_counts(orders, buckets)), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for r in counts.toArrow().to_pylist():
        total = sums.setdefault(r["lang"], np.zeros(buckets))
        if r["bucket"] < 0:
            seen[r["lang"]] = r["n"]
        else:
            total[r["bucket"]] = r["n"]
    langs = sorted(sums)
    prior = np.log(np.array([seen[x] for x in langs], float)) - np.log(max(1, sum(seen.values()))) if langs else np.zeros(0)
    table = np.zeros((buckets, len(langs)))
    for j, x in enumerate(langs):
        table[:, j] = np.log((sums[x] + alpha) / (sums[x].sum() + alpha * buckets))
    return Model(langs, prior, table, orders)


def _predict(model_bc, unknown: str):
    def run(it):
        model = model_bc.value
        for batch in it:
            lang, score = [unknown] * batch.num_rows, [0.0] * batch.num_rows
            for lo, _, texts in _texts(batch.column(-1)) if model.langs else ():
                able = [i for i, t in enumerate(texts) if _has_letter(t)]
                joint = model.posteriors([texts[i] for i in able])
                best = joint.argmax(1)
                p = 1.0 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
                for i, b, s in zip(able, best.tolist(), p.tolist(), strict=True):
                    lang[lo + i], score[lo + i] = model.langs[b], s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and lang_pred, score for each document.

    A text that is null or has no letter, and any text where the model has no
    language, gets ``und`` and 0. score is the posterior probability. Ties go to
    the language that sorts first. Repeated rows get equal values.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(lean(_predict(spark.sparkContext.broadcast(model), UNKNOWN)), f"{schema}, lang_pred string, score double")
