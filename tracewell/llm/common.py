"""Helpers that the operators of this subpackage share.

Words are the runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.
``bytes.lower`` and ``bytes.split`` follow exactly these two rules.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.tables import cut, drop, shared_dir

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes that are hashed at once, also within a long text or a long word.
SEGMENT_BYTES = 1 << 18

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when they start elsewhere."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


class Tables:
    """Written tables of one run, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        out = cut(df, path)
        self.paths[id(out)] = path, out
        # Spark's cleaner deletes a plan's shuffle files when the driver has collected the plan.
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            drop(self.spark, self.paths.pop(id(t))[0])


def text_bytes(col: pa.Array) -> list:
    """UTF-8 bytes of each text; a null is None."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.binary()).to_pylist()


def text_blocks(col: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, list]]:
    """(first, last + 1, texts as UTF-8 bytes) of runs of rows with about ``size`` bytes;
    only one run's texts are Python objects at a time."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.binary())
    lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(lens + 1) // (size or BLOCK_BYTES)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    for lo, hi in zip(first, [*first[1:], len(col)], strict=True):
        yield int(lo), int(hi), col.slice(lo, hi - lo).to_pylist()


def lean(run: Callable) -> Callable:
    """A function over batches that gives its memory back when a task's rows end, as a
    worker serves many tasks."""

    def wrapped(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def gathered(run: Callable, rows: int = 1 << 16) -> Callable:
    """A function over batches with its small batches put together to larger ones."""

    def wrapped(it):
        held, n = [], 0
        for b in run(it):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a permutation of the 64-bit numbers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_P = 0x9E3779B97F4A7C15 | 1
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """The first SEGMENT_BYTES powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(SEGMENT_BYTES, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS


def word_table(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of all words of a byte array that ends with a blank.

    A word's hash is a polynomial in random codes of its bytes, so one running
    sum gives all of them without a Python object for each word. The bytes are
    read segment by segment; the word that a segment's end cuts carries its sum
    on, so the arrays beside the result have a fixed size.
    """
    up, down = _powers()
    sums, starts, ends = [], [], []
    cut_at, cut_sum = -1, 0  # the word that the last segment's end has cut
    for lo in range(0, len(buf), SEGMENT_BYTES):
        part = buf[lo : lo + SEGMENT_BYTES]
        space = _WS[part]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.append(edge, len(part))
        s, e = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            codes = _CODES[part]
            codes *= up[: len(part)]
            run = np.cumsum(codes, dtype=np.uint64)
            h = (run[e - 1] - np.where(s > 0, run[s - 1], np.uint64(0))) * down[s]
        s, e = s + lo, e + lo
        if cut_at >= 0:
            if len(s) and s[0] == lo:
                h[0] = (cut_sum + int(h[0]) * pow(_P, lo - cut_at, 1 << 64)) % (1 << 64)
                s[0] = cut_at
            else:
                h, s, e = np.concatenate([[np.uint64(cut_sum)], h]), np.concatenate([[cut_at], s]), np.concatenate([[lo], e])
            cut_at = -1
        if len(e) and e[-1] == lo + len(part) < len(buf):
            cut_at, cut_sum = int(s[-1]), int(h[-1])
            h, s, e = h[:-1], s[:-1], e[:-1]
        sums.append(h)
        starts.append(s)
        ends.append(e)
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    with np.errstate(over="ignore"):
        return mix64(np.concatenate(sums) + (e - s).astype(np.uint64)), s, e


def joined(texts: list[bytes | None]) -> np.ndarray:
    """The bytes of all texts, a blank after each."""
    return np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)


def word_counts(texts: list[bytes | None], starts: np.ndarray) -> np.ndarray:
    """The number of words in each text, from the starts of all words in ``joined(texts)``."""
    lens = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    return np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)])))


def hash_words(texts: list[bytes | None], suffixes: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words, and the number of words in each text; with
    ``suffixes`` also a hash of each word's last two bytes."""
    buf = joined(texts)
    h, starts, ends = word_table(buf)
    counts = word_counts(texts, starts)
    if not suffixes:
        return h, counts
    with np.errstate(over="ignore"):
        last = _CODES[buf[ends - 1]]
        tail = mix64(last + np.where(ends - starts > 1, _CODES[buf[ends - 2]] * np.uint64(_P), np.uint64(0)))
    return h, counts, tail


def blocks(texts: list[bytes | None], size: int = BLOCK_BYTES):
    """(first, last + 1) of runs of texts with about ``size`` bytes."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n + 1
    if first < len(texts):
        yield first, len(texts)


def hashed(texts: list[bytes | None]):
    """(index, word hashes) of each text in turn."""
    for first, last in blocks(texts):
        h, counts = hash_words(texts[first:last])
        at = 0
        for i, n in zip(range(first, last), counts.tolist(), strict=True):
            yield i, h[at : at + n]
            at += n


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; fewer words: the whole sequence as one."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mix64(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - n + 1 + i]
        return mix64(out + np.uint64(n))


def partition_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def batches(n: int, size: int):
    return ((i, min(i + size, n)) for i in range(0, n, size))
