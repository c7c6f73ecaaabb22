"""Grouping spelling variants: a self-join of a vocabulary's trie at distance one.

The trie of all words is never in one place. A *frame* is a part of the join that
a task can do alone: words of one length n (or n+1) that agree in their first
``lo`` letters and in their last n - ``hi``, compared where they may differ, at
the letters between. Two near words differ first at some letter l (after their
longest common beginning), and belong together in the one frame with lo <= l < hi.
The first frames halve each word: near words share either the first half, the
prefix that partitions the trie, or all that follows. A frame that holds more
than ``FRAME_CHARS`` letters is halved again, down to a single letter, where a
frame has no more words than there are letters; so no task gets an unbounded
group, and no pair is lost.

Within a frame the letters between form a trie, and active-node sets (Wang, Feng
and Li, "Trie-Join", 2010) go down it: a node's set holds the nodes whose
beginnings are at distance one from its own, and follows from its parent's. Where
both nodes end words, the pair is emitted.

All letters lie below U+0100, so a word is kept as bytes of ISO 8859-1, a byte for
each letter, and order of bytes is order of code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Tables, gathered, lean, prepare, text_blocks
from tracewell.workers import spread

#: Letters in the words of a frame that a task joins as one trie.
FRAME_CHARS = 2_000_000
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
#: A long text is searched in steps, so its words are never all in memory.
STEP_BYTES = 4 << 20

# Letters A-Z, a-z and U+00C0 to U+00FF in UTF-8, the text lower-cased before.
_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")


# --- counting


def _runs(text: bytes) -> Counter:
    """How often each run of letters is in a text."""
    text = text.lower()
    if len(text) <= STEP_BYTES:
        return Counter(_RUN.findall(text))
    return Counter(m.group() for m in _RUN.finditer(text))


def variant(doc_id: int | None, run: bytes, every: int) -> bytes:
    """The word that a run counts for, as ISO 8859-1: one letter less where a hash of document and run says so."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, run))
    word = run.decode().encode("latin-1")
    if every and h % every == 0:
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
    return word


def word_counts(docs: DataFrame, every: int, least_chars: int) -> DataFrame:
    """(word as ISO 8859-1, n) of all words of (doc_id, text) with at least ``least_chars`` letters."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        found: Counter = Counter()
        for batch in it:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in text_blocks(batch.column(1)):
                for doc_id, text in zip(ids[lo:hi], texts, strict=True):
                    for r, n in _runs(text or b"").items():
                        if len(r) >= least_chars:
                            word = variant(doc_id, r, every)
                            if len(word) >= least_chars:
                                found[word] += n
                    if len(found) >= COUNTED:
                        yield out()
                        found = Counter()
        if found:
            yield out()

    counts = docs.mapInArrow(lean(run), "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


# --- frames


def _framed(words: DataFrame, n: Column, lo: Column, hi: Column) -> DataFrame:
    """Rows (size, lo, hi, frame, word, n): a word in one frame of the words of length ``size`` and one more."""
    tail = F.greatest(F.lit(0), F.col("size") - F.col("hi"))
    out = words.withColumn("size", n).withColumn("lo", lo).withColumn("hi", hi)
    ends = F.substr("word", F.length("word") - tail + 1, tail)
    return out.withColumn("frame", F.xxhash64("size", "lo", "hi", F.substr("word", F.lit(1), F.col("lo")), ends))


def halves(lo: Column, hi: Column) -> Column:
    """The two frames that a frame's places divide into."""
    mid = lo + F.floor((hi - lo) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def frames(words: DataFrame, tables: Tables, frame_chars: int) -> DataFrame:
    """(size, lo, hi, frame, word, n) of all frames with two words at least, none over ``frame_chars`` letters
    unless it has a single place.

    Each word stands in the frames of its own length and of one less, as near
    words' lengths differ by one at most. Sizes of frames are counted by a combined
    sum, and only the few that are too large are dealt with again.
    """
    length = F.length("word")
    sized = words.withColumn("__size", F.explode(F.array(length, length - 1)))
    whole = sized.withColumn("__half", F.explode(halves(F.lit(0), F.col("__size") + 1)))
    now = tables.cut(_framed(whole, F.col("__size"), F.col("__half.lo"), F.col("__half.hi")).select("size", "lo", "hi", "frame", "word", "n"))
    done = None
    while True:
        held = now.groupBy("frame").agg(F.count("*").alias("__words"), F.sum(F.length("word")).alias("__chars"))
        held = tables.cut(held.where("__words > 1"))
        fits = (F.col("__chars") <= frame_chars) | (F.col("hi") - F.col("lo") <= 1)
        met = now.join(held, "frame")
        ready = met.where(fits).drop("__words", "__chars")
        done = ready if done is None else done.unionByName(ready)
        if not held.where(F.col("__chars") > frame_chars).limit(1).count():
            return done
        large = met.where(~fits).withColumn("__half", F.explode(halves(F.col("lo"), F.col("hi"))))
        split = _framed(large.withColumnRenamed("size", "__size"), F.col("__size"), F.col("__half.lo"), F.col("__half.hi"))
        now = tables.cut(split.select("size", "lo", "hi", "frame", "word", "n"))


# --- the join within a frame


class Trie:
    """A trie of byte strings; ends tells which string ends at a node."""

    def __init__(self, strings: list[bytes]):
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, s in enumerate(strings):
            at = 0
            for c in s:
                kid = self.kids[at].get(c)
                if kid is None:
                    kid = self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                at = kid
            self.ends[at] = i

    def near(self) -> Iterator[tuple[int, int]]:
        """Ordered pairs of strings at edit distance one.

        A node's active set at distance one: its parent (its last letter is
        one too many), its siblings (another last letter), its children (one
        letter is missing), and the nodes that its letter reaches from the
        parent's set. Sets live only along the path to the node.
        """
        stack = [(0, frozenset(self.kids[0].values()))]
        while stack:
            node, active = stack.pop()
            end, kids = self.ends[node], self.kids[node]
            if end >= 0:
                yield from ((end, self.ends[m]) for m in active if self.ends[m] >= 0)
            for c, kid in kids.items():
                reach = {node, *kids.values(), *self.kids[kid].values()}
                reach.update(x for m in active if (x := self.kids[m].get(c)) is not None)
                reach.discard(kid)
                stack.append((kid, reach))


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def frame_pairs(size: int, lo: int, hi: int, words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ordered pairs of a frame's words at distance one that differ first at a letter of the frame."""
    tail = max(0, size - hi)
    for a, b in Trie([w[lo : len(w) - tail] for w in words]).near():
        u, v = words[a], words[b]
        # Two of the longer length meet in the frames of that length.
        if min(len(u), len(v)) == size and lo <= _common(u, v) < hi:
            yield a, b


def near_words(framed: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words at distance one, once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(frame, words: list[bytes], counts: list[int]) -> Iterator[pa.RecordBatch]:
            # Two frames whose hashes are equal are told apart by what they fix.
            parts: dict = {}
            for i, (key, w) in enumerate(zip(frame, words, strict=True)):
                size, lo, hi = key
                parts.setdefault((key, w[:lo], w[len(w) - max(0, size - hi) :] if size > hi else b""), []).append(i)
            for (key, _, _), mine in parts.items():
                out = [(mine[a], mine[b]) for a, b in frame_pairs(*key, [words[i] for i in mine])] if len(mine) > 1 else []
                if out:
                    a, b = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i in a], pa.binary()), pa.array([counts[i] for i in a], pa.int64()),
                         pa.array([words[i] for i in b], pa.binary()), pa.array([counts[i] for i in b], pa.int64())],
                        ["word", "n", "near", "near_n"],
                    )

        at, keys, words, counts = None, [], [], []
        for batch in it:
            frame = batch.column("frame").to_numpy()
            key = list(zip(*(batch.column(c).to_pylist() for c in ("size", "lo", "hi")), strict=True))
            word, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            edges = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]]).tolist() if len(frame) else []
            for lo, hi in zip(edges, [*edges[1:], len(frame)], strict=True):
                if frame[lo] != at:
                    yield from joined(keys, words, counts)
                    at, keys, words, counts = frame[lo], [], [], []
                keys += key[lo:hi]
                words += word[lo:hi]
                counts += n[lo:hi]
        yield from joined(keys, words, counts)

    dealt = framed.repartition(spread(framed.sparkSession), "frame").sortWithinPartitions("frame", "word")
    return dealt.select("size", "lo", "hi", "frame", "word", "n").mapInArrow(lean(gathered(run)), "word binary, n long, near binary, near_n long")


# --- forms and roots


def roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root) of (word, form): where following forms ends.

    Each round doubles the steps that a word has followed. A form is at least twice
    as frequent as its word, so a way has no more steps than the largest count has
    bits, and a handful of rounds are enough.
    """
    now = tables.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        met = now.select("word", "root").join(ahead, "root", "left")
        moved = tables.cut(met.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        tables.drop(now)
        if not moved.where("__moved").limit(1).count():
            return moved.drop("__moved")
        now = moved


def spelling_variants(
    docs: DataFrame, least_chars: int = 5, least_count: int = 3, factor: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text", frame_chars: int = FRAME_CHARS
) -> DataFrame:
    """Words, their near words, and the form and root of each.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; a
    run loses one letter where ``every`` divides crc32 of ``<id>:<run>`` (0: never;
    a null id is an empty text). Words of at least ``least_chars`` letters and
    ``least_count`` occurrences are near if one inserted, deleted or replaced letter
    tells them apart. Returns word, n (occurrences), n_near, form (the near word of
    largest n, ties to the smallest in code-point order, if its n is at least
    ``factor`` times the word's; else null), form_n and root (where forms lead; the
    word itself if nowhere). Null and empty texts have no words, repeated rows
    count again, an empty table gives no rows; other columns are left out.
    """
    prepare(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = tables.cut(word_counts(base, every, least_chars).where(F.col("n") >= least_count))
    pairs = near_words(frames(words, tables, frame_chars))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    around = tables.cut(pairs.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best")))
    chosen = F.when(-F.col("best.m") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")))
    told = around.select("word", "n_near", chosen.alias("to")).select("word", "n_near", "to.form", "to.form_n")
    ends = roots(told.where("form is not null"), tables)
    out = words.join(told, "word", "left").join(ends, "word", "left")
    text = lambda c: F.decode(c, "ISO-8859-1")
    return out.select(
        text(F.col("word")).alias("word"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), text(F.col("form")).alias("form"),
        F.col("form_n").cast("long"), text(F.coalesce("root", "word")).alias("root"),
    )
