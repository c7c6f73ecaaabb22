"""Best-fit decreasing packing of tokenised documents into sequences.

Best fit decreasing looks only at lengths, and there are no more lengths than
tokens in a sequence. So the driver packs the histogram of lengths: for each
length, longest first, a segment tree over remaining capacities names the
tightest capacity that still takes it, in logarithmic time, and all bins of
that capacity are filled in one step exactly as best fit fills them one by one.
The plan is a list of runs ("pieces of this length, of these ranks, go to these
bins at this place"), whose number depends on the sequence length and not on
the number of documents. Executors then place each piece by its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import blocks, cut, joined, lean, partition_id, prepare, text_blocks, word_counts, word_table

SEQUENCE_TOKENS = 2048
#: Parts between blanks whose ids a worker holds; then it begins anew.
CACHE_PARTS = 600_000
#: Bytes of texts that are encoded by parts at once: their new parts, of a byte and a
#: blank at least, and these without a sign at the end, fit into the table.
BLOCK_LIMIT = CACHE_PARTS


class CapacityTree:
    """A segment tree over capacities 0..size; a leaf counts the open bins of one capacity."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.sum = [0] * (2 * self.n)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.n
        while i:
            self.sum[i] += count
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has an open bin."""
        i = least + self.n
        if self.sum[i]:
            return least
        while i > 1:  # up to the first right sibling with bins, then down to its leftmost
            if not i & 1 and self.sum[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.sum[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Runs for each length, and the number of bins.

    A run (first rank, pieces, first bin, pieces a bin, offset) puts the piece of
    rank ``first + i`` into bin ``first bin + i // pieces a bin``, at ``offset +
    (i % pieces a bin) * length``.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, deque] = {}  # capacity -> intervals (first bin, bins)
    runs: dict[int, list] = {}
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            open_bins.setdefault(room, deque()).append((first, count))
            tree.add(room, count)

    for length in sorted(histogram, reverse=True):
        left, rank, mine = histogram[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins; a part-filled one is the tightest and fills up first
                each = capacity // length
                first, count = bins, -(-left // each)
                bins += count
                room = capacity
            else:
                each = room // length
                first, have = open_bins[room].popleft()
                count = min(have, -(-left // each))
                tree.add(room, -have)
                if have > count:
                    open_bins[room].appendleft((first + count, have - count))
                    tree.add(room, have - count)
            full, part = divmod(min(left, count * each), each)
            mine.append((rank, full * each + part, first, each, capacity - room))
            put(room - each * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            rank += full * each + part
            left -= full * each + part
        runs[length] = mine
    return runs, bins


class Encoder:
    """Ids of texts, equal to those of the tokenizer file.

    Where the file is a BPE with word ends that lower-cases, splits at white space
    before all else and keeps a run of letters whole, a text's ids are those of
    its parts between blanks in turn. Parts are then looked up by a 64-bit hash
    of their bytes (A-Z lower-cased) in a table, and only new ones are encoded. Two
    parts of one table would need equal hashes to be mixed up: a chance of 1e-8
    with CACHE_PARTS of them. Any other file, and a text that holds a special token,
    is encoded text by text.
    """

    SLOTS = 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        self.by_parts = _splits_at_blanks(spec)
        if self.by_parts:
            # The same merges for strings that are lower-case letter runs already.
            spec |= {"normalizer": None, "added_tokens": [], "post_processor": None}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.letters = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            self.ends[[i for w, i in self.whole.get_vocab().items() if w.endswith("</w>")]] = True
            self.signs = {s: self._plain(s.decode()) for s in (b".", b",")}
            self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.first, self.size = np.zeros(CACHE_PARTS + 1, np.int64), np.zeros(CACHE_PARTS, np.int32)
        self.flat, self.n = np.zeros(1 << 20, "<u4"), 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, or the free one where it belongs; and whether it is there."""
        at = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.SLOTS - 1)
            now = self.keys[at[left]]
            left = left[(now != h[left]) & (now != 0)]
        return at, self.keys[at] == h

    def _add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Entries for different hashes that are not in the table yet."""
        total = int(self.first[self.n]) + len(ids)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, "<u4")])
        self.flat[total - len(ids) : total] = ids
        new = np.arange(self.n, self.n + len(h))
        self.size[new] = sizes
        self.first[new + 1] = self.first[self.n] + np.cumsum(sizes)
        self.n += len(h)
        while len(h):
            at, _ = self._slots(h)
            self.keys[at] = h  # of several that want one slot the last stays
            placed = self.keys[at] == h
            self.entry[at[placed]] = new[placed]
            h, new = h[~placed], new[~placed]

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        n = self.size[entries].astype(np.int64)
        return self.flat[np.repeat(self.first[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _encode(self, words: list[str], h: np.ndarray) -> None:
        for lo in range(0, len(words), 8192):
            part = words[lo : lo + 8192]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            assert len(ends) == len(part)
            self._add(h[lo : lo + 8192], np.diff(ends, prepend=0), ids)

    def _learn(self, parts: list[bytes], h: np.ndarray) -> None:
        plain = np.fromiter((_PLAIN(p) is not None for p in parts), bool, len(parts))
        # A full stop or comma at the end does not change a letter run's ids.
        cores = sorted({p.rstrip(b".,").lower() for p, ok in zip(parts, plain.tolist(), strict=True) if ok})
        if cores:
            ch = word_table(joined(cores))[0]
            _, there = self._slots(ch)
            new = np.flatnonzero(~there)
            self._encode([cores[i].decode().lower() for i in new.tolist()], ch[new])
        for sign, more in self.signs.items():
            mine = [i for i in np.flatnonzero(plain).tolist() if parts[i].endswith(sign)]
            if mine:
                at, _ = self._slots(word_table(joined([parts[i][:-1] for i in mine]))[0])
                entries = self.entry[at]
                sizes = self.size[entries]
                ids = np.insert(self._gather(entries), np.repeat(np.cumsum(sizes), len(more)), np.tile(more, len(mine)))
                self._add(h[mine], sizes + len(more), ids)
        rest = np.flatnonzero(~plain)
        for lo in range(0, len(rest), 8192):
            some = rest[lo : lo + 8192]
            enc = self.whole.encode([parts[i].decode() for i in some], is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(enc.word_ids, np.int64), minlength=len(some))
            self._add(h[some], sizes, np.array(enc.ids, "<u4"))

    def _block(self, texts: list[bytes]) -> list[bytes]:
        buf = joined(texts)
        h, starts, ends = word_table(buf)
        h[h == 0] = 1  # 0 marks a free slot
        at, there = self._slots(h)
        if not there.all():
            new, first = np.unique(h[~there], return_index=True)
            if self.n + 2 * len(new) > CACHE_PARTS:
                self._clear()
                new, first = np.unique(h, return_index=True)
                there = np.zeros(len(h), bool)
            raw, of = buf.tobytes(), np.flatnonzero(~there)[first]
            self._learn([raw[s:e] for s, e in zip(starts[of].tolist(), ends[of].tolist(), strict=True)], new)
            at, _ = self._slots(h)
        entries = self.entry[at]
        ids = self._gather(entries)
        last = np.concatenate([[0], np.cumsum(self.size[entries], dtype=np.int64)])
        cuts = last[np.concatenate([[0], np.cumsum(word_counts(texts, starts))])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        out: list[bytes | None] = [None] * len(texts)
        for lo, hi in blocks(texts, BLOCK_LIMIT // 2):
            mine = list(range(lo, hi))
            if self.by_parts:
                lower = b" ".join(texts[lo:hi]).lower()
                if any(s in lower for s in self.special):
                    mine = [i for i in mine if not any(s in texts[i].lower() for s in self.special)]
                # A long text's parts may be more than the table holds; it is encoded as a whole.
                if sum(len(texts[i]) for i in mine) < BLOCK_LIMIT:
                    for i, raw in zip(mine, self._block([texts[i] for i in mine]), strict=True):
                        out[i] = raw
            for i in range(lo, hi):
                if out[i] is None:
                    out[i] = b"".join(self._plain(part).tobytes() for part in self._pieces(texts[i].decode()))
        return out

    def _pieces(self, text: str):
        """A long text in parts, cut before a blank, where that does not change its ids."""
        at = 0
        while self.by_parts and len(text) - at > BLOCK_LIMIT // 2:
            end = text.rfind(" ", at + 1, at + BLOCK_LIMIT // 2)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]


#: A run of Latin letters in UTF-8, and one full stop or comma at most.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]?").fullmatch

_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The encoder of this worker, which serves one task after another."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file has the properties that Encoder relies on."""
    normal, before, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = [n.get("type") for n in normal.get("normalizers", [])]
    blanks = next((n for n in normal.get("normalizers", []) if n.get("type") == "Replace"), {})
    splits = before.get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and (blanks.get("pattern"), blanks.get("content")) == ({"Regex": r"\s+"}, " ")
        and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and (splits[0].get("pattern"), splits[0].get("behavior"), splits[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and (splits[1].get("add_prefix_space"), splits[1].get("use_regex")) == (False, False)
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and not spec.get("post_processor")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
    )


# Fixed value: the split pattern of tokenizers that keep letter runs whole and drop white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _pieces(path: str, capacity: int, end: bytes, with_ids: bool):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank", "ids"]

    def run(it):
        encoder, chunk, ranks = _encoder(path), partition_id(), {}
        for batch in it:
            doc_ids = batch.column(0).to_pylist()
            for lo, _, texts in text_blocks(batch.column(1)):
                rows: list[tuple] = []
                for i, raw in enumerate(encoder.ids([t or b"" for t in texts]), lo):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        n = len(part) // 4
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc_ids[i], piece, piece * capacity, n, zlib.crc32(part), chunk, rank, part if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return lean(run)


def _place(runs: dict[int, list]):
    table = {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}

    def run(it):
        for batch in it:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                n = int(length[part[0]])
                first, _, bin_, each, offset = table[n]
                k = np.searchsorted(first, rank[part], "right") - 1
                i = rank[part] - first[k]
                seq[part] = bin_[k] + i // each[k]
                off[part] = offset[k] + (i % each[k]) * n
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(seq), pa.array(off)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its text's ids by the tokenizer file (no special tokens added)
    and then ``end_id``; a null text counts as empty. Only a document of more
    than ``capacity`` tokens is cut, into pieces of ``capacity``, the last one
    shorter. One row for each piece: doc_id, piece, start, length, ids_crc32
    (of the ids as unsigned little-endian 32-bit numbers), sequence_id and
    offset, gapless from 0 in each sequence; ``with_ids`` adds the ids as bytes.

    Null ids and repeated rows are packed like any other row. An empty table
    gives no rows. Other columns of ``docs`` play no part.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, rank long, ids binary"
    end = int(end_id).to_bytes(4, "little")
    pieces = cut(base.mapInArrow(_pieces(tokenizer, capacity, end, with_ids), schema))
    # Rows of a chunk are numbered; a chunk's first rank among all of its length is a sum over chunks.
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("length", "chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_decreasing(histogram, capacity)
    ranked = pieces.join(counts.select("length", "chunk", "base"), ["length", "chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"), "ids")
    out = ranked.mapInArrow(
        _place(runs),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long",
    )
    return out if with_ids else out.drop("ids")
