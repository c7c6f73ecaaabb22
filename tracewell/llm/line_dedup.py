"""Dropping lines that many documents hold, except in one of these documents.

Every line has a 128-bit hash of its key. The hashes that enough documents hold
form an index of shards: a shard is a minimal perfect hash over its hashes with
three arrays, of fingerprints (the hash's second half), of document counts and of
the document that keeps the line. Documents are then read once more and their
lines looked up in the arrays; no line, and no hash of one, is joined.

Shards are files in the folder that all executors share. A task that reads
documents holds one block of documents and one shard at a time: it sorts the
block's hashes by shard and opens each shard that it needs once. That reads the
index once a block, so it is the way for an index of up to ``INDEX_BYTES``, whose
size is known exactly when it is built. A larger index is not read by every task:
then the (hash, document) pairs are dealt to tasks by ranges of the hash, each
task looks its pairs up in the few shards of its range, and documents meet the
hashes that they lose. Both ways give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Tables, gathered, lean, prepare, shared_dir, text_blocks, text_bytes
from tracewell.llm.perfect_hash import PerfectHash
from tracewell.workers import spread

#: Hashes of a shard on average.
SHARD_KEYS = 1 << 14
#: Up to this size every task reads the index; a larger one is met by ranges of the hash.
INDEX_BYTES = 1 << 30
#: Bytes of text that a task looks up at once (a longer text is a block of its own), and of a piece of a long text.
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text in runs of about PIECE_BYTES."""
    at = 0
    while at <= len(text):
        end = text.find(b"\n", at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split(b"\n")
        at = end + 1


def _hashes(lines: list[bytes], least_chars: int) -> tuple[list[int], bytes]:
    """Places of the lines whose keys are long enough, and these keys' hashes one after the other."""
    places, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= least_chars:
            key = line.strip().lower()
            # A byte 10xxxxxx continues a code point.
            if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                places.append(i)
                out.append(xxhash.xxh3_128_digest(key))
    return places, b"".join(out)


def _distinct_hashes(lines: list[bytes], least_chars: int) -> set[bytes]:
    digests = _hashes(lines, least_chars)[1]
    return {digests[i : i + 16] for i in range(0, len(digests), 16)}


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    return pairs[:, 0], pairs[:, 1]


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in their order, and for each given pair the place of its own."""
    pairs = np.empty(len(hi), [("hi", np.uint64), ("lo", np.uint64)])
    pairs["hi"], pairs["lo"] = hi, lo
    found, back = np.unique(pairs, return_inverse=True)
    return found["hi"], found["lo"], back


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, hi, lo) of each long line of (doc_id, text), about once for a row; hi and lo are signed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, texts in _blocks(batch):
                for i, text in enumerate(texts):
                    digests = {d for lines in _pieces(text or b"") for d in _distinct_hashes(lines, least_chars)}
                    if digests:
                        hi, lo = _halves(b"".join(digests))
                        ids = block.column(0).take(pa.array(np.full(len(hi), i)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["doc_id", "hi", "lo"])

    return docs.mapInArrow(lean(gathered(run)), "doc_id long, hi long, lo long")


def repeated_lines(hashes: DataFrame, least_docs: int) -> DataFrame:
    """(hi, lo, n, keeper) of the hashes in at least ``least_docs`` documents.

    n counts distinct documents; rows without an id count as one. keeper is the
    largest id. Copies of a line within a document are gone before the counting
    shuffle, and counts combine before theirs.
    """
    once = hashes.distinct()
    found = once.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    return found.where((F.col("n") >= least_docs) & F.col("keeper").isNotNull())


# --- the index


class Index:
    """The shards of an index below a folder, read one at a time; shard k holds the k-th range of the first half."""

    def __init__(self, root: str, shards: int):
        self.root, self.shards = root, shards
        self.fs, self.dir = None, None

    def shard_of(self, hi: np.ndarray) -> np.ndarray:
        return ((hi >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def _file(self, shard: int) -> str:
        if self.fs is None:
            self.fs, self.dir = pafs.FileSystem.from_uri(self.root)
        return f"{self.dir}/shard-{shard:08d}.arrow"

    def write(self, shard: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, keeper: np.ndarray) -> int:
        """Build and store a shard; its bytes. A repeated task puts an equal file in the same place."""
        table = PerfectHash.of(hi, lo)
        at = table.number(hi, lo)
        marks, counts, keepers = np.empty(len(hi), np.uint64), np.empty(len(hi), np.uint32), np.empty(len(hi), np.int64)
        marks[at], counts[at], keepers[at] = lo, np.minimum(n, (1 << 32) - 1), keeper
        arrays = [np.array(table.sizes, np.int64), table.words, marks, counts, keepers]
        final = self._file(shard)
        part = f"{final}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.dir, recursive=True)
        with self.fs.open_output_stream(part) as out:
            for a in arrays:
                out.write(len(a).to_bytes(8, "little"))
            for a in arrays:
                out.write(a.tobytes())
        self.fs.move(part, final)
        return 40 + sum(a.nbytes for a in arrays)

    def read(self, shard: int):
        path = self._file(shard)
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None  # no hash fell into this range
        with self.fs.open_input_stream(path) as f:
            lens = np.frombuffer(f.read(40), "<i8").tolist()
            arrays = [np.frombuffer(f.read(n * np.dtype(t).itemsize), t) for n, t in zip(lens, ("<i8", "<u8", "<u8", "<u4", "<i8"), strict=True)]
        return PerfectHash(arrays[0].tolist(), arrays[1]), *arrays[2:]

    def look_up(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, keeper) of hashes in ascending order, shard by shard."""
        found, keeper = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        shard = self.shard_of(hi)
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(hi) else []
        for a, b in zip(edges, [*edges[1:], len(hi)], strict=True):
            held = self.read(int(shard[a]))
            if held is None:
                continue
            table, marks, _, keepers = held
            at = table.number(hi[a:b], lo[a:b])
            ok = at >= 0
            ok[ok] = marks[at[ok]] == lo[a:b][ok]
            found[a:b] = ok
            keeper[a:b][ok] = keepers[at[ok]]
        return found, keeper


def build_index(keys: DataFrame, index: Index) -> int:
    """Write the shards of (hi, lo, n, keeper); returns the bytes of all of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stored() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([index.write(at, cols[0].view(np.uint64), cols[1].view(np.uint64), *cols[2:])], pa.int64())], ["bytes"])

        at, held = None, []
        for batch in it:
            shard, *cols = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
            for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
                if held and shard[a] != at:
                    yield stored()
                    held = []
                at = int(shard[a])
                held.append([c[a:b] for c in cols])
        if held:
            yield stored()

    top = F.shiftrightunsigned("hi", 32)
    dealt = keys.select(F.shiftrightunsigned(top * index.shards, 32).alias("shard"), "hi", "lo", "n", "keeper")
    dealt = dealt.repartition(spread(keys.sparkSession), "shard").sortWithinPartitions("shard", "hi", "lo")
    return int(dealt.mapInArrow(lean(run), "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])


# --- dropping


def _kept(text: bytes | None, held: list[tuple[list[int], bytes]], away: Iterator[bool]) -> tuple[int, int, bytes]:
    """(lines, dropped lines, what is left) of a text; ``away`` tells of each long line in turn whether it goes."""
    n, gone, out = 0, 0, []
    for lines, (places, _) in zip(_pieces(text or b""), held, strict=True):
        n += len(lines)
        drop = {i for i in places if next(away)}
        gone += len(drop)
        if drop:
            lines = [x for i, x in enumerate(lines) if i not in drop]
        if lines:
            out.append(b"\n".join(lines))
    return n, gone, b"\n".join(out)


def _answers(doc_ids: pa.Array, texts: list[bytes | None], least_chars: int, drops: Callable) -> pa.RecordBatch:
    """Rows of a block; ``drops(row, hi, lo)`` tells which of its long lines go."""
    held = [[_hashes(lines, least_chars) for lines in _pieces(t or b"")] for t in texts]
    hi, lo = _halves(b"".join(d for mine in held for _, d in mine))
    row = np.repeat(np.arange(len(texts)), [sum(len(p) for p, _ in mine) for mine in held])
    away = iter(drops(row, hi, lo).tolist())
    rows = [_kept(t, mine, away) for t, mine in zip(texts, held, strict=True)]
    n, gone, left = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).view(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"]
    )


ROWS = "doc_id long, n_lines long, n_dropped long, text string"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with texts of about BLOCK_BYTES, and these texts."""
    for a, b, texts in text_blocks(batch.column(1), BLOCK_BYTES):
        yield batch.slice(a, b - a), texts


def by_arrays(docs: DataFrame, index: Index, least_chars: int) -> DataFrame:
    """Look up the lines of (doc_id, text) in the shards, block by block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in (x for batch in it for x in _blocks(batch)):
            ids = block.column(0)

            def drops(row: np.ndarray, hi: np.ndarray, lo: np.ndarray, ids=ids) -> np.ndarray:
                some_hi, some_lo, back = _distinct(hi, lo)
                found, keeper = index.look_up(some_hi, some_lo)
                own = pc.equal(ids.take(pa.array(row)), pa.array(keeper[back]))
                return found[back] & ~pc.fill_null(own, False).to_numpy(zero_copy_only=False)

            yield _answers(ids, texts, least_chars, drops)

    return docs.mapInArrow(lean(run), ROWS)


def by_ranges(docs: DataFrame, hashes: DataFrame, index: Index, least_chars: int) -> DataFrame:
    """Look up (doc_id, hi, lo) in the shards of each range, and let documents meet the hashes that they lose."""

    def lost(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            some_hi, some_lo, back = _distinct(hi, lo)
            found, keeper = index.look_up(some_hi, some_lo)
            own = pc.fill_null(pc.equal(batch.column("doc_id"), pa.array(keeper[back])), False)
            yield batch.filter(pc.and_(pa.array(found[back]), pc.invert(own)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                gone = {(p["hi"], p["lo"]) for p in batch.column(2)[i].as_py() or ()}

                def drops(row: np.ndarray, hi: np.ndarray, lo: np.ndarray, gone=gone) -> np.ndarray:
                    return np.array([p in gone for p in zip(hi.view(np.int64).tolist(), lo.view(np.int64).tolist(), strict=True)], bool)

                yield _answers(batch.column(0).slice(i, 1), text_bytes(batch.column(1).slice(i, 1)), least_chars, drops)

    # Ranges of hash and document split a line that very many documents hold.
    dealt = hashes.distinct().repartitionByRange(spread(docs.sparkSession), "hi", "lo", "doc_id").sortWithinPartitions("hi", "lo")
    pairs = dealt.mapInArrow(lean(lost), "doc_id long, hi long, lo long")
    gone = pairs.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "gone")
    return met.mapInArrow(lean(gathered(run)), ROWS)


def drop_repeated_lines(
    docs: DataFrame, least_docs: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    r"""Drop lines whose keys are in at least ``least_docs`` documents, except from the largest id that holds them.

    A text is split at ``\n``; a null or empty one has one empty line. A key is the
    line without blanks (0x20, 0x09-0x0D) at its ends, A-Z lower-cased; keys of
    less than ``least_chars`` code points stay. Returns doc_id, n_lines, n_dropped
    and text, what is left, for every row. Rows of one id are one document: all of
    them keep or lose a line alike. Rows without an id count as one document, which
    keeps nothing that another one holds; a key that no other holds stays. An empty
    table gives no rows; other columns are left out.
    """
    prepare(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashes = line_hashes(base, least_chars)
    keys = tables.cut(repeated_lines(hashes, least_docs))
    index = Index(f"{shared_dir(docs.sparkSession)}/lines", max(1, -(-keys.count() // SHARD_KEYS)))
    size = build_index(keys, index)
    tables.drop(keys)
    return by_arrays(base, index, least_chars) if size <= index_bytes else by_ranges(base, hashes, index, least_chars)
