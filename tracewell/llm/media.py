"""Media columns: content-addressed payloads in tar shards.

A payload is kept as an 8-bit greyscale PNG, named by the digest of its bytes,
in a tar shard. Each task writes its own shards straight to the store, each
digest once; a row carries digest, shard, offset and length. Metadata columns
come from range reads of a member's header alone, and a payload from one range
read of its member.

Shard names hold the attempt that wrote them, so a repeated task never writes
into a shard that another one wrote. The rows that name the shards are a table
written by Spark, which holds those of one successful attempt for each task.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, partition_id, prepare, shared_dir, text_bytes

#: Samples in a row of the image; a payload is filled up to whole rows.
WIDTH = 576
FILL = b"\xff"
#: A shard is closed when it has grown beyond this many bytes.
SHARD_BYTES = 64 << 20
#: Signature and IHDR chunk: all that the metadata columns need.
HEADER_BYTES = 33

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_IEND = struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    rows = max(1, -(-len(text) // WIDTH))
    return text + FILL * (rows * WIDTH - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG with the payload as its samples, in rows of WIDTH."""
    rows = len(payload) // WIDTH
    filtered = np.zeros((rows, WIDTH + 1), np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _IEND


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    """The samples of an image that encode_png made; checks each chunk's CRC."""
    width, rows, _ = read_header(media)
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data += body
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, width + 1)
    return raw[:, 1:].tobytes()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes tar shards of one task."""

    def __init__(self, root: str, limit: int = SHARD_BYTES):
        self.fs, self.dir = _store(root)
        self.fs.create_dir(self.dir, recursive=True)
        self.prefix, self.limit = f"shard-{partition_id():06d}-{uuid.uuid4().hex[:12]}", limit
        self.count, self.out, self.at = 0, None, 0

    def add(self, name: str, body: bytes) -> tuple[str, int]:
        """Append a member; (shard, offset of its bytes)."""
        if self.out is None:
            self.shard, self.at = f"{self.prefix}-{self.count:04d}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.dir}/{self.shard}")
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(body)
        self.out.write(b"\0" * (-len(body) % 512))
        offset, shard = self.at + len(head), self.shard
        self.at = offset + len(body) + -len(body) % 512
        if self.at >= self.limit:
            self.close()
        return shard, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.count = None, self.count + 1


def _write(root: str, limit: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def run(it):
        writer, seen = ShardWriter(root, limit), {}
        for batch in it:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    body = encode_png(payload)
                    seen[digest] = (*writer.add(f"{digest.hex()}.png", body), len(body))
                rows.append((doc_id, len(text or b""), digest, *seen[digest]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        writer.close()

    return run


def write_shards(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Store each text's payload; rows (doc_id, n_bytes, digest as bytes, shard, offset, length).

    The rows are a written table. Equal payloads share one place: every task
    stores a digest once, and all rows then carry the first of these places. A
    null text is stored as an empty one, a null id stays null.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    rows = cut(base.mapInArrow(_write(root, limit), "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"))
    return rows


def places(rows: DataFrame) -> DataFrame:
    """One (digest, shard, offset, length) for each digest, the least place."""
    spot = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return spot.select("digest", "p.shard", "p.offset", "p.length")


def _open(root: str, handles: dict, shard: str):
    if shard not in handles:
        for f in handles.values():
            f.close()
        handles.clear()
        fs, d = _store(root)
        handles[shard] = fs.open_input_file(f"{d}/{shard}")
    return handles[shard]


def header_columns(spots: DataFrame, root: str) -> DataFrame:
    """Adds width, height and bits to places, reading HEADER_BYTES of each member."""

    def run(it):
        handles: dict = {}
        for batch in it:
            got = [
                read_header(_open(root, handles, s).read_at(HEADER_BYTES, o))
                for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)
            ]
            w, h, b = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(b, pa.int32())],
                [*batch.schema.names, "width", "height", "bits"],
            )

    return spots.mapInArrow(run, "digest binary, shard string, offset long, length long, width int, height int, bits int")


def feature(payload: bytes) -> str:
    """Mean, deviation and 8-bin histogram of the samples, as text."""
    a = np.frombuffer(payload, np.uint8)
    bins = np.bincount(a >> 5, minlength=8)
    return f"{a.mean():.4f};{a.std():.4f};" + ",".join(map(str, bins.tolist()))


def _features(root: str):
    schema = pa.schema(
        [("digest", pa.binary()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()),
         ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32())]
    )

    def run(it):
        handles: dict = {}
        for batch in it:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                file = _open(root, handles, shard)
                width, height, _ = read_header(file.read_at(HEADER_BYTES, offset))
                media = file.read_at(length, offset)
                payload = decode_png(media)
                read_back = hashlib.sha256(payload).digest()
                if read_back != digest:
                    raise ValueError(f"{shard}@{offset}: payload is not {digest.hex()}")
                rows.append((read_back, len(payload), zlib.crc32(payload[-32:]), length, hashlib.sha256(media).digest(), feature(payload), width, height))
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def media_columns(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Store all texts, read them back, and return one row for each document.

    Columns: doc_id, n_bytes, digest, shard, offset, length, width, height,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. ``root`` is a URI that all executors reach (default: a new folder
    below spark.checkpoint.dir, which stays when the driver ends, as the rows name
    its shards). Equal texts have equal values; a null text counts as empty, a
    repeated row is returned again, an empty table gives no rows.
    """
    root = root or f"{shared_dir(docs.sparkSession, keep=True)}/shards"
    rows = write_shards(docs, root, id_col, text_col, limit)
    spots = places(rows)
    # Members of a shard are read together; a shard is bounded by ``limit``.
    read = spots.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(
        _features(root),
        "digest binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, width int, height int",
    )
    read = cut(read)
    at = spots.join(read, "digest")
    # A hot digest's rows are split by AQE; the other side has one row for it.
    return rows.select("doc_id", "n_bytes", "digest").join(at, "digest").select(
        "doc_id", "n_bytes", F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length", "width", "height", "payload_bytes",
        F.lower(F.hex("digest")).alias("payload_sha256"), "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature",
    )


def drop_orphans(rows: DataFrame, root: str) -> int:
    """Delete the shards below ``root`` that no row names, as failed attempts leave them; returns their number.

    Only names come to the driver, one for each SHARD_BYTES of media.
    """
    fs, d = _store(root)
    named = {r["shard"] for r in rows.select("shard").distinct().toLocalIterator()}
    found = [f for f in fs.get_file_info(pafs.FileSelector(d)) if f.is_file and f.base_name.startswith("shard-") and f.base_name not in named]
    for f in found:
        fs.delete_file(f.path)
    return len(found)


def extract(root: str, shard: str) -> dict[str, bytes]:
    """All members of a shard by name, through the standard tar reader."""
    fs, d = _store(root)
    with fs.open_input_file(f"{d}/{shard}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        return {os.path.basename(m.name): tar.extractfile(m).read() for m in tar.getmembers()}
