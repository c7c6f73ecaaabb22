"""Rewriting Parquet files whose schemas have drifted from an evolved one.

Columns are known by their Parquet field ids; names, places and types may differ.
A file's footer tells its drift as four bits. Each bit has one transform, a
function of a record batch alone, and a file's chain is the composition of those
that its bits ask for. The chain runs lazily: batches are read, pass through all
transforms and are written one by one, so a task's memory does not depend on the
size of a file, and a file without drift is not read at all beyond its footer.

A file is one row of a table of paths, and Spark deals these rows to tasks. An
output is written under a name of its attempt in a folder beside and then moved
into place; the drifted file goes only after all rewrites have been recorded in a
written table. A task that is run again therefore finds what its first attempt
found, and leaves the same files.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import cut, fold, lean, prepare, shared_dir
from tracewell.workers import spread

#: One bit for each kind of drift; FOREIGN are columns that the evolved schema does not have.
RENAME, REORDER, ADD, WIDEN, FOREIGN = 1, 2, 4, 8, 16
#: Rows of a batch that passes through a chain, and bytes of a row group.
BATCH_ROWS, GROUP_BYTES = 16_384, 32 << 20
_ID = b"PARQUET:field_id"

Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def evolved(fields: Iterable[tuple[int, str, pa.DataType]]) -> pa.Schema:
    """A schema of nullable columns from (field id, name, type)."""
    return pa.schema([pa.field(name, kind, metadata={_ID: str(i)}) for i, name, kind in fields])


def field_id(field: pa.Field) -> int | None:
    found = (field.metadata or {}).get(_ID)
    return None if found is None else int(found)


def _by_id(schema: pa.Schema) -> dict[int, pa.Field]:
    return {i: f for f in schema if (i := field_id(f)) is not None}


def drift_of(footer: pa.Schema, target: pa.Schema) -> int:
    """The bits in which a footer differs from the evolved schema; 0: not at all."""
    have, want = _by_id(footer), _by_id(target)
    known = [i for i in have if i in want]
    bits = RENAME * any(have[i].name != want[i].name for i in known)
    bits |= REORDER * (known != [i for i in want if i in have])
    bits |= ADD * any(i not in have for i in want)
    bits |= WIDEN * any(have[i].type != want[i].type for i in known)
    return bits | FOREIGN * (len(known) < len(footer))


# --- the four transforms: each mends one bit and leaves the others as they are


def _batch(pairs: list[tuple[pa.Array, pa.Field]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a for a, _ in pairs], schema=pa.schema([f for _, f in pairs]))


def rename(target: pa.Schema) -> Step:
    """Columns take the names that their ids have."""
    want = _by_id(target)
    return lambda b: _batch([(a, f.with_name(want[field_id(f)].name)) for a, f in zip(b.columns, b.schema, strict=True)])


def reorder(target: pa.Schema) -> Step:
    """Columns stand in the evolved order."""
    place = {i: k for k, i in enumerate(_by_id(target))}
    return lambda b: _batch(sorted(zip(b.columns, b.schema, strict=True), key=lambda p: place[field_id(p[1])]))


def add(target: pa.Schema, fills: dict[int, Any]) -> Step:
    """Columns that are missing stand behind the one that comes before them in the evolved order, with their
    fill value (null without one)."""
    order = list(_by_id(target).items())

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        out = list(zip(b.columns, b.schema, strict=True))
        for k, (i, f) in enumerate(order):
            ids = [field_id(x) for _, x in out]
            if i not in ids:
                at = 1 + ids.index(order[k - 1][0]) if k else 0  # those before it are there by now
                out.insert(at, (pa.repeat(pa.scalar(fills.get(i), f.type), b.num_rows), f))
        return _batch(out)

    return step


#: Types that hold every value of a narrower one.
WIDER = {
    pa.int8(): (pa.int16(), pa.int32(), pa.int64()),
    pa.int16(): (pa.int32(), pa.int64()),
    pa.int32(): (pa.int64(), pa.float64()),
    pa.float32(): (pa.float64(),),
    pa.string(): (pa.large_string(),),
    pa.date32(): (pa.timestamp("us"),),
}


def widen(target: pa.Schema) -> Step:
    """Columns of a narrower type take the evolved one; any other change of type is an error."""
    want = _by_id(target)

    def one(a: pa.Array, f: pa.Field) -> tuple[pa.Array, pa.Field]:
        kind = want[field_id(f)].type
        if kind != f.type and kind not in WIDER.get(f.type, ()):
            raise ValueError(f"{f.name}: {f.type} cannot be widened to {kind}")
        return a.cast(kind), f.with_type(kind)

    return lambda b: _batch([one(a, f) for a, f in zip(b.columns, b.schema, strict=True)])


def chain(bits: int, target: pa.Schema, fills: dict[int, Any]) -> Step:
    """The transforms of all bits as one function; the identity for none."""
    steps = ((WIDEN, lambda: widen(target)), (ADD, lambda: add(target, fills)), (REORDER, lambda: reorder(target)), (RENAME, lambda: rename(target)))
    asked = [make() for bit, make in steps if bits & bit]
    return lambda batch: reduce(lambda b, step: step(b), asked, batch)


# --- files


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _footer(path: str) -> pa.Schema:
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        return pq.read_schema(f)


def read_batches(path: str, known: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    """A file's rows batch by batch; only columns with ``known`` ids are read."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        schema = file.schema_arrow
        fields = [x for x in schema if known is None or field_id(x) in known]
        for b in file.iter_batches(BATCH_ROWS, columns=[x.name for x in fields], use_threads=False):
            yield pa.RecordBatch.from_arrays([b.column(x.name) for x in fields], schema=pa.schema(fields))


class _Writer:
    """One file, written beside its folder and moved into place when it is whole."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.fs, root = _open(folder)
        self.part, self.final, self.path = f"{root}-attempts/{uuid.uuid4().hex}-{name}", f"{root}/{name}", f"{folder}/{name}"
        for d in (f"{root}-attempts", root):
            self.fs.create_dir(d, recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.schema, self.writer = schema, pq.ParquetWriter(self.out, schema)
        self.rows, self.held, self.bytes = 0, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        self.bytes += batch.nbytes
        if self.bytes >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
        self.held, self.bytes = [], 0

    def close(self) -> str:
        self._flush()
        self.writer.close()
        self.out.close()
        self.fs.move(self.part, self.final)
        return self.path


def rewrite_file(path: str, folder: str, name: str, target: pa.Schema, fills: dict[int, Any]) -> tuple[int, str, int]:
    """Bring one file to the evolved schema; (drift, path of the file that now counts, rows).

    A file without drift stays where it is and only its footer is read.
    """
    footer = _footer(path)
    bits = drift_of(footer, target)
    if not bits:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            return 0, path, pq.read_metadata(f).num_rows
    step, out = chain(bits, target, fills), _Writer(folder, name, target)
    for batch in map(step, read_batches(path, set(_by_id(target)))):
        out.add(batch)
    return bits, out.close(), out.rows


def _rows(it: Iterator[pa.RecordBatch], make: Callable[[dict], dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for row in batch.to_pylist():  # a row is a file: one goes out as soon as it is done
            yield pa.RecordBatch.from_pylist([make(row)], schema=schema)


def migrate(files: DataFrame, folder: str, target: pa.Schema, fills: dict[int, Any] | None = None) -> DataFrame:
    """Turn the files named by ``path`` into files of the evolved schema, below ``folder``.

    ``files`` has one row for each file: file_no (whole number, unique) and path (a
    URI that executors reach); other columns are left out. Returns a written table
    (file_no, path, drift, rewritten, n_rows, start_columns); start_columns are
    the ordered names that the file had. Rows keep their order; nulls stay; columns
    that are missing get ``fills`` by field id; columns whose ids the evolved schema
    does not have go. Drifted files are deleted once the table is written. No files
    give no rows.
    """
    prepare(files.sparkSession)
    fills = fills or {}
    kinds = "file_no long, path string, drift int, rewritten boolean, n_rows long, start_columns string"
    schema = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("drift", pa.int32()), ("rewritten", pa.bool_()), ("n_rows", pa.int64()), ("start_columns", pa.string())])

    def one(row: dict) -> dict:
        bits, path, n = rewrite_file(row["path"], folder, f"evolved-{row['file_no']:08d}.parquet", target, fills)
        return {"file_no": row["file_no"], "path": path, "drift": bits, "rewritten": bits > 0, "n_rows": n, "start_columns": ",".join(_footer(row["path"]).names)}

    asked = files.select(F.col("file_no").cast("long"), "path").repartition(spread(files.sparkSession), "file_no")
    done = cut(asked.mapInArrow(lean(lambda it: _rows(it, one, schema)), kinds))
    _retire(files.select(F.col("file_no").cast("long"), F.col("path").alias("old")).join(done.where("rewritten"), "file_no"))
    return done


def _retire(pairs: DataFrame) -> None:
    """Delete files that others have replaced; one that is gone already is no error."""

    def one(row: dict) -> dict:
        fs, at = _open(row["old"])
        if row["old"] != row["path"] and fs.get_file_info(at).type == pafs.FileType.File:
            fs.delete_file(at)
        return {"n": 1}

    gone = pairs.select("old", "path").repartition(spread(pairs.sparkSession), "old")
    gone.mapInArrow(lambda it: _rows(it, one, pa.schema([("n", pa.int64())])), "n long").agg(F.sum("n")).collect()


# --- starting files with known drift


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``rank``, each row's place from 0 in the order of columns; also the number of rows.

    Ranges of the order go to partitions of their own; equal rows, which any order
    leaves alike, may go to several. What meets in one task is a count for each
    partition.
    """
    spark = rows.sparkSession
    n = spread(spark)
    # The last key tells apart rows that are equal in all others, so these can be dealt too.
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie")
    table = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).drop("__tie"))
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = table.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.withColumn("__base", F.coalesce(before, F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    out = table.withColumn("__part", part).join(F.broadcast(bases.select("__part", "__base")), "__part")
    return out.withColumn("rank", F.col("__base") + place).drop("__part", "__at", "__base"), int(total)


def version_of(file_no: int) -> int:
    """The drift with which a file starts."""
    v = zlib.crc32(f"7:{file_no}".encode()) % 24
    return 0 if v > 15 else v


def drifted(target: pa.Schema, version: int, swap: tuple[int, int], missing: set[int], narrow: dict[int, pa.DataType]) -> pa.Schema:
    """The evolved schema drifted by the bits of a version."""
    fields = _by_id(target)
    if version & RENAME:
        a, b = swap
        fields[a], fields[b] = fields[a].with_name(fields[b].name), fields[b].with_name(fields[a].name)
    if version & WIDEN:
        fields |= {i: fields[i].with_type(t) for i, t in narrow.items()}
    if version & ADD:
        fields = {i: f for i, f in fields.items() if i not in missing}
    first, *rest = fields.values()
    return pa.schema([first, *(reversed(rest) if version & REORDER else rest)])


def starting_files(dealt: DataFrame, folder: str, target: pa.Schema, shape: Callable[[int], pa.Schema]) -> DataFrame:
    """Write one file for each ``file_no``, its rows in the order of ``rank``; returns a written table (file_no, path).

    ``dealt`` has the columns of ``target`` by name, file_no and rank; ``shape`` is
    the schema of a file by its number. One task streams a file, many tasks files.
    """
    prepare(dealt.sparkSession)
    names, ids = target.names, [field_id(f) for f in target]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.close()])], ["file_no", "path"])

        at, out = None, None
        for batch in it:
            file_no = batch.column("file_no").to_numpy()
            edges = np.flatnonzero(np.r_[True, file_no[1:] != file_no[:-1]]) if len(file_no) else []
            for lo, hi in zip(edges, [*edges[1:], len(file_no)], strict=True):
                if file_no[lo] != at:
                    if out is not None:
                        yield done()
                    at = int(file_no[lo])
                    out = _Writer(folder, f"start-{at:08d}.parquet", shape(at))
                columns = {i: batch.column(n).slice(lo, hi - lo) for i, n in zip(ids, names, strict=True)}
                out.add(_batch([(columns[field_id(f)].cast(f.type, safe=not pa.types.is_floating(f.type)), f) for f in out.schema]))
        if out is not None:
            yield done()

    grouped = dealt.select("file_no", "rank", *names).repartition(spread(dealt.sparkSession), "file_no").sortWithinPartitions("file_no", "rank")
    return cut(grouped.mapInArrow(lean(run), "file_no long, path string"))


def deal_by_hash(rows: DataFrame, id_col: str, columns: Iterable[Column], files: int) -> DataFrame:
    """Rows in the order of crc32 of the id's decimal form, then the id, dealt in order to about ``files`` files.

    Adds file_no and rank. Rows of one id follow by a hash of the whole row; a null
    id counts as an empty text and comes before others.
    """
    kept = rows.select(*columns)
    keyed = kept.withColumn("__crc", fold(F.col(id_col), 1 << 32)).withColumn("__id", F.col(id_col)).withColumn("__row", F.xxhash64(*kept.columns))
    out, n = ranked(keyed, ["__crc", "__id", "__row"])
    return out.drop("__crc", "__id", "__row").withColumn("file_no", F.floor(F.col("rank") / (1 + n // files)).cast("long"))


# --- the table of clients

# The evolved schema by field id, its fill values, and what drifts.
CLIENTS = evolved(
    [(1, "client_id", pa.int64()), (2, "master_id", pa.int64()), (3, "source", pa.string()), (4, "updated_at", pa.timestamp("us")), (5, "name", pa.string()),
     (6, "email", pa.string()), (7, "city", pa.string()), (8, "nation_id", pa.int64()), (9, "segment", pa.string()), (10, "balance", pa.float64())]
)
CLIENT_FILLS = {7: "none", 8: -1}
CLIENT_SWAP, CLIENT_MISSING, CLIENT_NARROW = (5, 6), {7, 8}, {8: pa.int32(), 10: pa.float32()}
_SPARK = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.timestamp("us"): T.TimestampNTZType(), pa.float64(): T.DoubleType()}


def client_shape(file_no: int) -> pa.Schema:
    return drifted(CLIENTS, version_of(file_no), CLIENT_SWAP, CLIENT_MISSING, CLIENT_NARROW)


def rewrite_clients(clients: DataFrame, files: int = 1000, folder: str | None = None) -> DataFrame:
    """Write the rows of ``clients`` as drifted files and migrate these; the table of ``migrate``.

    Files lie in a new folder below ``spark.checkpoint.dir`` and stay there. Columns
    that the evolved schema does not name are left out, repeated rows stay, an
    empty table gives no files and no rows.
    """
    folder = folder or f"{shared_dir(clients.sparkSession, keep=True)}/clients"
    columns = [F.col(f.name).cast(_SPARK[f.type]).alias(f.name) for f in CLIENTS]
    start = starting_files(deal_by_hash(clients, "client_id", columns, files), folder, CLIENTS, client_shape)
    return migrate(start, folder, CLIENTS, CLIENT_FILLS)


# --- digests of files


def _floor_text(x: float) -> str:
    return str(math.floor(x) * 1048576 + math.floor((x - math.floor(x)) * 1048576)) if math.isfinite(x) else str(x)


def _texts(a: pa.Array) -> list[str]:
    """The fields of a column as texts: ``?`` for null, times in microseconds, other numbers' floor at 2**20."""
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.int64())
    if pa.types.is_floating(a.type):
        return ["?" if x is None else _floor_text(x) for x in a.to_pylist()]
    return pc.fill_null(a.cast(pa.string()), "?").to_pylist()


def file_digest(path: str) -> dict:
    """Names, null values and SHA-256 of the ids and of the rows of a file, read batch by batch."""
    ids, rows, nulls, n = hashlib.sha256(), hashlib.sha256(), 0, 0
    names = _footer(path).names
    for b in read_batches(path):
        nulls += sum(c.null_count for c in b.columns)
        texts = [_texts(c) for c in b.columns]
        if not b.num_rows:
            continue
        ids.update((("," if n else "") + ",".join(texts[0])).encode())
        rows.update((("\n" if n else "") + "\n".join(map("|".join, zip(*texts, strict=True)))).encode())
        n += b.num_rows
    return {"columns": ",".join(names), "n_nulls": nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest()}


def with_digests(files: DataFrame) -> DataFrame:
    """Adds columns, n_nulls, ids_sha256 and rows_sha256 to a table of ``migrate``, reading the files back."""
    prepare(files.sparkSession)
    added = pa.schema([("columns", pa.string()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                found = file_digest(batch.column("path")[i].as_py())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([found[f.name]], f.type) for f in added)], [*batch.schema.names, *added.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    spread_out = files.repartition(spread(files.sparkSession), "file_no")
    return spread_out.mapInArrow(lean(run), f"{kinds}, columns string, n_nulls long, ids_sha256 string, rows_sha256 string")
