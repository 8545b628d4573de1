"""Packed text chunks, and the two moves every whole-corpus comparison here is made of.

``pack`` turns (id, text) rows into chunk rows of about a megabyte of text, zstd-compressed, and
checkpoints them hash-partitioned by chunk. After that,

* ``visit`` runs a function once per chunk, together with the replies addressed to it. The chunks stay
  where they are: only replies move, so going over the corpus again costs no shuffle of texts;
* ``exchange`` sends request rows to their owners (a slice of some hash space) and returns what the
  owners reply, addressed to the asking chunks.

A chunk asks about each distinct value once, however often it occurs there, so a value held by a third
of all documents costs its owner one entry per chunk, not one per document. Rows are identified by
(chunk, position), so null and repeated ids need no special care.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.buffers import text_column

CHUNK_BYTES = 1 << 20
ROW_BITS = 15
CHUNK_ROWS = 1 << ROW_BITS      # (chunk, row) fits one long: 24 bits of partition, 24 of chunks in it, 15 of rows
SEQ_BITS = 24
NULL_ID = np.iinfo(np.int64).min   # sorts before every id; returned as null
PACKED = "chunk long, n_bytes long, ids binary, lens binary, z binary, rest binary"
_PACKED_ARROW = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()),
                           ("lens", pa.binary()), ("z", pa.binary()), ("rest", pa.binary())])


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column has (compared as Spark does, without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         chunk_bytes: int = CHUNK_BYTES, partitions: int | None = None, carry: bool = False) -> DataFrame:
    """Chunk rows of ``df``, checkpointed and hash-partitioned by chunk. With ``carry`` the other columns travel in
    the chunk too, for ``keep_rows``."""
    spark = df.sparkSession
    i, t, no_text = fresh(df.columns, "id", "text", "text_is_null")
    rows = df.select(F.col(id_col).cast("long").alias(i), F.col(text_col).cast("string").alias(t),
                     *([F.col(f"`{c}`") for c in df.columns if c != text_col] + [F.col(text_col).isNull().alias(no_text)] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << SEQ_BITS, 0
        press = zstandard.ZstdCompressor(level=3)
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        rest: list[pa.RecordBatch] = []
        size = rows_held = 0

        def flush():
            nonlocal seq, size, rows_held
            out = pa.RecordBatch.from_arrays([
                pa.array([base + seq], pa.int64()), pa.array([size], pa.int64()),
                pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([np.concatenate(lens).astype(np.int64).tobytes()], pa.binary()),
                pa.array([press.compress(np.concatenate(parts).tobytes())], pa.binary()),
                pa.array([press.compress(_to_ipc(rest)) if carry else None], pa.binary())], schema=_PACKED_ARROW)
            ids.clear(), lens.clear(), parts.clear(), rest.clear()
            seq, size, rows_held = seq + 1, 0, 0
            return out

        for batch in batches:
            buf, offs = text_column(batch.column(1))
            key = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            a, n = 0, key.size
            while a < n:
                b = int(np.searchsorted(offs, offs[a] + (chunk_bytes - size), "right")) - 1
                b = min(n, a + CHUNK_ROWS - rows_held, max(a + (size == 0), b))
                if b > a:
                    ids.append(key[a:b])
                    lens.append(np.diff(offs[a:b + 1]))
                    parts.append(buf[offs[a]:offs[b]].copy())
                    if carry:
                        rest.append(pa.RecordBatch.from_arrays(batch.columns[2:], batch.schema.names[2:]).slice(a, b - a))
                    size += int(offs[b] - offs[a])
                    rows_held += b - a
                if b < n:
                    yield flush()
                a = b
        if rows_held:
            yield flush()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # planned statically: an adaptive plan does not tell its checkpoint how the rows are partitioned
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return rows.mapInArrow(run, PACKED).repartition(n, "chunk").checkpoint(True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _to_ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as w:
        w.write_table(pa.Table.from_batches(batches).combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of one chunk row."""
    ids = np.frombuffer(row["ids"], np.int64)
    lens = np.frombuffer(row["lens"], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=max(1, int(row["n_bytes"])))
    return ids, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(lens)])


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def owner_count(packed: DataFrame, bytes_per_owner: int = 64 << 20) -> int:
    """Owners grow with the corpus, so that one owner's share stays bounded."""
    total = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]   # one number
    return max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // bytes_per_owner) + 1)


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each hash: equal slices of the hash space, so sorted hashes have sorted owners."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def by_owner(hashes: np.ndarray, owners: int) -> Iterator[tuple[int, int, int]]:
    """(owner, a, b) slices of sorted hashes."""
    own = owner_of(hashes, owners)
    cut = np.flatnonzero(np.diff(own)) + 1
    edges = np.concatenate([[0], cut, [own.size]]) if own.size else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(own[a]), int(a), int(b)


def visit(packed: DataFrame, fn: Callable[[tuple, dict[str, list[bytes]]], pa.Table], schema: str,
          replies: DataFrame | None = None, carried: bool = False) -> DataFrame:
    """``fn(chunk id, (ids, bytes, offsets), replies)`` for every chunk. ``replies`` has columns
    (chunk, kind, blob); the function gets them as {kind: [blob, ...]} in no order, with ``carried`` also the chunk's
    other columns under "rest"."""

    def one(row: dict) -> tuple:
        return row["chunk"], unpack(row)

    packed = packed if carried else packed.drop("rest")

    if replies is None:
        def over(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    chunk, data = one(row)
                    yield from fn(chunk, data, {}).to_batches()
        return packed.mapInArrow(over, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[str, list] = {}
        for kind, blob in zip(right.column("kind").to_pylist(), right.column("blob").to_pylist()):
            got.setdefault(kind, []).append(blob)
        (row,) = left.to_pylist()   # chunk ids are unique
        if carried:
            got["rest"] = [row["rest"]]
        return fn(*one(row), got)

    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


REQUEST = "owner long, chunk long, kind string, blob binary"
REQUEST_ARROW = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("kind", pa.string()), ("blob", pa.binary())])
REPLY = "chunk long, kind string, blob binary"
REPLY_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("blob", pa.binary())])


def request_table(rows: list[tuple[int, int, str, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, REQUEST_ARROW)], schema=REQUEST_ARROW)


def reply_table(rows: list[tuple[int, str, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, REPLY_ARROW)], schema=REPLY_ARROW)


def exchange(requests: DataFrame, fn: Callable[[list[tuple[int, str, bytes]]], list[tuple[int, str, bytes]]]) -> DataFrame:
    """Every owner gets its (chunk, kind, blob) requests at once and returns rows to send back.
    The replies (bits and small numbers) are checkpointed: later visits read them again."""

    def own(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("chunk").to_pylist(), table.column("kind").to_pylist(),
                        table.column("blob").to_pylist()))
        return reply_table(fn(rows))

    return requests.groupBy("owner").applyInArrow(own, REPLY).checkpoint(True)


def keep_rows(packed: DataFrame, dropped: DataFrame, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``like`` (packed with ``carry``) without those at the places ``dropped`` (chunk, pos), all columns
    as they were."""
    names = like.columns
    drops = dropped.select("chunk", F.lit("drop").alias("kind"), F.col("pos").cast("string").cast("binary").alias("blob"))

    def emit(chunk, data, got):
        ids, buf, offs = data
        keep = np.ones(ids.size, bool)
        keep[[int(b) for b in got.get("drop", ())]] = False
        rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(got["rest"][0])).read_all()
        text = pa.LargeStringArray.from_buffers(ids.size, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(buf.tobytes()))
        null = rest.column(rest.num_columns - 1).combine_chunks()      # the last one that pack adds
        text = pc.if_else(null, pa.scalar(None, pa.large_string()), text).cast(pa.string())
        cols = [text if c == text_col else rest.column(c) for c in names]
        return pa.table(cols, names=names).filter(pa.array(keep))

    return visit(packed, emit, like.schema, drops, carried=True)
