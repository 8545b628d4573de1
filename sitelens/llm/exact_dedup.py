"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every chunk of documents fingerprints its normalised texts (whitespace ``[\\x20\\x09-\\x0D]`` deleted),
   sorts the distinct fingerprints and sends each owner its slice, Golomb-Rice coded.
2. An owner decodes its slices and answers each chunk with a bitmap: which of its fingerprints occur twice
   or more. Only these bits come back; texts stay in their checkpointed chunks.
3. Only suspects (set bits) are shuffled for byte verification: per fingerprint the smallest and largest
   normalised text, combined on the map side, are equal exactly if all texts of the group are. Fingerprints
   that hold several texts (a collision) are grouped by the text itself.

Of equal texts the row with the most code points in its original text stays, then the smallest id (null
before all others); among repeated rows of one id, one stays. Null texts count as empty. Columns other
than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import chunks as C
from sitelens.llm.buffers import is_space


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-Rice coded gaps: unary quotients, then remainders."""
    n = values.size
    if n == 0:
        return np.zeros(3, "<u8").tobytes()
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(1, n - 1) if n > 1 else 0
    k = max(0, min(63, mean.bit_length() - 1)) if mean else 0
    quot = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quot.sum()) + quot.size, np.uint8)
    unary[np.cumsum(quot + 1) - 1] = 1
    low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k:]
    head = np.array([n, k, int(values[0])], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k, first = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    if n == 0:
        return np.zeros(0, np.uint64)
    m = n - 1
    low_bytes = (m * k + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, len(blob) - 24 - low_bytes, 24))
    ends = np.flatnonzero(unary)[:m]
    quot = np.diff(np.concatenate([[-1], ends])) - 1
    low = np.unpackbits(np.frombuffer(blob, np.uint8, low_bytes, len(blob) - low_bytes))[:m * k].reshape(m, k)
    full = np.zeros((m, 64), np.uint8)
    full[:, 64 - k:] = low
    gaps = np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)
    gaps += quot.astype(np.uint64) << np.uint64(k)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), gaps]))


def _normalised(buf, offs):
    """(bytes, offsets) without whitespace, and each text's code points before that."""
    keep = ~is_space(buf)
    at = np.concatenate([[0], np.cumsum(keep)])
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return buf[keep], at[offs], np.diff(starts[offs])


def _fingerprints(norm, offs, bits) -> np.ndarray:
    raw = memoryview(norm.tobytes())
    h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])), np.uint64, offs.size - 1)
    return h >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _suspect_mask(fps, replies) -> np.ndarray:
    uniq, inv = np.unique(fps, return_inverse=True)
    bits = np.zeros(uniq.size, bool)
    for blob in replies.get("dup", ()):
        start, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        bits[start:start + n] = np.unpackbits(np.frombuffer(blob, np.uint8, offset=16), count=n)
    return bits[inv]


def _answer(rows):
    decoded = []
    for chunk, _, blob in rows:
        start, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        local = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, 16), count=n).astype(bool)
        decoded.append((chunk, start, local, rice_decode(blob[16 + (n + 7) // 8:])))
    allv = np.concatenate([d[3] for d in decoded])
    uniq, inv, count = np.unique(allv, return_inverse=True, return_counts=True)
    many = count > 1
    many[inv[np.concatenate([d[2] for d in decoded])]] = True   # repeated within one chunk
    hit, out, at = many[inv], [], 0
    for chunk, start, local, _ in decoded:
        mine = hit[at:at + local.size]
        at += local.size
        if mine.any():
            out.append((chunk, "dup", np.array([start, local.size], "<i8").tobytes() + np.packbits(mine).tobytes()))
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (see the module docstring).
    ``fingerprint_bits`` below 64 only makes collisions more likely; results do not depend on it."""
    out = _decide(C.pack(df, id_col, text_col), fingerprint_bits)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    packed = C.pack(df, id_col, text_col, carry=True)
    return C.keep_rows(packed, _decide(packed, 64).where("not kept"), df, text_col)


def _decide(packed: DataFrame, fingerprint_bits: int) -> DataFrame:
    owners = C.owner_count(packed, 256 << 20)

    def ask(chunk, data, _):
        _, buf, offs = data
        norm, at, _ = _normalised(buf, offs)
        uniq, count = np.unique(_fingerprints(norm, at, fingerprint_bits), return_counts=True)
        rows = []
        for owner, a, b in C.by_owner(uniq, owners):
            head = np.array([a, b - a], "<i8").tobytes() + np.packbits(count[a:b] > 1).tobytes()
            rows.append((owner, chunk, "fp", head + rice_encode(uniq[a:b])))
        return C.request_table(rows)

    replies = C.exchange(C.visit(packed, ask, C.REQUEST), _answer)

    def rows_of(chunk, data, got):
        ids, buf, offs = data
        norm, at, points = _normalised(buf, offs)
        fps = _fingerprints(norm, at, fingerprint_bits)
        raw = memoryview(norm.tobytes())
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
        return pa.table({
            "chunk": pa.array(np.full(ids.size, chunk), pa.int64()), "pos": pa.array(np.arange(ids.size), pa.int64()),
            "doc_id": C.id_array(ids), "points": pa.array(points, pa.int64()), "text_sha256": pa.array(sha, pa.string()),
            "fp": pa.array(fps.view(np.int64), pa.int64(), mask=~_suspect_mask(fps, got))})

    def suspects_of(chunk, data, got):
        _, buf, offs = data
        norm, at, _ = _normalised(buf, offs)
        fps = _fingerprints(norm, at, fingerprint_bits)
        pos = np.flatnonzero(_suspect_mask(fps, got))
        raw = memoryview(norm.tobytes())
        return pa.table({
            "chunk": pa.array(np.full(pos.size, chunk), pa.int64()), "pos": pa.array(pos, pa.int64()),
            "fp": pa.array(fps[pos].view(np.int64), pa.int64()),
            "norm": pa.array([bytes(raw[at[i]:at[i + 1]]) for i in pos], pa.binary())})

    rows = C.visit(packed, rows_of, "chunk long, pos long, doc_id long, points long, text_sha256 string, fp long", replies)
    suspects = C.visit(packed, suspects_of, "chunk long, pos long, fp long, norm binary", replies)
    # byte verification, combined on the map side: a group of copies is one row per task
    verified = (suspects.groupBy("fp").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
                .select("fp", (F.col("lo") == F.col("hi")).alias("one_text")).checkpoint(True))

    order = F.struct((-F.col("points")).alias("p"), "doc_id", "chunk", "pos")

    def decide(members: DataFrame, key: list[str]) -> DataFrame:
        best = members.groupBy(*key).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        return members.join(best, key).select(
            "chunk", "pos", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
            ((F.col("chunk") == F.col("best.chunk")) & (F.col("pos") == F.col("best.pos"))).alias("kept"), "text_sha256")

    single = rows.where("fp is null").select(
        "chunk", "pos", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    out = single.unionByName(decide(rows.join(verified.where("one_text"), "fp", "left_semi"), ["fp"]))
    collided = verified.where("not one_text").select("fp")
    if not collided.isEmpty():
        texts = suspects.join(collided, "fp", "left_semi")
        members = rows.join(texts.drop("fp"), ["chunk", "pos"])
        out = out.unionByName(decide(members, ["fp", "norm"]))
    return out
