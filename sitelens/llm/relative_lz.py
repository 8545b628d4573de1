"""Substring dedup by window hashes, with relative Lempel-Ziv factors reported beside it.

What is removed is decided by the repeated windows of ``repeats`` alone; the factors add none to them, and passages shorter than
an anchor's context have no factor. Every document is factored from left to right against the indexed blocks of all documents (``repeats``: a block is
the reach of an anchor gram of words, held at its owner with the place of its first occurrence). A factor copies the
longest stretch that runs on in one source: consecutive anchors whose blocks occur earlier in the same document at
the same distance. The spans are
exactly the words covered by a window of ``length`` words that also starts earlier (smaller id, or same document and
earlier start), judged on the input.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null texts have no words; documents shorter than ``length`` words stay
whole; repeated rows of one id are ordered by their place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelens.llm import chunks as C
from sitelens.llm.buffers import blocks, span_hashes, spread_ranges, word_bounds
from sitelens.llm.repeats import Repeats, Resolved, covered

FACTOR = "start long, length long, source_id long, source_start long"


def word_codes(buf, offs):
    """(hash of each word, each row's first word)."""
    starts, ends, first = word_bounds(buf, offs)
    codes = np.empty(starts.size, np.uint64)
    for a, b in blocks(offs):
        i, j = first[a], first[b]
        base = offs[a]
        codes[i:j] = span_hashes(buf[base:offs[b]], starts[i:j] - base, ends[i:j] - base)
    return codes, first


def factors(first: np.ndarray, res: Resolved, T: int, g: int):
    """Greedy factors: (row, start, end, source index) in words of the chunk. A factor runs on while the next anchor's
    earlier place is in the same source row at the same distance."""
    i = np.flatnonzero(res.earlier)
    if i.size == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at, row, src = res.an.at[i], res.an.row[i], res.source[i]
    shift = (at - first[row]) - src["pos"]
    new = np.ones(i.size, bool)
    new[1:] = ((row[1:] != row[:-1]) | (src["chunk"][1:] != src["chunk"][:-1]) | (src["row"][1:] != src["row"][:-1])
               | (shift[1:] != shift[:-1]) | (at[1:] - at[:-1] > T))
    s = np.flatnonzero(new)
    e = np.append(s[1:], i.size) - 1
    start = np.maximum(first[row[s]], at[s] - (T - g))
    end = np.minimum(first[row[e] + 1], at[e] + T)
    return row[s], start, end, i[s]


def relative_lz_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20,
                      gram: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (kept words joined by one space) and the document's
    factors of at least ``length`` words (start, length, source_id, source_start), in words."""
    packed = C.pack(df, id_col, text_col)
    gram = min(gram, length)
    found = Repeats(packed, word_codes, length, gram, sources=True)

    def finish(chunk, data, flagged):
        ids, buf, offs = data
        _, codes, first, res, starts = flagged
        row, fs, fe, src = factors(first, res, length, gram)
        long_enough = fe - fs >= length
        row, fs, fe, src = row[long_enough], fs[long_enough], fe[long_enough], src[long_enough]
        # windows inside a factor, and the single ones at its boundaries
        inside = spread_ranges(fs, fe - fs - length + 1)
        gone = covered(np.unique(np.concatenate([starts, inside])), length, codes.size)
        ws, we, _ = word_bounds(buf, offs)
        keep = np.flatnonzero(~gone)
        kept_row = np.searchsorted(first, keep, "right") - 1
        # copy the kept words with one space before each but the first of its document
        lens = we[keep] - ws[keep]
        lead = np.ones(keep.size, np.int64)
        if keep.size:
            lead[0] = 0
            lead[1:] = kept_row[1:] == kept_row[:-1]
        out = np.full(int((lens + lead).sum()), 0x20, np.uint8)
        ends = np.cumsum(lens + lead)
        out[spread_ranges(ends - lens, lens)] = buf[spread_ranges(ws[keep], lens)]
        size = np.bincount(kept_row, weights=(lens + lead), minlength=ids.size).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        kept = pa.StringArray.from_buffers(ids.size, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))
        s = res.source[src] if src.size else None
        cut = np.searchsorted(row, np.arange(ids.size + 1))
        cols = [fs - first[row], fe - fs, s["id"] if src.size else fs, (fs - res.an.at[src] + s["pos"]) if src.size else fs]
        struct = pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) if k != 2 else C.id_array(np.asarray(c, np.int64)) for k, c in enumerate(cols)],
            ["start", "length", "source_id", "source_start"])
        n_words = np.diff(first)
        return pa.table({
            "doc_id": C.id_array(ids), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_words - np.bincount(kept_row, minlength=ids.size), pa.int64()), "kept": kept,
            "factors": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), struct)})

    return found.finish(finish, f"doc_id long, n_words long, n_removed long, kept string, factors array<struct<{FACTOR.replace(' ', ':').replace(',:', ',')}>>")
