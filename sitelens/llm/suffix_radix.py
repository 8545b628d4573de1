"""Suffix-array dedup of bytes by a depth-limited radix sort.

Suffixes are ordered only through their first ``length`` bytes, by most-significant-digit passes; what is left in
one group after the last pass are exactly the repeated windows. The digits are chosen so that a pass moves runs
of neighbouring suffixes instead of single ones (``repeats``):

* first digit: the suffix's anchor, the 36-byte gram with the smallest hash among its first ``length`` bytes.
  Neighbouring suffixes share it, so a run is one entry; a digit that occurs once ends its run's sorting;
* second digit: everything the run's windows can reach. A run whose digit occurs earlier is done as a whole
  (all its windows repeat), and so is one whose first digit has this second digit only;
* last digit: the rest, all ``length`` bytes, for the single suffixes of the runs that are left.

Each pass is a sort at the owners of its digits, who get one entry per chunk and digit. Matches never cross documents. A
byte goes if any window that starts earlier elsewhere covers it; strings are judged on the input. Null texts count as
empty; texts shorter than ``length`` stay whole; repeated rows of one id are ordered by their place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelens.llm import chunks as C
from sitelens.llm.buffers import byte_codes
from sitelens.llm.repeats import Repeats, covered


def _bytes(buf, offs):
    return byte_codes(buf), offs


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   gram: int = 36) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (start and end of each maximal run of bytes to remove), n_removed,
    kept (the remaining bytes)."""
    packed = C.pack(df, id_col, text_col)
    found = Repeats(packed, _bytes, length, min(gram, length))

    def finish(chunk, data, flagged):
        ids, buf, offs = data
        gone = covered(flagged[4], length, buf.size)
        left = buf[~gone].tobytes()
        at = np.concatenate([[0], np.cumsum(~gone)])[offs]
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        # a run ends at its document's end
        inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < buf.size)]
        both = np.unique(inner[gone[inner - 1] & gone[inner]]) if inner.size else inner
        s = np.sort(np.concatenate([np.flatnonzero(edge == 1), both]))
        e = np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
        row = np.searchsorted(offs, s, "right") - 1
        cut = np.searchsorted(row, np.arange(ids.size + 1))
        flat = np.stack([s - offs[row], e - offs[row]], 1).ravel() if s.size else np.zeros(0, np.int64)
        pairs = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.int64()), 2).cast(pa.list_(pa.int64()))
        return pa.table({
            "doc_id": C.id_array(ids), "n_bytes": pa.array(np.diff(offs), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs),
            "n_removed": pa.array(np.diff(offs) - np.diff(at), pa.int64()),
            "kept": pa.array([left[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())})

    return found.finish(finish, "doc_id long, n_bytes long, spans array<array<long>>, n_removed long, kept binary")
