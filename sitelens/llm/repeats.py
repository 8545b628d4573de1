"""Which windows of T consecutive tokens also start earlier, over a whole corpus, without moving texts.

A window is represented by its *anchor*: of the grams of g tokens inside it, the one with the smallest hash
(leftmost on ties). Equal windows have equal anchors at equal offsets, and neighbouring windows share theirs,
so the corpus is compared by about 2 / (T - g + 2) anchors per token. Three rounds of requests to owners, each
only about what the round before left open (``chunks.exchange``):

1. grams: does this gram occur twice anywhere? If not, no window around it repeats.
2. contexts: of the tokens that windows around the anchor can reach (T - g before, T after), where does the same
   stretch occur first? If earlier than here, every window of this anchor repeats; and if all anchors
   with this gram have the same context, nothing else is to be compared.
3. windows: only where a gram has several contexts, at the first place of each: where does each single window
   occur first?

"Earlier" is smaller id (null first), then chunk and row for repeated ids, then position. All keys are two
64-bit hashes (gram, and context or window).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from sitelens.llm import chunks as C
from sitelens.llm.buffers import blocks, code_span_hashes, mix, sliding_argmin, spread_ranges, window_hashes

_U = np.uint64


@dataclass
class Anchors:
    """Anchors of a chunk, in order: position, owning row, first and last window start, gram hash."""
    at: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray


def token_blocks(first: np.ndarray):
    yield from blocks(first)


def find_anchors(codes: np.ndarray, first: np.ndarray, T: int, g: int) -> Anchors:
    """Anchors of all windows of all rows; ``first`` holds each row's first token. Their gram hashes are mixed anew: being
    the smallest of their windows, they would nearly all fall into the first slices of the hash space, to few owners."""
    out = [[], [], [], [], []]
    for a, b in token_blocks(first):
        base, end = first[a], first[b]
        c = codes[base:end]
        if c.size < T:
            continue
        grams = window_hashes(c, g)
        pick = sliding_argmin(grams, T - g + 1)
        row = np.repeat(np.arange(a, b), np.diff(first[a:b + 1]))
        ok = np.flatnonzero(row[:pick.size] == row[T - 1:T - 1 + pick.size])   # windows inside one row
        if ok.size == 0:
            continue
        p = pick[ok]
        new = np.ones(p.size, bool)
        new[1:] = (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)
        s = np.flatnonzero(new)
        e = np.append(s[1:], p.size) - 1
        for k, v in enumerate((p[s] + base, row[ok[s]], ok[s] + base, ok[e] + base, mix(grams[p[s]]))):
            out[k].append(v)
    return Anchors(*(np.concatenate(v) if v else np.zeros(0, np.int64 if k < 4 else _U) for k, v in enumerate(out)))


def contexts(codes, first, an: Anchors, T: int, g: int) -> np.ndarray:
    """Hash of the tokens that windows around each anchor can reach, and of how it is cut by the row's ends."""
    left = np.maximum(first[an.row], an.at - (T - g))
    right = np.minimum(first[an.row + 1], an.at + T)
    h = np.empty(an.at.size, _U)
    # block-wise, so that the prefix sums stay in cache
    for a, b in token_blocks(first):
        i, j = np.searchsorted(an.at, (first[a], first[b]))
        if i < j:
            base = first[a]
            h[i:j] = code_span_hashes(codes[base:first[b]], left[i:j] - base, right[i:j] - base)
    return h ^ ((an.at - left).astype(_U) * _U(0xD6E8FEB86659FD93))


def order_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a sort by keys, the first the most significant, and where the runs of equal
    leading pairs (the first two keys) begin."""
    order = np.lexsort(keys[::-1])
    if order.size == 0:
        return order, np.zeros(0, np.int64)
    new = np.zeros(order.size, bool)
    new[0] = True
    for k in keys[:2]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


# --- round 1: grams ------------------------------------------------------------------------------

def ask_grams(chunk, gram, owners):
    uniq, count = np.unique(gram, return_counts=True)
    return [(o, chunk, "gram", np.array([a, b - a], "<i8").tobytes() + (count[a:b] > 1).tobytes() + uniq[a:b].tobytes())
            for o, a, b in C.by_owner(uniq, owners)]


def answer_grams(rows):
    parts = []
    for chunk, _, blob in rows:
        start, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        parts.append((chunk, start, np.frombuffer(blob, bool, n, 16), np.frombuffer(blob[16 + n:], _U)))
    values = np.concatenate([p[3] for p in parts])
    uniq, inv, count = np.unique(values, return_inverse=True, return_counts=True)
    many = count > 1
    many[inv[np.concatenate([p[2] for p in parts])]] = True
    hit, out, i = many[inv], [], 0
    for chunk, start, local, _ in parts:
        mine = hit[i:i + local.size]
        i += local.size
        if mine.any():
            out.append((chunk, "gram", np.array([start, local.size], "<i8").tobytes() + np.packbits(mine).tobytes()))
    return out


def read_bits(blobs, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    for blob in blobs:
        start, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        bits[start:start + n] = np.unpackbits(np.frombuffer(blob, np.uint8, offset=16), count=n)
    return bits


def repeated_grams(gram, replies) -> np.ndarray:
    uniq, inv = np.unique(gram, return_inverse=True)
    return read_bits(replies.get("gram", ()), uniq.size)[inv]


# --- rounds 2 and 3: where does a (gram, second hash) occur first? ---------------------------------

def local_firsts(hi, lo, ids, row, pos):
    """Per distinct (hi, lo), in sorted order: (index of its first place in this chunk, class of each input)."""
    order, starts = order_runs(hi, lo, ids, row, pos)
    cls = np.empty(order.size, np.int64)
    sizes = np.diff(np.append(starts, order.size))
    cls[order] = np.repeat(np.arange(starts.size), sizes)
    return order[starts], cls


def pack_columns(*cols: np.ndarray) -> bytes:
    """Integer columns, byte plane by byte plane, zstd-compressed: ids and places within a chunk differ in few bytes."""
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in cols]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_columns(blob: bytes, n: int, count: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, 8 * n * count))
    planes = np.frombuffer(raw, np.uint8).reshape(count, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def _owner_order(hi, lo, owners):
    own = C.owner_of((hi ^ lo) * _U(0x9E3779B97F4A7C15), owners)
    return own, np.argsort(own, kind="stable")


def ask_first(kind, chunk, hi, lo, ids, row, pos, owners):
    """Requests about the distinct (hi, lo) with their first place in this chunk. Keys are sent as 64 and 32 bits."""
    pick, _ = local_firsts(hi, lo, ids, row, pos)
    own, order = _owner_order(hi[pick], lo[pick], owners)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(own[order])) + 1, [own.size]]) if own.size else np.zeros(1, int)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        k = pick[order[a:b]]
        out.append((int(own[order[a]]), chunk, kind, np.array([a, b - a], "<i8").tobytes() + hi[k].tobytes()
                    + (lo[k] >> _U(32)).astype("<u4").tobytes() + pack_columns(ids[k], row[k], pos[k])))
    return out


def _first_entries(blob):
    a, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    return (a, np.frombuffer(blob, "<u8", n, 16), np.frombuffer(blob, "<u4", n, 16 + 8 * n),
            *unpack_columns(blob[16 + 12 * n:], n, 3))


def answer_first(rows, kind: str, sources: bool):
    """Tell each chunk which of its entries occur earlier elsewhere (with ``sources``: where)."""
    rows = [r for r in rows if r[1] == kind]
    if not rows:
        return []
    parts = [_first_entries(blob) for _, _, blob in rows]
    sizes = [p[1].size for p in parts]
    hi, lo, ids, row, pos = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
    chunk = np.repeat(np.array([r[0] for r in rows], np.int64), sizes)
    order, starts = order_runs(hi, lo, ids, chunk, row, pos)
    src = np.empty(order.size, np.int64)
    src[order] = np.repeat(order[starts], np.diff(np.append(starts, order.size)))   # the first place of each entry's key
    later = src != np.arange(src.size)
    out, i = [], 0
    for (c, _, _), p, n in zip(rows, parts, sizes):
        mine = later[i:i + n]
        if mine.any():
            blob = np.array([p[0], n], "<i8").tobytes() + np.packbits(mine).tobytes()
            if sources:
                f = src[i:i + n][mine]
                blob += pack_columns(ids[f], pos[f], chunk[f], row[f])
            out.append((c, kind, blob))
        i += n
    return out


_SOURCE = np.dtype([("id", "<i8"), ("pos", "<i8"), ("chunk", "<i8"), ("row", "<i8")])


def read_first(blobs, hi, lo, owners, sources: np.ndarray | None = None) -> np.ndarray:
    """Which of the distinct (hi, lo) occur earlier elsewhere; their places are written into ``sources``."""
    _, order = _owner_order(hi, lo, owners)
    far = np.zeros(hi.size, bool)
    for blob in blobs:
        a, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, 16), count=n).astype(bool)
        k = order[a:a + n][bits]
        far[k] = True
        if sources is not None:
            for name, col in zip(("id", "pos", "chunk", "row"), unpack_columns(blob[16 + (n + 7) // 8:], k.size, 4)):
                sources[name][k] = col
    return far


# --- round 2: has a gram several contexts? ----------------------------------------------------------

_SPREAD = np.dtype([("gram", "<u8"), ("lo", "<u8"), ("hi", "<u8"), ("idx", "<i4")])


def ask_spread(chunk, gram, ctx, owners):
    order, _ = order_runs(gram, ctx)
    s = gram[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if s.size else np.zeros(0, np.int64)
    e = np.empty(starts.size, _SPREAD)
    e["gram"], e["lo"] = s[starts], ctx[order[starts]]
    e["hi"] = ctx[order[np.append(starts[1:], s.size) - 1]] if s.size else 0
    e["idx"] = np.arange(starts.size)
    return [(o, chunk, "spread", e[a:b].tobytes()) for o, a, b in C.by_owner(e["gram"], owners)]


def answer_spread(rows):
    rows = [r for r in rows if r[1] == "spread"]
    if not rows:
        return []
    parts = [np.frombuffer(blob, _SPREAD) for _, _, blob in rows]
    e = np.concatenate(parts)
    order = np.argsort(e["gram"], kind="stable")
    g = e["gram"][order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    several = np.minimum.reduceat(e["lo"][order], starts) != np.maximum.reduceat(e["hi"][order], starts)
    hit = np.empty(e.size, bool)
    hit[order] = np.repeat(several, np.diff(np.append(starts, g.size)))
    out, i = [], 0
    for (c, _, _), p in zip(rows, parts):
        mine = np.ascontiguousarray(p["idx"][hit[i:i + p.size]])
        if mine.size:
            out.append((c, "spread", mine.tobytes()))
        i += p.size
    return out


def index_mask(blobs, size: int) -> np.ndarray:
    mask = np.zeros(size, bool)
    for blob in blobs:
        mask[np.frombuffer(blob, "<i4")] = True
    return mask


# --- the three rounds ---------------------------------------------------------------------------------

@dataclass
class Resolved:
    """What a chunk knows after the rounds: its anchors with repeated grams, which of them have an earlier
    context (and its place, if sources were asked for), and which are still open."""
    an: Anchors
    earlier: np.ndarray
    source: np.ndarray | None
    open: np.ndarray


class Repeats:
    """The comparison of one packed corpus. ``tokenise(bytes, offsets) -> (codes, first)`` gives each row's
    token codes (64-bit) and first token."""

    def __init__(self, packed: DataFrame, tokenise, T: int, g: int, sources: bool = False):
        self.tokenise, self.T, self.g, self.sources = tokenise, T, g, sources
        owners = C.owner_count(packed, 32 << 20)
        self.owners = owners
        self.packed, me = packed, self._carried()

        def grams(chunk, data, _):
            codes, first = me.tokenise(data[1], data[2])
            return C.request_table(ask_grams(chunk, find_anchors(codes, first, T, g).gram, owners))

        r1 = C.exchange(C.visit(packed, grams, C.REQUEST), answer_grams)

        def stretch(chunk, data, got):
            ids, codes, first, an, ctx = me.repeated(data, got)
            rows = ask_spread(chunk, an.gram, ctx, owners)
            rows += ask_first("context", chunk, an.gram, ctx, ids[an.row], an.row, an.at - first[an.row], owners)
            return C.request_table(rows)

        def second(rows):
            return answer_spread(rows) + answer_first(rows, "context", sources)

        r2 = r1.unionByName(C.exchange(C.visit(packed, stretch, C.REQUEST, r1), second))

        def windows(chunk, data, got):
            ids, codes, first, res = me.resolve(data, got)
            gram, w, p, row = me.open_windows(codes, first, res)
            return C.request_table(ask_first("window", chunk, gram, w, ids[row], row, p - first[row], owners))

        r3 = C.exchange(C.visit(packed, windows, C.REQUEST, r2), lambda rows: answer_first(rows, "window", False))
        self.replies = r2.unionByName(r3)

    def _carried(self) -> "Repeats":
        """What the tasks need of this object (not its DataFrames)."""
        me = object.__new__(Repeats)
        me.tokenise, me.T, me.g, me.sources, me.owners = self.tokenise, self.T, self.g, self.sources, self.owners
        return me

    def repeated(self, data, got):
        ids, buf, offs = data
        codes, first = self.tokenise(buf, offs)
        an = find_anchors(codes, first, self.T, self.g)
        keep = repeated_grams(an.gram, got)
        an = Anchors(*(getattr(an, k)[keep] for k in ("at", "row", "lo", "hi", "gram")))
        return ids, codes, first, an, contexts(codes, first, an, self.T, self.g)

    def resolve(self, data, got):
        ids, codes, first, an, ctx = self.repeated(data, got)
        pick, cls = local_firsts(an.gram, ctx, ids[an.row], an.row, an.at - first[an.row])
        earlier = np.ones(an.at.size, bool)
        earlier[pick] = False                      # later places in this chunk have theirs before them
        source = None
        if self.sources:
            source = np.empty(pick.size, _SOURCE)
            source["id"], source["pos"], source["chunk"], source["row"] = ids[an.row[pick]], \
                (an.at - first[an.row])[pick], -1, an.row[pick]     # chunk -1: this one
        far = read_first(got.get("context", ()), an.gram[pick], ctx[pick], self.owners, source)
        source = source[cls] if source is not None else None
        earlier |= far[cls]
        uniq, inv = np.unique(an.gram, return_inverse=True)
        several = index_mask(got.get("spread", ()), uniq.size)[inv]
        return ids, codes, first, Resolved(an, earlier, source, several & ~earlier)

    def open_windows(self, codes, first, res: Resolved):
        """(gram, window hash, start, row) of every window of the open anchors."""
        i = np.flatnonzero(res.open)
        lo, hi = res.an.lo[i], res.an.hi[i]
        count = hi - lo + 1
        p = spread_ranges(lo, count)
        w = np.empty(p.size, _U)
        for a, b in token_blocks(first):
            x, y = np.searchsorted(p, (first[a], first[b]))
            if x < y:
                w[x:y] = window_hashes(codes[first[a]:first[b]], self.T)[p[x:y] - first[a]]
        return np.repeat(res.an.gram[i], count), w, p, np.repeat(res.an.row[i], count)

    def flagged(self, data, got):
        """(ids, codes, first, resolved, starts): sorted starts of all windows that also start earlier."""
        ids, codes, first, res = self.resolve(data, got)
        gram, w, p, row = self.open_windows(codes, first, res)
        pick, cls = local_firsts(gram, w, ids[row], row, p - first[row])
        again = np.ones(p.size, bool)
        again[pick] = False
        again |= read_first(got.get("window", ()), gram[pick], w[pick], self.owners)[cls]
        i = np.flatnonzero(res.earlier)
        whole = spread_ranges(res.an.lo[i], res.an.hi[i] - res.an.lo[i] + 1)
        return ids, codes, first, res, np.sort(np.concatenate([whole, p[again]]))

    def finish(self, fn, schema: str) -> DataFrame:
        """One last visit: ``fn(data, flagged) -> Arrow table`` per chunk."""
        me = self._carried()
        return C.visit(self.packed, lambda chunk, data, got: fn(chunk, data, me.flagged(data, got)), schema, self.replies)


def covered(starts: np.ndarray, T: int, n: int) -> np.ndarray:
    """Mask of the n tokens that lie in a window [start, start + T)."""
    d = np.zeros(n + 1, np.int32)
    d[starts] += 1          # starts are distinct
    np.add.at(d, starts + T, -1)
    return np.cumsum(d[:n]) > 0
