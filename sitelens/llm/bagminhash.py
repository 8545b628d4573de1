"""MinHash near-dedup of word-shingle multisets with BagMinHash signatures.

Weights (shingle counts) are discretised at the integers. Each (shingle, dyadic weight level) has its own Poisson
process of points over time; a point carries a signature component and a place inside the level, i.e. the path down
the level's halves, and counts only for texts whose weight reaches that place. A component's value is the time of
its first point over all shingles, so two texts agree in a component with probability sum(min) / sum(max) of their
counts: the weighted Jaccard similarity, without bias. Points are drawn in order of time, and a shingle stops as
soon as its next point lies beyond the largest component of its text, which takes little more than one point per
shingle for long texts.

Signatures are cut into bands. Band hashes go to owners, who name each bucket's leader (its first row); every member is
verified exactly (multiset overlap of shingles) against the leaders of its buckets, in the member's chunk: a
leader's text travels once per chunk, however many members are there. Links between members are then implied,
except in buckets whose members still lie in several classes: there every member outside the leader's class sends a
sketch (a byte per component) to the bucket's chunks, and where it agrees with members of other classes about as often
as a pair at the threshold must, the text follows and is verified. So no pair of a bucket stays undecided, pairs are
listed only where sketches agree, and a bucket with a third of all rows costs one text per chunk.

Shingles are five consecutive words ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one shingle. Texts
without words are similar to nothing. Classes are the connected components of similarity >= threshold; null texts
count as empty; ids may be null or repeated (rows are told apart by their place).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import chunks as C
from sitelens.llm.buffers import blocks, code_span_hashes, mix, spread_ranges, window_hashes
from sitelens.llm.components import connected_components
from sitelens.llm.relative_lz import word_codes
from sitelens.llm.repeats import order_runs

_U = np.uint64
SHINGLE = 5
CHUNK_BYTES = 4 << 20        # larger chunks than elsewhere: a text is sent once per chunk
BANDS, BAND_ROWS = 40, 6     # a pair at similarity 0.8 shares a bucket with probability 1 - 5e-6


def shingle_bags(buf, offs, k: int = SHINGLE):
    """(row, hash, count) of the distinct shingles of every text, sorted by row and hash."""
    codes, first = word_codes(buf, offs)
    rows, hashes = [], []
    for a, b in blocks(first):
        c = codes[first[a]:first[b]]
        row = np.repeat(np.arange(a, b), np.diff(first[a:b + 1]))
        h = window_hashes(c, k)
        ok = row[:h.size] == row[k - 1:k - 1 + h.size] if h.size else np.zeros(0, bool)
        rows.append(row[:h.size][ok])
        hashes.append(h[ok])
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    rows.append(short)
    hashes.append(code_span_hashes(codes, first[short], first[short + 1]) if short.size else np.zeros(0, _U))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order, starts = order_runs(row.astype(np.int64), h)
    return row[order[starts]], h[order[starts]], np.diff(np.append(starts, row.size))


def bag_signatures(row, item, count, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) first arrival times; infinite for rows without items."""
    sig = np.full((n_rows, m), np.inf)
    if row.size == 0:
        return sig
    # dyadic levels (0,1], (1,2], (2,4], (4,8], ... up to each item's weight
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    src = np.repeat(np.arange(row.size), levels)
    level = spread_ranges(np.zeros(row.size, np.int64), levels)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    reach = count[src] - np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))   # weight inside the level
    seed = mix(item[src] + (level.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F))
    r, rate = row[src], width * m
    t, drawn = np.zeros(src.size), 0
    flat, limit = sig.ravel(), np.full(n_rows, np.inf)
    alive = np.arange(src.size)
    while alive.size:
        steps = int(np.clip(16384 // alive.size, 1, 128))
        no = (drawn + 1 + np.arange(steps)).astype(_U)[:, None]
        z = mix(seed[alive][None, :] + no * _U(0x9E3779B97F4A7C15))
        gap = -np.log(((z >> _U(11)).astype(float) + 0.5) * 2.0 ** -53) / rate[alive]
        gap[0] += t[alive]      # one running sum: times must not depend on how many points are drawn at once
        times = np.cumsum(gap, axis=0)
        z2 = mix(z ^ _U(0xE7037ED1A0B428DB))
        comp = ((z2 & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)
        cell = ((z2 >> _U(32)).astype(float) * 2.0 ** -32 * width[alive]).astype(np.int64)   # unit cell in the level
        hit = (cell < reach[alive]) & (times < limit[r[alive]])
        np.minimum.at(flat, (r[alive][None, :] * m + comp)[hit], times[hit])
        t[alive] = times[-1]
        drawn += steps
        rows = np.unique(r[alive])
        limit[rows] = sig[rows].max(axis=1)
        alive = alive[t[alive] < limit[r[alive]]]
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys, the band's number mixed in; 0 for rows without items."""
    bits = np.ascontiguousarray(sig).view(_U).reshape(sig.shape[0], bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x8EBC6AF09C88C6E3), bits.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    h[np.isinf(sig).any(axis=1)] = 0
    return h


def signature_parts(buf, offs, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, sketch) of every text: the sketch keeps one byte of each component."""
    row, item, count = shingle_bags(buf, offs)
    n, keys, sketch = offs.size - 1, [np.zeros((0, bands), _U)], [np.zeros((0, bands * rows), np.uint8)]
    for a in range(0, n, 1024):
        b = min(n, a + 1024)
        i, j = np.searchsorted(row, (a, b))
        sig = bag_signatures(row[i:j] - a, item[i:j], count[i:j], b - a, bands * rows)
        keys.append(band_hashes(sig, bands, rows))
        sketch.append((mix(sig.view(_U)) >> _U(56)).astype(np.uint8))
    return np.concatenate(keys), np.concatenate(sketch)


def _read_parts(blob: bytes, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (bands * 8 + bands * rows)
    return (np.frombuffer(blob, _U, n * bands).reshape(n, bands),
            np.frombuffer(blob, np.uint8, offset=n * bands * 8).reshape(n, bands * rows))


def least_agreement(threshold: float, m: int) -> int:
    """Sketch bytes that a pair at the threshold agrees in, less 5 standard deviations (missed with probability 3e-7, less
    than a pair that shares no band)."""
    return max(0, int(m * threshold - 5 * (m * threshold * (1 - threshold)) ** 0.5))


def _node(chunk, row):
    return (chunk << C.ROW_BITS) | row


# --- buckets and leaders ---------------------------------------------------------------------------

_LEAD = np.dtype([("hash", "<u8"), ("leader", "<i8")])


def _bucket_requests(chunk, bands, owners):
    """Each distinct bucket with the chunk's first member, to the bucket's owner."""
    flat = bands.ravel()
    uniq, at, count = np.unique(flat, return_index=True, return_counts=True)
    keep = uniq != 0
    uniq, row, count = uniq[keep], at[keep] // bands.shape[1], count[keep]
    out = []
    for o, a, b in C.by_owner(uniq, owners):
        e = np.empty(b - a, np.dtype([("hash", "<u8"), ("row", "<i4"), ("many", "?")]))
        e["hash"], e["row"], e["many"] = uniq[a:b], row[a:b], count[a:b] > 1
        out.append((o, chunk, "bucket", e.tobytes()))
    return out


def _bucket_answers(rows):
    dt = np.dtype([("hash", "<u8"), ("row", "<i4"), ("many", "?")])
    parts = [np.frombuffer(blob, dt) for _, _, blob in rows]
    e = np.concatenate(parts)
    node = _node(np.repeat(np.array([r[0] for r in rows], np.int64), [p.size for p in parts]), e["row"].astype(np.int64))
    order, starts = np.lexsort((node, e["hash"])), None
    h = e["hash"][order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(starts, h.size))
    leader = np.empty(h.size, np.int64)
    leader[order] = np.repeat(node[order[starts]], size)
    shared = np.empty(h.size, bool)
    shared[order] = np.repeat((size > 1) | np.maximum.reduceat(e["many"][order], starts), size)
    out, i = [], 0
    for (c, _, _), p in zip(rows, parts):
        k = np.flatnonzero(shared[i:i + p.size])
        if k.size:
            s = np.empty(k.size, _LEAD)
            s["hash"], s["leader"] = p["hash"][k], leader[i + k]
            out.append((c, "lead", s.tobytes()))
        i += p.size
    return out


def _leads(got):
    s = np.concatenate([np.frombuffer(b, _LEAD) for b in got.get("lead", ())] or [np.zeros(0, _LEAD)])
    return s[np.argsort(s["hash"])]


def _lookup(sorted_keys, values, missing=-1):
    """Index of each value among sorted distinct keys, or ``missing``."""
    if sorted_keys.size == 0:
        return np.full(values.shape, missing)
    at = np.minimum(np.searchsorted(sorted_keys, values), sorted_keys.size - 1)
    return np.where(sorted_keys[at] == values, at, missing)


# --- exact verification ------------------------------------------------------------------------------

def _similar(h1, c1, h2, c2, threshold) -> bool:
    """Weighted Jaccard similarity of two bags (sorted distinct hashes and counts) >= threshold."""
    if h1.size == 0 or h2.size == 0:
        return False
    if h1.size > h2.size:
        h1, c1, h2, c2 = h2, c2, h1, c1
    at = np.minimum(np.searchsorted(h2, h1), h2.size - 1)
    both = h2[at] == h1
    low = int(np.minimum(c1[both], c2[at[both]]).sum())
    return low >= threshold * (int(c1.sum()) + int(c2.sum()) - low) - 1e-9


_PAIR = np.dtype([("row", "<i4"), ("node", "<i8")])


def _verify(chunk, data, got, threshold) -> np.ndarray:
    """Links that join the classes of the asked pairs (row of this chunk, node): each other text is here or was sent once."""
    ids, buf, offs = data
    pairs = np.concatenate([np.frombuffer(b, _PAIR) for b in got.get("pair", ())] or [np.zeros(0, _PAIR)])
    sent = {int(np.frombuffer(b, "<i8", 1)[0]): b[8:] for b in got.get("text", ())}
    for node in np.unique(pairs["node"][pairs["node"] >> C.ROW_BITS == chunk]):
        r = int(node & (C.CHUNK_ROWS - 1))
        sent[int(node)] = buf[offs[r]:offs[r + 1]].tobytes()
    if not pairs.size:
        return np.zeros((0, 2), np.int64)
    nodes = np.unique(pairs["node"])
    ybuf = np.frombuffer(b"".join(sent[int(x)] for x in nodes), np.uint8)
    yoffs = np.concatenate([[0], np.cumsum([len(sent[int(x)]) for x in nodes])])
    xrows = np.unique(pairs["row"]).astype(np.int64)
    lens = offs[xrows + 1] - offs[xrows]
    bags = []
    for raw, cut, n in ((ybuf, yoffs, nodes.size), (buf[spread_ranges(offs[xrows], lens)], np.concatenate([[0], np.cumsum(lens)]), xrows.size)):
        row, item, count = shingle_bags(raw, cut)
        bags.append((item, count, np.searchsorted(row, np.arange(n + 1))))
    (yi, yc, yat), (xi, xc, xat) = bags
    py, px = np.searchsorted(nodes, pairs["node"]), np.searchsorted(xrows, pairs["row"])
    ny, nx = (np.add.reduceat(np.append(c, 0), at[:-1]) * (np.diff(at) > 0) for c, at in ((yc, yat), (xc, xat)))
    fits = np.minimum(ny[py], nx[px]) >= threshold * np.maximum(ny[py], nx[px])
    links, root = [], {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    for i in np.flatnonzero(fits):
        y, x = py[i], px[i]
        a, b = int(_node(chunk, int(pairs["row"][i]))), int(pairs["node"][i])
        if (ra := find(a)) == (rb := find(b)):
            continue        # already in one class by links found here: only a spanning forest is reported
        if _similar(xi[xat[x]:xat[x + 1]], xc[xat[x]:xat[x + 1]], yi[yat[y]:yat[y + 1]], yc[yat[y]:yat[y + 1]], threshold):
            links.append((a, b))
            root[max(ra, rb)] = min(ra, rb)
    return np.array(links, np.int64).reshape(-1, 2)


def _link_table(links):
    return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})


def _pair_table(chunk, row, node) -> pa.Table:
    e = np.empty(row.size, _PAIR)
    e["row"], e["node"] = row, node
    return C.reply_table([(chunk, "pair", np.unique(e).tobytes())] if e.size else [])


def _visitors(node: np.ndarray, label: np.ndarray, sketch: np.ndarray) -> bytes:
    """Some rows' nodes, classes and sketches in one value."""
    return np.int64(node.size).tobytes() + node.astype(np.int64).tobytes() + label.astype(np.int64).tobytes() + np.ascontiguousarray(sketch).tobytes()


def _read_visitors(blob: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ids = np.frombuffer(blob, np.int64, 2 * n, 8)
    return ids[:n], ids[n:], np.frombuffer(blob, np.uint8, n * m, 8 + 16 * n).reshape(n, m)


# --- the operator ---------------------------------------------------------------------------------------

def _little_endian(col: str):
    """A long as eight bytes."""
    big = F.unhex(F.lpad(F.hex(col), 16, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)])


def _texts(packed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text bytes) of the named rows; nodes are distinct."""
    asked = nodes.select(F.shiftright("node", C.ROW_BITS).alias("chunk"), F.lit("node").alias("kind"),
                         F.col("node").cast("string").cast("binary").alias("blob"))

    def fetch(chunk, data, got):
        _, buf, offs = data
        want = np.array([int(b) for b in got.get("node", ())], np.int64)
        row = want & (C.CHUNK_ROWS - 1)
        return pa.table({"node": pa.array(want, pa.int64()),
                         "text": pa.array([buf[offs[r]:offs[r + 1]].tobytes() for r in row], pa.binary())})

    return C.visit(packed, fetch, "node long, text binary", asked)


def _send(packed: DataFrame, wants: DataFrame) -> DataFrame:
    """Reply rows with the texts wanted: ``wants`` has distinct (node, chunk), the chunk to send to."""
    texts = _texts(packed, wants.select("node").distinct())
    return (wants.join(texts, "node")
            .select("chunk", F.lit("text").alias("kind"), F.concat(_little_endian("node"), "text").alias("blob")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its class), class_size, kept (one row of each class:
    the one with that id)."""
    out = _decide(C.pack(df, id_col, text_col, CHUNK_BYTES), threshold, bands, band_rows)
    return out.select("doc_id", "class_id", "class_size", "kept")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay (one per class), with all their columns."""
    packed = C.pack(df, id_col, text_col, CHUNK_BYTES, carry=True)
    out = _decide(packed, threshold, BANDS, BAND_ROWS).where("not kept")
    return C.keep_rows(packed, out.select(F.shiftright("node", C.ROW_BITS).alias("chunk"),
                                          F.col("node").bitwiseAND(C.CHUNK_ROWS - 1).alias("pos")), df, text_col)


def _decide(packed: DataFrame, threshold: float, bands: int, band_rows: int) -> DataFrame:
    """(node, doc_id, class_id, class_size, kept) of every row packed."""
    owners = C.owner_count(packed, 64 << 20)

    m = bands * band_rows
    agree = least_agreement(threshold, m)

    def ask(chunk, data, _):
        keys, sketch = signature_parts(data[1], data[2], bands, band_rows)
        return C.request_table([(-1, chunk, "bands", keys.tobytes() + sketch.tobytes())] + _bucket_requests(chunk, keys, owners))

    asked = C.visit(packed, ask, C.REQUEST).checkpoint(True)
    own = asked.where("kind = 'bands'").select("chunk", "kind", "blob")
    lead = C.exchange(asked.where("kind = 'bucket'"), _bucket_answers)

    def by_chunk(fn, schema):
        def run(table: pa.Table) -> pa.Table:
            got: dict[str, list] = {}
            for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
                got.setdefault(kind, []).append(blob)
            return fn(int(table.column("chunk")[0].as_py()), got)
        return lambda rows: rows.groupBy("chunk").applyInArrow(run, schema)

    def places_of(got):
        """(bucket, row, leader) of the chunk's places in shared buckets."""
        keys, _ = _read_parts(got["bands"][0], bands, band_rows)
        leads = _leads(got)
        at = _lookup(leads["hash"], keys.ravel())
        k = np.flatnonzero(at >= 0)
        return keys.ravel()[k], k // bands, leads["leader"][at[k]]

    def lead_pairs(chunk, got):
        _, row, leader = places_of(got)
        other = _node(chunk, row) != leader
        return _pair_table(chunk, row[other], leader[other])

    def wanted(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node = np.unique(np.frombuffer(blob, _PAIR)["node"])
                node = node[(node >> C.ROW_BITS) != chunk]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.full(node.size, chunk), pa.int64())],
                                                 ["node", "chunk"])

    def verified(pairs: DataFrame) -> DataFrame:
        wants = pairs.select("chunk", "blob").mapInArrow(wanted, "node long, chunk long").distinct()
        return C.visit(packed, lambda chunk, data, got: _link_table(_verify(chunk, data, got, threshold)), "a long, b long",
                       _send(packed, wants).unionByName(pairs)).checkpoint(True)

    links = verified(by_chunk(lead_pairs, C.REPLY)(own.unionByName(lead)).checkpoint(True))
    labels = connected_components(links)

    label_rows = labels.select(F.shiftright("node", C.ROW_BITS).alias("chunk"), F.lit("label").alias("kind"),
                               F.concat_ws(" ", "node", "label").cast("binary").alias("blob"))
    facts = own.unionByName(lead).unionByName(label_rows)
    spread = np.dtype([("hash", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("head", "<i8"), ("n", "<i8")])

    def members(chunk, got):
        """(bucket, row, label, leader) of the chunk's places in shared buckets."""
        h, row, leader = places_of(got)
        label = _node(chunk, np.arange(_read_parts(got["bands"][0], bands, band_rows)[0].shape[0], dtype=np.int64))
        for b in got.get("label", ()):
            node, root = b.split()
            label[int(node) & (C.CHUNK_ROWS - 1)] = int(root)
        return h, row, label[row], leader

    def ask_classes(chunk, got):
        h, row, label, leader = members(chunk, got)
        order = np.lexsort((label, h))
        s = h[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if s.size else np.zeros(0, np.int64)
        e = np.empty(starts.size, spread)
        if s.size:
            ends = np.append(starts[1:], s.size)
            e["hash"], e["lo"], e["hi"], e["n"] = s[starts], label[order[starts]], label[order[ends - 1]], ends - starts
            head = np.where(_node(chunk, row) == leader, label, -1)
            e["head"] = np.maximum.reduceat(head[order], starts)   # the leader's label, if it is here
        return C.request_table([(o, chunk, "class", e[a:b].tobytes()) for o, a, b in C.by_owner(e["hash"], owners)])

    def answer_classes(rows):
        """Buckets of three or more members in several classes (of two members, one was verified against the other)."""
        parts = [np.frombuffer(blob, spread) for _, _, blob in rows]
        e = np.concatenate(parts)
        order = np.argsort(e["hash"], kind="stable")
        h = e["hash"][order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(e["lo"][order], starts) != np.maximum.reduceat(e["hi"][order], starts)
        several &= np.add.reduceat(e["n"][order], starts) > 2
        size = np.diff(np.append(starts, h.size))
        hit, who = np.empty(h.size, bool), np.empty(h.size, np.int64)
        hit[order], who[order] = np.repeat(several, size), np.repeat(np.maximum.reduceat(e["head"][order], starts), size)
        out, i = [], 0
        for (c, _, _), p in zip(rows, parts):
            k = np.flatnonzero(hit[i:i + p.size])
            if k.size:
                s = np.empty(k.size, _LEAD)
                s["hash"], s["leader"] = p["hash"][k], who[i + k]
                out.append((c, "open", s.tobytes()))
            i += p.size
        return out

    opened = C.exchange(by_chunk(ask_classes, C.REQUEST)(facts), answer_classes)
    if not opened.isEmpty():
        facts = facts.unionByName(opened)

        def open_places(chunk, got):
            h, row, label, _ = members(chunk, got)
            o = np.concatenate([np.frombuffer(b, _LEAD) for b in got.get("open", ())] or [np.zeros(0, _LEAD)])
            o = o[np.argsort(o["hash"])]
            at = _lookup(o["hash"], h)
            k = np.flatnonzero(at >= 0)
            return h[k], row[k], label[k], o["leader"][at[k]]

        def outsiders(chunk, got):
            """Who goes visiting where. Open buckets whose leaders are of one class (``head``) are visited as one: a group of
            near copies shares dozens. Rows outside some leader's class post themselves to the heads of all their open
            buckets, as one list a head; the chunk's sketches of them follow once. ``low`` says that this chunk has members under a head,
            worth a visit by nodes above it: all, if one of them goes nowhere itself, else those above its smallest."""
            h, row, label, head = open_places(chunk, got)
            _, sketch = _read_parts(got["bands"][0], bands, band_rows)
            out = np.isin(row, row[label != head])
            posts = np.unique(np.column_stack([head[out], row[out]]), axis=0).reshape(-1, 2)
            rows, held = np.unique(row[out]), np.unique(head)
            low = np.full(held.size, np.iinfo(np.int64).max)
            np.minimum.at(low, np.searchsorted(held, head), np.where(out, _node(chunk, row), -1))
            mine = dict(zip(row.tolist(), label.tolist()))
            goes, first = np.unique(posts[:, 0], return_index=True)
            lists = [_node(chunk, part) for part in np.split(posts[:, 1], first[1:])] if goes.size else []
            n, k, one = goes.size, held.size, int(rows.size > 0)
            return pa.table({
                "head": pa.array([*goes.tolist(), *held.tolist()] + [None] * one, pa.int64()),
                "chunk": pa.array([chunk] * (n + k + one), pa.int64()),
                "low": pa.array([None] * n + low.tolist() + [None] * one, pa.int64()),
                "most": pa.array([int(x[-1]) for x in lists] + [None] * (k + one), pa.int64()),
                "nodes": pa.array([x.astype(np.int64).tobytes() for x in lists] + [None] * (k + one), pa.binary()),
                "sketch": pa.array([None] * (n + k) + [_visitors(_node(chunk, rows), np.array([mine[r] for r in rows.tolist()], np.int64),
                                                                 sketch[rows])] * one, pa.binary())})

        places = by_chunk(outsiders, "head long, chunk long, low long, most long, nodes binary, sketch binary")(facts).checkpoint(True)
        # a chunk's visitors under one head travel together: rows are pairs of chunks, not of rows and chunks
        posts = places.where("nodes is not null").select("head", F.col("chunk").alias("src"), "most", "nodes")
        held = places.where("low is not null").select("head", "chunk", "low")
        visits = (posts.join(held, "head").where("low < most").groupBy("src", "chunk")
                  .agg(F.collect_list(F.struct("low", "nodes")).alias("under")))
        carried = places.where("sketch is not null").select(F.col("chunk").alias("src"), "sketch")

        def those_who_go(batches):
            for batch in batches:
                for chunk, under, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "under", "sketch"))):
                    go = np.unique(np.concatenate([(x := np.frombuffer(u["nodes"], np.int64))[x > u["low"]] for u in under]))
                    node, own, sk = _read_visitors(blob, m)
                    k = np.isin(node, go)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array(["sketch"]), pa.array(
                        [_visitors(node[k], own[k], sk[k])], pa.binary())], schema=C.REPLY_ARROW)

        sketches = visits.join(carried, "src").select("chunk", "under", "sketch").mapInArrow(those_who_go, C.REPLY)

        def sketch_pairs(chunk, got):
            """Own rows of open buckets that agree with a visiting sketch of another class in enough components."""
            _, row, label, head = open_places(chunk, got)
            visits = row[label != head]
            row, first = np.unique(row, return_index=True)
            visits = np.isin(row, visits)       # rows that go visiting themselves: of two such, the larger node does
            label, (_, sketch) = label[first], _read_parts(got["bands"][0], bands, band_rows)
            mine, node = sketch[row], _node(chunk, row)
            out_r, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in got.get("sketch", ()):
                for y, other, sk in zip(*_read_visitors(b, m)):
                    same = (mine == sk).sum(axis=1)
                    k = np.flatnonzero((same >= agree) & (label != other) & (node != y) & ~(visits & (node > y)))
                    out_r.append(row[k])
                    out_n.append(np.full(k.size, y))
            return _pair_table(chunk, np.concatenate(out_r), np.concatenate(out_n))

        more = verified(by_chunk(sketch_pairs, C.REPLY)(facts.unionByName(sketches)).checkpoint(True))
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))

    def rows_of(batches):
        for batch in batches:
            for chunk, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_node(chunk, np.arange(ids.size, dtype=np.int64)), pa.int64()),
                                                  C.id_array(ids)], ["node", "doc_id"])

    rows = packed.select("chunk", "ids").mapInArrow(rows_of, "node long, doc_id long")
    mine = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    linked = rows.join(labels, "node")
    best = linked.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("best"), F.count(F.lit(1)).alias("size"))
    return mine.join(best, "label", "left").select(
        "node", "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("best.node") == F.col("node"), F.lit(True)).alias("kept"))
