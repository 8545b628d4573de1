"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text is escaped (spaces become U+2581, one is put in front) and cut into words where no piece can reach across;
distinct words of equal length advance together, one character a step. At each step the hashes of all substrings that
end there probe the sorted piece keys, and a vectorised maximum over the candidates stores score and backpointer.

* A unigram model is the plain case: the best sum of scores (an unknown character scores 10 below the lowest).
* A byte-pair model (the public ``piece_bpe_32k.model``) does not maximise a sum, but is a Viterbi search all the same:
  what it makes of a prefix is a prefix of what it makes of the whole, so each position has one last piece, and a
  candidate is admissible only if merging leaves it beside the last piece of the prefix before it (``_Merger.stays``,
  itself batched and remembered per pair). Results equal the library's merges; adding up scores would not.

Characters outside the vocabulary become bytes (byte fallback) or the unknown id. Null texts count as empty and have
no ids. Decoding joins pieces and bytes and removes the space put in front; U+2581 in a text comes back as a space,
as in the library. Models that normalise texts, or strip spaces, are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.buffers import blocks, code_span_hashes, mix, span_sums, spread_ranges, text_column

_U = np.uint64
SPACE = 0x2581
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
WORDS_KEPT = 1 << 21     # distinct words a worker remembers before it starts afresh


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, b[i:i + n]
            i += n


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        scores, types = [], []
        self.kind, fallback, norm = _UNIGRAM, 0, {}
        for field, value in _fields(data):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                types.append(d.get(3, _NORMAL))
            elif field == 2:
                d = dict(_fields(value))
                self.kind, fallback = d.get(3, _UNIGRAM), d.get(35, 0)
            elif field == 3:
                norm = dict(_fields(value))
        if self.kind not in (_UNIGRAM, _BPE) or norm.get(2) or norm.get(4, 1) or _USER in types:
            raise ValueError("only unigram and byte-pair models with identity normalisation are supported")
        self.prefix = bool(norm.get(3, 1))
        self.scores, self.types = np.array(scores, np.float64), np.array(types)
        self.unknown = int(np.flatnonzero(self.types == _UNKNOWN)[0])
        self.byte_ids = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.types == _BYTE):
            self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        if not fallback:
            self.byte_ids[:] = -1


def _char_codes(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(_U) + _U(0x51ED270B7A3F4E65))


class Encoder:
    """Word encoder of one vocabulary (one per Python worker)."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        normal = np.flatnonzero(vocab.types == _NORMAL)
        self.text = [[ord(c) for c in vocab.pieces[i]] for i in normal]
        self.longest = max(map(len, self.text))
        # symbols: pieces first (by place in `normal`), then single characters
        self.piece_id = normal.astype(np.int32)
        self.score = vocab.scores[normal]
        flat = np.array([c for t in self.text for c in t], np.int64)
        ends = np.cumsum([len(t) for t in self.text])
        self.length = np.array([len(t) for t in self.text])
        keys = code_span_hashes(_char_codes(flat), ends - self.length, ends)
        order = np.argsort(keys)
        self.keys, self.key_sym = keys[order], order
        self.maybe = np.zeros(1 << 20, bool)       # leading 20 bits of the keys: most probes end here
        self.maybe[(keys >> _U(44)).astype(np.int64)] = True
        self.lengths = np.unique(self.length)
        self.n_pieces = len(self.text)
        chars = np.unique(flat)
        single = {t[0]: k for k, t in enumerate(self.text) if len(t) == 1}
        self.chars = chars
        self.char_sym = np.array([single.get(int(c), self.n_pieces + k) for k, c in enumerate(chars)])
        self.other = self.n_pieces + chars.size
        # words end where no piece reaches across a pair of neighbouring characters
        pairs = [(a << 21) | b for t in self.text for a, b in zip(t, t[1:])]
        self.inner = np.unique(np.array(pairs, np.int64)) if pairs else np.zeros(0, np.int64)
        self.merger = _Merger(self) if vocab.kind == _BPE else None
        if self.merger is None:
            self.unknown_score = float(self.score.min()) - 10.0
        # ids of each symbol
        width = {k: [int(self.piece_id[k])] for k in range(self.n_pieces)}
        for k, c in enumerate(chars):
            if int(c) not in single:
                width[self.n_pieces + k] = self._spelt(int(c))
        self.extra_ids = width
        self.words = _Words()

    def _spelt(self, c: int) -> list[int]:
        ids = [int(self.v.byte_ids[b]) for b in chr(c).encode("utf-8", "surrogatepass")]
        return ids if min(ids) >= 0 else [self.v.unknown]

    def symbols(self, cp: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chars, cp), self.chars.size - 1)
        return np.where(self.chars[at] == cp, self.char_sym[at], self.other)

    def cut_long(self, cp, starts, ends, limit: int = 32):
        """Cut words beyond ``limit`` wherever no piece holds the two neighbouring characters together."""
        big = np.flatnonzero(ends - starts > limit)
        if big.size == 0:
            return starts, ends
        at = spread_ranges(starts[big] + 1, ends[big] - starts[big] - 1)
        pair = (cp[at - 1].astype(np.int64) << 21) | cp[at]
        k = np.minimum(np.searchsorted(self.inner, pair), self.inner.size - 1)
        free = at[self.inner[k] != pair] if self.inner.size else at
        return np.sort(np.concatenate([starts, free])), np.sort(np.concatenate([ends, free]))

    def viterbi(self, cp: np.ndarray) -> np.ndarray:
        """Symbols of n words of equal length, an (n, length) array of characters: one row each, right-aligned, -1 before."""
        n, L = cp.shape
        codes = _char_codes(cp)
        sym1 = self.symbols(cp)
        flat = codes.ravel()
        best = np.full((L + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((L + 1, n), np.int64)
        last = np.full((L + 1, n), -1, np.int64)
        base = np.arange(n) * L
        total, down = span_sums(flat)
        for i in range(1, L + 1):
            # a single character is always a candidate
            cand = [(1, np.arange(n), sym1[:, i - 1])]
            for w in self.lengths[(self.lengths > 1) & (self.lengths <= i)]:
                a, b = base + i - w, base + i
                h = mix((total[b] - total[a]) * down[a] ^ _U(w))
                k = np.flatnonzero(self.maybe[(h >> _U(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, h[k]), self.keys.size - 1)
                hit = self.keys[at] == h[k]
                if hit.any():
                    k, s = k[hit], self.key_sym[at[hit]]
                    ok = self.length[s] == w
                    cand.append((int(w), k[ok], s[ok]))
            w = np.concatenate([np.full(k.size, x) for x, k, _ in cand])
            k = np.concatenate([x for _, x, _ in cand])
            s = np.concatenate([x for _, _, x in cand])
            if self.merger is None:
                gain = np.where(s < self.n_pieces, self.score[np.minimum(s, self.n_pieces - 1)], self.unknown_score)
                value = best[i - w, k] + gain
            else:
                ok = self.merger.whole(s)
                ok[ok] = self.merger.stays(last[i - w[ok], k[ok]], s[ok])
                value = np.where(ok, 0.0, -np.inf)
            top = np.full(n, -np.inf)
            np.maximum.at(top, k, value)
            win = np.flatnonzero((value == top[k]) & np.isfinite(value))
            # on equal values the longest candidate: the later write wins
            best[i, k[win]], back[i, k[win]], last[i, k[win]] = value[win], w[win], s[win]
        if not np.isfinite(best[L]).all():
            raise RuntimeError("a word has no admissible segmentation")
        steps, at, live = np.full((n, L), -1, np.int64), np.full(n, L), np.arange(n)
        for k in range(L - 1, -1, -1):      # written from the right end
            steps[live, k] = last[at[live], live]
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
            if not live.size:
                break
        return steps

    def word_ids(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ends) of the given words of a character buffer."""
        size = ends - starts
        parts, where, counts = [], [], np.zeros(starts.size, np.int64)
        for L in np.unique(size):
            g = np.flatnonzero(size == L)
            for part in np.array_split(g, max(1, g.size * int(L) // (1 << 19))):
                chars = cp[starts[part][:, None] + np.arange(L)[None, :]]
                syms = self.viterbi(chars)
                plain = (syms < self.n_pieces).all(axis=1)
                used = syms[plain] >= 0
                counts[part[plain]] = used.sum(axis=1)
                parts.append(self.piece_id[syms[plain][used]])
                where.append(part[plain])
                for x, row, one in zip(part[~plain], chars[~plain], syms[~plain]):   # characters outside the vocabulary
                    ids, p = [], 0
                    for s in one[one >= 0]:
                        if s < self.n_pieces:
                            ids.append(int(self.piece_id[s]))
                            p += int(self.length[s])
                        else:
                            ids.extend(self.extra_ids.get(int(s)) or self._spelt(int(row[p])))
                            p += 1
                    counts[x] = len(ids)
                    parts.append(np.array(ids, np.int32))
                    where.append(np.array([x]))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        where = np.concatenate(where)
        flat, ends_ = np.concatenate(parts), np.cumsum(counts[where])
        order = np.argsort(where)
        return flat[spread_ranges((ends_ - counts[where])[order], counts[where][order])], np.cumsum(counts)

    def _split(self, buf: np.ndarray, offs: np.ndarray):
        """(characters, word starts, word ends, word hashes, words per text) of UTF-8 texts."""
        n = offs.size - 1
        raw = buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(raw, np.uint32)
        at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
        if at[-1] != cp.size:     # not valid UTF-8: text by text
            parts = [np.frombuffer(buf[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                     for a, b in zip(offs[:-1], offs[1:])]
            at = np.concatenate([[0], np.cumsum([p.size for p in parts])])
            cp = np.concatenate(parts) if parts else cp
        cp = np.where(cp == 0x20, np.uint32(SPACE), cp)
        if self.v.prefix:
            full = np.flatnonzero(np.diff(at) > 0)
            cp = np.insert(cp, at[full], SPACE)
            extra = np.zeros(n + 1, np.int64)
            extra[full + 1] = 1
            at = at + np.cumsum(extra)
        edge = np.zeros(cp.size + 1, bool)
        if self.splits_at_space() and cp.size:
            space = cp == SPACE
            edge[1:-1] = space[1:] & ~space[:-1]
        edge[at] = True
        cuts = np.flatnonzero(edge)
        if cp.size == 0:
            cuts = cuts[:0]
        starts, ends = self.cut_long(cp, cuts[:-1], cuts[1:])
        h = code_span_hashes(_char_codes(cp), starts, ends)
        return cp, starts, ends, h, np.diff(np.searchsorted(starts, at))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets per text) of UTF-8 texts: new words of all texts are encoded together."""
        hashes, per_text, new_h, new_cp, new_len = [], [], [], [], []
        if self.words.size > WORDS_KEPT:
            self.words = _Words()
        for a, b in blocks(offs, 1 << 18):
            cp, starts, ends, h, words = self._split(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
            uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
            new = self.words.missing(uniq)
            f = first[new]
            new_h.append(uniq[new])
            new_len.append(ends[f] - starts[f])
            new_cp.append(cp[spread_ranges(starts[f], ends[f] - starts[f])])
            hashes.append((uniq, inv.astype(np.int32)))
            per_text.append(words)
        if not hashes:
            return np.zeros(0, np.int32), np.zeros(offs.size, np.int64)
        h, lens = np.concatenate(new_h), np.concatenate(new_len)
        uniq, first = np.unique(h, return_index=True)
        if uniq.size:
            ends = np.cumsum(lens)
            self.words.add(uniq, *self.word_ids(np.concatenate(new_cp), (ends - lens)[first], ends[first]))
        ids, sizes = [], []
        for uniq, inv in hashes:
            s, c = self.words.spans(uniq)
            c = c[inv]
            ids.append(self.words.ids[spread_ranges(s[inv], c)])
            sizes.append(c)
        tokens = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), tokens[np.concatenate([[0], np.cumsum(np.concatenate(per_text))])]

    def splits_at_space(self) -> bool:
        if not hasattr(self, "_splits"):
            self._splits = not any(SPACE in t and t[:t.count(SPACE)] != [SPACE] * t.count(SPACE) for t in self.text)
        return self._splits


class _Words:
    """Ids of the words seen so far, by hash."""

    def __init__(self):
        self.hash, self.start, self.count = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    @property
    def size(self) -> int:
        return self.hash.size

    def missing(self, uniq):
        if not self.size:
            return np.arange(uniq.size)
        at = np.minimum(np.searchsorted(self.hash, uniq), self.size - 1)
        return np.flatnonzero(self.hash[at] != uniq)

    def add(self, h, ids, ends):
        counts = np.diff(np.concatenate([[0], ends]))
        hash_ = np.concatenate([self.hash, h])
        start = np.concatenate([self.start, self.ids.size + ends - counts])
        order = np.argsort(hash_)
        self.hash, self.start = hash_[order], start[order]
        self.count = np.concatenate([self.count, counts])[order]
        self.ids = np.concatenate([self.ids, ids])

    def spans(self, uniq):
        at = np.searchsorted(self.hash, uniq)
        return self.start[at], self.count[at]


class _Merger:
    """Byte-pair merging of many equal-length symbol rows at once, to judge which pieces stay side by side."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        index = {tuple(t): k for k, t in enumerate(enc.text)}
        char = {int(c): int(s) for c, s in zip(enc.chars, enc.char_sym)}
        sym = {t: k for t, k in index.items()} | {(c,): s for c, s in char.items()}
        self.n = enc.other + 1
        rows = []
        for t, k in index.items():
            for i in range(1, len(t)):
                a, b = sym.get(t[:i]), sym.get(t[i:])
                if a is not None and b is not None:
                    rows.append((a * self.n + b, k))
        rows.sort()
        self.pair = np.array([r[0] for r in rows], np.int64)
        self.into = np.array([r[1] for r in rows], np.int64)
        self.spell = [np.array([char[c] for c in t], np.int64) for t in enc.text]
        # pieces that merging ever makes out of their own characters
        self._whole = np.zeros(enc.n_pieces, bool)
        self.left, self.right = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)    # of the last merge
        for L in enc.lengths:
            g = np.flatnonzero(enc.length == L)
            rows = np.stack([self.spell[k] for k in g])
            self._whole[g] = [r == [k] for k, r in zip(g, self.merge(rows))]
            if L > 1:
                whole = np.flatnonzero(self._whole[g])
                self.left[g[whole]], self.right[g[whole]] = self.last[whole].T
        # priority of each symbol's last merge; single characters come before all
        rank = np.unique(-enc.score, return_inverse=True)[1]
        self.rank = np.full(self.n, -1, np.int64)
        self.rank[:enc.n_pieces] = np.where(enc.length > 1, rank, -1)
        self.ordered = np.ones(self.n, bool)    # every merge comes after those of its parts
        for L in enc.lengths[enc.lengths > 1]:
            g = np.flatnonzero(enc.length == L)
            g = g[self.left[g] >= 0]
            a, b = self.left[g], self.right[g]
            self.ordered[g] = self.ordered[a] & self.ordered[b] & (np.maximum(self.rank[a], self.rank[b]) < self.rank[g])
        self.seen_key, self.seen_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def merge(self, rows: np.ndarray) -> list[list[int]]:
        """Final symbols of each row: again and again the best-scored neighbouring pair, leftmost first."""
        rows = rows.copy()
        n, width = rows.shape
        size = np.full(n, width)
        live = np.arange(n)
        score = self.enc.score
        self.last = np.full((n, 2), -1, np.int64)       # the symbols of each row's last merge
        while live.size and rows.shape[1] > 1:
            left, right = rows[live, :-1], rows[live, 1:]
            key = np.where(right >= 0, left * self.n + right, -1)
            at = np.minimum(np.searchsorted(self.pair, key), self.pair.size - 1)
            value = np.where(self.pair[at] == key, score[self.into[at]], -np.inf)
            j = value.argmax(axis=1)
            go = np.isfinite(value[np.arange(live.size), j])
            live, j, into = live[go], j[go], self.into[at[np.arange(go.size), np.minimum(j, at.shape[1] - 1)]][go]
            if not live.size:
                break
            moved = rows[live]
            self.last[live] = np.column_stack([moved[np.arange(live.size), j], moved[np.arange(live.size), j + 1]])
            col = np.arange(rows.shape[1])[None, :]
            shifted = np.concatenate([moved[:, 1:], np.full((live.size, 1), -1)], axis=1)
            moved = np.where(col > j[:, None], shifted, moved)
            moved[np.arange(live.size), j] = into
            rows[live] = moved
            size[live] -= 1
        return [list(map(int, r[:s])) for r, s in zip(rows, size)]

    def whole(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < self.enc.n_pieces, self._whole[np.minimum(s, self.enc.n_pieces - 1)], True)

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b ends with just a beside b (a = -1: nothing before)."""
        ok = np.ones(a.size, bool)
        ask = np.flatnonzero((a >= 0) & (a != self.enc.other) & (b != self.enc.other))
        if ask.size == 0:
            return ok
        key = a[ask] * self.n + b[ask]
        slot = (mix(key.astype(_U)) >> _U(44)).astype(np.int64)
        unknown = self.seen_key[slot] != key
        if unknown.any():
            new, inv = np.unique(key[unknown], return_inverse=True)
            good = self._judge(new)
            at = (mix(new.astype(_U)) >> _U(44)).astype(np.int64)
            self.seen_key[at], self.seen_ok[at] = new, good    # one pair per slot: the last one stays
            out = self.seen_ok[slot]
            out[unknown] = good[inv]
            # a known pair may have lost its slot just now, but not its answer
            kept = ~unknown
            out[kept] = np.where(self.seen_key[slot[kept]] == key[kept], out[kept], self._judge_again(key[kept], slot[kept]))
            ok[ask] = out
        else:
            ok[ask] = self.seen_ok[slot]
        return ok

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs of pieces stay apart. If every merge comes after those of its parts, undoing the two pieces'
        merges from the last on shows whether a merge across the border would have come first (on equal scores
        the one further left does); otherwise the pair's characters are merged."""
        x, y = keys // self.n, keys % self.n
        good, plain = np.ones(keys.size, bool), self.ordered[x] & self.ordered[y]
        odd = np.flatnonzero(~plain)
        spelt = [np.concatenate([self._chars(int(x[k])), self._chars(int(y[k]))]) for k in odd]
        lens = np.array([t.size for t in spelt])
        for L in np.unique(lens):
            g = np.flatnonzero(lens == L)
            good[odd[g]] = [r == [int(x[k]), int(y[k])] for k, r in zip(odd[g], self.merge(np.stack([spelt[i] for i in g])))]
        live, limit = np.flatnonzero(plain), np.full(keys.size, np.iinfo(np.int64).max)
        while live.size:
            key = x[live] * self.n + y[live]
            at = np.minimum(np.searchsorted(self.pair, key), self.pair.size - 1)
            crossed = (self.pair[at] == key) & (self.rank[self.into[at]] < limit[live])
            good[live[crossed]] = False
            live = live[~crossed]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            more = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[more], rx[more], ry[more]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            x[live[first]] = self.right[x[live[first]]]
            y[live[~first]] = self.left[y[live[~first]]]
        return good

    def _judge_again(self, keys, slot) -> np.ndarray:
        lost = self.seen_key[slot] != keys
        out = np.zeros(keys.size, bool)
        if lost.any():
            uniq, inv = np.unique(keys[lost], return_inverse=True)
            out[lost] = self._judge(uniq)[inv]
        return out

    def _chars(self, s: int) -> np.ndarray:
        return self.spell[s] if s < self.enc.n_pieces else np.array([s], np.int64)


class Decoder:
    def __init__(self, vocab: Vocabulary):
        byte = {int(i): b for b, i in enumerate(vocab.byte_ids) if i >= 0}
        texts = []
        for i, (p, t) in enumerate(zip(vocab.pieces, vocab.types)):
            if i in byte:
                texts.append(bytes([byte[i]]))
            elif t == _NORMAL:
                texts.append(p.replace(chr(SPACE), " ").encode())
            else:
                texts.append(" ⁇ ".encode() if t == _UNKNOWN else b"")
        self.length = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.prefix = vocab.prefix

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        lens = self.length[ids]
        buf = self.bytes[spread_ranges(self.start[ids], lens)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[offs]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            out.append(buf[a + 1:b] if self.prefix and buf[a:a + 1] == b" " else buf[a:b])
        return out


_ENCODERS: dict[int, Encoder] = {}
_DECODERS: dict[int, Decoder] = {}


def _per_worker(cache: dict, make, vocab: Vocabulary):
    key = hash((tuple(vocab.pieces[:1000]), len(vocab.pieces), float(vocab.scores.sum()), vocab.kind))
    if key not in cache:
        cache.clear()
        cache[key] = make(vocab)
    return cache[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, ids): the piece ids of each text. The vocabulary (of fixed size) travels with the function."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _per_worker(_ENCODERS, Encoder, shared.value)
        for batch in batches:
            buf, offs = text_column(batch.column(1))
            for a, b in blocks(offs, 1 << 22):
                ids, cut = enc.encode(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "ids"])

    return rows.mapInArrow(run, f"id {key}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, text) of piece ids; bytes that are no valid UTF-8 become U+FFFD, null ids an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    key = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _per_worker(_DECODERS, Decoder, shared.value)
        for batch in batches:
            col = batch.column(1)
            ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
            texts = [t.decode("utf-8", "replace") for t in dec.decode(ids, offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {key}, text string").withColumnRenamed("id", id_col)


def encode_checked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, n_tokens, ids, round_trip): ids of each text, and whether decoding them gives the text back (a null text:
    an empty one; U+2581 in it: a space)."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(model))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _per_worker(_ENCODERS, Encoder, shared.value), _per_worker(_DECODERS, Decoder, shared.value)
        mark = chr(SPACE).encode()
        for batch in batches:
            buf, offs = text_column(batch.column(1))
            for a, b in blocks(offs, 1 << 22):
                raw, o = buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                ids, cut = enc.encode(raw, o)
                whole = raw.tobytes()
                same = [whole[x:y].replace(mark, b" ") == t for x, y, t in zip(o[:-1], o[1:], dec.decode(ids, cut))]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(cut), pa.int64()), lists, pa.array(same, pa.bool_())],
                    ["id", "n_tokens", "ids", "round_trip"])

    return rows.mapInArrow(run, f"id {key}, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)
