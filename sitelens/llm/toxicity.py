"""Toxicity by compression distance with two zstandard dictionaries.

Each class's dictionary is trained on that class's own texts: 5-byte strings that more of its texts hold (or hold repeatedly)
than the other class's do, by the log-likelihood ratio of the two shares and a multiple
of the other's share, are extended to the longest strings that nearly all of
their places agree on, until none is left that is telling beyond those taken (``telling``). So stems count as well as whole
words, and each language's strings are judged by their own evidence. Behind them both dictionaries hold the words that cover
most of the ordinary texts: a window without telling strings comes out alike under both, whatever its language.

A text, in lower case, is cut at spaces into windows of at most ``WINDOW`` bytes; each is compressed with either dictionary, and the
difference of the two lengths says how much of it only the toxic dictionary knows. The largest differences, their mean, and the
numbers and shares of windows beyond four differences go through a logistic calibration, whose intercept is that of the
labels' own class ratio; shares tell in long texts, numbers in short ones. Everything is fitted on a bounded sample of labelled
rows: at most ``max_rows`` per class, texts of at most ``max_bytes`` (parameters). Of near copies one counts. The calibration is fitted crosswise, each half of
the sample under dictionaries of the other half; the final dictionaries come from all of it. All windows of every whole text are
scored. Ids are used only to choose rows to learn from.

Null and empty texts have one empty window. Without two different texts of both classes nothing can be learnt: every score is 0, and
``drop_toxic`` keeps every row. Repeated rows are scored alike; other columns are ignored by the scores and kept by
``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.buffers import text_column

WINDOW, LEVEL = 48, 6
MAX_ROWS, MAX_BYTES = 2000, 8192
ORDINARY_WORDS = 1000
GRAM, LONGEST, MOST = 5, 24, 200
HEADS = 1 << 16         # values of a string's first two bytes
PART = 1 << 18          # places sorted at once while telling strings are looked for; more if more of them start with the same two bytes
EVIDENCE = 24.0         # twice the log-likelihood ratio: about one chance in a million for each string
TIMES = 6.0             # and so many times the other class's share: evidence alone grows with the sample, also for a mere
#                         difference in languages or topics between the classes
AGREE = 0.9             # share of its places that an extended string has to keep
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = bytes.maketrans(b"\x00\t\n\x0b\x0c\r", b"      ")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray     # bias first
    centre: np.ndarray
    scale: np.ndarray


def plain(text: bytes) -> bytes:
    """Lower case, every white space a space."""
    return text.decode("utf-8", "replace").lower().encode().translate(_SPACES)


def without_copies(texts: list[bytes]) -> list[bytes]:
    """The texts less those of which half the five-word runs or more stand in earlier ones: copies are no evidence of their own."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        runs = {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
        if 2 * len(runs & seen) < len(runs):
            out.append(t)
            seen |= runs
    return out


class _Joined:
    """Texts in one array, and the first two bytes of the string of ``GRAM`` bytes that starts at each place (0: none does)."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\0".join(texts) + b"\0" * GRAM, np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        n = len(self.bytes) - GRAM + 1
        self.head = (self.bytes[:n].astype(np.uint16) << 8) | self.bytes[1:n + 1]
        for i in range(GRAM):
            self.head[self.bytes[i:n + i] == 0] = 0

    def heads(self) -> np.ndarray:
        """How many strings start with each two bytes."""
        out = np.zeros(HEADS, np.int64)
        for i in range(0, len(self.head), PART):
            out += np.bincount(self.head[i:i + PART], minlength=HEADS)
        out[0] = 0
        return out


class _Places:
    """Where every string of ``GRAM`` bytes stands in some texts, and how many texts hold it once, or more than once.
    ``low``, ``high``: only strings with these first two bytes, as the places of all take many times the memory of the texts."""

    def __init__(self, texts: list[bytes] | _Joined, low: int = 1, high: int = HEADS - 1):
        of = texts if isinstance(texts, _Joined) else _Joined(texts)
        at = np.flatnonzero((of.head >= low) & (of.head <= high))
        codes = np.zeros(len(at), np.uint64)
        for i in range(GRAM):
            codes = (codes << np.uint64(8)) | of.bytes[at + i]
        order = np.argsort(codes, kind="stable")
        self.at = at[order]
        sorted_codes = codes[order]
        self.codes, first = np.unique(sorted_codes, return_index=True)
        self.size = np.diff(np.append(first, len(self.at)))
        text = np.searchsorted(of.ends, self.at, "right")
        new = np.append(True, (sorted_codes[1:] != sorted_codes[:-1]) | (text[1:] != text[:-1]))[:len(self.at)]
        runs = np.flatnonzero(new)
        again = np.diff(np.append(runs, len(self.at))) > 1
        which = np.searchsorted(self.codes, sorted_codes[runs])
        self.once = np.bincount(which, minlength=len(self.codes))
        self.twice = np.bincount(which[again], minlength=len(self.codes))

    def counts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts with the string, texts with it more than once) of other codes."""
        if not len(self.codes):
            return np.zeros(len(codes), int), np.zeros(len(codes), int)
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        here = self.codes[i] == codes
        return np.where(here, self.once[i], 0), np.where(here, self.twice[i], 0)


def evidence(a, n: int, b, m: int) -> np.ndarray:
    """Likelihood ratio statistic of a of n texts against b of m; 0 unless the first share is ``TIMES`` the second."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p = (a + b) / (n + m)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)
    g = 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(b, m * p) + part(m - b, m * (1 - p)))
    return np.where(a * m >= TIMES * b * n, g, 0.0)


def telling(own: list[bytes], other: list[bytes], least: float = EVIDENCE) -> list[bytes]:
    """Strings that set the ``own`` texts apart from the ``other`` ones, the most telling first."""
    mine, theirs = _Joined(own), _Joined(other)
    n, m = len(own), len(other)
    part = np.cumsum(mine.heads() + theirs.heads()) // PART
    edges = np.flatnonzero(np.diff(part)) + 1
    found = []      # of the strings with enough evidence, by code: strength, places, counts in the other texts
    for low, high in zip([1, *edges], [*(edges - 1), len(part) - 1]):
        p = _Places(mine, low, high)
        once, twice = _Places(theirs, low, high).counts(p.codes)
        strength = np.maximum(evidence(p.once, n, once, m), evidence(p.twice, n, twice, m))
        k = strength >= least
        found.append((strength[k], p.size[k], p.at[np.repeat(k, p.size)], once[k], twice[k]))
    strength, size, places, once, twice = (np.concatenate(x) for x in zip(*found))
    last = np.cumsum(size)
    taken = np.zeros(len(mine.bytes) + LONGEST, bool)
    out: list[bytes] = []
    for i in np.argsort(-strength, kind="stable"):
        if len(out) == MOST:
            break
        at = places[last[i] - size[i]:last[i]]
        at = at[~(taken[at + 1] | taken[at + 2] | taken[at + 3])]       # what strings taken before do not explain
        per = np.bincount(np.searchsorted(mine.ends, at, "right"), minlength=1)
        if max(evidence((per > 0).sum(), n, once[i], m), evidence((per > 1).sum(), n, twice[i], m)) < least:
            continue
        start, end, kept = 0, GRAM, at
        for step in (1, -1):
            while end - start < LONGEST:
                where = kept + (end if step == 1 else start - 1)
                byte = np.bincount(mine.bytes[np.maximum(where, 0)] * (where >= 0), minlength=1)
                best = int(byte.argmax())
                if best == 0 or byte[best] < AGREE * len(kept):
                    break
                kept = kept[(where >= 0) & (mine.bytes[np.maximum(where, 0)] == best)]
                start, end = (start, end + 1) if step == 1 else (start - 1, end)
        out.append(mine.bytes[kept[0] + start:kept[0] + end].tobytes())
        for x, a, b in ((at, 0, GRAM), (kept, start, end)):
            taken[(x[:, None] + np.arange(a, b)).ravel()] = True
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the (toxic, ordinary) dictionaries, of ``plain`` texts; the most telling strings stand last in their part."""
    words = Counter()
    for t in ordinary:
        words.update(set(_WORD.findall(t)))
    common = sorted(words, key=lambda w: (-words[w] * len(w), w))[:ORDINARY_WORDS]
    base = b"".join(b" " + w for w in reversed(common)) + b" "
    return tuple(b"".join(reversed(telling(a, b))) + base for a, b in ((toxic, ordinary), (ordinary, toxic)))


def windows(text: bytes) -> Iterator[bytes]:
    """``text`` in order in pieces of at most ``WINDOW`` bytes, cut before a space where there is one."""
    i, n = 0, len(text)
    while n - i > WINDOW:
        j = text.rfind(b" ", i + 1, i + WINDOW + 1)
        j = i + WINDOW if j < 0 else j
        yield text[i:j]
        i = j
    yield text[i:]


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.press = []
        for content in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(content.rjust(16, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False,
                                                       write_checksum=False, write_dict_id=False).compress)

    def features(self, text: bytes) -> list[float]:
        toxic, ordinary = self.press
        a = np.sort(np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(plain(text))], float))[::-1]
        n = len(a)
        out = [a[0], a[:3].sum() / 3, a.mean()]
        for least in (1, 2, 3, 4):
            number = int(np.searchsorted(-a, -least, "right"))
            out += [np.log1p(number), np.sqrt(number / n), np.log1p(number) * np.sqrt(number / n)]
        return out


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, centre, scale) of a penalised logistic fit by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.full(w.size, 1.0)
        penalty[0] = 1e-6
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def fit(toxic: list[bytes], ordinary: list[bytes], offset: float = 0.0) -> Model | None:
    """Model of the texts of either class. ``offset`` is added to the intercept: the log of the ordinary class's share in the
    sample over the toxic one's."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    t, o = (without_copies([plain(x) for x in texts]) for texts in (toxic, ordinary))
    if len(t) < 2 or len(o) < 2:
        return None
    x, y = [], []
    for half in (0, 1):
        scorer = Scorer(*dictionaries(t[half::2], o[half::2]))
        for label, rest in ((1.0, t[1 - half::2]), (0.0, o[1 - half::2])):
            x += [scorer.features(text) for text in rest]
            y += [label] * len(rest)
    w, centre, scale = calibrate(np.array(x), np.array(y))
    w[0] += offset
    return Model(*dictionaries(t, o), w, centre, scale)


def score_texts(model: Model, scorer: Scorer, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = (np.array([scorer.features(t) for t in texts]) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))


def held_out(id_col: str | Column) -> Column:
    """Rows never learnt from: crc32 of the id's text divisible by 5."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """Model from at most ``max_rows`` labelled rows per class that are not held out (chosen by a hash of the id)."""
    lab = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i"))
           .agg(F.max(label_col).alias("y")).where(~held_out("i")))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")) \
        .where(F.octet_length("t") <= max_bytes)
    picks = [lab.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(max_rows) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1])     # at most 2 * max_rows ids: small enough to broadcast
    one = rows.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t"))   # repeated rows of one id count once
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(one.collect(), key=lambda r: (r.y, r.i)):   # bounded likewise
        texts[r.y].append(bytes(r.t))
    # the calibration holds for the classes as they are labelled, not as they were capped
    share = {r.y: min(1.0, max_rows / r["count"]) for r in lab.groupBy("y").count().collect()}
    return fit(texts[1], texts[0], float(np.log(share.get(0, 1.0) / share.get(1, 1.0))))


def toxicity_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    key = rows.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.ordinary) if model else None
        for b in batches:
            buf, offs = text_column(b.column(1))
            raw = buf.tobytes()
            s = score_texts(model, scorer, [raw[x:y] for x, y in zip(offs[:-1], offs[1:])]) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             ["i", "score", "predicted"])

    return rows.mapInArrow(run, f"i {key}, score double, predicted int").withColumnRenamed("i", id_col)


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.toxic, model.ordinary)
        for b in batches:
            buf, offs = text_column(b.column(at))
            raw = buf.tobytes()
            s = score_texts(model, scorer, [raw[x:y] for x, y in zip(offs[:-1], offs[1:])])
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
