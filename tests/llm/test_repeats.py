"""Substring operators (relative LZ, suffix radix sort) against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from sitelens.llm.buffers import byte_codes
from sitelens.llm.relative_lz import relative_lz_dedup, word_codes
from sitelens.llm.repeats import ask_grams, ask_spread, contexts, find_anchors
from sitelens.llm.suffix_radix import repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(token_lists, T):
    """token_lists: [(id, tokens)] in order; flags of tokens covered by a window that starts earlier."""
    first = {}
    order = sorted(range(len(token_lists)), key=lambda i: (token_lists[i][0] is not None, token_lists[i][0] or 0, i))
    flags = {}
    for i in order:
        toks = token_lists[i][1]
        f = [False] * len(toks)
        for p in range(len(toks) - T + 1):
            w = tuple(toks[p:p + T])
            if w in first:
                f[p:p + T] = [True] * T
            else:
                first[w] = (i, p)
        flags[i] = f
    return flags


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(12)] + ["é%d" % i for i in range(4)]
    passage = [rnd.choice(vocab) + str(rnd.randrange(99)) for _ in range(60)]
    docs = []
    for i in range(60):
        n = rnd.choice([0, 1, 3, 10, 40, 90])
        words = [rnd.choice(vocab) + str(rnd.randrange(9)) for _ in range(n)]
        if rnd.random() < 0.6:
            a = rnd.randrange(30)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage[a:a + rnd.randrange(5, 60)]
        if rnd.random() < 0.2:
            words = words + ["x"] * rnd.randrange(60)
        if rnd.random() < 0.3 and docs:
            words = WORD.findall(rnd.choice(docs)[1] or "") + words[:3]
        sep = rnd.choice([" ", "\n", " \t "])
        docs.append((i, sep.join(words)))
    docs += [(3, docs[3][1]), (900, None), (901, ""), (902, " \n"), (None, docs[7][1]), (903, "y " * 400)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("T,g,seed", [(20, 8, 0), (5, 3, 1), (6, 6, 2), (2, 1, 3)])
def test_relative_lz_equals_brute_force(spark, T, g, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, length string").coalesce(1)
    got = relative_lz_dedup(df, length=T, gram=g).collect()
    toks = [(i, WORD.findall(t or "")) for i, t in docs]
    flags = brute(toks, T)
    want = sorted((str(i), len(w), sum(flags[k]), " ".join(x for x, f in zip(w, flags[k]) if not f))
                  for k, (i, w) in enumerate(toks))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    text = {i: w for i, w in toks if i is not None}
    for r in got:   # every factor is a copy of what it names
        for f in r.factors:
            if r.doc_id is not None and f.source_id is not None:
                assert text[r.doc_id][f.start:f.start + f.length] == text[f.source_id][f.source_start:f.source_start + f.length]


@pytest.mark.parametrize("T,g,seed", [(100, 36, 0), (12, 5, 1), (8, 8, 2)])
def test_suffix_radix_equals_brute_force(spark, T, g, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(3)
    rows = [(i, t) for i, t in docs]
    got = repeated_spans(df, length=T, gram=g).collect()
    toks = [(i, (t or "").encode()) for i, t in rows]
    flags = brute(toks, T)
    want = []
    for k, (i, b) in enumerate(toks):
        f = flags[k]
        spans = sum(1 for p in range(len(f)) if f[p] and (p == 0 or not f[p - 1]))
        want.append((str(i), len(b), sum(f), spans, hashlib.sha256(bytes(x for x, y in zip(b, f) if not y)).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in got) == sorted(want)


@pytest.mark.parametrize("tokenise,T,g", [(lambda buf, offs: (byte_codes(buf), offs), 100, 36), (word_codes, 20, 8)])
def test_owners_get_equal_shares_of_anchors(tokenise, T, g):
    """An anchor's gram has the smallest hash of its windows; its owner is still any of them."""
    rnd = random.Random(4)
    buf = np.frombuffer(" ".join("%x" % rnd.getrandbits(rnd.randrange(4, 40)) for _ in range(100_000)).encode(), np.uint8)
    codes, first = tokenise(buf, np.array([0, buf.size // 3, buf.size]))
    an = find_anchors(codes, first, T, g)
    assert an.gram.size > 10_000
    owners = 51
    for asked in (ask_grams(0, an.gram, owners), ask_spread(0, an.gram, contexts(codes, first, an, T, g), owners)):
        sizes = [len(blob) for _, _, _, blob in asked]
        assert len(sizes) == owners and max(sizes) < 2 * sum(sizes) / owners


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert relative_lz_dedup(df).count() == 0
    assert repeated_spans(df).count() == 0
