"""BagMinHash near-dedup: signatures are unbiased, classes equal brute force."""

import random
import re
from collections import Counter

import numpy as np

from sitelens.llm.bagminhash import bag_signatures, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text or "")
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def classes(docs, threshold=0.8):
    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def test_signatures_estimate_the_weighted_jaccard_similarity():
    rnd = np.random.default_rng(0)
    items = rnd.integers(1, 1 << 62, 60).astype(np.uint64)
    c1, c2 = rnd.integers(0, 9, 60), rnd.integers(0, 9, 60)
    c1[0], c2[0] = 300, 170
    row = np.repeat([0, 1], 60)
    count = np.concatenate([c1, c2])
    keep = count > 0
    sig = bag_signatures(row[keep], np.concatenate([items, items])[keep], count[keep], 2, 4096)
    want = np.minimum(c1, c2).sum() / np.maximum(c1, c2).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def corpus(seed):
    rnd = random.Random(seed)

    def text(n):
        return [f"w{rnd.randrange(400)}" for _ in range(n)]

    docs = []
    for _ in range(12):
        base = text(rnd.choice([3, 8, 60, 150]))
        for _ in range(rnd.choice([1, 2, 6, 14])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
            docs.append(" ".join(w))
    chain = text(200)      # a chain: neighbours are similar, its ends are not
    for k in range(10):
        docs.append(" ".join(chain[k * 9:k * 9 + 110]))
    docs += ["", None, " \n", "", "one", "one", "one two", "a " * 300, "a " * 310, "a " * 600]
    rnd.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node int").repartition(3)
        got = near_duplicates(df).collect()
        want = {}
        for g in classes(docs):
            ids = sorted(docs[i][0] for i in g)
            want |= {i: (ids[0], len(ids), i == ids[0]) for i in ids}
        assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in got} == want


def test_members_unlike_the_leader_are_still_linked(spark):
    """Few, wide bands put everything into few buckets: links must not depend on who leads them."""
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_duplicates(df, bands=60, band_rows=1).collect()
    want = {}
    for g in classes(docs):
        ids = sorted(docs[i][0] for i in g)
        want |= {i: ids[0] for i in ids}
    assert {r.doc_id: r.class_id for r in got} == want


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (9, None)], "doc_id long, text string")
    got = sorted([tuple(r) for r in near_duplicates(df).collect()], key=str)
    assert [g[2] for g in got if g[0] != 9] == [3, 3, 3] and sum(g[3] for g in got) == 2
    assert near_duplicates(df.limit(0)).count() == 0
