"""Compression-distance toxicity: held-out accuracy on the test tables and edge cases."""

import os
import random
import tracemalloc
import zlib

import pytest

from sitelens.llm import toxicity as T
from sitelens.llm.toxicity import drop_toxic, held_out, toxicity_scores, train

SF = "/root/testdata/sf0.1"
BAD = ["stupid", "idiot", "worthless", "pathetic", "moron", "scum"]


def auc(pairs):
    pairs = sorted(pairs)
    pos = sum(y for _, y in pairs)
    rank, i = 0.0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        rank += sum(y for _, y in pairs[i:j]) * (i + j + 1) / 2
        i = j
    return (rank - pos * (pos + 1) / 2) / (pos * (len(pairs) - pos))


def made(n, seed):
    rnd = random.Random(seed)
    syl = ["an", "the", "er", "ing", "on", "re", "sta", "ble", "ou", "ti"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(syl) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(40, 300))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(2 + len(words) // 30):
                words[rnd.randrange(len(words))] = rnd.choice(BAD)
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_accuracy_on_made_texts(spark):
    rows = made(800, 0)
    df = spark.createDataFrame([(i, t, 5) for i, t, _ in rows], "doc_id long, text string, toxic int").repartition(3)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(df, train(df, lab)).collect()}
    test = [(got[i].score, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(test) > 0.97
    assert sum((s >= 0.5) == y for s, y in test) / len(test) > 0.93
    assert {r.doc_id for r in df.where(held_out("doc_id")).collect()} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}


def test_nulls_empty_long_and_repeated(spark):
    rows = made(200, 1)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None), (901, ""), (902, "the " * 60000), (902, "")],
                               "doc_id long, text string")
    got = toxicity_scores(df, train(df, lab)).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = [r.score for r in got if r.doc_id in (900, 901)]
    assert empty[0] == empty[1] < 0.5
    none = toxicity_scores(df, train(df, lab.where("toxic = 0"))).collect()
    assert {r.score for r in none} == {0.0}
    clash = df.selectExpr("*", "'x' AS i", "1 AS t", "2.0 AS score")
    kept = drop_toxic(clash, train(clash, lab))
    assert kept.columns == clash.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity_scores(df.limit(0), train(df.limit(0), lab)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_labels_of_the_test_tables(spark):
    """Every held-out row of ``labels.toxic``, whatever its language or words."""
    df, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity_scores(df, train(df, lab)).join(lab, "doc_id").where(held_out("doc_id") & lab.toxic.isNotNull()).collect()
    pairs = [(r.score, r.toxic) for r in scores]
    caught = sum(s >= 0.5 for s, y in pairs if y) / sum(y for _, y in pairs)
    flagged = sum(s >= 0.5 for s, y in pairs if not y) / sum(1 - y for _, y in pairs)
    print(f"{len(pairs)} rows, auc {auc(pairs):.3f}, caught {caught:.3f}, clean flagged {flagged:.4f}")
    assert auc(pairs) > 0.93 and caught > 0.8 and flagged < 0.01


def plain_telling(own, other):
    """``telling``'s first strings by counting in plain Python: grams by evidence, without extension."""
    import math

    def shares(texts):
        once, twice = {}, {}
        for t in texts:
            seen = {}
            for i in range(len(t) - T.GRAM + 1):
                seen[t[i:i + T.GRAM]] = seen.get(t[i:i + T.GRAM], 0) + 1
            for g, c in seen.items():
                once[g] = once.get(g, 0) + 1
                twice[g] = twice.get(g, 0) + (c > 1)
        return once, twice

    def g2(a, n, b, m):
        p = (a + b) / (n + m)
        g = 2 * sum(x * math.log(x / e) for x, e in ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p))) if x)
        return g if a * m >= T.TIMES * b * n else 0.0
    (o1, o2), (t1, t2) = shares(own), shares(other)
    return {g: max(g2(o1[g], len(own), t1.get(g, 0), len(other)), g2(o2[g], len(own), t2.get(g, 0), len(other))) for g in o1}


def test_telling_strings_equal_plain_counts():
    rows = made(240, 4)
    toxic = [T.plain(t.encode()) for _, t, y in rows if y]
    ordinary = [T.plain(t.encode()) for _, t, y in rows if not y]
    strength = plain_telling(toxic, ordinary)
    mine, theirs = T._Places(toxic), T._Places(ordinary)
    got = [int(c).to_bytes(T.GRAM, "big") for c in mine.codes]
    once, twice = theirs.counts(mine.codes)
    value = [max(a, b) for a, b in zip(T.evidence(mine.once, len(toxic), once, len(ordinary)),
                                       T.evidence(mine.twice, len(toxic), twice, len(ordinary)))]
    assert dict(zip(got, [round(v, 6) for v in value])) == {g: round(v, 6) for g, v in strength.items()}
    found = T.telling(toxic, ordinary)
    assert all(any(w.strip().decode() in f.decode() or f.decode().strip() in w.decode() for f in found) for w in (b.encode() for b in BAD))
    assert all(max(strength[f[i:i + T.GRAM]] for i in range(len(f) - T.GRAM + 1)) >= T.EVIDENCE for f in found)
    assert T.telling([], ordinary) == [] and T.telling([b"", b"a"], [b""]) == []


def test_telling_by_parts_is_the_same_in_little_memory(monkeypatch):
    """Of few bytes at once: the same strings, and no array with many bytes for each byte of the texts."""
    texts = [T.plain(t.encode()) for _, t, _ in made(1200, 5)]
    toxic = [t.replace(b"the", b"moron scum") if i % 3 == 0 else t for i, t in enumerate(texts[:600])]
    whole = T.telling(toxic, texts[600:])
    monkeypatch.setattr(T, "PART", 1 << 14, raising=False)
    tracemalloc.start()
    found = T.telling(toxic, texts[600:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == whole and any(b"scum" in f for f in found)
    assert peak < 20 * sum(map(len, toxic + texts[600:]))


def test_a_stem_within_words_is_learnt():
    """Toxic texts that share no whole word, only the beginning of words."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["an", "the", "er", "ing", "on", "re", "sta", "ble", "ou", "ti"]) for _ in range(rnd.randint(1, 3)))
    text = lambda bad: " ".join("qrstem" + word() if bad and rnd.random() < 0.05 else word() for _ in range(150))
    toxic, ordinary = [[text(bad).encode() for _ in range(80)] for bad in (True, False)]
    model = T.fit(toxic[:60], ordinary[:60])
    scorer = T.Scorer(model.toxic, model.ordinary)
    assert (T.score_texts(model, scorer, toxic[60:]) > 0.5).mean() > 0.9 and (T.score_texts(model, scorer, ordinary[60:]) < 0.5).mean() > 0.9


def test_copies_and_languages_are_no_evidence():
    """A text copied many times within one class, or a language that one class uses more, makes no telling strings."""
    rnd = random.Random(10)
    text = lambda syl: " ".join("".join(rnd.choice(syl) for _ in range(rnd.randint(1, 3))) for _ in range(80)).encode()     # noqa: E731
    one, two = ["an", "the", "er", "ing"], ["que", "ado", "cion", "el"]
    copied = text(one)
    toxic = [copied.replace(b"the", b"the ", 1 + i % 3) for i in range(60)] + [text(two if i % 2 else one) for i in range(120)]
    ordinary = [text(two if i % 4 == 0 else one) for i in range(300)]
    assert T.telling(toxic, ordinary) != []
    kept = T.without_copies(toxic)
    assert len(kept) == 121 and T.telling(kept, T.without_copies(ordinary)) == []
    assert T.without_copies([b"", b"", b"a", b"a", b"a b"]) == [b"", b"a", b"a b"]


def test_windows_cover_the_text():
    rnd = random.Random(9)
    for n in (0, 1, 47, 48, 49, 300, 5000):
        t = bytes(rnd.choice(b"abc  ") for _ in range(n)) + b"x" * rnd.choice([0, 100])
        w = list(T.windows(t))
        assert b"".join(w) == t and all(0 < len(x) <= T.WINDOW for x in w if t) and len(w) >= 1


def test_scores_do_not_depend_on_the_cap(spark):
    rows = [(i, t, int(i % 8 == 3)) for i, t, y in made(1600, 2) if not y]     # labels that the texts say nothing of
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    true = sum(y for *_, y in rows) / len(rows)
    for cap in (60, 2000):
        got = [r.score for r in toxicity_scores(df, train(df, lab, max_rows=cap)).collect()]
        print("cap", cap, "mean score", sum(got) / len(got), "share", true)
        assert abs(sum(got) / len(got) - true) < 0.05


def test_a_repeated_id_sends_one_text_to_the_driver(spark, monkeypatch):
    rows = made(120, 3)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, f"copy {k}") for k in range(400)], "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sent, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    assert train(df, lab) is not None
    texts = [r for got in sent for r in got if "t" in r.__fields__]
    print("texts sent", len(texts))
    assert len(texts) == len({r.i for r in texts}) > 50 and next(r.t for r in texts if r.i == 1) == min(t.encode() for t in [rows[1][1], *(f"copy {k}" for k in range(400))])
