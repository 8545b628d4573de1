"""The corpus pipeline against plain Python, stage by stage, and row-keeping of the stages."""

import os
import random
from collections import namedtuple

import pytest
import sentencepiece

import corpus_pipeline as P
from sitelens.llm.sentencepiece_viterbi import DEFAULT_MODEL
from tests.llm.test_bagminhash import classes

Row = namedtuple("Row", "doc_id text lang source n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")


@pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="needs the public model file")
def test_stages_equal_plain_python(spark, tmp_dir):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        t = words(rnd, 60)
        if bad:
            t = " ".join(x + (" idiot" if k % 8 == 0 else " scum" if k % 8 == 4 else "") for k, x in enumerate(t.split()))
        docs.append(Row(i, t, "en", "s0", len(t)))
        labels.append((i, 1, int(bad)))
    base = docs[1].text
    docs += [Row(1000, base.replace(" ", "\n"), "en", "s1", 1), Row(1001, base + " tail", "de", "s1", 2), Row(1002, None, None, None, None),
             Row(1003, "", "en", "s0", 0), Row(None, docs[2].text, "en", "s0", 5), Row(4, docs[4].text, "en", "s0", 6)]
    tables(spark, tmp_dir, docs, labels)
    cur = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, cur, tmp_dir)
        if name != "sentencepiece":
            assert out.columns == cur.columns and out.dtypes == cur.dtypes
        path = f"{tmp_dir}/out-{name}"
        out.write.parquet(path)
        cur = spark.read.parquet(path)
        seen.append(cur.collect())
    tox, exact, near, mixed, enc = seen
    ids = lambda rows: sorted(str(r.doc_id) for r in rows)
    rejected = {str(d.doc_id) for d in docs} - set(ids(tox))
    assert rejected <= {str(d.doc_id) for d in docs if d.text and "idiot" in d.text} and len(rejected) > 80
    want = {}
    for r in sorted(tox, key=lambda r: (-len(r.text or ""), r.doc_id is not None, r.doc_id or 0)):
        want.setdefault("".join((r.text or "").split()), str(r.doc_id))
    assert ids(exact) == sorted(want.values())
    groups = classes([(r.doc_id, r.text) for r in exact])
    firsts = [min((exact[i].doc_id is not None, exact[i].doc_id or 0) for i in g) for g in groups]
    assert ids(near) == sorted(str(i) if ok else "None" for ok, i in firsts)
    by_id = {str(r.doc_id): r for r in near}
    assert set(ids(mixed)) <= set(by_id) and all(by_id[str(r.doc_id)] == r for r in mixed)
    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    assert sorted((str(r.doc_id), r.ids) for r in enc) == sorted((str(r.doc_id), sp.encode(r.text or "")) for r in mixed)


def test_an_empty_table_passes_through(spark, tmp_dir):
    tables(spark, tmp_dir, [], [])
    assert P.run(spark, tmp_dir).count() == 0
