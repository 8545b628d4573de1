"""Stages that keep all columns: columns called like anything the code uses itself, very long texts, empty tables."""

import random

import pytest

from sitelens.llm.bagminhash import drop_near_duplicates
from sitelens.llm.exact_dedup import drop_exact_duplicates
from sitelens.llm.mixing import mix
from sitelens.llm.toxicity import drop_toxic, train

NAMES = ["__id", "__text", "__text_is_null", "__n", "__p", "__rate", "__copies", "__i", "i", "t", "n", "p", "y", "id", "text_is_null", "n_words",
         "posterior", "rate", "copies", "chunk", "pos", "node", "label", "kind", "blob", "class_id", "kept", "rest", "Id_"]


def stages(spark):
    lab = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    return {"toxicity": lambda d: drop_toxic(d, train(d, lab)), "exact": drop_exact_duplicates, "near": drop_near_duplicates,
            "mix": lambda d: mix(d, lab)}


@pytest.mark.parametrize("stage", ["toxicity", "exact", "near", "mix"])
def test_columns_of_the_codes_own_names_stay(spark, stage):
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(40)) for _ in range(40)]
    texts += ["", None, "a " * 300_000, "b" * 600_000]
    cols = ", ".join(f"`{c}` string" for c in NAMES)
    df = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in NAMES]) for i, t in enumerate(texts)], f"doc_id long, text string, {cols}").repartition(2)
    got = stages(spark)[stage](df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    want = {r.doc_id: r for r in df.collect()}
    rows = got.collect()
    assert len(rows) >= 30 and all(r == want[r.doc_id] for r in rows)
    assert stages(spark)[stage](df.limit(0)).collect() == []
