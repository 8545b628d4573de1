"""Connected components against union-find."""

import random

from sitelens.llm.components import connected_components


def test_equals_union_find(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    links += [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(180)] + [(3, 2), (2, 3), (-5, 4)]
    rnd.shuffle(links)
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "a long, b long").checkpoint()).collect()
    assert {r.node: r.label for r in got} == {v: find(v) for v in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
