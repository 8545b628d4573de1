"""Change-set laws and the reference's duplicate/hash rules."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.operators import diff as D
from sitelens.operators.diff import diff_snapshots

SCHEMA = "ord long, url string, hash string, last_modified string"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _brute(old, new):
    """The reference's two Map walks, in plain Python."""
    lo = {}
    for r in old:
        lo[r[1]] = r
    ln = {r[1] for r in new}
    out = []
    for r in new:
        o = lo.get(r[1], None)
        if o is None and r[1] not in lo:
            out.append(("added", r[1], 0, r[0]))
        elif o[2] != r[2]:
            out.append(("modified", r[1], 0, r[0]))
    for r in old:
        if r[1] not in ln:
            out.append(("removed", r[1], 1, r[0]))
    return sorted(out, key=lambda x: (x[2], x[3]))


def _run(spark, old, new):
    d = D.diff_snapshots(_df(spark, old), _df(spark, new))
    return sorted(((r.change_type, r.url, r.section, r.ord) for r in d.collect()), key=lambda x: (x[2], x[3]))


_row = st.tuples(st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from(["h1", "h2", None]))


@settings(max_examples=40, deadline=None)
@given(st.lists(_row, max_size=8), st.lists(_row, max_size=8))
def test_diff_equals_map_walk(spark, a, b):
    old = [(i, u, h, None) for i, (u, h) in enumerate(a)]
    new = [(i, u, h, None) for i, (u, h) in enumerate(b)]
    assert _run(spark, old, new) == _brute(old, new)


def test_laws(spark):
    a = [(1, "u1", "h1", None), (2, "u2", "h2", None), (3, "u3", "h3", None)]
    b = [(1, "u2", "h2", None), (2, "u3", "hX", None), (3, "u4", "h4", None)]
    assert _run(spark, a, a) == []
    ab = _run(spark, a, b)
    ba = _run(spark, b, a)
    assert {u for t, u, *_ in ab if t == "added"} == {u for t, u, *_ in ba if t == "removed"}
    assert {u for t, u, *_ in ab if t == "modified"} == {u for t, u, *_ in ba if t == "modified"} == {"u3"}


def test_only_hash_counts_and_last_wins(spark):
    old = [(1, "u", "h1", "2020"), (2, "u", "h2", "2021")]
    new = [(1, "u", "h2", "2099"), (2, "u", "h1", None)]
    got = D.diff_snapshots(_df(spark, old), _df(spark, new)).collect()
    assert [(r.change_type, r.ord, r.old_hash) for r in got] == [("modified", 2, "h2")]
    listing = D.change_listing(D.diff_snapshots(_df(spark, old), _df(spark, new))).collect()
    assert listing[0].last_modified == ""


def test_summary_and_lines(spark):
    old = [(1, "u", "h1", None), (2, "gone", "h9", None)]
    new = [(1, "u", "h2", None)]
    ch = D.diff_snapshots(_df(spark, old), _df(spark, new))
    assert {r.change_type: r.n for r in D.change_summary(ch).collect()} == {"added": 0, "modified": 1, "removed": 1}
    content = spark.createDataFrame([("h1", b"a\nb\nb\n"), ("h2", b"a\nb\nc\n")], "hash string, body binary")
    lines = {(r.line, r.n_old, r.n_new) for r in D.line_changes(ch, content).collect()}
    assert lines == {("b", 2, 1), ("c", 0, 1)}


def test_many_reports_are_compared_by_crawl(spark):
    """Equal urls and ordinals in different reports do not mix; without ``by`` they would."""
    cols = "crawl_id string, ord long, url string, hash string"
    old = spark.createDataFrame([("a", 0, "u", "1"), ("b", 0, "u", "2"), ("b", 1, "v", "3"), (None, 0, "u", "9"), ("ab", 0, "c", "1")], cols)
    new = spark.createDataFrame([("a", 0, "u", "2"), ("b", 0, "u", "2"), ("a", 1, "v", "3"), (None, 0, "u", "9"), ("a", 2, "bc", "1")], cols)
    got = {(r.crawl_id, r.change_type, r.url) for r in diff_snapshots(old, new, by=["crawl_id"]).collect()}
    assert got == {("a", "modified", "u"), ("b", "removed", "v"), ("a", "added", "v"), ("ab", "removed", "c"), ("a", "added", "bc")}
