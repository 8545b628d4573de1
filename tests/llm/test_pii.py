"""Base spans against Python's regex on the contract's patterns; added spans never disturb them."""

import random
import re

from pyspark.sql import functions as F

from sitelens.llm.pii_boost import Model, find_pii, train

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, rx) in enumerate(RX.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


HARD = ["", "a@b.c", "a@b.c_x@d.e.f", "a@b.c._d@e.f", "x@@y.z", "a@b..c", "é.55@mail4.example.com é", "a@b.c@d.e", "+1 (017) 555-7713 rest",
        "1.2.3.4.5.6.7.8", "256.1.1.1", "1.1.1.1", "001.002.000000003.4", "4845168114407329", "4845 1681 1440 7329", "4845-1681-1440-7329",
        "4845  1681144 07329", "+49 170 1234567+1 555 123 45 67", "+1 2", "++12 345 678 90", "12345678901234567890123", "😀 a@b.co 😀 1.2.3.4",
        "a\u0003b@c.d\u0001 1\u00012\u0002", "-@-.-", "%@a.b-", "1" * 30 + " 2", "0000000000000", "+123456789.", "+1" + " " * 9 + "23456789 ",
        "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 y", "4 1 1", "1.2.3.4", "a 5"]


def corpus():
    rnd = random.Random(4)
    bits = ["4 1 1 1 1 1 1 1 ", "1-1-1-", "1 1", "a", "b@", "@", ".", "c.d", "-", " ", "+1", "+", "55", "4845168114407329", "4111 1111 1111 1111", "10.0.0.", "255", "7", "é", "(", ")", "\n", "_", "x@y.zz"]
    return HARD + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(600)]


def test_base_spans_equal_the_contract(spark):
    rows = list(enumerate(corpus())) + [(9000, None), (None, "a@b.c"), (3, "a@b.c_x@d.e.f")]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, id string")
    trees = [(1.0, (1, 8.5, (0.0,), (1.0,)))]
    for model in (None, Model(trees, {0: 0.5, 1: 0.5, 2: 0.5})):
        got = find_pii(df, model).collect()
        assert sorted((str(r.doc_id), r.base) for r in got) == sorted((str(i), base(t or "")) for i, t in rows)
        for r in got:
            kinds = [x.split(":")[0] for x in r.base.split(",")] if r.base else []
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in RX]
            assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
            if model is None:
                assert r.spans == r.base


def test_very_long_runs_do_not_overflow_the_stack(spark):
    texts = ["1" * 200_000, "1 " * 100_000, "a." * 100_000, "a@" + "b." * 60_000 + "c", "x" * 300_000, "1-" * 90_000, "a" * 200_000 + "@b.c",
             "1." * 90_000, "+1" + "(" * 200_000, "ab:" * 80_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.base for r in find_pii(df, None).collect()}
    assert got[3] == f"email:0:{len(texts[3])}" and got[6] == f"email:0:{200_004}" and got[0] == ""


def test_trained_model_adds_spans_and_runs_no_python(spark):
    rnd = random.Random(2)
    texts = []
    for i in range(400):
        w = [rnd.choice(["the", "and", "of", "42", "1999", "3.5"]) for _ in range(20)]
        if i % 2:
            w.insert(5, f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}")
        if i % 3 == 0:
            w.insert(9, f"call ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}")
        if i % 5 == 0:
            w.insert(2, f"{rnd.randrange(10**6, 10**7)}")
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = train(df)
    out = find_pii(df, model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = out.collect()
    assert all(r.base == base(t) for r, (_, t) in zip(sorted(rows), texts))
    assert train(df.limit(0)) is None and find_pii(df.limit(0), model).count() == 0


PLANTED = {"iban": ("account", "GB82WEST12345698765432"), "ip6": ("ip6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), "short": ("ip6", "2001:db8::8a2e:370:7334"),
           "secret": ("secret", 'token = "04dbeb93c1f25a7786d0e4b1a9f3c6d2e8b70514"'), "contact": ("contact", "joe.doe (at) mail (dot) org")}
NOT = ["GB82WEST12345698765433", "00:1a:2b:3c:4d:5e", "1:2:3:4:5:6:7:8:9", "token: required", "12::34::56"]


def planted(every):
    """Texts with one of PLANTED or NOT at every ``every``-th; (texts, spans wanted, spans not wanted)."""
    rnd = random.Random(6)
    kinds, texts, want, wrong = [*PLANTED.values(), *((None, x) for x in NOT)], [], [], []
    for i in range(1200):
        w = " ".join(rnd.choice(["the", "and", "of", "42", "1999", "10485761"]) for _ in range(12))
        if i % 4 == 0:
            w += f" +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} x{i}@mail.example.com"
        if i % every == 1:
            kind, m = kinds[i // every % len(kinds)]
            at = len(w) + 3
            w = f"{w} x {m} the end"
            (want if kind else wrong).append((i, f"{kind}:{at}:{at + len(m)}" if kind else (at, at + len(m))))
        texts.append((i, w))
    return texts, want, wrong


def test_planted_data_that_no_base_kind_describes_is_found(spark):
    for every in (3, 100):      # enough of each to calibrate; one or two of each in the whole table
        texts, want, wrong = planted(every)
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.spans.split(",") for r in find_pii(df, train(df)).collect()}
        assert len(want) >= 5 and [w for w in want if w[1] not in got[w[0]]] == []
        for i, (s, e) in wrong:
            assert not any(int(x.split(":")[1]) < e and s < int(x.split(":")[2]) for x in got[i] if x), (i, texts[i], got[i])


def test_a_table_of_secrets_only_needs_no_other_class(spark):
    m = PLANTED["secret"][1]
    df = spark.createDataFrame([(i, f"a {m}") for i in range(50)], "doc_id long, text string")
    assert {r.spans for r in find_pii(df, train(df)).collect()} == {f"secret:2:{2 + len(m)}"}


def test_a_long_key_is_one_span(spark):
    """No part of a keyed secret stays in the text, however long it is."""
    import random as r
    rnd = r.Random(12)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    texts = [f"set api_key = {key(n)} here" for n in (20, 64, 65, 120, 500, 100_000)] + ["x (at) " + ".".join(["ab"] * 30) + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in find_pii(df, Model([], {})).collect()}
    for i, n in enumerate((20, 64, 65, 120, 500, 100_000)):
        assert f"secret:4:{14 + n}" in got[i].split(",")
    assert got[6] == f"contact:0:{len(texts[6]) - 2}"


def test_entropy_of_a_value(spark):
    import math

    from sitelens.llm.pii_boost import _entropy
    values = ["", "a", "aa", "ab", "aabbbc", "0123456789abcdef" * 20, "é😀é x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, got in df.select("v", _entropy(df.v)).collect():
        want = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
        assert abs(got - want) < 1e-6


def test_thresholds_count_the_candidates_of_all_texts(spark):
    """61 addresses in 16,000 texts: half of them calibrate, more than MIN_CALIBRATION. A sample of texts held too few."""
    from sitelens.llm.pii_boost import GENERATORS, MIN_CALIBRATION
    n = spark.range(16_000)
    no = F.col("id") / 266
    tail = F.substring(F.sha2(no.cast("int").cast("string"), 256), 1, 6)
    word = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz" * 3), F.lit(1), (no + 1).cast("int"))
    address = F.concat(word, F.when(no.cast("int") % 3 == 0, F.lit(" at[at]")).otherwise(F.lit("@")), F.lit("h"), tail, F.lit(".com"))
    sums = F.concat(F.lit("order "), (F.col("id") * 7919 + 100000).cast("string"), F.lit(" - "), (F.col("id") % 97).cast("string"), F.lit(" 77"))
    df = n.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 266 == 0, F.concat(F.lit("to "), address, F.lit(" now"))).otherwise(sums).alias("text"))
    assert df.where("text like 'to %'").count() > 2 * MIN_CALIBRATION
    assert list(GENERATORS).index("contact") in train(df).thresholds


def test_thresholds_by_running_counts(spark):
    from sitelens.llm.pii_boost import _thresholds
    rows = [(0, float(i % 10 != 0 if i > 40 else i % 2), 1.0, float(i)) for i in range(100)] + [(1, 1.0, 30.0, 2.5)] + [(2, 1.0, 19.0, 1.0)] + [(3, 0.0, 50.0, 1.0)]
    want, good = None, 0.0
    for i, (_, y, _, m) in enumerate(sorted(rows[:100], key=lambda r: -r[3])):
        good += y
        want = m if good >= 0.9 * (i + 1) else want
    assert _thresholds(spark.createDataFrame(rows, "g int, y double, w double, m double"), 0.9) == {0: want, 1: 2.5}
