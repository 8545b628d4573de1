"""Personal data by candidate gradient boosting, in DataFrame functions only.

Two layers of spans are found in every whole text, with positions in code points (end exclusive):

* base spans of four kinds by fixed patterns and checks (email, ip, card, phone): leftmost and non-overlapping
  per kind, failing matches dropped without retries;
* added spans: high-recall generators propose overlapping candidates (numbers, contacts, keyed secrets, account
  numbers, IPv6 addresses); boosted trees score their format and context, and those that reach their generator's
  calibrated threshold, and touch no base span (keyed secrets may: a long key can hold digits that pass as a card), are kept.

The trees learn from the candidates of all texts. The label is a check of the candidate's own kind, whatever
the base layer says: checksum (IBAN, card), syntax (addresses, obfuscated ones too), phone format and context, key word plus
entropy of the value. Thresholds are the lowest score from which on at least ``precision`` of the candidates' other half passes;
a generator with too few candidates there, or none such score, is decided by its check. Fitted trees are turned
into one column expression, so that finding spans is a single pass without shuffle, explode or Python.

Java's regex engine recurses on repeated groups and retries a run at each of its characters; the patterns here avoid
both (separators inside numbers and domains are first replaced, one code point for one, by control characters), so
very long digit runs, dotted names and words are safe. Null texts count as empty; ids are carried along, null or
repeated; the columns of the input other than id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]     # in the order of the contract
# A secret's value goes on to the next white space, however long it is. Longer runs of number characters are proposed in pieces
# (no number kind is longer), local parts have 64 characters, domains 127 labels and account numbers 34 characters at most.
GENERATORS = {
    "number": r"[0-9(+][0-9 ()./-]{5,60}[0-9]",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){0,126}",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|token|secret|api[_-]?key|ssn|iban) {0,3}[:=] {0,3}[^\x20\x09-\x0D]{4,}+",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}(?![A-Z0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?=[0-9a-fA-F:]{1,35}::|(?:[0-9a-fA-F]{1,4}:){3})[0-9a-fA-F]{1,4}(?:::?[0-9a-fA-F]{1,4}){1,7}(?![0-9A-Fa-f:])",
}
FEATURES = ["generator", "length", "digits", "letters", "groups", "distinct", "plus", "parens", "dots", "dashes", "spaces",
            "at", "leading_zero", "before_digit", "before_letter", "after_digit", "after_letter", "hint", "line_start",
            "checksum", "syntax", "entropy"]
SPAN = "array<struct<s:int,e:int,m:string>>"
CONTEXT = 24
MIN_CALIBRATION = 20    # candidates of a generator in the other half
_GROUP = "[0-9a-fA-F]{1,4}"
IP6 = (f"^(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=.*[0-9])(?!(?:[0-9a-fA-F]+:+){{7}}[0-9a-fA-F])"
       f"{_GROUP}(?::{_GROUP}){{0,5}}::{_GROUP}(?::{_GROUP}){{0,5}})$")
IP4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|0{0,2}[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
EMAIL = r"^[a-z0-9._%+-]{1,64}@(?:[a-z0-9-]{1,63}\.){1,126}[a-z][a-z0-9-]{1,62}$"
PHONE = r"^(?:\+[0-9].*|(?:[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9][0-9 .-]+|(?:1[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})$"
CALL = r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|t\u00e9l)[^\n0-9]{0,12}$"


def _spans(text: Column, pattern: str) -> Column:
    """[(start, end, match)] of a pattern: matches are fenced with U+0003, the text is split there, and one
    pass over the pieces sums up lengths."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0003$0\u0003")), "\u0003", -1)
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x)).alias("at"), (~a["odd"]).alias("odd"),
            F.when(a["odd"], F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (a["at"] + F.length(x)).alias("e"),
                                                                 x.alias("m"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"])


def _when(text: Column, needle: str, spans: Column) -> Column:
    """Skip the regex where a character that every match holds is absent."""
    return F.when(F.contains(text, F.lit(needle)), spans).otherwise(F.array().cast(SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _layers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (text with U+0001..U+0003 replaced), base spans per kind, candidates per generator."""
    fence = "\u0001\u0002\u0003"
    rows = df.select(F.col(id_col).alias("id"),
                     F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), fence, "\u0004" * 3).alias("t"))
    t = F.col("t")
    has_digit = F.rlike(t, F.lit("[0-9]"))
    rows = rows.select("id", "t",
                       F.regexp_replace(t, r"(?<=[0-9])[ -](?=[0-9])", "\u0001").alias("tc"),
                       F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\u0002"))
                       .otherwise(F.lit("")).alias("te"),
                       has_digit.alias("has_digit"))
    local = "[A-Za-z0-9.\u0002_%+-]"
    email = _when(F.col("te"), "@", _spans(
        F.col("te"), f"(?:(?<!{local})|\\G){local}++@[A-Za-z0-9-]++\u0002[A-Za-z0-9\u0002-]++"))
    # each part at most 255, leading zeros allowed
    ip = F.filter(_when(t, ".", _spans(t, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")), lambda x: F.forall(
        F.split(x["m"], r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))))
    card = F.filter(F.when(F.col("has_digit"), _spans(F.col("tc"), "[0-9][0-9\u0001]{11,}")).otherwise(F.array().cast(SPAN)),
                    lambda x: F.length(_digits(x["m"])).between(12, 19) & F.call_function("luhn_check", _digits(x["m"])))
    phone = F.filter(_when(t, "+", _spans(t, r"\+[0-9][ ().0-9-]{7,}[0-9]")), lambda x: F.length(_digits(x["m"])).between(9, 15))
    none = F.array().cast(SPAN)

    def holds(*needles: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in needles])

    may = {"number": F.col("has_digit"), "contact": holds("@", "at)", "at]"), "secret": holds("=", ":"),
           "account": F.col("has_digit"), "ip6": holds(":")}
    gens = [F.when(may[name], _spans(t, pattern)).otherwise(none).alias(f"g_{name}") for name, pattern in GENERATORS.items()]
    return rows.select("id", "t", email.alias("email"), ip.alias("ip"), card.alias("card"), phone.alias("phone"), *gens)


def _count(m: Column, cls: str) -> Column:
    return F.length(m) - F.length(F.regexp_replace(m, cls, ""))


def _iban(m: Column) -> Column:
    """Length and checksum (mod 97) of an account number."""
    moved = F.split(F.concat(F.substring(m, 5, 64), F.substring(m, 1, 4)), "")
    rest = F.aggregate(moved, F.lit(0), lambda a, c: F.when(c == "", a).when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97)
                       .otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.when(F.rlike(m, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")), rest == 1).otherwise(F.lit(False))


def _value(m: Column) -> Column:
    """What follows the key word, without quotes and closing marks."""
    return F.regexp_replace(F.regexp_replace(m, "^[^:=]+[:=] {0,3}[\"'`]?", ""), "[\"'`,;.)\\]}].*$", "")


def _entropy(v: Column) -> Column:
    """Bits a character (to six places): from the lengths of equal runs among the sorted characters, in one pass."""
    n = F.length(v)
    begin = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(c == a["c"], F.struct(c.alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))) \
        .otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("run"), (a["sum"] + a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0)))).alias("sum")))
    total = F.aggregate(F.filter(F.array_sort(F.split(v, "")), lambda c: c != ""), begin, step,
                        lambda a: a["sum"] + a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0))))
    return F.when(n > 0, F.round(F.log2(F.greatest(n, F.lit(1))) - total / n, 6)).otherwise(F.lit(0.0))


def _facts(name: str, t: Column):
    """Match -> (m, s, e, text before, character after, checksum, syntax, entropy)."""
    def of(x: Column) -> Column:
        m, no, zero = x["m"], F.lit(False), F.lit(0.0)
        checksum, syntax, entropy = no, no, zero
        if name == "number":
            checksum = F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))
            syntax = F.rlike(m, F.lit(IP4))
        elif name == "contact":
            plain = F.regexp_replace(F.regexp_replace(F.lower(m), r" ?(?:@|[(\[]at[)\]]) ?", "@"), r" ?(?:\.|[(\[]dot[)\]]) ?", ".")
            syntax = F.rlike(plain, F.lit(EMAIL))
        elif name == "secret":
            checksum = F.when(F.rlike(m, F.lit("(?i)^iban")), _iban(_value(m))).otherwise(no)
            syntax = F.rlike(m, F.lit("(?i)^ssn")) & F.rlike(_value(m), F.lit("^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$"))
            entropy = _entropy(_value(m))
        elif name == "account":
            checksum = _iban(m)
        else:
            syntax = F.rlike(m, F.lit(IP6))
        before = F.substring(t, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        return F.struct(m.alias("m"), x["s"].alias("s"), x["e"].alias("e"), before.alias("before"),
                        F.substring(t, x["e"] + 1, F.lit(1)).alias("after"), checksum.alias("checksum"), syntax.alias("syntax"),
                        entropy.alias("entropy"))
    return of


def _check(name: str, x: Column) -> Column:
    """The candidate is personal data by the rules of its own kind."""
    m = x["m"]
    if name == "number":
        alone = ~F.rlike(x["before"], F.lit(r"[\p{L}0-9]$")) & ~F.rlike(x["after"], F.lit(r"[\p{L}0-9]"))
        phone = F.length(_digits(m)).between(7, 15) & (F.rlike(m, F.lit(PHONE)) | F.rlike(x["before"], F.lit(CALL)))
        return x["checksum"] | x["syntax"] | (alone & phone)
    if name == "secret":
        v = _value(m)
        mixed = F.rlike(v, F.lit("[a-z]")) & F.rlike(v, F.lit("[A-Z]"))
        keyed = ((F.length(v) >= 6) & F.rlike(v, F.lit("[0-9]")) & (x["entropy"] >= 2.25)) | ((F.length(v) >= 16) & mixed & (x["entropy"] >= 3.5))
        return F.when(F.rlike(m, F.lit("(?i)^(?:ssn|iban)")), x["checksum"] | x["syntax"]).otherwise(keyed)
    return x["checksum"] | x["syntax"]


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds ``base`` [(s, kind no, e)] in order, and ``cand`` [(generator no, s, e, features, check)]."""
    def numbered(i: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))

    base = F.array_sort(F.concat(*[F.transform(F.col(k), numbered(i)) for i, k in enumerate(KINDS)]))
    rows = rows.withColumn("base", base)
    t = F.col("t")

    def features(i: int, name: str):
        return lambda x: candidate(i, name, x)

    def candidate(i: int, name: str, x: Column) -> Column:
        m, s, e, before, after = x["m"], x["s"], x["e"], x["before"], x["after"]
        digits = _digits(m)
        flag = lambda c: c.cast("double")
        return F.struct(
            F.lit(i).alias("g"), s.alias("s"), e.alias("e"), F.array(
                F.lit(float(i)), flag(F.length(m)), flag(F.length(digits)), flag(_count(m, "[A-Za-z]")),
                flag(F.size(F.split(m, "[^0-9A-Za-z]+"))), flag(F.size(F.array_distinct(F.split(digits, "")))),
                flag(F.contains(m, F.lit("+"))), flag(F.contains(m, F.lit("("))), flag(_count(m, r"\.")), flag(_count(m, "-")),
                flag(_count(m, " ")), flag(F.contains(m, F.lit("@"))), flag(F.startswith(m, F.lit("0"))),
                flag(F.rlike(before, F.lit("[0-9]$"))), flag(F.rlike(before, F.lit(r"\p{L}$"))),
                flag(F.rlike(after, F.lit("[0-9]"))), flag(F.rlike(after, F.lit(r"\p{L}"))),
                flag(F.rlike(before, F.lit(r"(?i)(?:tel|phone|call|fax|mail|contact|card|visa|iban|account|ssn|address|ip)[^\n]{0,8}$"))),
                flag((s == 0) | F.endswith(before, F.lit("\n"))), flag(x["checksum"]), flag(x["syntax"]), x["entropy"]).alias("f"),
            _check(name, x).alias("ok"))

    cand = F.concat(*[F.transform(F.transform(F.col(f"g_{name}"), _facts(name, t)), features(i, name)) for i, name in enumerate(GENERATORS)])
    return rows.withColumn("cand", cand)


def _touches(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


class Model:
    """Boosted trees as plain tuples, and a threshold per generator."""

    def __init__(self, trees: list[tuple[float, tuple]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def margin(self, f: Column) -> Column:
        def walk(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            feature, split, left, right = node
            return F.when(f[feature] <= split, walk(left)).otherwise(walk(right))
        return reduce(lambda a, b: a + b, [F.lit(w) * walk(t) for w, t in self.trees], F.lit(0.0))

    def accepts(self, c: Column) -> Column:
        """The score reaches the threshold of the candidate's generator; without one, the check is passed."""
        if not self.thresholds:
            return c["ok"]
        limit = reduce(lambda acc, g: F.when(c["g"] == g, F.lit(self.thresholds[g])).otherwise(acc), self.thresholds,
                       F.lit(None).cast("double"))
        return F.coalesce(self.margin(c["f"]) >= limit, c["ok"])


def _tree(node) -> tuple:
    """A fitted JVM tree node as nested tuples (feature, threshold, left, right) or (value,)."""
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = 12, depth: int = 3,
          precision: float = 0.9) -> Model | None:
    """Model from the candidates of all texts; without trees if they hold no candidates of both classes, None if there are no texts.

    Candidates alike in features and check are one row with their number as its weight. Half of them (by a hash of the features)
    fit the trees, the other half the thresholds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    if df.isEmpty():
        return None
    rows = _candidates(_layers(df, id_col, text_col))
    c = F.col("c")
    rows = (rows.select(F.explode_outer("cand").alias("c")).where(c.isNotNull())
            .groupBy(c["g"].alias("g"), c["f"].alias("f"), c["ok"].cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
            .withColumn("half", F.pmod(F.xxhash64("f", "g"), F.lit(2))).checkpoint(True))
    counts = {(r.half, r.y): (r.w, r.n) for r in rows.groupBy("half", "y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
    if not all(counts.get((h, y), (0, 0))[0] >= 5 for h in (0, 1) for y in (0.0, 1.0)):
        return Model([], {})
    # Spark ML looks for split points among maxBins ** 2 rows: with so many bins these are all rows, up to a million different ones
    bins = max(32, min(1024, isqrt(counts[0, 0.0][1] + counts[0, 1.0][1]) + 1))
    fitted = GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=trees, maxDepth=depth, maxBins=bins, seed=11) \
        .fit(rows.where("half = 0").select("y", "w", array_to_vector("f").alias("v")))
    jtrees = fitted._java_obj.trees()
    weights = list(fitted.treeWeights)
    model = Model([(w, _tree(t.rootNode())) for w, t in zip(weights, jtrees)], {})
    model.thresholds = _thresholds(rows.where("half = 1").select("g", "y", "w", model.margin(F.col("f")).alias("m")), precision)
    return model


def _thresholds(scored: DataFrame, precision: float) -> dict[int, float]:
    """Per generator the lowest score from which on at least ``precision`` of the candidates pass. ``scored``: g, y, w, m.

    Running counts go range of scores by range, so that no task holds all scores of a generator.
    """
    sums = ("n", "good")
    s = (scored.groupBy("g", "m").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("good"))
         .repartitionByRange(F.col("g"), F.col("m").desc()).withColumn("part", F.spark_partition_id()).checkpoint(True))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy("g", "part").agg(*[F.sum(c).alias(c) for c in sums]) \
        .select("g", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}_before") for c in sums])
    higher = Window.partitionBy("g", "part").orderBy(F.col("m").desc())
    s = s.join(before, ["g", "part"]).select("g", "m", *[(F.col(f"{c}_before") + F.sum(c).over(higher)).alias(c) for c in sums])
    best = s.groupBy("g").agg(F.max("n").alias("n"), F.min(F.when(F.col("good") >= precision * F.col("n"), F.col("m"))).alias("m"))
    return {r.g: r.m for r in best.collect() if r.m is not None and r.n >= MIN_CALIBRATION}       # a row a generator


def find_pii(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base (spans of the base layer), spans (all), each a text of
    ``kind:start:end`` by start and kind, comma-joined."""
    rows = _candidates(_layers(df, id_col, text_col))
    names = KINDS + list(GENERATORS)
    if model is None:
        added = F.array().cast("array<struct<s:int,k:int,e:int>>")
    else:
        keyed = F.lit(list(GENERATORS).index("secret"))     # its key word vouches for the whole value, also around a base span
        added = F.transform(F.filter("cand", lambda c: model.accepts(c) & ((c["g"] == keyed) | ~_touches(F.col("base"), c))),
                            lambda c: F.struct(c["s"].alias("s"), (c["g"] + len(KINDS)).alias("k"), c["e"].alias("e")))

    def text(spans: Column) -> Column:
        kinds = F.array(*[F.lit(n) for n in names])
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")

    rows = rows.withColumn("added", added)
    return rows.select(F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                       text(F.col("base")).alias("base"), text(F.array_sort(F.concat("base", "added"))).alias("spans"))
