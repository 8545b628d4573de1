"""Operator 13 against a plain dynamic programme, full enumeration of short audits, and a row-by-row brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sitelens.llm import conversation_repair as CR

PATTERN = re.compile(r"(s?(ua)+)?")
INIT = "suax"


def by_table(codes: str, entry: int, leave: int):
    """Least (cost, audit), by passes over the table of nodes until nothing changes."""
    rows = [divmod(ord(c) - 65, 4) for c in codes]
    best = {(0, entry): (0, "")}

    def better(node, cost, audit):
        if node not in best or (cost, audit) < best[node]:
            best[node] = (cost, audit)
            return True
        return False
    for i in range(len(rows) + 1):
        while any(better((i, CR.NEXT[q]), best[i, q][0] + 5, best[i, q][1] + "I") for q in range(4) if (i, q) in best):
            pass
        if i == len(rows):
            break
        initial, fault = rows[i]
        for q in range(4):
            if (i, q) not in best:
                continue
            c, a = best[i, q]
            better((i + 1, q), c + 2, a + "D")
            if fault < 2:
                better((i + 1, CR.NEXT[q]), c + 1 + 5 * fault, a + "R")
                if initial < 3 and CR.KEEP[q][initial] is not None:
                    better((i + 1, CR.KEEP[q][initial]), c + 5 * fault, a + "K")
    ends = [best[len(rows), q] for q in (CR.ACCEPT if leave == CR.DONE else (leave,)) if (len(rows), q) in best]
    return min(ends) if ends else None


def by_enumeration(codes: str):
    """Every edit script with up to two inserts, judged by the pattern on role initials alone."""
    rows, found = [divmod(ord(c) - 65, 4) for c in codes], []
    spots = [p for n in range(3) for p in itertools.combinations_with_replacement(range(len(rows) + 1), n)]
    choices = [["D"] if f > 1 else ["D", "K", "Ru", "Ra"] for _, f in rows]
    for spot in spots:
        for roles in itertools.product("ua", repeat=len(spot)):
            for edits in itertools.product(*choices):
                cost, audit, made = 0, "", ""
                for i in range(len(rows) + 1):
                    for p, r in zip(spot, roles):
                        if p == i:
                            cost, audit, made = cost + 5, audit + "I", made + r
                    if i < len(rows):
                        e, (initial, fault) = edits[i], rows[i]
                        audit += e[0]
                        cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if fault == 1 and e != "D" else 0)
                        made += "" if e == "D" else INIT[initial] if e == "K" else e[1]
                if PATTERN.fullmatch(made):
                    found.append((cost, audit))
    return min(found)


def random_codes(rnd, n):
    return "".join(CR.code(rnd.choice([0, 1, 1, 1, 2, 2, 2, 3]), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n))


def test_search_equals_the_table():
    rnd = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 7, 9, 14, 40] * 25:
        codes = random_codes(rnd, n)
        for entry, leave in itertools.product(range(4), range(5)):
            assert CR.cheapest(codes, entry, leave) == by_table(codes, entry, leave), (codes, entry, leave)


def test_search_equals_every_script():
    rnd = random.Random(4)
    for codes in ["", *(random_codes(rnd, n) for n in [1, 2, 3, 4] * 12)]:
        assert CR.cheapest(codes, 0, CR.DONE) == by_enumeration(codes), codes


def brute(table):
    """{conv_id: row of the contract} of (conv_id, turn, role, text) rows."""
    sp = lambda v: " " if v is None else v      # noqa: E731
    out, after = {}, {}
    for conv, turn, role, text in table:
        after.setdefault(conv, [])
        role, text = sp(role), sp(text)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        codes, seen = "", set()
        for _, role, text in rows:
            body = text.strip(CR.SPACES)
            fault = 2 if not body else 3 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            codes += CR.code("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3, fault)
        faults = [(ord(c) - 65) % 4 for c in codes]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = by_table(codes, 0, CR.DONE)
        made, state, i = [], 0, 0
        for e in audit:
            if e == "I":
                state = CR.NEXT[state]
                made.append(("user" if state == 2 else "assistant") + ":")
                continue
            if e == "K":
                state = CR.KEEP[state]["sua".index(rows[i][1][0])]
                made.append(f"{rows[i][1]}:{rows[i][2]}")
            elif e == "R":
                state = CR.NEXT[state]
                made.append(("user" if state == 2 else "assistant") + ":" + rows[i][2])
            i += 1
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(2), faults.count(3),
                     faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def held(spark, table, schema="conv_id long, turn long, role string, text string", extra=(), block=CR.BLOCK):
    df = spark.createDataFrame(table, schema)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    got = CR.repair_report(df, CR.damage(df), block).collect()
    assert len({r.conv_id for r in got}) == len(got)
    assert {r.conv_id: tuple(r[c] for c in COLS) for r in got} == brute(table)


def test_random_conversations(spark):
    rnd = random.Random(5)
    table = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 9)):
            t = None if rnd.random() < 0.05 else turn + rnd.choice([0, 0, 0, 7])
            table.append((conv, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                          rnd.choice(["yes.", "no", "", "\t\x0b ", None, "why? \n", "yes.", "päö!", "a" * 300])))
    table += table[:20]
    held(spark, table, extra=("key", "digest", "audit", "seq", "kind", "codes"))


@pytest.mark.parametrize("block", [4, 512])
def test_one_conversation_over_many_tasks(spark, block):
    """Most rows are in one conversation: it is cut into blocks in several tasks, and folded to the same result."""
    rnd = random.Random(6)
    table = [(7, t, rnd.choice(["user", "assistant", "user", "assistant", "x"]), rnd.choice(["a.", "b", f"t{t}.", f"u{t}!"]))
             for t in range(1500)]
    table += [(c, t, "user", "q.") for c in range(5) for t in range(3)]
    held(spark, table, block=block)
    k = CR._keyed(CR.damage(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))
    order = ["key", "has_turn", "turn", "digest"]
    tasks = (k.select(*order).repartitionByRange(4, *order).where("key = 'v7'")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert tasks > 1


def test_long_texts_turns_and_all_dropped(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    held(spark, [(1, dropped, "user", "gone."), (2, 0, "user", "x" * 2_000_000 + "."), (2, 1, "assistant", "y? " * 300_000),
                 (3, -5, "user", "a."), (3, 10 ** 15, "assistant", "b.")])


def test_empty_table(spark):
    held(spark, [])
    held(spark, [("c1", 0, "user", "a."), (None, None, None, None)], schema="conv_id string, turn long, role string, text string")
