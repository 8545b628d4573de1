"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation's rows, in the order of their turns, become a lattice: node (i, state) has dealt with i rows and stands at
one state of the wanted role pattern ``(s?(ua)+)?``. Edits are its arcs, with costs: Keep 0, Rerole to user/assistant 1,
Delete 2 (the only one for blank and repeated rows), Insert an empty user/assistant row 5; a truncated row that is not
deleted adds 5. A forward heap from the entry and a reverse heap from the exits advance towards each other; they stop when
no crossing of the least cost can be left, and of all crossings of that cost the one with the least concatenated audit
(initials K, R, D, I, compared as ASCII) is taken. Roles of inserted and re-roled rows follow from the state.

No conversation is gathered for the search: slim rows (turn, fault, initial of the role, digest) are range-partitioned by
(conversation, turn), so a conversation with a third of all rows lies in many tasks, and are cut into blocks of at most
``BLOCK`` rows. A block that may have neighbours is searched once for every pair of entry and exit state. A fold then walks
the blocks of a conversation in order and keeps one (cost, audit) for each of four states. That is exact: two paths of equal
cost between the same nodes are never prefixes of each other (the longer one would only add paid inserts), so the least audit
of a whole is made of least audits of its parts. ``repaired_rows`` streams the texts once past the audits.

Defined cases: a null role or text counts as one space (so does a null id or turn in the key of ``damage``); an empty role has
no initial and fits nowhere; null turns come first and all count as one turn; rows of equal turn are ordered by the digest of
(role, text), so equal rows stand together; a null conv_id is a conversation of its own; turns that are not numbers are null;
gaps beyond a long are its largest value; of an empty table nothing is returned. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512
SPACES = " \t\n\x0b\x0c\r"
INITIALS, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
#: States: 0 nothing kept yet, 1 after s, 2 after u, 3 after a. Exit 4 stands for the accepting ones, 0 and 3.
NEXT = (2, 2, 3, 2)
KEEP = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
ACCEPT = (0, 3)
DONE = 4
_LONG = (1 << 63) - 1


def code(initial: int, fault: int) -> str:
    """One letter for a row: initial 0 s, 1 u, 2 a, 3 other; fault as in ``FAULTS``."""
    return chr(65 + 4 * initial + fault)


def _steps(codes: str, i: int, q: int):
    """Arcs out of node (i, q): (cost, letter, node)."""
    yield 5, "I", (i, NEXT[q])
    if i < len(codes):
        initial, fault = divmod(ord(codes[i]) - 65, 4)
        yield 2, "D", (i + 1, q)
        if fault < 2:
            if initial < 3 and KEEP[q][initial] is not None:
                yield 5 * fault, "K", (i + 1, KEEP[q][initial])
            yield 1 + 5 * fault, "R", (i + 1, NEXT[q])


def _steps_back(codes: str, i: int, q: int):
    """Arcs into node (i, q): (cost, letter, node)."""
    if i:
        initial, fault = divmod(ord(codes[i - 1]) - 65, 4)
        yield 2, "D", (i - 1, q)
    for p in range(4):
        if NEXT[p] == q:
            yield 5, "I", (i, p)
        if i and fault < 2:
            if initial < 3 and KEEP[p][initial] == q:
                yield 5 * fault, "K", (i - 1, p)
            if NEXT[p] == q:
                yield 1 + 5 * fault, "R", (i - 1, p)


@lru_cache(maxsize=20_000)
def cheapest(codes: str, entry: int, exit_: int) -> tuple[int, str] | None:
    """Least cost, and the ASCII-least audit of that cost, from state ``entry`` before the rows to ``exit_`` after them.

    Heap keys are (cost, rows dealt with): arcs of no cost always take a row, so when a node is popped all its
    predecessors on cheapest paths were popped before it and its audit is final.
    """
    n = len(codes)
    ends = [(n, q) for q in (ACCEPT if exit_ == DONE else (exit_,))]
    cost = ({(0, entry): 0}, dict.fromkeys(ends, 0))
    audit = ({(0, entry): ""}, dict.fromkeys(ends, ""))
    heaps = [[(0, 0, entry)], [(0, -i, q) for i, q in ends]]
    settled: tuple[set, set] = (set(), set())
    best = 0 if (0, entry) in ends else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0][0] <= heaps[0][0][0])
        c, i, q = heapq.heappop(heaps[side])
        node = (abs(i), q)
        if node in settled[side]:
            continue
        settled[side].add(node)
        mine, other, text = cost[side], cost[1 - side], audit[side][node]
        for w, letter, to in (_steps_back if side else _steps)(codes, *node):
            if to not in settled[side]:
                said = letter + text if side else text + letter
                if to not in mine or c + w < mine[to]:
                    mine[to], audit[side][to] = c + w, said
                    heapq.heappush(heaps[side], (c + w, -to[0] if side else to[0], to[1]))
                elif c + w == mine[to] and said < audit[side][to]:
                    audit[side][to] = said
            if to in other and (best is None or c + w + other[to] < best):
                best = c + w + other[to]
    if best is None:
        return None
    # Every cheapest path has an arc from a node settled forward to one settled in reverse, or one side settled all of it.
    found = [audit[0][e] for e in ends if e in settled[0] and cost[0][e] == best]
    found += [audit[1][s] for s in [(0, entry)] if s in settled[1] and cost[1][s] == best]
    found += [audit[0][u] + letter + audit[1][v] for u in settled[0] for w, letter, v in _steps(codes, *u)
              if v in settled[1] and cost[0][u] + w + cost[1][v] == best]
    return best, min(found)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a rule-made damage: crc32 of ``conv_id:turn`` modulo 20 drops the row (0), empties its
    text (1), removes its ``[.!?]`` (2), repeats it (3) or makes its role user (4). Nulls count as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"),
                                kind.alias("kind")).where(F.col("kind") != 0)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _key(conv: Column) -> Column:
    """A text for each conversation, never null."""
    return F.concat(F.when(conv.isNull(), "n").otherwise("v"), F.coalesce(conv.cast("string"), F.lit("")))


def _keyed(rows: DataFrame) -> DataFrame:
    """key, conv_id, has_turn, turn, role, text, digest of (role, text): sorting by (key, has_turn, turn, digest) is the
    order of the rows."""
    turn = F.col("turn").try_cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return rows.select(_key(F.col("conv_id")).alias("key"), "conv_id", turn.isNotNull().alias("has_turn"),
                       F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


_BLOCKS = pa.schema([("key", pa.string()), ("task", pa.int64()), ("seq", pa.int64()), ("codes", pa.string()),
                     ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                     ("moves", pa.list_(pa.struct([("entry", pa.int64()), ("leave", pa.int64()), ("cost", pa.int64()),
                                                   ("audit", pa.string())])))])
_BLOCKS_SQL = ("key string, task long, seq long, codes string, turns long, first_turn long, last_turn long, "
               "moves array<struct<entry: long, leave: long, cost: long, audit: string>>")


def _moves(codes: str, open_left: bool, open_right: bool) -> list[dict]:
    out = []
    for entry in range(4) if open_left else (0,):
        for leave in range(4) if open_right else (DONE,):
            if (found := cheapest(codes, entry, leave)) is not None:
                out.append({"entry": entry, "leave": leave, "cost": found[0], "audit": found[1]})
    return out


def _search_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of a task, each with its cheapest edits. The first and the last conversation of a task may
    go on in another one; all others are whole here."""
    from pyspark import TaskContext

    task, seq, made = TaskContext.get().partitionId(), 0, []
    key, codes, turns, seen, left, is_first = None, [], [], None, False, True

    def close(right: bool) -> None:
        nonlocal seq, codes, turns, left
        text = "".join(codes)
        made.append({"key": key, "task": task, "seq": seq, "codes": text, "turns": len(turns),
                     "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                     "moves": _moves(text, left, right)})
        seq, codes, turns, left = seq + 1, [], [], True

    def flush():
        nonlocal made
        out, made = pa.RecordBatch.from_pylist(made, _BLOCKS), []
        return out

    for b in batches:
        for k, has_turn, turn, initial, fault, later, digest in zip(*(b.column(c).to_pylist() for c in (
                "key", "has_turn", "turn", "initial", "fault", "later", "digest"))):
            if k != key:
                if key is not None:
                    close(False)
                    is_first = False
                key, seen, left = k, None, is_first
            elif len(codes) == block:
                close(True)
            if fault != 2 and (later or seen == (has_turn, turn, digest)):
                fault = 3
            seen = (has_turn, turn, digest)
            codes.append(code(initial, fault))
            if has_turn and (not turns or turns[-1] != turn):
                turns.append(turn)
        if len(made) >= 1000:
            yield flush()
    if key is not None:
        close(True)
        yield flush()


_FOLDED = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal",
                                                                       "cost")), ("audit", pa.string())])
_FOLDED_SQL = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Path:
    """An audit as a chain of parts: paths of a conversation share their beginnings."""
    __slots__ = ("before", "part", "parts")

    def __init__(self, before: "_Path | None", part: str):
        self.before, self.part, self.parts = before, part, before.parts + 1 if before else 1

    def text(self, stop: "_Path | None" = None) -> str:
        out, p = [], self
        while p is not stop:
            out.append(p.part)
            p = p.before
        return "".join(reversed(out))

    def less(self, other: "_Path") -> bool:
        """Both have as many parts; compared from where they part."""
        a, b = self, other
        while a is not b and a is not None:
            a, b = a.before, b.before
        return self.text(a) < other.text(a)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, from its blocks in order: counts, and the cheapest edits through all blocks."""
    made: list[dict] = []
    key = None

    def close() -> None:
        ends = [states[q] for q in (DONE, *ACCEPT) if q in states]
        least = min(c for c, _ in ends)
        audit = min(p.text() for c, p in ends if c == least)
        gaps = min(_LONG, high - low + 1 - turns) if turns else 0
        made.append({"key": key, "gaps": gaps, "illegal": illegal, "cost": least, "audit": audit,
                     **{FAULTS[f]: faults[f] for f in (1, 2, 3)}})

    def flush():
        nonlocal made
        out, made = pa.RecordBatch.from_pylist(made, _FOLDED), []
        return out

    for b in batches:
        for r in b.to_pylist():
            if r["key"] != key:
                if key is not None:
                    close()
                key, states, faults = r["key"], {0: (0, None)}, [0, 0, 0, 0]
                illegal = turns = 0
                low = high = last = last_turn = None
            pairs = [divmod(ord(c) - 65, 4) for c in r["codes"]]
            for initial, fault in pairs:
                faults[fault] += 1
                illegal += last is not None and (last, initial) not in ((0, 1), (1, 2), (2, 1))
                last = initial
            if r["turns"]:
                turns += r["turns"] - (r["first_turn"] == last_turn)
                low, high, last_turn = r["first_turn"] if low is None else low, r["last_turn"], r["last_turn"]
            new: dict[int, tuple[int, _Path]] = {}
            for m in r["moves"]:
                if m["entry"] in states:
                    cost, path = states[m["entry"]]
                    at = (cost + m["cost"], _Path(path, m["audit"]))
                    old = new.get(m["leave"])
                    if old is None or at[0] < old[0] or at[0] == old[0] and at[1].less(old[1]):
                        new[m["leave"]] = at
            states = new
        if len(made) >= 1000:
            yield flush()
    if key is not None:
        close()
        yield flush()


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): key, conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. ``block``: most rows that one search takes; any value gives the same rows."""
    k = _keyed(rows)
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(body == "", 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    slim = k.select("key", "has_turn", "turn", "digest", initial.alias("initial"), fault.alias("fault"))
    place = F.struct("has_turn", "turn")
    seen = slim.groupBy("key", "digest").agg(F.min(place).alias("earliest"))
    slim = slim.join(seen, ["key", "digest"]).withColumn("later", place > F.col("earliest")).drop("earliest")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "has_turn", "turn", "digest"]
    blocks = slim.repartitionByRange(n, *order).sortWithinPartitions(*order) \
        .mapInArrow(lambda batches: _search_blocks(batches, block), _BLOCKS_SQL)
    folded = (blocks.repartition(n, "key").sortWithinPartitions("key", "task", "seq").mapInArrow(_fold, _FOLDED_SQL))
    ids = rows.select(_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    return ids.join(folded, "key")


_ROWS = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each conversation, after its audit, turned into the repaired ones."""
    key, audit, at, state, seq = None, "", 0, 0, 0
    made: list[tuple] = []

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal seq
        made.append((key, seq, edit, role, text))
        seq += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            emit("I", "user" if state == 2 else "assistant", "")

    def flush():
        nonlocal made
        out, made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), _ROWS)], schema=_ROWS), []
        return out

    for b in batches:
        for k, said, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "audit", "role", "text"))):
            if said is not None:
                inserts()
                key, audit, at, state, seq = k, said, 0, 0, 0
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEEP[state][INITIALS.index(role[0])]
                emit("K", role, text)
            elif edit == "R":
                state = NEXT[state]
                emit("R", "user" if state == 2 else "assistant", text)
        if made:
            yield flush()
    inserts()
    if made:
        yield flush()


def repaired_rows(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """key, seq, edit (K, R or I), role, text of the repaired conversations; ``repaired`` is what ``repair`` returned for
    ``rows``. The rows of a conversation come one after another within a partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    texts = _keyed(rows).select("key", none.cast("string").alias("audit"), "has_turn", "turn", "digest", "role", "text")
    audits = repaired.select("key", "audit", F.lit(False).alias("has_turn"), F.lit(0).cast("long").alias("turn"),
                             none.cast("binary").alias("digest"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    order = ["key", F.col("audit").desc_nulls_last(), "has_turn", "turn", "digest"]
    return (audits.unionByName(texts).repartition(n, "key").sortWithinPartitions(*order)
            .select("key", "audit", "role", "text").mapInArrow(_apply, "key string, seq long, edit string, role string, text string"))


def text_digests(repaired: DataFrame) -> DataFrame:
    """key, repaired_sha256 of rows as ``repaired_rows`` yields them: SHA-256 of the ``role:text`` lines, fed row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, sums = [], []
            for k, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "role", "text"))):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        sums.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if keys:
                yield pa.RecordBatch.from_pydict({"key": keys, "repaired_sha256": sums})
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [state.hexdigest()]})
    return repaired.mapInArrow(run, "key string, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The contract's row for every conversation of ``conversations``, whose rows after damage are ``rows``."""
    # the audits are read twice (result and text stream): written once, the search is not repeated
    done = repair(rows, block).drop("conv_id").checkpoint(eager=True)
    digests = text_digests(repaired_rows(rows, done))
    ids = conversations.select(_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    out = ids.join(done, "key", "left").join(digests, "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
