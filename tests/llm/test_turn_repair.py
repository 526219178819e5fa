"""Conversation repair against a shortest-path search, a full CYK over all splits, and a plain version of the query."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from contrail.llm import turn_repair as R

BLANK = " \t\n\v\f\r"


def full_cyk(symbols):
    """Every span, by length, over every split."""
    n = len(symbols)
    cells = {(i, i + 1): R.terminal(c) for i, c in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            found = [R.combine(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            cells[i, i + size] = tuple(min((f[x] for f in found if f[x] is not None), default=None) for x in range(16))
    return cells[0, n] if n else R.EMPTY


def search(symbols):
    """Dijkstra over (cost, audit) with rows taken one after the other; knows nothing of spans."""
    pattern = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(symbols) and state in ("", "a"):
            return cost, audit
        for c in "ua":
            if (state, c) in pattern:
                heapq.heappush(heap, (cost + 5, audit + "I", i, c))
        if i < len(symbols):
            x = symbols[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if x != "D":
                extra = 5 if x.isupper() else 0
                if (state, x.lower()) in pattern:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, x.lower()))
                for c in "ua":
                    if (state, c) in pattern:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, c))


@pytest.mark.parametrize("n", range(4))
def test_all_short_sequences(n):
    for symbols in itertools.product("suaxSUAXD", repeat=n):
        s = "".join(symbols)
        assert R.cheapest(R.parse(s)) == search(s) == R.cheapest(full_cyk(s)), s


def test_longer_sequences():
    r = random.Random(4)
    for _ in range(300):
        s = "".join(r.choices("suaxSUAXD", [2, 6, 6, 1, 1, 2, 2, 1, 3], k=r.randrange(4, 60)))
        assert R.cheapest(R.parse(s)) == search(s), s
    s = "".join(r.choices("suaxUAD", k=18))
    assert R.parse(s) == full_cyk(s)


def plain(rows):
    """The whole query in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, symbols, faults = set(), "", dict.fromkeys("bdt", 0)
        for _, role, text in after:
            body = text.rstrip(BLANK)
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("b", "d") else i.upper() if fault == "t" else i
        cost, audit = search(symbols)
        lines, state, at = [], "", 0
        for edit in audit:
            if edit in "DK" or edit == "R":
                _, role, text = after[at]
                at += 1
            if edit == "D":
                continue
            if edit in "RI":
                role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:{'' if edit == 'I' else text}")
            state = role[0]
        turns = [t for t, _, _ in after if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["b"], faults["d"], faults["t"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, schema="conv_id long, turn long, role string, text string"):
    found = R.conversation_repairs(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_against_plain_version(spark):
    r = random.Random(11)
    texts = ["Yes.", "No!", "why?", "cut", "", " ", "\t\n", "end. \n", "a\nb.", "x .", None, "é…", "Yes.\x85"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            for _ in range(r.choice([1, 1, 1, 2])):
                rows.append((conv, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                             r.choice(texts) if r.random() < .5 else f"say {r.randrange(999)}" + r.choice([".", "?", ""])))
    assert got(spark, rows) == plain(rows)


def test_one_conversation_over_many_partitions(spark):
    """A conversation of thousands of rows with tied turns, whose pieces meet from many tasks."""
    r = random.Random(2)
    rows = [(7, t // 3, r.choice(["user", "assistant"]), f"line {r.randrange(2500)}" + r.choice([".", ""])) for t in range(6000)]
    rows += [(7, 40, "user", "the same.")] * 3000 + [(8, 0, "system", "Hello."), (8, 1, "user", "Hi.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_edges(spark):
    assert got(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    long = "word " * 400_000 + "end."
    rows = [(1, t, role, long) for t, role in ((0, "user"), (1, "assistant"), (None, None))]
    assert got(spark, rows) == plain(rows)
    extra = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3)], "conv_id long, turn long, role string, text string, seq string, n int")
    assert R.conversation_repairs(extra).count() == 1


def test_repaired_rows(spark):
    rows = [(5, 0, "user", "A."), (5, 3, "user", "B.")]
    base = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long")
    found = R.repaired(base, base).where("place >= 0").orderBy("place").select("edit", "role", "text").collect()
    assert [tuple(x) for x in found] == [("K", "user", "A."), ("R", "assistant", "B.")]
