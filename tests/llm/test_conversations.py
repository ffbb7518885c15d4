"""Conversation repair against a plain search over all audits, and odd tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import conversations as C

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, audit) of (initial, fault) rows, every state carrying its best audit."""
    paths = {(0, 0, "")}
    for initial, fault in rows:
        grown = set()
        for state, cost, audit in paths:
            for n in range(3):
                s, word = state, "I" * n
                for _ in range(n):
                    s = 3 if s == 2 else 2
                c = cost + 2 * n
                grown.add((s, c + 3, audit + word + "D"))
                if fault in (1, 2):
                    continue
                extra = int(fault == 3)
                grown.add((3 if s == 2 else 2, c + 2 + extra, audit + word + "R"))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, s))
                if to is not None:
                    grown.add((to, c + extra, audit + word + "K"))
        least = {}
        for s, c, a in grown:
            least[s] = min(least.get(s, (1 << 30, "")), (c, a))
        paths = {(s, *v) for s, v in least.items()}
    close = {0: "", 1: "II", 2: "I", 3: ""}
    return min((c + 2 * len(close[s]), a + close[s]) for s, c, a in paths)


def exhaustive(rows):
    """Every audit with at most two inserts in a row."""
    found = []

    def go(i, state, cost, audit):
        if i == len(rows):
            found.append((cost + {0: 0, 1: 4, 2: 2, 3: 0}[state], audit + {0: "", 1: "II", 2: "I", 3: ""}[state]))
            return
        initial, fault = rows[i]
        for n in range(3):
            s = state
            for _ in range(n):
                s = 3 if s == 2 else 2
            c, a = cost + 2 * n, audit + "I" * n
            go(i + 1, s, c + 3, a + "D")
            if fault not in (1, 2):
                go(i + 1, 3 if s == 2 else 2, c + 2 + (fault == 3), a + "R")
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, s))
                if to is not None:
                    go(i + 1, to, c + (fault == 3), a + "K")

    go(0, 0, 0, "")
    return min(found)


def audit_of(rows):
    audit = "".join(C.row_edits(rows, 0, None))
    state = 0
    for (initial, _), word in zip(rows, C.row_edits(rows, 0, None)):
        state = C._walk(state, word, initial)
    return audit + C.CLOSING[state][0]


def test_hirschberg_equals_search():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suaaux"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 5))]
        assert audit_of(rows) == exhaustive(rows)[1] == cheapest(rows)[1]
    for _ in range(300):
        rows = [(rng.choice("suauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 60))]
        assert audit_of(rows) == cheapest(rows)[1]


def test_blocks_equal_rows():
    rng = random.Random(5)
    for _ in range(100):
        rows = [(rng.choice("suauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 40))]
        parts = [rows[i:i + 7] for i in range(0, len(rows), 7)]
        ends = C.crossings([C.block_item(p) for p in parts], 0, None)
        starts = [0] + ends[:-1]
        got = "".join(w for p, s, e in zip(parts, starts, ends) for w in C.row_edits(p, s, e)) + C.CLOSING[ends[-1]][0]
        assert got == cheapest(rows)[1]


def expected(rows):
    """The contract, row by row."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        name = lambda v: " " if v is None else str(v)
        act = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if act == 0:
            continue
        text = "" if act == 1 else "".join(c for c in text if c not in ".!?") if act == 2 else text
        role = "user" if act == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if act == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            visible = text.rstrip(C.SPACE)
            faults.append(1 if not visible else 2 if (role, text) in seen else 3 if visible[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(own, faults)])
        state, at, said = 0, 0, []
        for edit in audit:
            if edit == "I":
                state = 3 if state == 2 else 2
                said.append(("user", "assistant")[state == 3] + ":")
                continue
            _, role, text = own[at]
            at += 1
            if edit == "R":
                state = 3 if state == 2 else 2
                said.append(("user", "assistant")[state == 3] + ":" + text)
            elif edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                said.append(f"{role}:{text}")
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [3, C.BLOCK])
def test_query_equals_brute_force(spark, block):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert got(C.audits(C.damage(table), block)) == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 3, "user", "Hm."), (7, None, "system", "S."), (7, 1, "user", ""), (7, 1, "user", "x" * 200_000),
            (8, 5, "", "A."), (8, 5, "", "A."), (8, 9, "User", "B."), (9, 1, "user", " \t\n")]
    rows += [(1, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "No", "", None, "Ü?"])) for t in range(300)]
    rows += [(2, 4, "user", "Same.")] * 50
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("digest", "fault", "copy", "word", "part")))
    assert got(C.audits(C.damage(df), 16)) == expected(rows)
    assert C.audits(C.damage(df.limit(0))).collect() == []
    # every message lost: the conversation is still there
    lost = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    one = got(C.audits(C.damage(spark.createDataFrame([(lost, 0, "user", "A.")], SCHEMA))))
    assert one == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "So.")]
    out = C.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    roles = {c: [(r.role, r.text) for r in out if r.conv_id == c] for c in (1, 2)}
    assert [r for r, _ in roles[1]] == ["user", "assistant"] * (len(roles[1]) // 2)
    assert roles[2] == [("user", ""), ("assistant", "So.")]
