"""Conversation repair: the cheapest edits that make a conversation's roles
``(s?(ua)+)?``, found by Hirschberg's divide and conquer over four states.

Rows of a conversation are taken by turn (null first), then role, then the text's
MD5, repeated rows side by side. A row is blank (nothing but white space), else a
duplicate (its role and text came earlier), else truncated (its last visible
character is not one of ``.!?``). Edits: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only edit for blanks and duplicates), Insert an empty user or
assistant message 2; a truncated row that stays adds 1. An audit is the edits'
initials in order; of the cheapest audits the ASCII-least counts.

States: nothing yet, after the system message, after a user, after an assistant.
For a stretch of rows, ``through`` gives for each end state the least cost and the
rank of its least audit among the four. An audit of a stretch ends with its last
row's own edit (inserts belong to the row after them), so no audit is a prefix of
another and ranks decide ties without the audits themselves. Hirschberg: the
forward vector of the first half and the backward vector of the second meet; the
cheapest crossing, of equals the one of least rank, splits the stretch in two, and
each half is solved alone. Memory is linear in the rows, never rows x states.

Scale: the narrow rows (no texts) are range-partitioned and sorted, so that a
conversation of any length spreads over many tasks, and cut in blocks of at most
BLOCK rows. Each block is reduced to a 4 x 4 table; the same divide and conquer over a
conversation's blocks (one small row each) gives the states between them, and then
blocks are solved apart. Only the answer, one audit and one hash over all of a
conversation's text, is put together in one stream a conversation, which holds one
message at a time.

A null role or text is one space; a null conv_id is a conversation like others; a null
turn comes first. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import scratch, small, table, to_arrow

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
INFINITY = 1 << 40
KEEP, DELETE, OTHER = 0, 3, 2  # costs; OTHER is that of Rerole and of Insert
FAULTS = ("", "blank", "duplicate", "truncated")
CLOSING = (("", 0), ("II", 4), ("I", 2), ("", 0))  # edits after the last row, by state
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # state after an inserted or re-roled message

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # least costs and audit ranks by state
Item = tuple[Vector, ...]  # one vector for each start state


def _walk(state: int, word: str, initial: str) -> int | None:
    """The state after the edits ``word`` whose last one falls on a row."""
    for edit in word:
        if edit in "IR":
            state = _NEXT[state]
        elif edit == "K":
            ends = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {})
            if state not in ends:
                return None
            state = ends[state]
    return state


@lru_cache(maxsize=None)
def words(initial: str, fault: int) -> tuple[dict[int, tuple[int, str]], ...]:
    """For each start state, end state -> (cost, least word) of one row."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        for inserts in range(4):
            for edit, cost in (("K", KEEP), ("R", OTHER), ("D", DELETE)):
                if edit != "D" and fault in (1, 2):
                    continue
                word = "I" * inserts + edit
                end = _walk(state, word, initial)
                cost += OTHER * inserts + (fault == 3 and edit != "D")
                if end is not None and (cost, word) < best.get(end, (INFINITY, "")):
                    best[end] = cost, word
        out.append(best)
    return tuple(out)


def _ranked(keys: list[tuple]) -> tuple[int, ...]:
    order = sorted(range(4), key=keys.__getitem__)
    return tuple(order.index(i) for i in range(4))


@lru_cache(maxsize=None)
def row_item(initial: str, fault: int) -> Item:
    return tuple((tuple(best.get(q, (INFINITY, ""))[0] for q in range(4)),
                  _ranked([(best[q][1],) if q in best else ("~", q) for q in range(4)])) for best in words(initial, fault))


def at(state: int) -> Vector:
    return tuple(0 if q == state else INFINITY for q in range(4)), (0, 1, 2, 3)


def through(vector: Vector, item: Item) -> Vector:
    """The forward vector behind ``item``. Ranks compare where an audit stood before
    the item, then its words within it."""
    costs, ranks = vector
    best = [min((min(costs[p] + item[p][0][q], INFINITY), ranks[p], item[p][1][q]) for p in range(4)) for q in range(4)]
    return tuple(b[0] for b in best), _ranked([(b[0] >= INFINITY, b[1], b[2]) for b in best])


def _back(costs: tuple[int, ...], item: Item) -> tuple[int, ...]:
    return tuple(min(min(item[p][0][q] + costs[q] for q in range(4)), INFINITY) for p in range(4))


@lru_cache(maxsize=1 << 16)
def _step(vector: Vector, initial: str, fault: int) -> Vector:
    return through(vector, row_item(initial, fault))


def _forward(vector: Vector, items: list, lo: int, hi: int) -> Vector:
    """Through items[lo:hi]; rows' vectors, less their least cost, are few and cached."""
    for i in range(lo, hi):
        item = items[i]
        if isinstance(item[0], str):
            least = min(vector[0])
            costs, ranks = _step((tuple(min(c - least, INFINITY) for c in vector[0]), vector[1]), *item)
            vector = tuple(min(c + least, INFINITY) for c in costs), ranks
        else:
            vector = through(vector, item)
    return vector


def _item(item) -> Item:
    return row_item(*item) if isinstance(item[0], str) else item


def block_item(rows: list[tuple[str, int]]) -> Item:
    """The table of a stretch of (initial, fault) rows."""
    return tuple(_forward(at(p), rows, 0, len(rows)) for p in range(4))


def crossings(items: list, start: int, end: int | None) -> list[int]:
    """The states behind each item on the least of the cheapest ways from ``start`` to
    ``end`` (None: any end that closes cheapest)."""
    states = [start] * len(items)
    if not items:
        return states
    if end is None:
        costs, ranks = _forward(at(start), items, 0, len(items))
        end = min(range(4), key=lambda q: (costs[q] + CLOSING[q][1], ranks[q]))
    todo = [(0, len(items), start, end)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo == 1:
            states[lo] = q
            continue
        mid = (lo + hi) // 2
        costs, ranks = _forward(at(p), items, lo, mid)
        rest = at(q)[0]
        for i in range(hi - 1, mid - 1, -1):
            rest = _back(rest, _item(items[i]))
        x = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
        todo += [(lo, mid, p, x), (mid, hi, x, q)]
    return states


def row_edits(rows: list[tuple[str, int]], start: int, end: int | None) -> list[str]:
    """One word a row: the inserts before it and its own edit."""
    out, state = [], start
    for row, after in zip(rows, crossings(rows, start, end)):
        out.append(words(*row)[state][after][1])
        state = after
    return out


# --- tables ---------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20:
    0 is lost (``copies`` 0), 1 has its text emptied, 2 loses its ``.!?``, 3 stands
    twice (``copies`` 2), 4 is given the role user."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    act = F.crc32(F.concat(given[0], F.lit(":"), given[1])) % 20
    return conversations.select("conv_id", "turn", act.alias("act"), given[2].alias("role"), given[3].alias("text")).select(
        "conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("act") == 0, 0).when(F.col("act") == 3, 2).otherwise(1).alias("copies"))


def _order() -> list:
    return [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest", "copy")]


def _messages(rows: DataFrame) -> DataFrame:
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), copies.cast("bigint").alias("copies"))


def _faulty(messages: DataFrame) -> DataFrame:
    """One narrow row per message and copy with its fault. Repeated rows collapse before
    the shuffle; a message is a duplicate unless no earlier turn has its role and text."""
    seen = F.rtrim("text", F.lit(SPACE))
    own = (F.when(seen == "", 1).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), 3).otherwise(0)).alias("own")
    rows = (messages.filter("copies > 0").select("conv_id", "turn", "role", "digest", own, "copies")
            .groupBy("conv_id", "turn", "role", "digest", "own").agg(F.sum("copies").alias("copies")))
    first = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(
        F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_null"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    is_first = F.col("turn").isNull() | (~F.col("_null") & (F.col("turn") == F.col("_least")))
    copies = rows.select("conv_id", "turn", "role", "digest", "own", is_first.alias("_first"),
                         F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    fault = F.when(F.col("own") == 1, 1).when(~F.col("_first") | (F.col("copy") > 1), 2).otherwise(F.col("own"))
    return copies.select("conv_id", "turn", "role", "digest", "copy", fault.cast("int").alias("fault"))


def _stream(df: DataFrame, schema: str, run: Callable[[Iterator[tuple]], Iterable[tuple]], at_once: int = 20_000) -> DataFrame:
    """``run`` over the rows of each partition, in their order."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow(fields)

    def task(batches):
        rows = (row for b in batches for part in small(b) for row in zip(*(c.to_pylist() for c in part.columns)))
        held = []
        for row in run(rows):
            held.append(row)
            if len(held) >= at_once:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), out)], schema=out)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), out)], schema=out)

    return df.mapInArrow(task, fields)


def _runs(rows: Iterator[tuple], width: int, limit: int | None = None) -> Iterator[tuple]:
    """(key, list of rows) of neighbouring rows that agree in their first ``width`` values."""
    key, held = None, []
    for row in rows:
        if held and (row[:width] != key or (limit and len(held) >= limit)):
            yield key, held
            held = []
        key = row[:width]
        held.append(row)
    if held:
        yield key, held


def edits(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, digest, copy, fault, word): each message's edit."""
    conv = messages.schema["conv_id"].dataType.simpleString()
    row = "struct<turn:bigint,role:string,digest:binary,copy:bigint,fault:int>"
    ordered = _faulty(messages).repartitionByRange(*_order()).sortWithinPartitions(*_order()).select(
        F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "digest", "copy", "fault")

    def blocks(rows):
        for n, ((part, conv_id), held) in enumerate(_runs(rows, 2, block)):
            item = block_item([(r[3][:1], r[6]) for r in held])
            yield (conv_id, part, n, [dict(zip(("turn", "role", "digest", "copy", "fault"), r[2:])) for r in held],
                   [x for vector in item for side in vector for x in side])

    cut = scratch(_stream(ordered, f"conv_id {conv}, part int, block int, rows array<{row}>, item array<bigint>", blocks, 500), "blocks")

    def between(rows):
        for _, held in _runs(rows, 1):
            items = [tuple((tuple(r[3][8 * p:8 * p + 4]), tuple(r[3][8 * p + 4:8 * p + 8])) for p in range(4)) for r in held]
            start = 0
            for r, end in zip(held, crossings(items, 0, None)):
                yield r[1], r[2], start, end
                start = end

    order = [F.asc_nulls_first("conv_id"), "part", "block"]
    states = scratch(_stream(cut.select("conv_id", "part", "block", "item").repartition("conv_id").sortWithinPartitions(*order),
                             "part int, block int, start int, end int", between), "states")

    def solve(rows):
        for conv_id, held, start, end in rows:
            found = row_edits([(r["role"][:1], r["fault"]) for r in held], start, end)
            for r, word in zip(held, found):
                yield conv_id, r["turn"], r["role"], r["digest"], r["copy"], r["fault"], word

    return _stream(cut.join(states, ["part", "block"]).select("conv_id", "rows", "start", "end"),
                   f"conv_id {conv}, turn bigint, role string, digest binary, copy bigint, fault int, word string", solve)


def _told(conversation: Iterable[tuple], say: Callable[[str, str], None]) -> dict:
    """Figures of one conversation from its texts and edits in order; ``say`` gets each
    message of the repaired one."""
    n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0}
    state, text, audit = 0, None, []
    first = last = before = None
    for _, turn, role, _, copy, fault, word, body in conversation:
        if copy <= 0:
            text = body
            continue
        if fault:
            n[FAULTS[fault]] += 1
        if turn is not None:
            first = turn if first is None else first
            n["turns"] += turn != last
            last = turn
        n["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        audit.append(word)
        n["cost"] += OTHER * (word.count("I") + word.count("R")) + DELETE * word.count("D") + (fault == 3 and "D" not in word)
        for edit in word:
            if edit in "IR":
                state = _NEXT[state]
                say(("user", "assistant")[state == 3], "" if edit == "I" else text)
            elif edit == "K":
                state = _walk(state, "K", role[:1])
                say(role, text)
    for _ in CLOSING[state][0]:
        state = _NEXT[state]
        audit.append("I")
        n["cost"] += OTHER
        say(("user", "assistant")[state == 3], "")
    n["gaps"] = 0 if first is None else last - first + 1 - n["turns"]
    n["audit"] = "".join(audit)
    return n


def _joined(rows: DataFrame, block: int) -> DataFrame:
    """Texts and edits of each conversation in order, a text before its edits. Messages
    that are lost leave a row, so that every conversation is there."""
    messages = _messages(rows)
    kept = F.col("copies") > 0
    texts = messages.select("conv_id", "turn", "role", F.when(kept, F.col("digest")).alias("digest"), F.lit(0).cast("bigint").alias("copy"),
                            F.lit(0).alias("fault"), F.lit("").alias("word"), F.when(kept, F.col("text")).alias("body"))
    all_rows = texts.union(edits(messages, block).withColumn("body", F.lit(None).cast("string")))
    return all_rows.repartition("conv_id").sortWithinPartitions(*_order())


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, iterator of its rows), streamed."""
    row = next(rows, None)
    while row is not None:
        conv_id, pending = row[0], [row]

        def own():
            while pending:
                yield pending.pop()
                following = next(rows, None)
                if following is not None:
                    (pending if following[0] == conv_id else left).append(following)

        left: list = []
        yield conv_id, own()
        row = left.pop() if left else None


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: its faults, cheapest audit and the hash of the repaired
    conversation (``role:text``, newline-joined)."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def run(given):
        for conv_id, conversation in _groups(given):
            sha, said = hashlib.sha256(), []

            def say(role, text):
                sha.update(("\n" * bool(said) + f"{role}:{text}").encode())
                said[:] = [1]

            told = _told(conversation, say)
            yield (conv_id, *(told[c] for c in names), sha.hexdigest())

    return _stream(_joined(rows, block), f"conv_id {conv}, " + ", ".join(f"{c} bigint" for c in names[:-1])
                   + ", audit string, repaired_sha256 string", run)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text), place from 0."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(given):
        for conv_id, conversation in _groups(given):
            said: list[tuple[str, str]] = []
            _told(conversation, lambda role, text: said.append((role, text)))
            for place, (role, text) in enumerate(said):
                yield conv_id, place, role, text

    return _stream(_joined(rows, block), f"conv_id {conv}, place bigint, role string, text string", run)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damage(table(spark, sf_dir, "conversations")))
