"""Repeated byte strings by two-stage suffix sorting: bytes covered by a WINDOW-byte
string that also starts anywhere else are removed, in the same text or another.

Texts are compared as UTF-8 bytes and never across their ends; strings are judged on
the input. Rows of one text count once each, so a text that stands in two rows is
repeated throughout.

1. Every window of a text picks its least-hashed GRAM-byte gram. Neighbouring windows
   that pick the same gram form a stretch. Equal windows pick equal grams at equal
   places, so a match lies between two stretches of one gram, at one distance from it.
   Stretches are known by a 128-bit digest; one that stands twice is repeated as a
   whole. Where a gram has several different stretches, one of each is sorted.
2. Suffixes that are smaller than their successors are sorted directly, by their first
   WINDOW bytes. The others are induced: a scan over the buckets of first bytes, in
   order, hands each suffix's predecessor to the next free place of its bucket.
3. Neighbours in suffix order that share WINDOW bytes are repeated.

Scale: only narrow rows (a digest about every 140 bytes) are shuffled for step 1, and
only stretches whose gram is met in another one are fetched. A gram with more than
CROWD different stretches is halved by the windows' distance from the gram: windows of
half the distances share a longer string, which takes the gram's place, and pieces that
are now equal settle each other (single windows always are). So no sort holds more than CROWD stretches
of one key, and a passage in a third of all texts is spread over many tasks.

Null texts are empty; texts shorter than WINDOW have nothing to remove. Long texts are
read in chunks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, scratch, small, table, to_arrow

WINDOW = 400
GRAM = 128
CROWD = 256
_SORT = 1 << 16  # bytes sorted at once
_CHUNK = 1 << 19  # window starts of a text handled at once
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = 20
_LOW = np.uint64((1 << _PLACE_BITS) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))


class Stretches:
    """Finds the stretches of a text; made once per task."""

    def __init__(self, window: int, gram: int):
        n = _CHUNK + window
        self.window, self.gram = window, gram
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.codes = np.random.RandomState(1).randint(0, 1 << 63, 256, np.int64).astype(np.uint64)

    def of(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(gram, place of the gram, first window, windows) arrays of each chunk."""
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data) - self.window + 1, _CHUNK):
            part = data[at:at + _CHUNK + self.window - 1]
            n = len(part)
            prefix = np.append(np.uint64(0), np.cumsum(self.codes[part] * self.up[:n], dtype=np.uint64))
            grams = (prefix[self.gram:] - prefix[:-self.gram]) * self.down[:n - self.gram + 1]
            grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            grams ^= grams >> np.uint64(29)
            # the least hash of each window, of equals the last place
            least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
            span, width = self.window - self.gram + 1, 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[:width - span], least[span - width:])
            picked = (_LOW - (least & _LOW)).astype(np.int64)
            first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
            place = picked[first]
            yield grams[place], place + at, first + at, np.diff(np.append(first, len(picked)))


def _stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(uid, doc_id, gram, place, digest, start, windows, again): the stretches of each
    text; ``again`` counts equal ones that follow each other without a gap (a run of
    one byte has one at every place)."""
    schema = (f"uid binary, doc_id {texts.schema['doc_id'].dataType.simpleString()}, gram bigint, place int, digest binary, "
              "start bigint, windows int, again bigint")
    fields = texts.sparkSession.createDataFrame([], schema).schema
    out = to_arrow(fields)

    def run(batches):
        finder = Stretches(window, gram)
        held: list[tuple] = []

        def done():
            uids, ids, grams, places, digests, first, count, again = zip(*held)
            sizes = [len(g) for g in grams]
            columns = ([u for u, n in zip(uids, sizes) for _ in range(n)], [i for i, n in zip(ids, sizes) for _ in range(n)],
                       np.concatenate(grams).view(np.int64), np.concatenate(places), [d for own in digests for d in own],
                       *map(np.concatenate, (first, count, again)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        rows = 0
        for batch in batches:
            for part in small(batch):
                for uid, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    for grams, place, first, count in finder.of(text or b""):
                        ends = (first + count - 1 + window).tolist()
                        digests = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(first.tolist(), ends)]
                        halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
                        same = (halves[1:] == halves[:-1]).all(1) & (np.diff(first) == count[:-1])
                        head = np.flatnonzero(np.append(True, ~same))
                        held.append((uid, doc_id, grams[head], (place - first)[head], [digests[i] for i in head.tolist()],
                                     first[head], count[head], np.diff(np.append(head, len(first)))))
                        rows += len(head)
                        if rows > 20_000:
                            yield done()
                            rows = 0
        if held:
            yield done()

    return texts.select("uid", "doc_id", "text").mapInArrow(run, fields)


# --- two-stage sorting ------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    at = np.searchsorted(change, np.arange(n))
    rising = np.append(text[change] < text[change + 1], False)
    smaller = rising[at]  # than its successor; the last suffix is followed by the empty one

    own = np.flatnonzero(smaller)[::-1]  # of equals the shorter, which is the later, comes first
    padded = np.append(text, np.zeros(depth, np.uint8))
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[own])
    own = own[np.argsort(heads.view(f"V{depth}").ravel(), kind="stable")]

    sizes, induced = np.bincount(text, minlength=256), np.bincount(text[~smaller], minlength=256)
    begin = np.append(0, np.cumsum(sizes))
    order, free = np.empty(n, np.int64), begin[:-1].copy()
    letter = text[own]
    firsts = np.append(0, np.cumsum(sizes - induced))
    order[begin[letter] + induced[letter] + np.arange(len(own)) - firsts[letter]] = own

    def hand_on(placed: np.ndarray) -> None:
        """Predecessors larger than their successor take the next places of their buckets."""
        before = placed[placed > 0] - 1
        before = before[~smaller[before]]
        letters = text[before]
        by_letter = np.argsort(letters, kind="stable")
        before, letters = before[by_letter], letters[by_letter]
        count = np.bincount(letters, minlength=256)
        start = np.cumsum(count) - count
        order[free[letters] + np.arange(len(before)) - start[letters]] = before
        free[:] += count

    hand_on(np.array([n]))
    for c in np.flatnonzero(sizes).tolist():
        done = begin[c]
        while done < free[c]:
            done, now = free[c], order[done:free[c]].copy()
            hand_on(now)
        hand_on(order[begin[c] + induced[c]:begin[c + 1]])
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` bytes at a[i] and b[i] are the same."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    alive = np.arange(len(a))
    for k in [*range(0, depth - 7, 8), depth - 8]:
        same = (words[a[alive] + k] == words[b[alive] + k]).all(1)
        alive = alive[same]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_windows(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece the starts of the windows that stand in the pieces twice or more."""
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)  # ends are 0, the least
    offsets = np.cumsum([0] + [len(p) + 1 for p in pieces])
    starts = np.concatenate([np.arange(o, o + max(0, len(p) - window + 1)) for o, p in zip(offsets.tolist(), pieces)])
    whole = np.zeros(len(joined), bool)
    whole[starts] = True
    order = suffix_order(joined, window)
    order = order[whole[order]]
    if not len(order):
        return [order] * len(pieces)
    near = common_prefixes(joined, order[1:], order[:-1], window)
    found = np.sort(order[np.append(near, False) | np.append(False, near)])
    bounds = np.searchsorted(found, offsets)
    return [found[bounds[i]:bounds[i + 1]] - offsets[i] for i in range(len(pieces))]


# --- candidate stretches -----------------------------------------------------------

_PIECE = "key binary, low int, high int, n bigint, uid binary, start bigint, place int, piece binary"
_OPEN = "c > 1 AND single > 0"  # of a key: something in it is not known to be repeated


def _sizes() -> list[Column]:
    return [F.count("*").alias("c"), F.count_if(F.col("n") == 1).alias("single")]


def _halved(rows: DataFrame, window: int) -> DataFrame:
    """Each piece cut in two by the distance of its windows from the gram, the half-open
    range [low, high): windows of [a, b) share the bytes that lie in all of them."""
    def one(key, low, high, n, uid, start, place, piece):
        out, mid = [], (low + high) // 2
        for a, b in ((low, mid), (mid, high)):
            first, last = max(0, place - b + 1), min(len(piece) - window, place - a)  # windows here
            if a < b and first <= last:
                shared = piece[max(0, place - a):place - b + 1 + window]
                name = xxhash.xxh3_128_digest(key + bytes([a >> 8, a & 255, b >> 8, b & 255]) + shared)
                own = piece[first:last + window]
                out.append((name, a, b, n, uid, start + first, place - first, own, xxhash.xxh3_128_digest(name + own)))
        return [dict(zip((*names, "content"), r)) for r in out],

    names = [c.split()[0] for c in _PIECE.split(", ")]
    struct = ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in _PIECE.split(", ")) + ",content:binary"
    return map_texts(rows, f"rows array<struct<{struct}>>", one, *names).select(F.inline("rows"))


def _sorted_spans(pieces: DataFrame, window: int) -> DataFrame:
    """(uid, start, windows) of repeated windows in the pieces of single stretches (n = 1)."""
    fields = pieces.sparkSession.createDataFrame([], "uid binary, start bigint, windows bigint").schema
    out = to_arrow(fields)

    def run(batches):
        held, size = [], 0

        def done():
            rows = []
            for (_, n, uid, start, _), found in zip(held, repeated_windows([h[4] for h in held], window)):
                if n == 1 and len(found):
                    first = found[np.append(True, np.diff(found) > 1)]
                    last = found[np.append(np.diff(found) > 1, True)]
                    rows += [(uid, start + a, b - a + 1) for a, b in zip(first.tolist(), last.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            for part in small(batch):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if size > _SORT and row[0] != held[-1][0]:
                        yield from done()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[4])
        if held:
            yield from done()

    dealt = pieces.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "n", "uid", "start", "piece").mapInArrow(run, fields)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("uid"), text.alias("text"))


def spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(uid, start, windows): runs of repeated window starts in the texts of
    ``texts`` (uid, doc_id, text). Every run of a text is there, some more than once."""
    raw = scratch(_stretches(texts, window, gram), "stretches")
    grams = scratch(raw.groupBy("gram").agg(F.sum("again").alias("c")).filter("c > 1").select("gram"), "grams")
    # rows of one text collapse before the shuffle
    found = scratch(raw.join(grams, "gram", "left_semi").groupBy("uid", "gram", "place", "digest", "start", "windows", "again")
                    .agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc_id")), "found")
    classes = scratch(found.groupBy("gram", "place", "digest", "windows").agg(
        F.sum(F.col("rows") * F.col("again")).alias("n"), F.min(F.struct("uid", "start", "doc_id")).alias("one")), "classes")
    unsettled = scratch(classes.groupBy("gram").agg(*_sizes()).filter(_OPEN).select("gram"), "unsettled")
    twice = scratch(classes.filter("n > 1").select("gram", "place", "digest"), "twice")
    whole = found.join(twice, ["gram", "place", "digest"], "left_semi").select(
        "uid", "start", (F.col("windows") * F.col("again")).alias("windows"))

    wanted = (classes.join(unsettled, "gram", "left_semi").select("gram", "place", "windows", "n", "one.*")
              .groupBy(F.col("uid").alias("_uid"), F.col("doc_id").alias("_doc_id"))
              .agg(F.collect_list(F.struct("gram", "place", "windows", "n", "start")).alias("_wanted")))
    with_text = texts.join(wanted, (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    piece = F.substring(F.col("text"), (F.col("_w.start") + 1).cast("int"), F.col("_w.windows") + window - 1)
    todo = scratch(with_text.select("uid", "text", F.explode("_wanted").alias("_w")).select(
        F.unhex(F.lpad(F.hex("_w.gram"), 16, "0")).alias("key"), F.lit(0).alias("low"), F.lit(window - gram + 1).alias("high"), F.col("_w.n").alias("n"),
        "uid", F.col("_w.start").alias("start"), F.col("_w.place").alias("place"), piece.alias("piece"))
        # rows that repeat both doc_id and text gave their pieces more than once
        .dropDuplicates(["key", "uid", "start"]), "pieces")
    parts = [whole]
    while True:
        sizes = scratch(todo.groupBy(F.col("key").alias("_key")).agg(*_sizes()).filter(_OPEN), "sizes")
        of = todo.join(sizes, F.col("key") == F.col("_key"))
        parts.append(_sorted_spans(of.filter(F.col("c") <= crowd), window))
        if sizes.filter(F.col("c") > crowd).isEmpty():
            break
        halves = scratch(_halved(of.filter(F.col("c") > crowd), window), "halves")
        # equal pieces settle each other; one of them stays, for others to be compared with
        alike = scratch(halves.groupBy(F.col("content").alias("_content")).agg(
            F.sum("n").alias("total"), F.min(F.struct("uid", "start")).alias("one")), "alike")
        known = halves.join(alike, F.col("content") == F.col("_content"))
        parts.append(known.filter("total > 1 AND n = 1").select(
            "uid", "start", (F.length("piece") - (window - 1)).cast("bigint").alias("windows")))
        todo = scratch(known.filter((F.col("one.uid") == F.col("uid")) & (F.col("one.start") == F.col("start"))).select(
            "key", "low", "high", F.col("total").alias("n"), "uid", "start", "place", "piece"), "todo")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def removed(runs: list | None, n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The maximal removed (start, end) of a text of ``n`` bytes."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["start"] + r["windows"] - 1 + window) for r in runs or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, min(b, n)) for a, b in out]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``keep_text``
    also ``kept``, the bytes that stay."""
    texts = _texts(docs)
    # written, so that a text that stands in many rows is a join key that AQE can split
    runs = scratch(spans(texts, window, gram, crowd).distinct().groupBy(F.col("uid").alias("_uid"))
                   .agg(F.collect_list(F.struct("start", "windows")).alias("runs")), "runs")

    def one(doc_id, text, runs):
        out, at, kept = removed(runs, len(text), window), 0, []
        for start, end in out:
            kept.append(text[at:start])
            at = end
        kept = b"".join([*kept, text[at:]])
        row = doc_id, len(text), len(text) - len(kept), len(out), hashlib.sha256(kept).hexdigest()
        return (*row, kept) if keep_text else row

    return map_texts(texts.join(runs, F.col("uid") == F.col("_uid"), "left"),
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                     "kept_sha256 string" + ", kept binary" * keep_text, one, "doc_id", "text", "runs")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
