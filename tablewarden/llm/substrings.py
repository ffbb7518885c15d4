"""Substring dedup: words covered by a passage of WINDOW words that an earlier
document has, found by factoring documents against an index of reference phrases.

A window is WINDOW consecutive words (runs of characters other than space and
\\t\\n\\v\\f\\r, unchanged). Each word covered by a window whose sequence also starts
in a document with a smaller doc_id is removed; windows are judged on the input.

Reference phrases. Every window picks its least-hashed GRAM-word gram (the last of
equals). Windows that pick the same gram lie side by side and form one phrase: the
words they cover. Equal windows pick the same gram at the same place, so matches
can only lie between phrases of one gram, and grams found once are out at once.

Greedy factors, longest first, against every block (hash partition) of the index:
1. Whole phrases: one that an earlier document has too is a factor, removed whole.
   The phrase's first document stands for all copies of it from then on.
2. Where a gram keeps several different phrases, factors end inside them. There
   every window of the phrases' first documents is looked up by itself, so no
   match that begins or ends at a factor boundary is missed.
Factors of a document are joined to spans and cut from its words.

Scale: copies collapse in step 1, so step 2 sees distinct phrases only. All lookups
pre-aggregate a least doc_id per key before the shuffle, and join it back one row
to many from a written table, which AQE may split; no pairs of documents are made. Phrases and windows
are compared by 64-bit polynomial hashes of 64-bit word hashes.

Null and empty texts have no words. Rows of a null doc_id neither lose words nor
take any. Rows that repeat a doc_id are not earlier than each other; spans are kept
by doc_id and a hash of the text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, scratch, table

WINDOW = 50
GRAM = 12
_CHUNK = (1 << 20) - 2 * WINDOW  # window starts handled at once; places fit 20 bits
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class _WordHashes(dict):
    """64-bit hash by word, forgotten when many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of word ranges; made once per task."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.words = window, gram, _WordHashes()
        self.up, self.down = _powers(_BASE, 1 << 10), _powers(_BACK, 1 << 10)

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if n >= len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_BACK, 2 * n)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        return np.append(np.uint64(0), np.cumsum(h * self.up[:n], dtype=np.uint64))

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((prefix[end] - prefix[start]) * self.down[start])

    def phrases(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(gram, phrase, start, windows) arrays of each chunk of a text's words."""
        for at in range(0, len(words) - self.window + 1, _CHUNK):
            part = words[at:at + _CHUNK + self.window - 1]
            prefix, n = self.prefix(part), len(part)
            places = np.arange(n - self.gram + 1)
            grams = self.ranges(prefix, places, places + self.gram)
            least = (grams & ~_LOW) | (_LOW - places.astype(np.uint64))
            span, width = self.window - self.gram + 1, 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[:width - span], least[span - width:])
            picked = (_LOW - (least & _LOW)).astype(np.int64)
            first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
            last = np.append(first[1:], len(picked)) - 1
            place = picked[first]
            phrase = self.ranges(prefix, first, last + self.window) * np.uint64(128) + (place - first).astype(np.uint64)
            yield grams[place], _mixed(phrase), first + at, last - first + 1

    def windows(self, words: list[bytes], spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, hash) of the windows in ``spans`` (start, windows), which are in order.
        Spans come in runs, so that a text's untouched stretches are not hashed."""
        i = 0
        while i < len(spans):
            at, j = spans[i][0], i
            end = at + spans[i][1] + self.window - 1
            while j + 1 < len(spans) and spans[j + 1][0] <= end and spans[j + 1][0] - at < _CHUNK:
                j += 1
                end = max(end, spans[j][0] + spans[j][1] + self.window - 1)
            prefix = self.prefix(words[at:end])
            starts = np.unique(np.concatenate([np.arange(s - at, s - at + c) for s, c in spans[i:j + 1]]))
            yield starts + at, self.ranges(prefix, starts, starts + self.window)
            i = j + 1


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _phrases(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash, gram, phrase, start, windows of every phrase."""
    def setup():
        hasher = Hasher(window)

        def one(doc_id, text_hash, text):
            words, rows = split(text), []
            for gram, phrase, start, count in hasher.phrases(words):
                rows += zip(_signed(gram), _signed(phrase), start.tolist(), count.tolist())
            return doc_id, text_hash, [dict(zip(("gram", "phrase", "start", "windows"), r)) for r in rows]

        return one

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(docs, f"doc_id {id_type}, text_hash bigint, found array<struct<gram:bigint,phrase:bigint,start:int,windows:int>>",
                     None, "doc_id", "text_hash", "text", setup=setup)
    return rows.select("doc_id", "text_hash", F.inline("found"))


def _windows(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash, start, hash of every window in ``spans`` (doc_id, text_hash, start, windows)."""
    places = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "windows"))).alias("spans"))

    def setup():
        hasher = Hasher(window)

        def one(doc_id, text_hash, text, spans):
            words, rows = split(text), []
            for start, code in hasher.windows(words, [(s["start"], s["windows"]) for s in spans]):
                rows += zip(start.tolist(), _signed(code))
            return doc_id, text_hash, [{"start": s, "hash": h} for s, h in rows]

        return one

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(docs.join(places, ["doc_id", "text_hash"]),
                     f"doc_id {id_type}, text_hash bigint, found array<struct<start:int,hash:bigint>>",
                     None, "doc_id", "text_hash", "text", "spans", setup=setup)
    return rows.select("doc_id", "text_hash", F.inline("found"))


def _earlier(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``first``, the least doc_id of the row's key."""
    return rows.join(scratch(rows.groupBy(key).agg(F.min("doc_id").alias("first")), key), key)


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, start, end (in words) of passages that an earlier document has.
    ``docs`` has doc_id, text and text_hash."""
    named = docs.where(F.col("doc_id").isNotNull())
    phrases = scratch(_phrases(named, window), "phrases")
    again = scratch(phrases.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "grams")
    # nothing is grouped in the stage of this join, so that AQE may split a gram that many phrases hold
    shared = scratch(phrases.join(again, "gram", "left_semi"), "shared")
    owned = scratch(_earlier(shared, "phrase"), "owned")
    whole = owned.where("first < doc_id").select("doc_id", "text_hash", "start", (F.col("start") + F.col("windows") - 1 + window).alias("end"))
    firsts = owned.where("first = doc_id")
    split_grams = scratch(firsts.select("gram", "phrase").distinct().groupBy("gram").agg(F.count("*").alias("c"))
                          .where("c > 1").select("gram"), "split-grams")
    looked_up = scratch(_windows(named, firsts.join(split_grams, "gram", "left_semi"), window).distinct(), "windows")
    found = scratch(looked_up.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .where("first < last").select("hash", "first"), "found")
    single = looked_up.join(found, "hash").where("first < doc_id").select(
        "doc_id", "text_hash", "start", (F.col("start") + window).alias("end"))
    # rows that repeat a doc_id and text share their spans
    return whole.union(single).distinct()


def cut(text: str | None, spans: list | None) -> tuple[list[bytes], int]:
    """The words of ``text`` outside ``spans`` (start, end), and how many it had."""
    words = split(text)
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``keep_text`` also
    ``kept``, the words that stay joined by one space."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    spans = factors(own, window).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def one(doc_id, text, spans):
        kept, n = cut(text, spans)
        joined = b" ".join(kept)
        row = doc_id, n, n - len(kept), hashlib.sha256(joined).hexdigest()
        return (*row, joined.decode()) if keep_text else row

    return map_texts(own.join(spans, ["doc_id", "text_hash"], "left"), f"doc_id {id_type}, n_words bigint, n_removed bigint, "
                     "kept_sha256 string" + ", kept string" * keep_text, one, "doc_id", "text", "spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
