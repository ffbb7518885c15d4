"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a chunk wherever its low ``bits`` bits
are all ones, so chunk boundaries depend on near content only and survive edits
elsewhere. The signature at block size 2^bits holds 12 bits of each chunk's hash
(two characters). ``bits`` is the least for which the whole text, however long,
has at most MAX_CHUNKS boundaries; a fingerprint holds the signatures at that and
the next LEVELS - 1 block sizes: ``bits:signature:signature:signature``.

Likeness of two fingerprints is 1 - edit distance / longer length of two
signatures of one block size, the best where two sizes are shared, 0 where none
is. Equal fingerprints are at 1; an empty signature is like nothing else.

Null texts count as empty. ``with_edits`` goes by ascending doc_id, null ids last,
equal ids by text; the document after the last is the first (itself, if alone).
Rows are range-dealt into buckets, the first rows of each bucket are sent to the
bucket before as well, and each task streams its buckets in order with one text
held. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, table, to_arrow

WINDOW = 7
MAX_CHUNKS = 64
MIN_BITS = 2
LEVELS = 3
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_BLOCK = 1 << 20
_OF_BYTE = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
_FACTOR = np.uint32(0x9E3779B1)


def _rolling(raw: np.ndarray) -> np.ndarray:
    """A mixed polynomial of the last WINDOW bytes at each byte (shorter at the start)."""
    values = _OF_BYTE[raw]
    out = values.copy()
    term = values
    for j in range(1, min(WINDOW, len(raw))):
        term = term[:-1] * _FACTOR
        out[j:] += term
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA77)
    return out ^ (out >> np.uint32(13))


def _triggers(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (exclusive ends) at ``bits`` and their hashes, in blocks of the whole text."""
    raw, mask = np.frombuffer(data, np.uint8), np.uint32((1 << bits) - 1)
    ends, hashes = [], []
    for at in range(0, len(raw), _BLOCK):
        lead = min(at, WINDOW - 1)
        h = _rolling(raw[at - lead:at + _BLOCK])[lead:]
        found = np.flatnonzero((h & mask) == mask)
        ends.append(found + at + 1)
        hashes.append(h[found])
    return (np.concatenate(ends), np.concatenate(hashes)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    bits = max(MIN_BITS, (len(data) // MAX_CHUNKS).bit_length())
    ends, hashes = _triggers(data, bits)
    while len(ends) > MAX_CHUNKS and bits < 32:
        bits += 1
        keep = (hashes >> np.uint32(bits - 1)) & np.uint32(1) == 1
        ends, hashes = ends[keep], hashes[keep]
    parts, digest = [], xxhash.xxh32_intdigest
    for level in range(bits, bits + LEVELS):
        cuts = [0, *ends.tolist()]
        if cuts[-1] < len(data):
            cuts.append(len(data))
        codes = [digest(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        parts.append("".join([_CHARS[c & 63] + _CHARS[c >> 6 & 63] for c in codes]))
        keep = (hashes >> np.uint32(level)) & np.uint32(1) == 1 if level < 32 else np.zeros(len(ends), bool)
        ends, hashes = ends[keep], hashes[keep]
    return ":".join([str(bits), *parts])


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance, one step of bit vectors per item of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, last, d = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for x in b:
        eq = masks.get(x, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diag | up))
        left = diag & up
        if right & last:
            d += 1
        elif left & last:
            d -= 1
        right = right << 1 | 1
        up = (left << 1 | (full & ~(diag | right))) & full
        down = diag & right & full
    return d


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    x, y = ([s[i:i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 1.0 - edit_distance(x, y) / max(len(x), len(y))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (p, *xs), (q, *ys) = a.split(":"), b.split(":")
    step = int(p) - int(q)  # a's first level is b's of this number
    return max((_alike(x, y) for x, y in zip(xs[max(0, -step):], ys[max(0, step):])), default=0.0)


def edited(text: str, after: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, f"doc_id {id_type}, fingerprint string", lambda i, t: (i, fingerprint(t)), id_col, text_col)


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows with their bucket of the id order; peek is 1 for those that the bucket before looks at."""
    at = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    shares = [i / buckets for i in range(1, buckets)]
    got = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares or [0.5], 20 * buckets)).first()
    bounds = np.array(sorted({b for b in got[1] or [] if shares and b > got[0]}), np.int64)

    @F.pandas_udf("bigint")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the bucket, plus 1 if the id is the bucket's first."""
        ids = ids.to_numpy(np.int64)
        right = np.searchsorted(bounds, ids, "right")
        return pd.Series(2 * right + (right > np.searchsorted(bounds, ids, "left")))

    # the first document of all follows the last bucket
    first = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").limit(1).select(
        "doc_id", "text", F.lit(len(bounds)).cast("long").alias("bucket"), F.lit(2).alias("peek"))
    placed = docs.select("doc_id", "text", place(at).alias("place"))
    bucket = F.shiftright("place", 1)
    here = F.struct(bucket.alias("bucket"), F.lit(0).alias("peek"))
    before = F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("peek"))
    return placed.select("doc_id", "text", F.inline(F.when(F.col("place") % 2 == 1, F.array(here, before)).otherwise(
        F.array(here)))).union(first)


def with_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    spark = docs.sparkSession
    buckets = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    fields = spark.createDataFrame([], schema).schema
    out = to_arrow(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, fingerprint of the row that waits for its next
        for batch in batches:
            rows = []
            for doc_id, text, bucket, peek in zip(*(batch.column(c) for c in ("doc_id", "text", "bucket", "peek"))):
                doc_id, text, bucket, peek = doc_id.as_py(), text.as_py(), bucket.as_py(), peek.as_py()
                if peek and held is None:
                    continue
                own = fingerprint(text)
                if held:
                    new = edited(held[2], text)
                    code = fingerprint(new)
                    rows.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[3], code,
                                 likeness(held[3], code), likeness(held[3], own)))
                held = None if peek else (bucket, doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    order = ["bucket", "peek", F.col("doc_id").asc_nulls_last(), "text"]
    return (_bucketed(docs, buckets).repartition("bucket").sortWithinPartitions(*order).mapInArrow(run, fields))


def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
