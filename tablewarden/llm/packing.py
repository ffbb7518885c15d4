"""Best-fit packing of tokenised documents with certified bin counts.

``pieces`` tokenises whole texts (byte-level BPE, end id appended) and cuts only
documents longer than the capacity, into full pieces; the first may be shorter.
``pack`` then assigns pieces to sequences:

1. Pieces are dealt by hash into partitions of about ``part_rows`` (a hot document
   or source makes no difference) and each is packed by best-fit decreasing.
2. Dual-feasible functions give each partition a lower bound on its sequences. A
   partition that meets its bound is certified: no packing of its pieces is
   better. A full sequence is certified by itself.
3. Partitions with a gap give up the pieces of their sequences that are not full,
   and certified ones those of sequences with over an eighth of room (the bound of
   a partition rounds up, that of all together only once). These are exchanged,
   dealt anew into as few partitions as hold them, and packed again. The new
   packing stands if it needs fewer sequences. Rounds end when nothing is left to
   exchange, or when ``patience`` deals in a row, each salted anew, gained nothing;
   ``bins`` and ``bound`` show what gap is left.

Null and empty texts are the end id alone. Rows with a null doc_id are packed like
others; repeated rows are packed as often as they stand; ties of length go by the
row's place in the table of pieces. An empty table gives no rows.

Tokens: the rank file holds the tokenizer file's vocabulary, and the rank encoder
is about five times faster. The two may disagree only on characters that their
regex libraries date differently, so texts outside the long-settled blocks of
_SETTLED go to the tokenizer itself, as do those with runs of white space that the rank
encoder's regex can not take; the rest to the ranks. Marker strings of the
tokenizer's added tokens become their ids in both.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewarden.llm.common import map_texts, scratch, table

CAPACITY = 2048
PART_ROWS = 20_000
SPARE = 7 / 8
END_ID = 0
# Latin, Greek, Cyrillic, punctuation, currency: letters, digits and spaces for decades.
_SETTLED = re.compile(r"[\x00-ɏΑ-ΡΣ-ωЀ-ҁḀ-ỿ‐-‧‰-⁞₠-₵]*")


@dataclass(frozen=True)
class Tokens:
    """Paths of the tokenizer and of the same vocabulary as ranks."""

    tokenizer: str
    ranks: str

    @staticmethod
    def default() -> Tokens:
        return Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def encoder(self) -> Callable[[str], list[int]]:
        """A function from text to ids; built once per task."""
        import tiktoken

        with open(self.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.tokenizer) as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        marks, exact = set(added), []

        def encode(text: str) -> list[int]:
            if _SETTLED.fullmatch(text):
                try:
                    return fast.encode(text, allowed_special=marks, disallowed_special=())
                except ValueError:  # its regex gives up on runs of about a million white spaces
                    pass
            if not exact:
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                from tokenizers import Tokenizer

                exact.append(Tokenizer.from_file(self.tokenizer))
            return exact[0].encode(text, add_special_tokens=False).ids

        return encode


def pieces(docs: DataFrame, tokens: Tokens | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for every row of ``docs``."""
    tokens = tokens or Tokens.default()

    def setup():
        encode = tokens.encoder()

        def one(doc_id, text):
            ids = np.array(encode(text or "") + [END_ID], "<u4")
            out, at = [], 0
            while at < len(ids):
                n = (len(ids) - at) % capacity or capacity
                part = ids[at:at + n]
                row = {"piece": len(out), "start": at, "length": n, "ids_crc32": zlib.crc32(part.tobytes())}
                out.append(row | {"ids": part.tolist()} if keep_ids else row)
                at += n
            return doc_id, out

        return one

    id_type = docs.schema["doc_id"].dataType.simpleString()
    piece = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * keep_ids
    rows = map_texts(docs, f"doc_id {id_type}, pieces array<struct<{piece}>>", None, "doc_id", "text", setup=setup)
    return rows.select("doc_id", F.inline("pieces"))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Fewest bins that can hold ``lengths`` (each ``counts`` times): the best of two
    families of dual-feasible functions, over the histogram of lengths."""
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, lengths, 1 if counts is None else counts)
    sizes = np.arange(capacity + 1)
    total = int((hist * sizes).sum())
    best = -(-total // capacity)
    count, mass = np.append(0, hist.cumsum()), np.append(0, (hist * sizes).cumsum())
    for k in range(1, capacity // 2 + 1):
        # above capacity - k: a whole bin; below k: nothing; the rest by its length
        whole = int(count[capacity + 1] - count[capacity - k + 1])
        rest = int(mass[capacity - k + 1] - mass[k])
        best = max(best, whole - (-rest // capacity))
        # over half: a bin each, with what the others need beyond the room left there
        large = int(count[capacity - k + 1] - count[capacity // 2 + 1])
        room = large * capacity - int(mass[capacity - k + 1] - mass[capacity // 2 + 1])
        small = int(mass[capacity // 2 + 1] - mass[k])
        best = max(best, whole + large + max(0, -(-(small - room) // capacity)))
    for k in range(1, 65):
        # x of (k + 1) x capacity multiples keep their share; others round down to 1/k
        scaled = sizes * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((hist * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each length and the fill of each bin."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _deal(items: DataFrame, rows: int, part_rows: int, salt: int) -> DataFrame:
    parts = max(1, -(-rows // part_rows))
    return items.withColumn("part", F.lit(salt << 28) + F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)))


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing of each part, with its sequences' ids, its bin count and bound."""
    extra = "sequence_id bigint, offset bigint, fill bigint, bins bigint, bound bigint"
    added = StructType.fromDDL(extra)
    kept = [c for c in items.columns if c not in added.names]
    schema = StructType(items.select(*kept).schema.fields + added.fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[kept].sort_values("uid", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit(lengths, capacity)
        return frame.assign(sequence_id=frame["part"] * (1 << 28) + bins, offset=offsets, fill=fill[bins], bins=len(fill),
                            bound=lower_bound(lengths, capacity))

    return items.select(*kept).groupBy("part").applyInPandas(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, patience: int = 3) -> DataFrame:
    """``items`` (rows of ``pieces``, or any rows with a ``length`` up to ``capacity``)
    with sequence_id and offset. part, bins and bound are of the packing that made the
    sequence: its part was packed into ``bins`` sequences and none has fewer than
    ``bound``."""
    items = scratch(items.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    now = scratch(_packed(_deal(items, items.count(), part_rows, 0), capacity), "packed")
    deal = idle = 0
    while idle < patience:
        open_ = (F.col("fill") < capacity) & (
            (F.col("bins") > F.col("bound")) | (F.col("fill") < capacity * SPARE))
        pool = now.where(open_)
        rows, parts, bins = pool.agg(F.count("*"), F.countDistinct("part"), F.countDistinct("sequence_id")).first()
        if parts < 2:
            break
        deal += 1
        again = scratch(_packed(_deal(pool, rows, part_rows, deal), capacity), "repacked")
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= bins:
            idle += 1
            continue
        idle = 0
        now = scratch(now.where(~open_).unionByName(again), "exchanged")
    return now.drop("uid", "fill")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound) of a whole packing, from the histogram of lengths."""
    hist = packed.groupBy("length").count().collect()  # at most ``capacity`` rows
    lengths, counts = (np.array([r[i] for r in hist], np.int64) for i in (0, 1))
    return packed.agg(F.countDistinct("sequence_id")).first()[0], lower_bound(lengths, capacity, counts)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")
