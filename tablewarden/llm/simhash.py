"""SimHash near-duplicates through a byte-position inverted index.

Fingerprint: texts are lower-cased (A-Z), cut into words at white space, and every
``shingle`` consecutive words (repeats included; fewer words: the whole sequence)
are hashed with XXH64, seed 42. A bit is 1 if set in over half the hashes. Null
texts, empty texts and texts without a word have fingerprint zero, and link like
any other.

Links: two fingerprints at most 3 bits apart differ in at most 3 of 8 bytes, so
they share at least 5 positional bytes. Lists of one positional byte would hold
1/256 of the corpus each, so the index is kept on triples of positions: of 5
shared positions, 3 lie in one half of the fingerprint, so the 4 triples in each
half (8 postings a fingerprint) meet every such pair. Pairs that meet in a list
have all their shared positional bytes tallied, those with 5 or more are kept,
and the bit distance is verified.

Scale: equal fingerprints are merged before indexing, and lists with one entry
are dropped after a pre-aggregated count. A long list is cut into blocks and each
pair of blocks is a group of its own, at most about 2 * BLOCK entries; a group
hands on a spanning forest of its links, never all its pairs, which is all that
components need. No list is capped.

Rows of a null doc_id take part and get the smallest doc_id reachable (null if
there is none). Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, scratch, table
from tablewarden.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
BLOCK = 512
_CHUNK = 1 << 16
# All triples of positions within bytes 0-3 and within bytes 4-7, as masks.
MASKS = [sum(0xFF << 8 * (4 * half + i) for i in range(4) if i != out) for half in (0, 1) for out in range(4)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    starts = accumulate((len(w) + 1 for w in words), initial=0)
    ends = accumulate((len(w) + 1 for w in words), initial=-1)
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[s:e], 42) for s, e in zip(starts, islice(ends, k, None)))
    n, counts = 0, np.zeros(64, np.int64)
    while len(part := np.fromiter(islice(hashes, _CHUNK), np.uint64)):
        n += len(part)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, f"doc_id {id_type}, fp bigint", lambda i, t: (i, fingerprint(t, shingle)), id_col, text_col)


def _forest(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal ``group``: pairs are met
    by their distance in the run, all runs at once."""
    n = len(fp)
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    end = np.repeat(np.append(cut[1:], n), np.diff(np.append(cut, n)))
    root = np.arange(n)
    at, d = np.arange(n), 1
    while len(at := at[at + d < end[at]]):
        x = fp[at] ^ fp[at + d]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = at[(tally >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
        pairs = np.stack([root[near], root[near + d]], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        if len(pairs):
            up: dict[int, int] = {}

            def find(i: int) -> int:
                while i in up:
                    i = up[i]
                return i

            for a, b in pairs.tolist():
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            new = np.arange(n)
            for i in up:
                new[i] = find(i)
            root = new[root]
        d += 1
    linked = np.flatnonzero(root != np.arange(n))
    return fp[linked], fp[root[linked]]


def _linker(max_bits: int):
    keys = ["t", "m", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list and block pair; a group may span two batches."""
        rest = None

        def links(group: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _forest(group, fp, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if rest:
                cols, fp = [np.append(x, y) for x, y in zip(rest[0], cols)], np.append(rest[1], fp)
            group = np.cumsum(np.append(0, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            last = int(np.searchsorted(group, group[-1]))
            yield from links(group[:last], fp[:last]) if last else ()
            rest = [c[last:] for c in cols], fp[last:]
        if rest:
            yield from links(np.zeros(len(rest[1]), np.int64), rest[1])

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A spanning set of links (a, b) between the distinct fingerprints of ``fps``
    (column fp). ``max_bits`` up to 3, by the guarantee above."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index of triples meets pairs of at most 3 differing bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    postings = fps.select("fp").distinct().select("fp", F.posexplode(
        F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "m"))
    lists = scratch(postings.groupBy("t", "m").agg(F.count("*").alias("n")).where("n > 1")
                    .select("t", "m", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = (postings.join(lists, ["t", "m"])
           .select("t", "m", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
           .select("t", "m", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "fp"))
    return (met.repartition("t", "m", "i", "j").sortWithinPartitions("t", "m", "i", "j")
            .mapInArrow(_linker(max_bits), "a bigint, b bigint"))


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, component_id, rep (the struct doc_id, fp of the component's first document,
    null ids last) for each distinct fingerprint of ``fps`` (doc_id, fp)."""
    firsts = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("first"))
    roots = components(links(fps, max_bits))
    # only linked fingerprints are grouped by component; the others stand for themselves
    linked = scratch(firsts.join(roots, F.col("fp") == F.col("node")).select("node", "root", "first"), "linked")
    reps = scratch(linked.groupBy("root").agg(F.min("first").alias("rep")), "reps")
    named = firsts.join(linked.join(reps, "root").select("node", "rep"), F.col("fp") == F.col("node"), "left")
    rep = F.coalesce("rep", "first")
    return named.select("fp", rep["doc_id"].alias("component_id"),
                        F.struct(rep["doc_id"].alias("doc_id"), rep["fp"].alias("fp")).alias("rep"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every row of ``docs``."""
    fps = scratch(fingerprints(docs, shingle=shingle), "fingerprints")
    named = scratch(classes(fps, max_bits).select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the smallest doc_id (null ids last). Of rows that repeat
    it with the same fingerprint the least text stays (null first), then the least of the
    other columns in their order; columns of nested types do not decide. Columns as they are."""
    @F.pandas_udf("bigint")
    def mark(texts):
        return texts.map(lambda t: fingerprint(t, shingle)).astype("int64")

    own, rep_id, rep_fp = (_unused(docs, n) for n in ("own_fp", "rep_id", "rep_fp"))
    fps = scratch(fingerprints(docs, shingle=shingle), "fingerprints")
    reps = scratch(classes(fps, max_bits).select(
        F.col("rep.doc_id").alias(rep_id), F.col("rep.fp").alias(rep_fp)).distinct(), "reps")
    # null-safe, as a filter on the mark would be pushed below and compute it twice
    marked = docs.withColumn(own, mark(F.coalesce(F.col("text"), F.lit(""))))
    kept = marked.join(reps, F.col("doc_id").eqNullSafe(F.col(rep_id)) & F.col(own).eqNullSafe(F.col(rep_fp)), "left_semi")
    nested = [f.name for f in docs.schema if f.dataType.typeName() in ("map", "array", "struct", "variant")]
    deciding = F.struct("text", *(c for c in docs.columns if c != "text" and c not in nested))
    row = F.min_by(F.struct(*docs.columns), deciding) if nested else F.min(deciding)
    return kept.groupBy("doc_id", own).agg(row.alias("row")).select("row.*").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
