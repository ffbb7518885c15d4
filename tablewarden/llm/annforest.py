"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Fit: each of ``trees`` trees splits a sample of at most SAMPLE distinct vectors
(first by hash, a documented bound; collected as one bounded array) at the median
of their projections on the difference of two random points, down to about
LEAF_ROWS sample points a leaf. Every vector of the table is then routed to one
leaf of each tree.

Search: one priority queue is shared by all trees of a query. It holds branches by
the worst margin on the way to them, so the most promising branch of any tree is
opened next, until ``probes`` leaves are open and they hold enough vectors. How many
are needed for a recall of ``recall`` is learned: the nearest of TRIALS sample vectors
in the sample are found by brute force, and the leaves counted that come before the
first that holds them. Clustered vectors need few leaves, vectors without any
structure many. Queries meet the vectors of their leaves in groups of leaf and block;
a leaf with many vectors has many blocks, and the queries of a group pass by in
batches. Each group reranks its candidates exactly: cosine of the original vectors in
double precision; ties go to the smaller id.

Equal vectors are merged first: a vector that a third of the rows hold is indexed
and searched once, with its k + 1 smallest ids, which is all that k neighbours can
need. A result holds each query's k + 1 nearest, without the query itself.

Vectors that are null, zero, hold null or non-finite components, or have another
length than most, take no part, nor do rows of a null id. Repeated ids are one
candidate at their best score. Tables with fewer candidates give all of them; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import scratch, table

SAMPLE = 20_000
LEAF_ROWS = 32
TRIALS = 200
BLOCK = 4096
PAIRS = 65536  # scored at once


@dataclass(frozen=True)
class Forest:
    """Complete trees: node i has children 2i + 1 and 2i + 2; leaves count from 0."""

    normals: np.ndarray  # tree, node, component
    offsets: np.ndarray  # tree, node
    depth: int
    probes: int = 0  # leaves to open for a query, where learned

    @property
    def trees(self) -> int:
        return len(self.offsets)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit row of ``x`` in each tree: (row, tree)."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                over = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + over
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """The place of each leaf in the order in which ``search`` opens them: (tree, leaf)."""
        margins = (self.normals @ q - self.offsets) if self.depth else self.offsets
        worst = np.full((self.trees, 1), -np.inf)
        for level in range(self.depth):
            m = margins[:, (1 << level) - 1:(2 << level) - 1]
            worst = np.stack([np.maximum(worst, m), np.maximum(worst, -m)], axis=2).reshape(self.trees, -1)
        place = np.empty(worst.size, np.int64)
        place[np.argsort(worst, axis=None, kind="stable")] = np.arange(worst.size)
        return place.reshape(worst.shape)

    def search(self, q: np.ndarray, counts: np.ndarray, probes: int, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) to open for unit vector ``q``, most promising first, from one
        queue: ``probes`` of them that hold vectors, and on until a tree has ``least``."""
        margins = (self.normals @ q - self.offsets) if self.depth else self.offsets
        first = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(self.trees)]
        found, held = [], [0] * self.trees
        while queue and (len(found) < probes or max(held) < least):
            worst, t, node = heapq.heappop(queue)
            if node >= first:
                if counts[t, node - first]:
                    found.append((t, node - first))
                    held[t] += int(counts[t, node - first])
                continue
            m = float(margins[t, node])
            heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
        return found


def fit(sample: np.ndarray, trees: int, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> Forest:
    """Trees over the rows of ``sample`` (scaled to unit length here)."""
    x, rng = unit(sample), np.random.default_rng(seed)
    depth = max(0, int(np.log2(max(1, len(x) / leaf_rows))))
    nodes = (1 << depth) - 1
    normals, offsets = np.zeros((trees, nodes, x.shape[1])), np.zeros((trees, nodes))
    for t in range(trees):
        groups = {0: np.arange(len(x))}
        for node in range(nodes):
            rows = groups.pop(node)
            if len(rows) > 1:
                a, b = x[rng.choice(rows, 2, replace=False)]
                normals[t, node] = a - b
                along = x[rows] @ normals[t, node]
                offsets[t, node] = np.median(along)
                over = along > offsets[t, node]
            else:
                over = np.zeros(len(rows), bool)
            groups[2 * node + 1], groups[2 * node + 2] = rows[~over], rows[over]
    return Forest(normals, offsets, depth)


def learn_probes(forest: Forest, sample: np.ndarray, k: int, recall: float) -> Forest:
    """``forest`` with the leaves that a query must open so that ``recall`` of the ``k``
    nearest are met, by TRIALS rows of ``sample`` as queries against all its rows."""
    x = unit(sample)
    held = forest.leaves(x)
    trial = np.unique(np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int))
    near = x[trial] @ x.T
    near[np.arange(len(trial)), trial] = -np.inf
    k = min(k, len(x) - 1)
    if not k:
        return replace(forest, probes=forest.trees)
    needed = []
    for i, row in zip(trial, near):
        place = forest.order(x[i])
        for j in np.argpartition(-row, k - 1)[:k]:
            needed.append(1 + place[np.arange(forest.trees), held[j]].min())
    return replace(forest, probes=max(forest.trees, int(np.quantile(needed, recall, method="higher"))))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of vector ``q`` with rows ``x``, in double precision, each row by itself."""
    q, x = np.asarray(q, np.float64), np.asarray(x, np.float64)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec and a 128-bit hash (a, b) of the vector, for rows that take part."""
    vec = F.col("vec")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).where(
        F.col("vec_id").isNotNull() & vec.isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", bad)
        & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size[0] if size else 0)).select(
        "vec_id", "vec", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"))


def _placed(distinct: DataFrame, forest: Forest, counts: np.ndarray | None, probes: int, least: int) -> DataFrame:
    """Rows of ``distinct`` with ``places``: their leaf in each tree, or, with the
    vectors held by each leaf given, the leaves to open for them as queries."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("vec")))
                if counts is None:
                    places = [[{"tree": t, "leaf": leaf} for t, leaf in enumerate(row)] for row in forest.leaves(x).tolist()]
                else:
                    places = [[{"tree": t, "leaf": leaf} for t, leaf in forest.search(q, counts, probes, least)] for q in x]
                kind = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32())]))
                yield batch.append_column("places", pa.array(places, kind))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    placed = distinct.mapInArrow(run, schema + ", places array<struct<tree:int,leaf:int>>")
    return placed.select(*distinct.columns, F.inline("places"))


def _reranker(keep: int):
    keys = ["tree", "leaf", "block"]
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def answer(vectors: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        """Each query with its ``keep`` nearest of ``vectors``."""
        ids = vectors.column("ids").combine_chunks()
        x, q = (_matrix(t.column("vec").combine_chunks()).astype(np.float64) for t in (vectors, queries))
        ux, size, least_id = unit(x), np.sqrt((x * x).sum(axis=1)), pc.list_element(ids, 0).to_numpy()
        for at in range(0, len(q), 256):
            part = q[at:at + 256]
            rough = unit(part) @ ux.T
            last = max(0, len(x) - keep)
            row, near = np.nonzero(rough >= np.partition(rough, last, axis=1)[:, last:last + 1] - 1e-9)
            length = np.sqrt((part * part).sum(axis=1))
            score = np.concatenate([(x[n] * part[r]).sum(axis=1) / (size[n] * length[r]) for n, r in (
                (near[i:i + PAIRS], row[i:i + PAIRS]) for i in range(0, len(row), PAIRS))])
            best = np.lexsort((least_id[near], -score, row))
            row, near, score = row[best], near[best], score[best]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < keep
            of = pa.array(at + row[kept])
            yield pa.RecordBatch.from_arrays(
                [queries.column("a").combine_chunks().take(of), queries.column("b").combine_chunks().take(of),
                 ids.take(pa.array(near[kept])).cast(out.field("ids").type), pa.array(score[kept])], schema=out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, vectors before queries; a group may span batches.
        The vectors of one group are held, of its queries those of one batch."""
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(k).to_numpy() for k in (*keys, "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                *group, kind = place[s].tolist()
                if group != last:
                    held, last = [], group
                if kind == 0:
                    held.append(batch.slice(s, e - s))
                elif held:
                    yield from answer(pa.Table.from_batches(held), pa.Table.from_batches([batch.slice(s, e - s)]))

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = 10, recall: float = 0.96,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row where
    ``is_query`` (of the id, as column vec_id) holds, among all other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    by_vector = Window.partitionBy("a", "b").orderBy("vec_id")
    distinct = scratch(rows.select("vec_id", "a", "b", "vec").dropDuplicates(["vec_id", "a", "b"])
                       .withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
                       .groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")),
                       "vectors")
    sample = distinct.orderBy("a", "b").limit(SAMPLE).select("vec").toPandas()["vec"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.stack(sample)
    forest = learn_probes(fit(sample, trees), sample, k, recall)
    placed = scratch(_placed(distinct, forest, None, 0, 0), "leaves")
    counts = np.zeros((trees, 1 << forest.depth), np.int64)
    for t, leaf, n in placed.groupBy("tree", "leaf").count().toLocalIterator():  # as many as the forest has leaves
        counts[t, leaf] = n
    blocks = spark.createDataFrame([(t, leaf, -(-int(n) // BLOCK)) for (t, leaf), n in np.ndenumerate(counts) if n],
                                   "tree int, leaf int, blocks int")
    asked = rows.where(is_query).groupBy("a", "b").agg(F.first("vec").alias("vec"))
    data = placed.join(F.broadcast(blocks), ["tree", "leaf"]).select(
        "tree", "leaf", F.pmod("a", "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "a", "b", "vec", "ids")
    probed = _placed(asked, forest, counts, forest.probes, k + 1).join(F.broadcast(blocks), ["tree", "leaf"]).select(
        "tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
        "a", "b", "vec", F.array().cast("array<bigint>").alias("ids"))
    groups = ["tree", "leaf", "block"]
    found = (data.union(probed).repartition(*groups).sortWithinPartitions(*groups, "kind")
             .mapInArrow(_reranker(k + 1), "a bigint, b bigint, ids array<bigint>, score double"))
    pairs = found.select("a", "b", F.explode("ids").alias("vec_id"), "score").groupBy("a", "b", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    answers = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "a", "b")
    near = queries.join(answers, ["a", "b"]).where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (near.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
