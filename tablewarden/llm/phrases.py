"""Phrase collocations by vertical partitioning of depth-truncated suffix trees.

Texts have A-Z lower-cased and are split at ``.,;:!?`` and line ends (LF, VT, FF, CR)
into pieces, those at spaces and tabs into words. Everything is per language. Every
word of a piece starts a suffix, cut after DEPTH words (or at the end of its piece).

1. One pass counts all words, and longer prefixes where a sorted run of texts has LOCAL
   or more of them. A prefix (at first one word) that starts more suffixes than the
   budget is *split*: its extensions by one word take its place, in turn. What is left
   are the prefixes whose subtrees fit the budget. Those that fill an eighth of it or
   more are packed into groups first-fit, the rest are dealt to groups by hash. (The
   counts of longer prefixes are lower bounds and only decide who does what.)
2. Each task sorts the suffixes of its texts, counts equal ones and sends each group
   its share as one block with its own word list.
3. Each group merges its blocks, sorts, and forms its subtrees: neighbours that share
   their first k words lie below one node of depth k, whose count is the sum of its
   leaves. No subtree needs another group; a split prefix, which is above the subtrees,
   has its leaves added up over all groups.
4. Nodes with at least MIN_COUNT are joined to the counts of their cuts and scored in
   Spark, in decimals.

Scale: a group holds at most about the budget in suffixes, plus one share of the
small prefixes. Beyond NAMED budgets of input the budget grows with it, so that prefixes
that are named, not hashed, stay few (a bound on what is sent to tasks, whatever the
input) and are frequent enough for step 1 to see. The most frequent word is split, never
one group's work. A language's best rows are found
within salted parts first.

Null texts are empty, a null language is ``und``. Texts of any length are read in
slices. Extra columns are not read. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewarden.llm.common import scratch, small, table, to_arrow

DEPTH = 4
MIN_COUNT = 30
COVER = 80  # per cent of a phrase's occurrences inside a longer one that drop it
TOP = 2000
BUDGET = 1 << 21  # suffixes of a group
NAMED = 1 << 14  # a prefix this part of all suffixes can be split
LOCAL = 64  # a run's count of a longer prefix that step 1 takes note of: this part of a run
_SLICE = 1 << 16
_VOCABULARY = 40_000  # words of a sorted run: with a slice more still 16 bits
_RUN = 1 << 20
_BREAK = b"."
_TABLE = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def slices(text: bytes | None) -> Iterator[list[bytes]]:
    """Words and breaks of a text, in slices; the cut between two is never inside a word."""
    data, at = (text or b"").translate(_TABLE), 0
    while at < len(data):
        end = at + _SLICE
        if end < len(data):
            ends = [x for x in (data.find(b" ", end), data.find(_BREAK, end)) if x >= 0]
            end = min(ends, default=len(data))
        yield data[at:end].replace(_BREAK, b" . ").split()
        at = end


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Run:
    """Suffixes of texts of one language, gathered to be sorted together."""

    def __init__(self):
        self.ids, self.parts, self.size = _Ids({_BREAK: 0}), [], 0

    def add(self, text: bytes | None) -> Iterator[None]:
        """Yields after each slice, when the run may be taken."""
        tail = np.zeros(0, np.uint64)
        for words in slices(text):
            new = np.fromiter(map(self.ids.__getitem__, words), np.uint64, len(words))
            whole = np.append(tail, new)
            tail = whole[max(0, len(whole) - DEPTH + 1):]
            self._take(whole, len(whole) - len(tail))
            if self.size > _RUN or len(self.ids) > _VOCABULARY:
                names = list(self.ids)
                left = [names[i] for i in tail.tolist()]
                yield
                tail = np.fromiter(map(self.ids.__getitem__, left), np.uint64, len(left))
        self._take(tail, len(tail))

    def _take(self, ids: np.ndarray, starts: int) -> None:
        """The first ``starts`` suffixes of ``ids``, 16 bits a word, nothing behind a break."""
        if not starts:
            return
        padded = np.append(ids, np.zeros(DEPTH, np.uint64))
        word = padded[:starts]
        packed, alive = word.copy(), word > 0
        for k in range(1, DEPTH):
            word = padded[k:k + starts]
            alive = alive & (word > 0)
            packed = packed << np.uint64(16) | word * alive
        self.parts.append(packed[packed > 0])
        self.size += len(self.parts[-1])

    def sorted(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by id, distinct packed suffixes in order, their counts; then empty again."""
        suffixes, counts = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (np.zeros(0, np.uint64),) * 2
        words = list(self.ids)
        self.__init__()
        return words, suffixes, counts.astype(np.int64)


def _first(suffixes: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, suffixes[1:] != suffixes[:-1])) if len(suffixes) else np.zeros(0, np.int64)


def _prefix(words: list[bytes], packed: int, depth: int) -> bytes:
    """The words of a packed suffix, each with a space behind it."""
    return b"".join(words[packed >> 16 * (DEPTH - 1 - k) & 0xFFFF] + b" " for k in range(depth) if packed >> 16 * (DEPTH - 1 - k) & 0xFFFF)


class Prefixes:
    """Which group a suffix belongs to: split prefixes, named groups, else a hash."""

    def __init__(self, split: Iterable[tuple[str, bytes]], named: Mapping[tuple[str, bytes], int], groups: int):
        self.split, self.named, self.groups = frozenset(split), dict(named), groups

    def place(self, lang: str, prefix: bytes, depth: int) -> int:
        if depth < DEPTH and (lang, prefix) in self.split:
            return -1
        group = self.named.get((lang, prefix))
        return zlib.crc32(prefix, zlib.crc32(lang.encode())) % self.groups if group is None else group

    def groups_of(self, lang: str, words: list[bytes], suffixes: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(suffixes), np.int64), np.arange(len(suffixes))
        for depth in range(1, DEPTH + 1):
            at = suffixes[todo] >> np.uint64(16 * (DEPTH - depth))
            starts = _first(at)
            places = [self.place(lang, _prefix(words, p, depth), depth)
                      for p in (suffixes[todo[starts]]).tolist()]
            out[todo] = np.repeat(np.array(places, np.int64), np.diff(np.append(starts, len(at))))
            todo = todo[out[todo] < 0]
            if not len(todo):
                return out
        return out


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Sorted runs of (lang, text) rows. Short texts are joined by a break first."""
    runs: dict[str, Run] = {}
    short: dict[str, list[bytes]] = {}
    held = 0

    def add(lang, text):
        run = runs.setdefault(lang, Run())
        for _ in run.add(text):
            yield (lang, *run.sorted())

    def rest():
        for lang, texts in short.items():
            yield from add(lang, _BREAK.join(texts))
        short.clear()
        for lang, run in runs.items():
            yield (lang, *run.sorted())
        runs.clear()

    for batch in batches:
        for part in small(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                held += len(text)
                if len(text) >= _SLICE:
                    yield from add(lang, text)
                else:
                    texts = short.setdefault(lang, [])
                    texts.append(text)
                    if sum(map(len, texts)) >= _SLICE:
                        yield from add(lang, _BREAK.join(short.pop(lang)))
                # languages that are many would each hold a run
                if held > 16 * _RUN:
                    yield from rest()
                    held = 0
    yield from rest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def _in_arrow(df: DataFrame, schema: str, run) -> DataFrame:
    fields = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow(fields)

    def task(batches):
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(task, fields)


def census(texts: DataFrame) -> DataFrame:
    """(lang, prefix, depth, n): suffixes that start with each word, and at least how many
    start with longer prefixes that are frequent somewhere."""
    def run(batches):
        for lang, words, suffixes, counts in _runs(batches):
            for depth in range(1, DEPTH + 1):
                starts = _first(suffixes >> np.uint64(16 * (DEPTH - depth)))
                if not len(starts):
                    continue
                sums = np.add.reduceat(counts, starts)
                whole = (suffixes[starts] >> np.uint64(16 * (DEPTH - depth)) & np.uint64(0xFFFF)) > 0
                keep = np.flatnonzero(whole & ((sums >= LOCAL) | (depth == 1)))
                firsts = suffixes[starts[keep]].tolist()
                yield [lang] * len(keep), [_prefix(words, p, depth) for p in firsts], [depth] * len(keep), sums[keep]

    return _in_arrow(texts, "lang string, prefix binary, depth int, n bigint", run).groupBy("lang", "prefix", "depth").agg(F.sum("n").alias("n"))


def partition(counts: DataFrame, total: int, budget: int) -> Prefixes:
    """The groups of the prefixes of a :func:`census`."""
    budget = max(budget, total // NAMED, 1)
    groups = max(1, -(-2 * total // budget))
    # the budget is at least total / NAMED, which bounds the rows that come here
    rows = sorted(((r.depth, r.lang, bytes(r.prefix), r.n) for r in counts.filter(F.col("n") > budget // 8).collect()))
    split, large = set(), []
    for depth, lang, prefix, n in rows:
        above = prefix[:prefix.rindex(b" ", 0, -1) + 1] if depth > 1 else None
        if above is not None and (lang, above) not in split:
            continue
        if n > budget and depth < DEPTH:
            split.add((lang, prefix))
        else:
            large.append((n, lang, prefix))
    named, room = {}, []
    for n, lang, prefix in sorted(large, key=lambda x: (-x[0], x[1:])):
        group = next((g for g in range(max(0, len(room) - 64), len(room)) if room[g] >= n), None)
        if group is None:
            room.append(budget)
            group = len(room) - 1
        room[group] -= n
        named[lang, prefix] = groups + group
    return Prefixes(split, named, groups)


def _blocks(texts: DataFrame, prefixes: Prefixes) -> DataFrame:
    """(lang, part, words, suffixes, counts): each run's share of each group."""
    def run(batches):
        for lang, words, suffixes, counts in _runs(batches):
            # a suffix of one word is counted already
            longer = (suffixes >> np.uint64(16 * (DEPTH - 2)) & np.uint64(0xFFFF)) > 0
            suffixes, counts = suffixes[longer], counts[longer]
            if not len(suffixes):
                continue
            groups = prefixes.groups_of(lang, words, suffixes)
            order = np.argsort(groups, kind="stable")
            ends = np.append(_first(groups[order]), len(order))
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = suffixes[order[lo:hi]]
                ids = np.stack([own >> np.uint64(16 * (DEPTH - 1 - k)) & np.uint64(0xFFFF) for k in range(DEPTH)])
                used, local = np.unique(np.append(ids.ravel(), np.uint64(0)), return_inverse=True)
                names = b" ".join(words[i] for i in used[1:].tolist())
                yield ([lang], [int(groups[order[lo]])], [names], [local[:-1].astype(np.uint16).tobytes()],
                       [counts[order[lo:hi]].astype(np.int32).tobytes()])

    return _in_arrow(texts, "lang string, part bigint, words binary, suffixes binary, counts binary", run)


def tree(blocks: Iterable[tuple[bytes, bytes, bytes]], split: frozenset[bytes], least: int) -> Iterator[tuple[bytes, int]]:
    """(prefix, count) of the nodes of two words and more over a group's blocks: those
    that have ``least`` leaves at least, and split prefixes with the leaves they have here."""
    ids, columns, totals = _Ids({b"": 0}), [[] for _ in range(DEPTH)], []
    for names, suffixes, counts in blocks:
        own = names.split(b" ") if names else []
        to = np.append(0, np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
        local = np.frombuffer(suffixes, np.uint16).reshape(DEPTH, -1)
        for k in range(DEPTH):
            columns[k].append(to[local[k]])
        totals.append(np.frombuffer(counts, np.int32))
    cols = [np.concatenate(c) for c in columns]
    counts = np.concatenate(totals).astype(np.int64)
    words, bits = list(ids), max(1, len(ids).bit_length())
    if bits * DEPTH <= 64:
        packed = np.zeros(len(counts), np.uint64)
        for c in cols:
            packed = packed << np.uint64(bits) | c.astype(np.uint64)
        order = np.argsort(packed)
    else:
        order = np.lexsort(cols[::-1])
    cols, counts = [c[order] for c in cols], counts[order]
    edge = np.append(True, cols[0][1:] != cols[0][:-1])
    for depth in range(2, DEPTH + 1):
        edge = edge | np.append(True, cols[depth - 1][1:] != cols[depth - 1][:-1])
        starts = np.flatnonzero(edge)
        sums = np.add.reduceat(counts, starts)
        above = {ids[p[:p.index(b" ")]] for p in split if p.count(b" ") == depth and p[:p.index(b" ")] in ids}
        maybe = np.isin(cols[0][starts], list(above)) if above else np.zeros(len(starts), bool)
        for i in np.flatnonzero(((sums >= least) | maybe) & (cols[depth - 1][starts] > 0)).tolist():
            prefix = b"".join(words[c[starts[i]]] + b" " for c in cols[:depth])
            if sums[i] >= least or prefix in split:
                yield prefix, int(sums[i])


def _nodes(blocks: DataFrame, split: Iterable[tuple[str, bytes]], least: int) -> DataFrame:
    by_lang: dict[str, set[bytes]] = {}
    for lang, prefix in split:
        by_lang.setdefault(lang, set()).add(prefix)
    names = {lang: frozenset(own) for lang, own in by_lang.items()}

    def run(batches):
        key, held = None, []

        def done():
            found = list(tree(held, names.get(key[1], frozenset()), least))
            if found:
                prefixes, counts = zip(*found)
                yield [key[1]] * len(found), prefixes, counts

        for batch in batches:
            for part in small(batch):
                for lang, group, words, suffixes, counts in zip(*(c.to_pylist() for c in part.columns)):
                    if held and key != (group, lang):
                        yield from done()
                        held = []
                    key = group, lang
                    held.append((words, suffixes, counts))
        if held:
            yield from done()

    dealt = blocks.repartition("part", "lang").sortWithinPartitions("part", "lang")
    # a split prefix has a row of each group
    found = _in_arrow(dealt, "lang string, prefix binary, n bigint", run)
    return found.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to DEPTH words that stand at least
    ``least`` times; (lang, n) of all languages with words."""
    texts = _texts(docs)
    counts = scratch(census(texts), "census")
    words = counts.filter("depth = 1").select("lang", "prefix", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    # groups for every task of a shuffle, also where the input is small
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefixes = partition(counts, total, min(budget, max(1 << 14, total // tasks)))
    nodes = _nodes(_blocks(texts, prefixes), prefixes.split, least)
    found = scratch(words.filter(F.col("n") >= least).union(nodes), "nodes")
    phrase = F.rtrim(F.col("prefix").cast("string"), F.lit(" "))
    return found.select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("size"), F.col("n").alias("f")), totals


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    counts, totals = phrase_counts(docs, least, budget)
    words = F.split("phrase", " ")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = (counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("_w"), "size",
                                             F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", _part(F.col("_w"), 1, F.col("k")).alias("_left"),
                    _part(F.col("_w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("_right")))
    of = lambda name, side: counts.select(F.col("lang").alias(f"_{side}l"), F.col("phrase").alias(f"_{side}p"), F.col("f").alias(name))
    scored = (cuts.join(of("l", "x"), (F.col("lang") == F.col("_xl")) & (F.col("_left") == F.col("_xp")))
              .join(of("r", "y"), (F.col("lang") == F.col("_yl")) & (F.col("_right") == F.col("_yp")))
              .withColumn("_num", F.lit(2_000_000).cast("decimal(7,0)") * exact("a")).withColumn("_den", exact("l") + exact("r"))
              .withColumn("score", F.expr("_num div _den")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    # contiguous parts of two words and more, with the most frequent phrase around them
    longer = counts.filter("size > 2").select("lang", words.alias("_w"), "size", "f")
    inside = longer.select("lang", "f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: _part(F.col("_w"), s, m))))).alias("_inner"))
    cover = inside.groupBy(F.col("lang").alias("_cl"), "_inner").agg(F.max("f").alias("_f"))
    kept = (best.join(cover, (F.col("lang") == F.col("_cl")) & (F.col("phrase") == F.col("_inner")), "left")
            .filter(F.col("_f").isNull() | (exact("_f") * 100 < exact("a") * COVER))
            .select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS part, max(f) AS f
  FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < size AND s + m - 1 <= size GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.phrase
  WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
