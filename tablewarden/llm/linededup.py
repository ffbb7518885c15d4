"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is the text between two line feeds; its words are its runs of characters
other than space and \\t\\n\\v\\f\\r. Two lines are near if their word sequences are
equal or, both having at least MIN_WORDS words, one inserted, deleted or replaced
word apart. A line is removed if a near line stands earlier in the input (by
doc_id, then line number; null ids last), whether or not that line stays itself.
Lines without words are neither compared nor removed.

Steps
1. Equal lines become classes: 96-bit hash, earliest place. All that follows is
   per class, so thousands of copies of a line cost one row.
2. Prefilter without loss: of two lines one word apart, either the first or the
   last half of the shorter is intact in the other, so each class has three hashed
   halves; classes that share none with another are done.
3. The others emit all variants within the bound as hashed keys. Replaced word i:
   (length, i, sum of positional word hashes without word i). Deleted word i: the
   sum of word-pair hashes with i taken out, which equals the whole-line key of the
   line that lacks it. Sums are modulo 2^62, so a variant costs constant work.
4. Equal keys are joined. All lines that share a replacement key are within the
   bound of each other, so each meets the earliest only; a deletion key pairs a
   whole line with its one-word-longer neighbours. Neither makes all pairs of a group.
5. The edit distance is verified on the words, and the later class is removed.

Tables of shared keys are written before they are joined: AQE splits a hot key
only where both sides of a join come straight from a shuffle or a table.

Null texts count as empty and stay null. Rows that repeat a doc_id and text are the
same document: they keep the same lines. Extra columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import let, scratch, table

MIN_WORDS = 5
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]"
_MASK = (1 << 62) - 1


def _words(line: Column) -> Column:
    """The words of a line; most lines have single spaces only, and need no regex."""
    odd = reduce(lambda a, b: a | b, [line.contains(s) for s in ("  ", "\t", "\v", "\f", "\r")])
    plain = ~(odd | (line == "") | line.startswith(" ") | line.endswith(" "))
    return F.when(plain, F.split(line, " ")).otherwise(F.filter(F.split(line, SPACE), lambda w: w != ""))


def _hash(*parts) -> Column:
    return F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _sum(hashes: Column) -> Column:
    """Sum modulo 2^62 of an array of longs below 2^62."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + h).bitwiseAND(F.lit(_MASK)))


def _doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, no, words of every line that has words."""
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    # a filter on the words would be pushed below and split each line twice
    return lines.where(F.col("line").rlike(WORD)).select("doc_id", "text_hash", "no", _words(F.col("line")).alias("words"))


def _halves(words: Column, n: Column) -> Column:
    """Hashed halves under which a line of n words meets lines of n, n + 1 and n - 1
    words: the first floor(m / 2) and the last ceil(m / 2) for m of n and n - 1. One
    of the two lengths is the same for both, so there are three."""
    low = F.floor((n - 1) / 2).cast("int")
    front = lambda h: _hash(0, F.slice(words, F.lit(1), h))
    back = lambda h: _hash(1, F.slice(words, n - h + 1, h))
    odd = F.array(front(low), back(low + 1), back(low))
    even = F.array(front(low + 1), front(low), back(low + 1))
    return (F.when(n < MIN_WORDS, F.array().cast("array<bigint>")).when(n % 2 == 1, odd).otherwise(even))


def _classes(docs: DataFrame) -> DataFrame:
    """One row per distinct line: h1, h2, first (its earliest place), halves."""
    n = F.size("words")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "no")
    return (_doc_lines(docs)
            .select(F.xxhash64("words").alias("h1"),
                    F.hash("words").alias("h2"), place.alias("place"), _halves(F.col("words"), n).alias("halves"))
            .groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("halves").alias("halves")))


def _candidates(classes: DataFrame) -> DataFrame:
    """The classes that share a half with another class."""
    halves = classes.select("h1", F.explode("halves").alias("half"))
    # the halves of one class differ, so two rows of a half are two classes
    shared = scratch(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), "halves")
    ids = halves.join(shared, "half", "left_semi").select("h1").distinct()
    return classes.join(ids, "h1", "left_semi").select("h1", "h2", "first")


def _with_words(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """``candidates`` with their words, read at their first place."""
    places = candidates.groupBy(F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t")).agg(
        F.collect_list(F.struct(F.col("first.no").alias("no"), "h1", "h2", "first")).alias("lines"))
    met = docs.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    found = met.select(let(F.split("text", "\n"), lambda ls: F.transform("lines", lambda x: F.struct(
        x["h1"].alias("h1"), x["h2"].alias("h2"), x["first"].alias("first"), F.get(ls, x["no"]).alias("line")))).alias("lines"))
    return (found.select(F.inline("lines")).dropDuplicates(["h1", "h2"])
            .select("h1", "h2", "first", _words(F.col("line")).alias("words")))


def _variants(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replacement variants, deletion variants, whole lines), each keyed by ``key``."""
    words, n = F.col("words"), F.size("words")
    own = F.transform(words, lambda w, i: _hash(2, i, w).bitwiseAND(F.lit(_MASK)))
    link = lambda a, b: _hash(3, F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))).bitwiseAND(F.lit(_MASK))
    # words are never empty, so "" marks both ends
    pairs = F.transform(F.sequence(F.lit(0), n), lambda i: link(F.when(i > 0, F.get(words, i - 1)), F.get(words, i)))
    kept = lines.select("h1", "h2", "first", "words", n.alias("n"), own.alias("own"), pairs.alias("pairs"))
    sums = scratch(kept.select("h1", "h2", "first", "words", "n", "own", "pairs", _sum(F.col("own")).alias("own_sum"),
                               _sum(F.col("pairs")).alias("pair_sum")), "line-sums")
    minus = lambda a, *bs: reduce(lambda x, b: (x - b).bitwiseAND(F.lit(_MASK)), bs, a)
    at = F.sequence(F.lit(0), F.col("n") - 1)
    replaced = sums.select("h1", "h2", "first", F.explode(F.transform(
        "own", lambda h, i: _hash(4, F.col("n"), i, minus(F.col("own_sum"), h)))).alias("key"))
    less = lambda i: (minus(F.col("pair_sum"), F.get("pairs", i), F.get("pairs", i + 1)) + link(
        F.when(i > 0, F.get("words", i - 1)), F.get("words", i + 1))).bitwiseAND(F.lit(_MASK))
    deleted = sums.where(F.col("n") > MIN_WORDS).select("h1", "h2", "first", F.explode(F.array_distinct(F.transform(
        at, lambda i: _hash(5, F.col("n") - 1, less(i))))).alias("key"))
    whole = sums.select("h1", "h2", "first", _hash(5, F.col("n"), F.col("pair_sum")).alias("key"))
    return replaced, deleted, whole


def _one_apart(x: Column, y: Column) -> Column:
    """Whether word arrays differ by at most one inserted, deleted or replaced word:
    the words they share from the front and from the back leave one at most."""
    def shared(a: Column, b: Column) -> Column:
        equal = F.zip_with(a, b, lambda u, v: F.coalesce(u == v, F.lit(False)))
        return let(F.array_position(equal, False), lambda p: F.when(p > 0, p - 1).otherwise(F.size(a)))

    return shared(x, y) + shared(F.reverse(x), F.reverse(y)) >= F.greatest(F.size(x), F.size(y)) - 1


def _near(lines: DataFrame) -> DataFrame:
    """The first places of the classes that have a near class with an earlier one."""
    replaced, deleted, whole = _variants(lines)
    earliest = scratch(replaced.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("e"), F.count("*").alias("c"))
                       .where("c > 1").select("key", "e"), "replacements")
    by_replacing = replaced.join(earliest, "key").where(F.col("e.first") < F.col("first")).select(
        F.struct("h1", "h2").alias("later"), F.struct("e.h1", "e.h2").alias("earlier"))
    other = whole.select("key", F.struct("h1", "h2").alias("w"), F.col("first").alias("w_first"))
    first, mine = F.col("first") < F.col("w_first"), F.struct("h1", "h2")
    by_deleting = deleted.join(other, "key").select(
        F.when(first, F.col("w")).otherwise(mine).alias("later"), F.when(first, mine).otherwise(F.col("w")).alias("earlier"))
    pairs = by_replacing.union(by_deleting).distinct()
    text = lines.select(F.struct("h1", "h2").alias("line"), "words")
    both = (pairs.join(text.select(F.col("line").alias("later"), F.col("words").alias("x")), "later")
            .join(text.select(F.col("line").alias("earlier"), F.col("words").alias("y")), "earlier"))
    same = _one_apart(F.col("x"), F.col("y"))
    return both.where(same).select("later").distinct().join(
        lines.select(F.struct("h1", "h2").alias("later"), "first"), "later").select("first")


def dedup_lines(docs: DataFrame, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with near-duplicate lines taken out of ``text_col``; with ``counts`` also the
    columns n_lines and n_removed (replacing any of that name)."""
    named = docs.select(*(F.col(c).alias("doc_id" if c == "doc_id" else "text" if c == text_col else f"x_{c}")
                          for c in docs.columns))
    named = named.withColumn("text_hash", F.xxhash64("text"))
    own = named.select("doc_id", "text", "text_hash")
    classes = scratch(_classes(own), "line-classes")
    lines = scratch(_with_words(_candidates(classes), own), "line-words")
    firsts = classes.select("first", F.lit(True).alias("own")).union(_near(lines).select("first", F.lit(False)))
    of = lambda own: F.collect_list(F.when(F.col("own") == own, F.col("first.no")))
    kept = (firsts.groupBy(F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"))
            .agg(F.array_except(of(True), of(False)).alias("kept")))
    joined = named.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    first = F.coalesce("kept", F.array().cast("array<int>"))

    def rebuild(ls: Column) -> Column:
        """The kept lines and those without words, in their order; set operations keep it linear."""
        blank = F.filter(F.transform(ls, lambda x, i: F.when(~x.rlike(WORD), i)), lambda i: i.isNotNull())
        return let(F.array_sort(F.array_union(blank, first)), lambda at: F.struct(
            F.array_join(F.transform(at, lambda i: F.get(ls, i)), "\n").alias("text"),
            F.size(ls).alias("n_lines"), (F.size(ls) - F.size(at)).alias("n_removed")))

    done = joined.withColumn("done", F.when(F.col("text").isNotNull(), let(F.split("text", "\n"), rebuild)))
    out = [F.col("done.text").alias(c) if c == text_col else F.col("doc_id" if c == "doc_id" else f"x_{c}").alias(c)
           for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if not counts:
        return done.select(*out)
    count = lambda c: F.coalesce(F.col(f"done.{c}"), F.lit(0)).cast("long").alias(c)
    return done.select(*out, count("n_lines"), count("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# Every pair of lines that share a half and a length within one is compared by its common
# words from both ends: a way of its own, without hashes, variants or classes of the operator.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, u.no - 1 AS no, u.line, list_filter(regexp_split_to_array(u.line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no) u
), c AS (
  SELECT w, len(w) AS n, min(row(doc_id, no)) AS first FROM l WHERE len(w) > 0 GROUP BY w
), k AS (
  SELECT w, n, first, unnest([n, n - 1]) AS m FROM c WHERE n >= 5
), s AS (
  SELECT w, n, first, m, 'front' AS side, w[1:m // 2] AS part FROM k WHERE m >= 5
  UNION ALL SELECT w, n, first, m, 'back', w[n - (m - m // 2) + 1:n] FROM k WHERE m >= 5
), p AS (
  SELECT DISTINCT a.w AS x, b.w AS y, a.n AS xn, b.n AS yn, b.first
  FROM s a JOIN s b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND least(a.n, b.n) = a.m AND a.first < b.first
), e AS (
  SELECT y, xn, yn,
    coalesce(list_min(list_filter(range(1, least(xn, yn) + 1), lambda i: x[i] <> y[i])) - 1, least(xn, yn)) AS f,
    coalesce(list_min(list_filter(range(1, least(xn, yn) + 1), lambda i: x[xn + 1 - i] <> y[yn + 1 - i])) - 1, least(xn, yn)) AS g
  FROM p
), near AS (
  SELECT DISTINCT y AS w FROM e WHERE f + g >= greatest(xn, yn) - 1
), o AS (
  SELECT l.doc_id, l.no, l.line,
    len(l.w) = 0 OR (c.first = row(l.doc_id, l.no) AND NOT EXISTS (SELECT 1 FROM near WHERE near.w = l.w)) AS kept
  FROM l LEFT JOIN c ON l.w = c.w
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (kept), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""
