"""Theta join of rows to prefix/suffix/contains patterns (J8), as one equi join.

Every part of a pattern gives *anchors*, values that each matching row must have:
the part itself for a prefix or suffix (longer ones cut to a power of two) and for a
substring of up to GRAM characters, for a longer one of enough words its longest run of
WORDS words (its first and last word may be parts of longer ones), and for any other the
least-hashed grams of its windows. Of a pattern's anchors the one that fewest rows have is used: rows are counted
by anchor, each anchor for itself, so a common prefix or a one-letter part is no
key where another part is rarer, however many patterns there are.

A row has one anchor for each prefix and suffix length in use, one for every place of a
short substring's length, one for every run of WORDS words, and one for about every half
window of a long substring's. Anchors are
64-bit hashes of the kind, the length, the scope columns that the pattern restricts and the
value, whose lowest bits are a code of the shape (kind, length, scope); the join carries hashes only, (row hash, anchor), and candidate pairs come back
to the rows by the row hash, where the full predicate decides. Patterns that a count
finds few and short are broadcast; rows and their anchors never are, as files of repeated
names are far smaller than their rows. AQE splits hot keys.

Building the plan runs one small job, the distinct shapes of the
patterns: at most some hundred rows, and rows have no anchors of other shapes. Where
patterns have a choice of anchors, it also writes the rows' anchors (two numbers each), as
both the count and the join read them, the patterns' anchors, their counts, and the patterns with the anchor chosen. Then shapes that
few patterns chose are broadcast though others are not, and rows' anchors of shapes that none chose are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import affix_match, blocks, let, minimizers
from tablewarden.sources.scratch import written

PARTS = ("prefix", "suffix", "contains")
EXACT = 64  # prefixes and suffixes up to here are anchors as a whole
GRAM = 16  # substrings up to here are anchors as a whole
WORDS = 3  # words, parted by a space, of a longer substring's anchor
WINDOW = 4096  # the longest window of a substring; also the size of a text's blocks
BLOCK = 64  # characters of a text's blocks for short substrings
CODES = 1 << 10  # shapes are told apart by so many codes
SHARED = 1000  # an anchor of more patterns is no key of a join of patterns
FEW_PATTERNS, FEW_CHARS = 50_000, 1 << 22  # parts, and their characters, that are broadcast


def normalize_patterns(patterns: DataFrame, scope_cols: Sequence[str] = ()) -> DataFrame:
    """Empty strings become null (absent); adds ``refused`` when all three are absent."""
    cols = [F.col("pattern_id")]
    for c in PARTS:
        cols.append(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c))
    cols += [F.col(c) for c in scope_cols]
    out = patterns.select(*cols)
    return out.withColumn("refused", F.coalesce(*PARTS).isNull())


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.floor(F.log2(n)).cast("int"))


def _end(kind: int, text: Column, length: Column) -> Column:
    return text.substr(F.length(text) - length + 1, length) if kind == 1 else text.substr(F.lit(1), length)


def _code(anchor: Column) -> Column:
    """The code of an anchor's shape; two shapes may share one."""
    return anchor.bitwiseAND(F.lit(CODES - 1).cast("bigint"))


def _anchor(kind: int, length: Column, mask: Column, scope: Sequence[Column], value: Column) -> Column:
    shape = _code(F.xxhash64(F.lit(kind), length.cast("int"), mask))
    return F.xxhash64(F.lit(kind), length, mask, *scope, value).bitwiseAND(F.lit(-CODES).cast("bigint")).bitwiseOR(shape)


def _grams(text: Column, length: Column, most: int, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of the substrings of ``length`` characters that start at one of the first ``most``."""
    starts = F.sequence(F.lit(1), F.least(F.length(text) - length + 1, F.lit(most)))
    return F.when(F.length(text) >= length, F.transform(starts, lambda i: fn(text.substr(i, length)))).otherwise(F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return F.split(text, " ", -1)


def _inner_words(part: Column) -> Column:
    """The words of a substring that are whole words of any text it stands in; of a long
    substring, those of its start."""
    return let(_words(part.substr(1, 2 * WINDOW)), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))


def _word_runs(words: Column) -> Column:
    """Hashes of every WORDS words that follow each other."""
    def longer(hashes: Column, more: int) -> Column:
        if not more:
            return hashes
        return let(hashes, lambda h: longer(F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b)), more - 1))

    return longer(F.transform(words, lambda w: F.xxhash64(w)), WORDS - 1)


def _longest_run(part: Column) -> Column:
    """The hash of the run of most characters among a substring's inner words."""
    def sizes(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (WORDS - 1))
        return F.transform(at, lambda i: F.struct(F.length(F.array_join(F.slice(w, i, WORDS), "")).alias("n"), i.alias("i")))

    return let(_inner_words(part), lambda w: F.get(_word_runs(w), F.array_max(sizes(w))["i"] - 1))


def _parts(patterns: DataFrame, scope_cols: Sequence[str]) -> DataFrame:
    """Usable patterns as ``_p_*`` columns, one row per present part, with its shape.
    Every column is new, so a pattern table may derive from the rows it is joined to."""
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(scope_cols)), F.lit(0))
    n = [F.length(c) for c in PARTS]
    length = [F.when(x <= EXACT, x).otherwise(_power(x)) for x in n[:2]] + [F.when(n[2] <= GRAM, n[2]).otherwise(F.least(_power(n[2]), F.lit(WINDOW)))]
    worded = (n[2] > GRAM) & (F.size(_inner_words(F.col("contains"))) >= WORDS)
    kinds, length = [F.lit(0), F.lit(1), F.when(worded, 3).otherwise(2)], [*length[:2], F.when(worded, WORDS).otherwise(length[2])]
    shapes = [F.when(n[k].isNotNull(), F.struct(kinds[k].alias("kind"), length[k].cast("int").alias("length"),
                                                F.col(c).alias("part"))) for k, c in enumerate(PARTS)]
    return patterns.filter(~F.col("refused")).select(
        F.col("pattern_id").alias("_p_id"), *[F.col(c).alias(f"_p_{c}") for c in PARTS],
        *[F.col(c).cast("string").alias(f"_p_{c}") for c in scope_cols], mask.alias("_p_mask"),
        F.inline(F.filter(F.array(*shapes), lambda x: x.isNotNull())))


def _pattern_anchors(parts: DataFrame, scope_cols: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """One row per pattern and anchor that could stand for it."""
    scope = [F.coalesce(F.col(f"_p_{c}"), F.lit("")) for c in scope_cols]
    kind, length, part, mask = (F.col(c) for c in ("kind", "length", "part", "_p_mask"))
    out = F.array().cast("array<bigint>")
    if long := [n for n in windows if n > GRAM]:
        # windows of a substring's start are enough; two blocks of it at most
        grams = F.filter(minimizers(part.substr(1, 2 * WINDOW), long, GRAM), lambda x: x["window"] == length)
        out = F.when(kind == 2, F.transform(grams, lambda x: _anchor(2, length, mask, scope, x["gram"]))).otherwise(out)
    if len(long) < len(windows):
        # one for a part of up to GRAM characters; those of fewer than 2 * GRAM have some of GRAM
        short = F.array_distinct(_grams(part, length, GRAM, lambda x: _anchor(2, length, mask, scope, F.xxhash64(x))))
        out = F.when((kind == 2) & (length <= GRAM), short).otherwise(out)
    out = F.when(kind == 3, F.array(_anchor(3, length, mask, scope, _longest_run(part)))).otherwise(out)
    for k in (0, 1):
        out = F.when(kind == k, F.array(_anchor(k, length, mask, scope, F.xxhash64(_end(k, part, length))))).otherwise(out)
    kept = [c for c in parts.columns if c.startswith("_p_") and c != "_p_mask"]
    return parts.select(*kept, F.explode(out).alias("_p_anchor"))


def _row_anchors(rows: DataFrame, name_col: str, shapes: Sequence[tuple[int, int, int]], scope_cols: Sequence[str]) -> DataFrame:
    """(_id, _anchor): the hash of each row's name and the anchors it has."""
    name = F.col(name_col)
    found = []
    for kind, mask in sorted({(k, m) for k, _, m in shapes}):
        lengths = sorted(n for k, n, m in shapes if (k, m) == (kind, mask))
        scope = [F.coalesce(F.col(c).cast("string"), F.lit("")) if mask >> i & 1 else F.lit("") for i, c in enumerate(scope_cols)]
        if kind < 2:
            long_enough = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(name))
            found.append(F.transform(long_enough, lambda n: _anchor(
                kind, n, F.lit(mask), scope, F.xxhash64(_end(kind, name, n)))))
            continue
        if kind == 3:
            found.append(F.transform(F.array_distinct(_word_runs(_words(name))), lambda run: _anchor(3, F.lit(WORDS), F.lit(mask), scope, run)))
            continue
        if long := [n for n in lengths if n > GRAM]:
            grams = F.array_distinct(F.flatten(F.transform(blocks(name, WINDOW, max(long) - 1), lambda b: minimizers(b, long, GRAM))))
            found.append(F.transform(grams, lambda x: _anchor(2, x["window"], F.lit(mask), scope, x["gram"])))
        if short := [n for n in lengths if n <= GRAM]:
            found.append(F.array_distinct(F.flatten(F.transform(blocks(name, BLOCK, GRAM - 1), lambda b: F.concat(*[
                _grams(b, F.lit(n), BLOCK, lambda x: _anchor(2, F.lit(n), F.lit(mask), scope, F.xxhash64(x))) for n in short])))))
    every = F.concat(*found) if found else F.array().cast("array<bigint>")
    return rows.filter(name.isNotNull()).select(F.xxhash64(name).alias("_id"), F.explode(every).alias("_anchor"))


def _rarest(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Of each pattern's anchors the one that fewest rows have. The count is exact: in a sketch
    some of many patterns would find their rare anchor under a common one's count, and meet every row.
    Counts of the anchors that over SHARED patterns have, few by that, are broadcast to them."""
    counts = anchors.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_rows"))
    wanted = candidates.groupBy("_p_anchor").agg((F.count(F.lit(1)) > SHARED).alias("_common"))
    known = written(wanted.join(counts.hint("merge"), F.col("_p_anchor") == F.col("_anchor"), "left").select(
        F.col("_p_anchor").alias("_known"), "_common", F.coalesce("_rows", F.lit(0)).alias("_n")), "counts")
    common = known.filter("_common").select(F.col("_known").alias("_shared"), F.col("_n").alias("_shared_n"))
    counted = candidates.join(common.hint("broadcast"), F.col("_p_anchor") == F.col("_shared"), "left")
    # a pattern whose count is there already goes anywhere, to no match
    key = F.when(F.col("_shared").isNull(), F.col("_p_anchor")).otherwise(F.xxhash64("_p_id"))
    counted = counted.join(known.filter(~F.col("_common")).select("_known", "_n").hint("merge"),
                           (key == F.col("_known")) & F.col("_shared").isNull(), "left")
    kept = [c for c in candidates.columns if c != "_p_anchor"]
    return counted.groupBy(*kept).agg(F.min_by("_p_anchor", F.struct(F.coalesce("_shared_n", "_n"), "_p_anchor")).alias("_p_anchor"))


def _few(counts: Sequence[tuple[int, int, int]]) -> set[int]:
    """Of (code, patterns, characters) the codes of fewest patterns that can be broadcast together."""
    out, patterns, chars = set(), 0, 0
    for code, n, size in sorted(counts, key=lambda x: (x[1], x[2])):
        patterns, chars = patterns + n, chars + size
        if patterns > FEW_PATTERNS or chars > FEW_CHARS:
            break
        out.add(code)
    return out


def match_patterns(rows: DataFrame, patterns: DataFrame, name_col: str, *,
                   scope_cols: Sequence[str] = ()) -> DataFrame:
    """Pairs of ``rows`` and non-refused ``patterns`` whose predicate holds on
    ``rows[name_col]``; ``patterns`` must already be normalised.

    ``scope_cols`` name columns present on both sides; a non-null pattern
    value restricts it to rows with the same value. Each result row is a row
    of ``rows`` plus ``pattern_id``; a (row, pattern) pair appears once. Building the
    plan runs jobs: the patterns' shapes, and where there is a choice the rows' anchors
    and the patterns' chosen ones.
    """
    parts = _parts(patterns, scope_cols)
    present = F.size(F.array_compact(F.array(*[f"_p_{c}" for c in PARTS])))
    seen = parts.groupBy("kind", "length", "_p_mask").agg(
        F.max(present).alias("most"), F.count(F.lit(1)).alias("rows"), F.sum(F.length("part")).alias("chars")).collect()
    shapes = [tuple(r)[:3] for r in seen]
    candidates = _pattern_anchors(parts, scope_cols, sorted({n for k, n, _ in shapes if k == 2}))
    anchors = _row_anchors(rows, name_col, shapes, scope_cols)
    # a prefix, a suffix, and a substring that is short or of words, alone leave nothing to choose
    choice = any(r["most"] > 1 or r["kind"] == 2 and r["length"] > GRAM for r in seen)
    if choice:
        anchors = written(anchors, "anchors")
        chosen = written(_rarest(written(candidates, "candidates"), anchors), "chosen")
        size = sum((F.coalesce(F.length(f"_p_{c}"), F.lit(0)) for c in PARTS), F.lit(0))
        counts = [tuple(r) for r in chosen.groupBy(_code(F.col("_p_anchor"))).agg(F.count(F.lit(1)), F.sum(size)).collect()]
        few = _few(counts)
        sides = [("broadcast", few), ("merge", {code for code, *_ in counts} - few)]
        # no pattern at all still needs a join
        pairs = [anchors.filter(_code(F.col("_anchor")).isin(codes)).join(
            chosen.filter(_code(F.col("_p_anchor")).isin(codes)).hint(how), F.col("_anchor") == F.col("_p_anchor"))
            for how, codes in sides if codes] or [anchors.join(chosen.hint("broadcast"), F.col("_anchor") == F.col("_p_anchor"))]
        pairs = reduce(DataFrame.union, pairs)
    else:
        # rows are read once, as their anchors are not written
        few = sum(r["rows"] for r in seen) <= FEW_PATTERNS and sum(r["chars"] for r in seen) <= FEW_CHARS
        pairs = anchors.join(candidates.hint("broadcast" if few else "merge"), F.col("_anchor") == F.col("_p_anchor"))
    pairs = pairs.drop("_anchor", "_p_anchor").distinct()
    cond = F.xxhash64(rows[name_col]) == pairs["_id"]
    cond = cond & affix_match(rows[name_col], pairs["_p_prefix"], pairs["_p_suffix"], pairs["_p_contains"])
    for c in scope_cols:
        cond = cond & (pairs[f"_p_{c}"].isNull() | (rows[c].cast("string") == pairs[f"_p_{c}"]))
    return rows.join(pairs.hint("merge"), cond).select(*[rows[c] for c in rows.columns], F.col("_p_id").alias("pattern_id"))
