"""String predicates and parsers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes by default
# (Unicode whitespace plus the ASCII separators 0x1C-0x1F), as a Java regex class.
_PY_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda
    variable is a reference, not a copy of the expression)."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column) -> Column:
    """Empty string counts as 'not given' (Python truthiness of the reference)."""
    return F.nullif(c, F.lit(""))


def affix_match(name: Column, prefix: Column, suffix: Column, contains: Column) -> Column:
    """Case-sensitive prefix AND suffix AND substring test; null/'' parts are absent.

    Uses startswith/endswith/contains (never LIKE: ``_`` and ``%`` are literals here).
    A null name never matches.
    """
    p, s, c = blank_to_null(prefix), blank_to_null(suffix), blank_to_null(contains)
    return (
        name.isNotNull()
        & (p.isNull() | name.startswith(p))
        & (s.isNull() | name.endswith(s))
        & (c.isNull() | name.contains(c))
    )


def contains_ignore_case(name: Column, pattern: Column) -> Column:
    """case-insensitive substring; an empty or null pattern keeps everything.

    A null name is treated as ''.
    """
    pat = F.lower(F.coalesce(pattern, F.lit("")))
    return (pat == "") | F.lower(F.coalesce(name, F.lit(""))).contains(pat)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` with no argument."""
    return F.regexp_replace(F.regexp_replace(c, "^" + _PY_SPACE + "+", ""), _PY_SPACE + "+$", "")


def split_key_value(raw: Column) -> Column:
    """``key:value`` split at the first colon, both sides stripped.

    Returns ``struct<tag_key, tag_value, valid>``; text without a colon is not valid.
    """
    parts = F.split(raw, ":", 2)
    ok = raw.isNotNull() & (F.size(parts) == 2)
    return F.struct(
        F.when(ok, py_strip(F.get(parts, 0))).alias("tag_key"),
        F.when(ok, py_strip(F.get(parts, 1))).alias("tag_value"),
        F.coalesce(ok, F.lit(False)).alias("valid"),
    )


def invalid_path(path: Column) -> Column:
    """empty, or containing a space or a percent sign."""
    return F.coalesce(
        path.isNull() | (path == "") | path.contains(" ") | path.contains("%"), F.lit(True)
    )


def minimizers(text: Column, windows: Sequence[int], gram: int) -> Column:
    """(window, hash) of the least-hashed ``gram`` of every window of ``text``, for each of
    ``windows`` (characters; beyond ``gram`` powers of two), each hash once; a window of up to
    ``gram`` (a power of two) is its own gram. A text that contains another of at least
    ``window`` characters has all of the other's hashes, about one for every half window.

    Hashes of 2n characters come from those of n (as do those between, of two that overlap),
    and least hashes of 2n grams from those of n, so all windows share one pass."""
    def pairs(a: Column, shift: int, fn: Callable) -> Column:
        left = F.greatest(F.size(a) - shift, F.lit(0))
        return F.zip_with(F.slice(a, 1, left), F.slice(a, shift + 1, left), fn)

    def found(a: Column, window: int) -> Column:
        return F.transform(F.array_distinct(a), lambda g: F.struct(F.lit(window).alias("window"), g.alias("gram")))

    def hashes(a: Column, size: int) -> Column:
        out = [found(pairs(a, w - size, lambda x, y: F.xxhash64(x, y)) if w > size else a, w)
               for w in windows if size <= w < 2 * size and w <= gram]
        if size < gram and any(w >= 2 * size for w in windows):
            out.append(let(pairs(a, size, lambda x, y: F.xxhash64(x, y)), lambda b: hashes(b, 2 * size)))
        elif size == gram and any(w > gram for w in windows):
            out.append(least(a, 1))
        return F.concat(*out)

    def least(a: Column, width: int) -> Column:
        spans = {w: w - gram + 1 for w in windows if w > gram}
        out = [found(pairs(a, n - width, lambda x, y: F.least(x, y)), w) for w, n in spans.items() if width <= n < 2 * width]
        if any(n >= 2 * width for n in spans.values()):
            out.append(let(pairs(a, width, lambda x, y: F.least(x, y)), lambda b: least(b, 2 * width)))
        return F.concat(*out)

    return let(F.transform(F.split(text, ""), lambda c: F.xxhash64(c)), lambda a: hashes(a, 1))


def blocks(text: Column, size: int, overlap: int) -> Column:
    """``text`` in pieces of ``size`` characters, each with up to ``overlap`` (at most
    ``size``) of the next, so that work on a long text stays small at a time."""
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda parts: F.transform(
        parts, lambda part, i: F.concat(part, F.coalesce(F.get(parts, i + 1).substr(1, overlap), F.lit("")))))
