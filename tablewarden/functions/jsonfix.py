"""Recursive boolean coercion of JSON text (P17) with built-ins only.

Text is first canonicalised by ``parse_json``/``to_json`` (compact, no spaces,
keys sorted, strings re-escaped). In canonical text an unescaped ``"`` always
delimits a string, a value string is preceded by ``:``, ``[`` or ``,`` and
followed by ``,``, ``]`` or ``}``, and a key is followed by ``:``. So a
look-around regex rewrites exactly the string *values* equal to true/false
(ignoring case, no trimming) at any depth and leaves keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """Canonical compact JSON, or null when the text is not valid JSON
    (including duplicate keys, which ``parse_json`` rejects)."""
    return F.to_json(F.try_parse_json(text))


def _replace_word(c: Column, word: str) -> Column:
    inner = rf'(?i)(?<=[:\[,])"{word}"(?=[,\]}}])'
    bare = rf'(?i)^"{word}"$'
    return F.regexp_replace(F.regexp_replace(c, inner, word), bare, word)


def coerce_boolean_json(text: Column) -> Column:
    """JSON text in, canonical JSON text out, with "true"/"false" string values
    (any case) turned into JSON booleans. Invalid JSON gives null."""
    return _replace_word(_replace_word(canonical_json(text), "true"), "false")


def coerce_boolean_text(text: Column) -> Column:
    """JSON text that parses to what :func:`coerce_boolean_json` gives. Text with
    an escape that could spell a letter goes through canonical text, which is slow; any
    other with a quoted true or false is changed as it is. In JSON a quote before a word is no string's end, and an escaped one follows a
    backslash, so a quoted word without one is a whole string: a key if a colon follows."""
    raw = text
    for word in ("true", "false"):
        raw = F.regexp_replace(raw, rf'(?i)(?<!\\)"{word}"(?!\s*+:)', word)
    return (F.when(text.contains("\\u"), coerce_boolean_json(text))
            .when(F.lower(text).contains('"true"') | F.lower(text).contains('"false"'), F.when(F.try_parse_json(text).isNotNull(), raw)).otherwise(text))
