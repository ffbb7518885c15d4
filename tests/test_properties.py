"""Property tests: batches of random cases against plain-Python statements of
each rule (one Spark job per batch)."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewarden.functions.jsonfix import coerce_boolean_json
from tablewarden.functions.text import affix_match, split_key_value
from tablewarden.operators.patterns import match_patterns, normalize_patterns

ALPHABET = "ab_%#:1 \tT"
names = st.text(alphabet=ALPHABET, max_size=8)
parts = st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=3))


def py_affix(name, prefix, suffix, contains):
    if name is None:
        return False
    return ((not prefix or name.startswith(prefix)) and (not suffix or name.endswith(suffix))
            and (not contains or contains in name))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(names, parts, parts, parts), min_size=30, max_size=60))
def test_affix_match_is_python_semantics(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, name string, prefix string, suffix string, contains string")
    got = {r["i"]: r["m"] for r in df.select(
        "i", affix_match(F.col("name"), F.col("prefix"), F.col("suffix"), F.col("contains")).alias("m")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == py_affix(*c), c


@settings(max_examples=3, deadline=None)
@given(st.lists(names, min_size=20, max_size=40, unique=True),
       st.lists(st.tuples(parts, parts, parts), min_size=1, max_size=12))
def test_pattern_join_is_python_semantics(spark, objs, pats):
    rows = spark.createDataFrame([(o,) for o in objs], "object string")
    p = normalize_patterns(spark.createDataFrame(
        [(i, *c) for i, c in enumerate(pats)], "pattern_id int, prefix string, suffix string, contains string"))
    want = sorted((i, o) for i, c in enumerate(pats) for o in objs if any(c) and py_affix(o, *c))
    got = sorted((r["pattern_id"], r["object"]) for r in match_patterns(rows, p, "object").collect())
    assert got == want


def py_coerce(v):
    if isinstance(v, dict):
        return {k: py_coerce(x) for k, x in v.items()}
    if isinstance(v, list):
        return [py_coerce(x) for x in v]
    if isinstance(v, str) and v.lower() in ("true", "false"):
        return v.lower() == "true"
    return v


words = st.sampled_from(["true", "True", "FALSE", "false", " true", "yes", "x\"true\"", "a,\"false\"]",
                         "tRuE", "", "\\", "q:"])
json_values = st.recursive(
    st.one_of(words, st.integers(-1000, 1000), st.booleans(), st.none()),
    lambda inner: st.one_of(st.lists(inner, max_size=4),
                            st.dictionaries(st.one_of(words, st.text("abc", max_size=3)), inner, max_size=4)),
    max_leaves=12)


@settings(max_examples=4, deadline=None)
@given(st.lists(json_values, min_size=10, max_size=30), st.sampled_from([None, 2]))
def test_coercion_is_python_semantics(spark, docs, indent):
    texts = [json.dumps(d, indent=indent) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    out = df.select("i", coerce_boolean_json(F.col("s")).alias("c")).collect()
    for r in out:
        want = py_coerce(docs[r["i"]])
        assert json.loads(r["c"]) == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab: \t\n\x1c\xa0 ", max_size=8), min_size=20, max_size=40))
def test_split_key_value_is_python_semantics(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = {r["i"]: r["kv"] for r in df.select("i", split_key_value(F.col("raw")).alias("kv")).collect()}
    for i, t in enumerate(texts):
        kv = got[i]
        if ":" in t:
            k, v = t.split(":", 1)
            assert (kv["tag_key"], kv["tag_value"], kv["valid"]) == (k.strip(), v.strip(), True), repr(t)
        else:
            assert kv["valid"] is False and kv["tag_key"] is None
