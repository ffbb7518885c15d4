"""The pattern join: anchors by rarity, minimizers of long values, hot parts."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.functions.text import blocks, minimizers
from tablewarden.operators.patterns import _parts, _pattern_anchors, _rarest, _row_anchors, match_patterns, normalize_patterns

PATTERN = "pattern_id int, prefix string, suffix string, contains string"


def brute(names, patterns, scope=None):
    out = []
    for i, name in enumerate(names):
        for pid, p, s, c in patterns:
            if not (p or s or c) or name is None:
                continue
            if name.startswith(p or "") and name.endswith(s or "") and (c or "") in name:
                out.append((i, pid))
    return sorted(out)


def matched(spark, names, patterns):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    pairs = match_patterns(rows, normalize_patterns(spark.createDataFrame(patterns, PATTERN)), "name")
    return sorted((r.i, r.pattern_id) for r in pairs.collect())


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda lo, hi, letters="abé😀_%": "".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi)))
    names = [None, ""] + [text(0, 60) for _ in range(120)] + [text(80, 300, "ab") for _ in range(10)]
    long = [n for n in names if n and len(n) > 40]
    patterns = []
    for pid in range(80):
        part = lambda: rng.choice([None, "", text(1, 4)])
        p, s, c = part(), part(), part()
        if pid % 4 == 0:
            host = rng.choice(long)
            at = rng.randrange(0, len(host) - 30)
            c = host[at:at + rng.randrange(1, 31)]
        elif pid % 4 == 1:
            host = rng.choice(long)
            p, s = host[:rng.randrange(1, 80)], host[rng.randrange(-80, -1):]
        patterns.append((pid, p, s, c))
    want = brute(names, patterns)
    assert len(want) > 100
    assert matched(spark, names, patterns) == want


def test_minimizers_are_shared_and_few(spark):
    rng = random.Random(7)
    inner = "".join(rng.choice("abcdefgh") for _ in range(700))
    outer = "".join(rng.choice("abcdefgh") for _ in range(9000)) + inner + "".join(rng.choice("abcdefgh") for _ in range(9000))
    df = spark.createDataFrame([(inner, outer)], "a string, b string")
    windows = [4, 32, 512]
    found = F.array_distinct(F.flatten(F.transform(blocks(F.col("b"), 4096, 511), lambda x: minimizers(x, windows, 16))))
    r = df.select(minimizers(F.col("a"), windows, 16).alias("a"), found.alias("b"),
                  minimizers(F.lit("short"), windows, 16).alias("none")).first()
    assert set(r.a) <= set(r.b) and {x.window for x in r.none} == {4}
    for rows, lo, hi in ((r.a, 1, 10), (r.b, 30, 4 * 18_700 / 512)):
        assert lo <= sum(x.window == 512 for x in rows) < hi


def test_a_thousand_patterns_that_share_a_prefix_have_no_common_key(spark):
    names = spark.range(20_000).select(F.format_string("Customer#%09d", "id").alias("name"))
    patterns = spark.range(1000).select(
        F.col("id").cast("int").alias("pattern_id"), F.lit("Customer#").alias("prefix"),
        F.when(F.col("id") % 2 == 0, F.lpad(F.col("id").cast("string"), 4, "0")).alias("suffix"),
        F.when(F.col("id") % 2 == 1, F.lpad(F.col("id").cast("string"), 5, "0")).alias("contains"))
    pats = normalize_patterns(patterns)
    parts = _parts(pats, [])
    shapes = [tuple(r) for r in parts.select("kind", "length", "_p_mask").distinct().collect()]
    anchors = _row_anchors(names, "name", shapes, [])
    chosen = _rarest(_pattern_anchors(parts, [], [n for k, n, _ in shapes if k == 2]), anchors)
    # candidate pairs: a few for each pattern, not rows x patterns; no key on the shared prefix
    assert chosen.select("_p_anchor").distinct().count() > 900
    pairs = anchors.join(chosen, F.col("_anchor") == F.col("_p_anchor")).count()
    result = match_patterns(names, pats, "name")
    n = result.count()
    want = names.crossJoin(patterns).filter(F.expr("(suffix is null or endswith(name, suffix)) and (contains is null or contains(name, contains))")).count()
    assert n == want and pairs < 20 * n


def test_a_long_value_and_a_long_pattern(spark):
    """1 MB values and a pattern of 4,096 characters: keys stay few."""
    rng = random.Random(11)
    letters = "".join(rng.choices("abcdefghijklmnop ", k=1_000_000))
    names = [letters, letters[400_000:500_000] + "!" + letters[500_000:800_000], "short"]
    needle = letters[499_000:503_096]
    patterns = [(1, None, None, needle), (2, None, None, letters[700_000:700_100]), (3, "a" * 5000, None, None), (4, letters[:5000], None, None)]
    assert matched(spark, names, patterns) == [(0, 1), (0, 2), (0, 4), (1, 2)]


def test_scopes(spark):
    rows = spark.createDataFrame([(1, "n1", "a", "x"), (2, "n1", "b", "x"), (3, "n2", "a", None)], "i int, name string, c string, s string")
    patterns = spark.createDataFrame([(1, "n", None, None, "a", None), (2, None, "1", None, None, "x"), (3, None, None, "n", "b", "x"),
                                      (4, "n", None, None, None, None)],
                                     PATTERN + ", c string, s string")
    got = match_patterns(rows, normalize_patterns(patterns, ["c", "s"]), "name", scope_cols=["c", "s"])
    assert sorted((r.i, r.pattern_id) for r in got.collect()) == [(1, 1), (1, 2), (1, 4), (2, 2), (2, 3), (2, 4), (3, 1), (3, 4)]


def test_short_substrings_give_no_candidates_but_matches(spark):
    """6 digits are looked up as 6 digits: their first 4 would meet a hundred times the rows."""
    names = spark.range(20_000).select(F.format_string("Customer#%09d", F.col("id") * 37).alias("name"))
    tokens = spark.range(2000).select(F.col("id").alias("pattern_id"), F.lit(None).cast("string").alias("prefix"),
                                      F.lit(None).cast("string").alias("suffix"), F.lpad((F.col("id") * 331).cast("string"), 6, "0").alias("contains"))
    pats = normalize_patterns(tokens)
    parts = _parts(pats, [])
    shapes = [tuple(r) for r in parts.select("kind", "length", "_p_mask").distinct().collect()]
    anchors, keys = _row_anchors(names, "name", shapes, []), _pattern_anchors(parts, [], [n for _, n, _ in shapes])
    pairs = anchors.join(keys, F.col("_anchor") == F.col("_p_anchor")).count()
    want = names.crossJoin(tokens).filter(F.col("name").contains(F.col("contains"))).count()
    assert pairs == want > 200 and match_patterns(names, pats, "name").count() == want


def test_minimizers_of_lengths_that_are_no_powers(spark):
    r = spark.createDataFrame([("abcdefghijklmnopqrst",)], "t string").select(
        *[minimizers(F.col("t").substr(1, n), [3, 5, 6, 11, 16], 16).alias(f"n{n}") for n in (2, 5, 20)]).first()
    count = lambda found: {n: sum(x.window == n for x in found) for n in (3, 5, 6, 11, 16)}
    assert count(r.n2) == dict.fromkeys((3, 5, 6, 11, 16), 0) and count(r.n5) == {3: 3, 5: 1, 6: 0, 11: 0, 16: 0}
    assert count(r.n20) == {3: 18, 5: 16, 6: 15, 11: 10, 16: 5} and set(r.n5) <= set(r.n20)


def test_rows_of_repeated_names_are_not_broadcast(spark, tmp_path):
    """A file of few names is far smaller than its rows, so its size says nothing of them."""
    path = str(tmp_path / "rows")
    spark.range(50_000).select("id", F.concat(F.lit("a quite ordinary name "), F.col("id") % 3).alias("name")).write.parquet(path)
    pats = normalize_patterns(spark.createDataFrame([(1, None, None, "name 2"), (2, "a quite ordinary", None, None)], PATTERN))
    df = match_patterns(spark.read.parquet(path), pats, "name")
    assert df.count() == 50_000 + 16_666
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in text and "BuildRight" in text


def test_long_substrings_of_words_have_an_anchor_a_word(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice(["a", "", "é😀", "the", "\n", "of\tthe", "longer", "Word."]) for _ in range(n)]
    names = [None, "", "no space", *(" ".join(words(rng.randrange(1, 80))) for _ in range(60)), " ".join(words(9000))]
    patterns = []
    for pid in range(90):
        host = rng.choice([n for n in names if n and len(n) > 60])
        at = rng.randrange(0, len(host) - 40)
        patterns.append((pid, None, host[-12:] if pid % 9 == 0 else None, host[at:at + rng.choice([17, 25, 40, 300])]))
    patterns.append((90, None, None, names[-1] + " "))  # longer than any name
    patterns.append((91, None, None, names[-1]))
    assert matched(spark, names, patterns) == brute(names, patterns)
    # those of words alone: an anchor for each run of words and no work for each character
    pats = normalize_patterns(spark.createDataFrame([(1, None, None, "he long run of words stands he")], PATTERN))
    shapes = [tuple(r) for r in _parts(pats, []).select("kind", "length", "_p_mask").distinct().collect()]
    rows = spark.createDataFrame([("the long run of words stands here",)], "name string")
    assert shapes == [(3, 3, 0)] and _row_anchors(rows, "name", shapes, []).count() == 5
    assert _pattern_anchors(_parts(pats, []), [], []).count() == 1


def test_each_of_many_patterns_has_its_rarest_anchor(spark):
    """No pattern takes a common anchor because its rare one is counted together with another."""
    names = spark.range(20_000).select(F.format_string("Customer#%09d", "id").alias("name"))
    pats = normalize_patterns(names.select(F.col("name").alias("pattern_id"), F.lit("Customer#").alias("prefix"),
                                           F.col("name").alias("suffix"), F.lit("0").alias("contains")))
    parts = _parts(pats, [])
    shapes = [tuple(r) for r in parts.select("kind", "length", "_p_mask").distinct().collect()]
    anchors = _row_anchors(names, "name", shapes, [])
    chosen = _rarest(_pattern_anchors(parts, [], [n for k, n, _ in shapes if k == 2]), anchors)
    assert anchors.join(chosen, F.col("_anchor") == F.col("_p_anchor")).count() == 20_000


@pytest.mark.parametrize("few", [0, 30])
def test_shapes_of_few_patterns_beside_those_of_many(spark, monkeypatch, few):
    """Patterns that are broadcast and those that are not give each of their rows once."""
    monkeypatch.setattr("tablewarden.operators.patterns.FEW_PATTERNS", few)
    names = [f"n#{i * 37 % 1000:04d}" + "-xyz" * (i % 40) for i in range(200)]
    patterns = [(i, "n#", n[-9:] if i % 3 else None, None if i % 3 == 1 else n[3:6]) for i, n in enumerate(names)]
    patterns += [(1000 + i, "n#", None, f"{i:02d}") for i in range(10)] + [(1010, "", "", "")]
    assert matched(spark, names, patterns) == brute(names, patterns)
    assert matched(spark, names, []) == matched(spark, names, [(1, "n#", "no", "such")]) == []
