"""Collocations against a plain count, at budgets that split prefixes of every depth."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import phrases as P

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, lang string, text string"


def expected(rows, top=P.TOP, least=P.MIN_COUNT):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own = f.setdefault(lang, Counter())
            own.update(tuple(words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def zipf(rng, n, words):
    return " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))


@pytest.mark.parametrize("budget", [40, 700, P.BUDGET])
def test_equals_plain_counts(spark, monkeypatch, budget):
    rng = random.Random(budget)
    words = [c * n for n in (1, 2, 3) for c in "abcdeé"] + ["New", "york.", "x\x01", "it's,"]
    rows = [(i, rng.choice(["en", "fr", None, "und"]), zipf(rng, rng.randrange(0, 120), words)) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected([r[1:] for r in rows])
    assert len(want) > 50 and any(len(r[2].split(" ")) > 2 for r in want)
    counts, totals = P.phrase_counts(df, budget=budget)
    assert got(P.collocations(df, budget=budget)) == want
    # budgets below the smallest that phrase_counts takes, through the partition itself
    monkeypatch.setattr(P, "LOCAL", 2)
    texts = P._texts(df)
    found = P.census(texts).cache()
    words = found.filter("depth = 1")
    prefixes = P.partition(found, words.agg(F.sum("n")).first()[0], budget)
    if budget == 40:
        assert {p.count(b" ") for _, p in prefixes.split} == {1, 2, 3}
    nodes = P._nodes(P._blocks(texts, prefixes), prefixes.split, 30)
    got_nodes = {(r.lang, bytes(r.prefix).decode()[:-1]): r.n for r in nodes.collect()}
    assert len(got_nodes) == nodes.count()
    assert got_nodes == {(r.lang, r.phrase): r.f for r in counts.filter("size > 1").collect()}


def test_top_and_ties(spark):
    rows = [(i, "en", "b a. a b. c d. d c e; x y z w v") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(P.collocations(df, top=3)) == expected([r[1:] for r in rows], top=3)


def test_long_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "_SLICE", 50)
    rng = random.Random(2)
    long = zipf(rng, 5000, ["one", "two", "three", "four", "five.", "É"])
    rows = [(1, "en", long), (1, "en", long), (2, None, None), (None, None, ""), (3, "", " \t.\n"), (4, "en", "z" * 300_000), (5, "en", " ." * 50_000)]
    # the slice size is a constant of the module, which tasks carry: cut here too
    one = P.Run()
    for _ in one.add(long.encode()):
        pass
    words, suffixes, counts = one.sorted()
    assert counts.sum() == len(re.findall(r"[^\x20\x09.]+", long))
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("prefix", "n", "part", "words", "phrase", "rank")))
    assert got(P.collocations(df)) == expected([r[1:] for r in rows])
    assert P.collocations(df.limit(0)).collect() == []


def test_runs_taken_between_slices(monkeypatch):
    monkeypatch.setattr(P, "_SLICE", 64)
    monkeypatch.setattr(P, "_RUN", 10)
    rng = random.Random(4)
    text = zipf(rng, 900, ["one", "two", "three.", "four"])
    run, seen = P.Run(), Counter()

    def take():
        words, suffixes, counts = run.sorted()
        for s, c in zip(suffixes.tolist(), counts.tolist()):
            seen[P._prefix(words, s, 4)] += c

    for _ in run.add(text.encode()):
        take()
    take()
    want = Counter()
    for piece in text.split("."):
        own = piece.split()
        want.update(b"".join(w.encode() + b" " for w in own[i:i + 4]) for i in range(len(own)))
    assert seen == want
