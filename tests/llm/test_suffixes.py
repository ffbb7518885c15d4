"""Two-stage sorting against plain sorting, and the removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import suffixes as S

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def expected(rows, window=S.WINDOW):
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(hash(t[i:i + window]) for _, t in data for i in range(len(t) - window + 1))
    out = []
    for doc_id, t in data:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if seen[hash(t[i:i + window])] > 1:
                cover[i] += 1
                cover[i + window] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(t) else 0
        out.append((doc_id, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b"abc\x00\xff"[:rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 60))) * rng.randrange(1, 3)
        depth = rng.choice([1, 3, 200])
        order = S.suffix_order(np.frombuffer(text, np.uint8), depth).tolist()
        assert sorted(order) == list(range(len(text)))
        if depth == 200:
            assert order == sorted(range(len(text)), key=lambda i: text[i:])
        else:
            heads = [text[i:i + depth] for i in order]
            assert heads == sorted(heads)


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(100):
        pieces = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(0, 80))) for _ in range(rng.randrange(1, 6))]
        window = rng.choice([8, 11])
        seen = Counter(p[i:i + window] for p in pieces for i in range(len(p) - window + 1))
        want = [[i for i in range(len(p) - window + 1) if seen[p[i:i + window]] > 1] for p in pieces]
        assert [f.tolist() for f in S.repeated_windows(pieces, window)] == want


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(900 + i, (r[1] or "")[:3000][i:] + "é!" + (rows[i + 1][1] or "")[:500]) for i, r in enumerate(rows[:30])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(S.dedup(df)) == expected(rows)


@pytest.mark.parametrize("crowd", [2, 5, 256])
def test_crowded_grams(spark, crowd):
    rng = random.Random(crowd)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(12))
    rows = []
    for i in range(60):
        before, after = (" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(2))
        cut = rng.randrange(0, 40)
        rows.append((i, f"{before} {passage[cut:] if i % 3 else passage} {after}"))
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(S.dedup(df, window=40, gram=16, crowd=crowd)) == expected(rows, 40)


def test_odd_rows(spark, monkeypatch):
    long = "".join(random.Random(3).choices("abcdef \n", k=90_000))
    rows = [(1, None), (2, ""), (None, "x" * 399), (None, "x" * 400), (3, "ü" * 5000), (4, "ab" * 3000), (5, " " * 200_000),
            (6, long), (6, long), (None, long[:500]), (7, "y" * 401), (8, "z" * 400)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("uid", "start", "key", "n", "gram", "runs", "text_hash")))
    assert got(S.dedup(df)) == expected(rows)
    assert S.dedup(df.limit(0)).collect() == []


def test_texts_longer_than_a_chunk():
    rng = random.Random(8)
    text = bytes(rng.choices(b"abcdefgh", k=1000)) * 3 + rng.randbytes(S._CHUNK)
    finder = S.Stretches(S.WINDOW, S.GRAM)
    windows = [(int(f), int(c)) for _, _, first, count in finder.of(text) for f, c in zip(first, count)]
    at = 0
    for first, count in windows:
        assert first == at
        at += count
    assert at == len(text) - S.WINDOW + 1
