"""Operators against brute force, round trips and planted cases."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tablewarden.llm import annforest, bpe, ctph, licenses, linededup, packing, pii, registry, simhash, substrings, toxicity

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def texts(spark, sf=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- sql -----------------------------------------------------------------------------

@pytest.mark.parametrize("name", registry.SQL)
def test_sql(spark, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{MEDIUM}/documents.parquet'")
    want = duckdb.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, MEDIUM).select(*want.columns).collect()
    assert {tuple(r) for r in got} == set(want.fetchall())


# --- neighbours ----------------------------------------------------------------------

def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = annforest.search(df, F.col("vec_id") % 50 == 0).collect()
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        score = annforest.cosine(x[ids == q][0], x)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        assert all(s == score[ids == v][0] for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(ids[order]))
        total += 5
    assert hit >= 0.9 * total


def test_clustered_vectors_need_few_candidates():
    """200,000 vectors around 2,000 centres: a query meets under a tenth of them."""
    rng = np.random.default_rng(3)
    x = annforest.unit(rng.normal(size=(2000, 32))[rng.integers(0, 2000, 200_000)] + 0.3 * rng.normal(size=(200_000, 32)))
    sample = x[:annforest.SAMPLE]
    forest = annforest.learn_probes(annforest.fit(sample, 10), sample, 5, 0.96)
    leaf = forest.leaves(x)
    counts = np.stack([np.bincount(leaf[:, t], minlength=1 << forest.depth) for t in range(10)])
    hit, met = [], []
    for q in range(0, 200_000, 2000):
        opened = forest.search(x[q], counts, forest.probes, 6)
        seen = np.zeros(len(x), bool)
        for t, at in opened:
            seen |= leaf[:, t] == at
        score = x @ x[q]
        score[q] = -1
        hit += seen[np.argsort(-score)[:5]].tolist()
        met.append(sum(int(counts[t, at]) for t, at in opened))
    print(f"recall {np.mean(hit):.3f}, candidates a query {np.mean(met):.0f} of {len(x)}, leaves opened {forest.probes}")
    assert np.mean(hit) >= 0.9 and np.mean(met) < 0.1 * len(x)


def test_leaves_are_opened_in_order():
    x = annforest.unit(np.random.default_rng(5).normal(size=(2000, 8)))
    forest = annforest.fit(x, 3)
    place = forest.order(x[7])
    every = forest.search(x[7], np.ones(place.shape, int), place.size, 1)
    assert sorted(place.ravel().tolist()) == list(range(place.size))
    margins = forest.normals @ x[7] - forest.offsets

    def worst(t, leaf):
        node, path = leaf + (1 << forest.depth) - 1, []
        while node:
            up = (node - 1) // 2
            path.append(margins[t, up] if node == 2 * up + 1 else -margins[t, up])
            node = up
        return max(path)

    by_search = [worst(t, leaf) for t, leaf in every]
    by_order = [worst(t, leaf) for t, leaf in sorted(np.ndindex(place.shape), key=lambda p: place[p])]
    assert by_search == by_order == sorted(by_order)


def test_a_vector_that_many_rows_hold(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [float(i), 1.0, 0.0]) for i in range(300, 330)]
    got = annforest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") == 250).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(i + 1, i) for i in range(5)]


# --- toxicity ------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    rows = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = [(r.score, r.toxic, r.predicted) for r in rows.collect() if r.held_out]
    bad, good = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    assert auc > 0.95 and np.mean([p for _, y, p in held if y]) > 0.85 and np.mean([p for _, y, p in held if not y]) < 0.03


def test_labels_find_the_sentence(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    sentence = lambda *extra: " ".join([*rng.choices(words, k=6), *extra]) + ". "
    rows = []
    for i in range(300):
        body = [sentence() for _ in range(5)]
        if i % 3 == 0:
            body[i % 5] = sentence("vile")
        rows.append((float(i % 3 == 0), toxicity._features("".join(body))))
    model = toxicity.fit(rows)
    df = spark.createDataFrame([(1, "w1 w2 w3. w4 vile w5. w6 w7."), (2, "w1 w2. w3 w4.")], "doc_id bigint, text string")
    assert [(r.doc_id, r.sentence_no) for r in toxicity.offending(df, model).collect()] == [(1, 1)]
    assert [r.doc_id for r in toxicity.keep_clean(df, model).collect()] == [2]
    assert toxicity.fit([]).weights == {} and toxicity.fit([(1.0, [[1]])]).weights == {}


def test_length_alone_is_not_toxic(spark):
    rng = random.Random(4)
    sentence = lambda *extra: " ".join([*rng.choices([f"w{i}" for i in range(50)], k=6), *extra]) + ". "
    # every labelled document is longer than 20,000 characters
    texts = ["".join([sentence() for _ in range(1200)] + [sentence("vile")] * (i % 3 == 0)) for i in range(60)]
    assert min(map(len, texts)) > 20_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    new = ["".join(sentence() for _ in range(n)) for n in (1, 300, 1500, 5000)]
    new += [t + "w1 w2 vile w3." for t in new]
    got = toxicity.score(spark.createDataFrame(list(enumerate(new)), "doc_id bigint, text string"), model).collect()
    low, high = [r.score for r in got if r.doc_id < 4], [r.score for r in got if r.doc_id >= 4]
    assert max(low) < 0.01 and min(high) >= toxicity.THRESHOLD and max(high) - min(high) < 0.01


def test_clean_documents_by_length(spark):
    """Held-out clean documents of sf0.1 by length, and bags joined of them up to 1,000 sentences and more."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    clean = (docs.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 0"), "doc_id")
             .where(toxicity.held_out()).select("doc_id", "text"))
    rows = toxicity.score(clean, model).join(clean, "doc_id").collect()
    for low, high, most in ((0, 2000, 0.01), (2000, 10_000, 0.03), (10_000, 1 << 30, 0.15)):
        band = [r.score >= toxicity.THRESHOLD for r in rows if r.text and low <= len(r.text) < high]
        assert band and np.mean(band) <= most
    kept = [r.text for r in sorted(rows, key=lambda r: r.doc_id) if r.text and r.score < toxicity.THRESHOLD]
    joined, part = [], []
    for t in kept:
        part.append(t)
        if sum(len(toxicity.sentences(x)) for x in part) > 1000:
            joined, part = [*joined, "\n".join(part)], []
    got = toxicity.score(spark.createDataFrame(list(enumerate(joined)), "doc_id bigint, text string"), model).collect()
    assert len(got) > 10 and np.mean([r.score >= toxicity.THRESHOLD for r in got]) < 0.2


# --- simhash -------------------------------------------------------------------------

def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_simhash_against_all_pairs(spark):
    codes = {i: simhash_brute(t) for i, t in texts(spark).items()}
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(codes), 2):
        if (codes[a] ^ codes[b]).bit_count() <= 3:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = simhash.op3_simhash(spark, SMALL).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{c:016x}", find(i)) for i, c in codes.items()}


def test_links_of_one_long_list(spark, monkeypatch):
    """A crowd of near fingerprints, over many blocks, joins into its true components."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = list({b ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(64)) for b in base for _ in range(150)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.classes(spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")).collect()
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert {r.fp: r.component_id for r in got} == {f: root[i] for i, f in enumerate(signed)}


# --- lines ---------------------------------------------------------------------------

def near(x, y):
    if x == y:
        return True
    if min(len(x), len(y)) < linededup.MIN_WORDS or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def test_lines_against_all_pairs(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcd") for _ in range(rng.randint(3, 9))] for _ in range(25)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k:k + rng.choice([0, 1])] = [rng.choice("abcdxy")][:rng.choice([0, 1])]
                w = w or ["a"]
            lines.append(rng.choice(["", "", " "]) + rng.choice([" ", "  ", "\t"]).join(w))
        docs.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n \n"])))
    places = [(i, n, line, line.split()) for i, t in docs for n, line in enumerate(t.split("\n"))]
    want = {}
    for i, t in docs:
        kept = [line for d, n, line, w in places if d == i and
                (not w or not any((e, m) < (d, n) and v and near(v, w) for e, m, _, v in places))]
        want[i] = "\n".join(kept)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert any(near(a[3], b[3]) and a[3] != b[3] for a, b in itertools.combinations(places, 2))


def test_lines_stay_in_the_jvm(spark):
    plan = linededup.op4_line_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- packing -------------------------------------------------------------------------

def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokens = packing.Tokens.default()
    exact, fast = Tokenizer.from_file(tokens.tokenizer), tokens.encoder()
    got = {}
    for r in packing.op5_packing(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in texts(spark).items():
        ids = exact.encode(t, add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(got[i], key=lambda r: r.piece):
            assert r.start == at and (r.length == 2048 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for t in ["a<|endoftext|>b", "x \x85\x1c y", "日本語 テスト", "͸ ²½ ٣ 𝟛x", "I'll   \n\n  é’s", ""]:
        assert fast(t) == exact.encode(t, add_special_tokens=False).ids


def test_packing_is_gapless_and_near_its_bound(spark):
    rng = random.Random(1)
    items = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(3000)], "doc_id bigint, length bigint")
    packed = packing.pack(items, capacity=100, part_rows=300)
    by = {}
    for r in packed.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    used, bound = packing.certificate(packed, 100)
    assert used == len(by) and sum(map(len, by.values())) == 3000 and bound <= used <= bound * 1.02


def test_lower_bound_holds(spark):
    rng = np.random.default_rng(0)
    for _ in range(100):
        sizes = rng.integers(1, 21, rng.integers(1, 8))
        best = [99]

        def place(i, bins):
            if len(bins) < best[0]:
                if i == len(sizes):
                    best[0] = len(bins)
                else:
                    for k, b in enumerate(bins):
                        if b + sizes[i] <= 20:
                            place(i + 1, [*bins[:k], b + sizes[i], *bins[k + 1:]])
                    place(i + 1, [*bins, sizes[i]])

        place(0, [])
        assert packing.lower_bound(sizes, 20) <= best[0] <= len(packing.best_fit(sizes, 20)[2])


# --- bpe -----------------------------------------------------------------------------

def test_bpe_is_tiktokens(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["", "x" * 5000, "ab" * 900 + "  \n\n" * 300, "\x1c\x85   x", "don't I'LL it's", "日本語 <|endoftext|> é"]
    rows = [*texts(spark).items(), *enumerate(odd, 10_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in bpe.encode(df, keep_ids=True).collect()}
    for i, t in rows:
        ids = np.array(exact.encode_ordinary(t), "<u4").tobytes()
        r = got[i]
        assert bytes(r.ids) == ids and r.decoded == t and r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


# --- personal data -------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def ok(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if ok(k, m[0])]


def test_base_spans(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice(["a", "@", ".", "-", "_", "1", "25", "4111", " ", "+", "(", ")", "x@y.z", "00"]) for _ in range(40))
            for _ in range(3000)]
    for t in [*texts(spark).values(), *made, "card 4111 1111-1111 1111.", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0000256.1.1.1"]:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == base_spans(t)


def test_checksums_context_and_redaction():
    spans = pii.find_spans("bank IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; visa 378282246310005")
    assert [(s[0], round(s[3], 1)) for s in spans] == [("iban", 1.0), ("card_short", 1.0)]
    assert pii.find_spans("number 378282246310005") == []
    assert pii.redact_text("mail a@b.co or +1 (555) 010-9999") == "mail <EMAIL> or <PHONE>"
    assert pii.find_spans("1" * 200_000 + "@" * 1000 + "a." * 100_000) == []


# --- licences ------------------------------------------------------------------------

def test_whole_licence_texts_and_wrapped_notices(spark):
    import textwrap

    held = dict(licenses.TEMPLATES)  # the last text of each licence: the longest
    opening = dict(licenses.OPENINGS)
    wrap = lambda t, mark="": "\n".join(mark + line for line in textwrap.wrap(t, 60))
    body = "\n\n".join(wrap(" ".join(f"clause{i * j % 97} term{j}" for j in range(200))) for i in range(1, 20))
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    code = "\n".join(f"int value{i} = compute{i}(value{i + 1});" for i in range(200))
    rows = [
        (1, "a/LICENSE", wrap(held["MIT"].replace("Copyright (c).", "Copyright (c) 2019 Some Name and others"))),
        (2, "b/LICENSE", wrap(held["BSD-3-Clause"].replace("the copyright holder", "Example Labs"))),
        (3, "c/LICENSE", wrap(opening["Apache-2.0"]) + "\n\n" + body),
        (4, "d/COPYING", wrap(opening["GPL-3.0"]) + "\n\n" + body),
        (5, "e/x.c", "/*\n" + wrap(gpl, " * ") + "\n *\n */\n" + code),
        (6, "f/README", "This project is licensed under the Apache License, Version 2.0 - see the LICENSE file for details"),
        (7, "g/x.c", "/*\n" + wrap(held["MIT"], " * ") + "\n */\n\n" + code),
        (8, "h/x.c", code), (9, "h/y", body), (10, "a/sub/z.c", code), (11, "g/z.c", code),
    ]
    filler = [(i, f"z/{i}", "see the file for details of this project and its license terms, under version 2") for i in range(100, 400)]
    df = spark.createDataFrame(rows + filler, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.license, r.via) for r in licenses.inherit(licenses.own_licenses(df)).collect()}
    assert {i: got[i] for i in range(1, 12)} == {
        1: ("MIT", "file"), 2: ("BSD-3-Clause", "file"), 3: ("Apache-2.0", "file"), 4: ("GPL-3.0", "file"),
        5: ("GPL-3.0", "header"), 6: ("Apache-2.0", "file"), 7: ("MIT", "header"), 8: (None, "none"), 9: (None, "none"),
        10: ("MIT", "inherited"), 11: (None, "none")}
    assert all(got[i] == (None, "none") for i in range(100, 400))


def test_license_scores_are_plain_tfidf(spark):
    """Every part of every text against every template, without bounds or prefilters."""
    import collections
    import math

    rng = random.Random(6)
    words = licenses.terms(" ".join(t for _, t in licenses.TEMPLATES)) + [f"w{i}" for i in range(60)]
    made = ["\n".join(" ".join(rng.choices(words, k=rng.randrange(8))) for _ in range(rng.randrange(6))) for _ in range(60)]
    made += [made[3], made[3], "", None, " ".join(t for _, t in licenses.TEMPLATES[:2]), licenses.OPENINGS[0][1]]
    made += [text.replace("software", rng.choice(words)) for _, text in licenses.TEMPLATES]
    n, cos = len(made), {}
    df = collections.Counter(t for text in made for t in set(licenses.terms(text or "")))
    vector = lambda ts: {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in collections.Counter(ts).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(parts, templates):
        scored = [(-round(sum(x * b.get(t, 0) for t, x in a.items()) / size(a) / size(b), 6), name)
                  for a in map(vector, parts) if a for name, b in templates]
        return min([s for s in scored if -s[0] >= licenses.THRESHOLD], default=(0.0, None))

    whole = [(name, vector(licenses.terms(t))) for name, t in licenses.TEMPLATES]
    heads = [(name, vector(licenses.terms(t)[:licenses.OPENING])) for name, t in licenses.OPENINGS]
    for i, text in enumerate(made):
        lines = [licenses.terms(line) for line in (text or "").split("\n")]
        runs = [sum(g, []) for held, g in itertools.groupby(lines, key=bool) if held]
        flat = sum(lines, [])
        cos[i] = best(lines + runs, whole), min(best([flat], whole), best([flat[:licenses.OPENING]], heads))
    rows = spark.createDataFrame([(i, f"p/{i}", t) for i, t in enumerate(made)], "doc_id bigint, path string, text string")
    got = {r.doc_id: ((-r.header_score, r.header), (-r.file_score, r.file)) for r in licenses.own_licenses(rows).collect()}
    assert got == cos and sum(h[1] is not None for h, _ in cos.values()) > 10


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "a/LICENSE", mit), (2, "a/b/LICENSE", gpl), (3, "a/b/c/x", words), (4, "a/y", words), (5, "z", words),
            (6, "a/b/w", mit + "\n" + words), (7, "ab/v", words), (8, None, words), (9, "a/b/c/n", None)]
    got = licenses.inherit(licenses.own_licenses(spark.createDataFrame(rows, "doc_id bigint, path string, text string")))
    assert {r.doc_id: (r.license, r.via) for r in got.collect()} == {
        1: ("MIT", "file"), 2: ("GPL-3.0", "file"), 3: ("GPL-3.0", "inherited"), 4: ("MIT", "inherited"), 5: (None, "none"),
        6: ("MIT", "header"), 7: (None, "none"), 8: (None, "none"), 9: ("GPL-3.0", "inherited")}


# --- piecewise hashes ----------------------------------------------------------------

def test_edits(spark):
    docs = sorted(texts(spark).items())
    got = {r.doc_id: r for r in ctph.with_edits(spark.read.parquet(f"{SMALL}/documents.parquet"), buckets=7).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        new = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(t)
        assert (r.fingerprint, r.edited_fingerprint) == (ctph.fingerprint(t), ctph.fingerprint(new))
        assert r.near_next == ctph.likeness(r.fingerprint, ctph.fingerprint(after))
    assert np.mean([r.near_edited > 0.25 for r in got.values()]) > 0.9
    assert np.median([r.near_next for r in got.values()]) < 0.1


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in "ab")
        assert ctph.edit_distance(a, b) == slow(a, b)


def test_long_regular_texts_have_short_fingerprints():
    for t in ["", "a", "\n" * 100_000, "ab" * 1_500_000]:
        assert len(ctph.fingerprint(t)) < 6 * ctph.MAX_CHUNKS * ctph.LEVELS
        assert ctph.likeness(ctph.fingerprint(t), ctph.fingerprint(t)) == 1.0


# --- passages ------------------------------------------------------------------------

def passages_brute(docs, size=substrings.WINDOW):
    words, first = {i: (t or "").encode().split() for i, t in docs}, {}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out


def planted():
    rng = random.Random(3)
    base = [rng.choice("ab cd ef gh".split()) for _ in range(300)]
    docs = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, 250)
            w += base[a:a + rng.randint(5, 120)] + [rng.choice("xyz") for _ in range(rng.randint(0, 4))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*docs, (40, None), (41, ""), (42, "x " * 500), (43, "x " * 300)]


@pytest.mark.parametrize("chunk", [substrings._CHUNK, 70])
def test_passages(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "_CHUNK", chunk)
    for docs in (planted(), list(texts(spark).items())):
        got = substrings.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == passages_brute(docs)


# --- documents of one id -------------------------------------------------------------

def test_texts_of_equal_short_hash_stay_apart(spark):
    """Pairs of texts that Spark's 32-bit hash does not tell apart, under one id."""
    short = lambda df: df.select(F.hash("text")).distinct().count()
    near, alone = "one two three four six\nfirst 12753", "b140010 alone and not like others"
    df = spark.createDataFrame([(None, near), (None, alone), (0, "one two three four five")], "doc_id bigint, text string")
    assert short(df.where("doc_id is null")) == 1
    assert sorted(r.text for r in linededup.dedup_lines(df).collect()) == [alone, "first 12753", "one two three four five"]
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    df = spark.createDataFrame([(1, p), (2, f"{p} 17627"), (2, f"{q} 278865")], "doc_id bigint, text string")
    assert short(df.where("doc_id = 2")) == 1
    got = substrings.dedup(df, keep_text=True).collect()
    assert sorted(r.kept for r in got) == ["17627", p, f"{q} 278865"]
