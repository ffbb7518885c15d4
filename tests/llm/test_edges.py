"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names
through every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.llm import annforest, bpe, ctph, licenses, linededup, packing, pii, simhash, substrings, toxicity

MODEL = toxicity.Model({toxicity.buckets("bad")[0]: 9.0}, -5.0)
LONG = "word " * 60_000 + "\n" + "x" * 100_000
ROWS = [(1, "some clean line of plain words\n\nanother line", 3), (2, None, 4), (None, "a text without an id", 5),
        (3, "", None), (4, "   \n\t", 1), (5, LONG, 2), (5, LONG, 2), (None, None, None)]
# names that operators give to their own columns
CLASHES = ["score", "fp", "n_lines", "piece", "start", "length", "spans", "place", "path", "text_hash", "uid", "part",
           "own_fp", "rep_id", "rep_fp", "_own_fp", "_rep_id", "_rep_fp", "row"]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


OPERATORS = {
    "toxicity": lambda d: toxicity.score(d, MODEL),
    "offending": lambda d: toxicity.offending(d, MODEL),
    "simhash": simhash.near_duplicates,
    "line_dedup": linededup.dedup_lines,
    "packing": lambda d: packing.pack(packing.pieces(d)),
    "bpe": bpe.encode,
    "pii": pii.find,
    "licenses": lambda d: licenses.inherit(licenses.own_licenses(d.withColumn("path", F.concat(F.lit("a/b/"), "doc_id")))),
    "ctph": ctph.with_edits,
    "substrings": substrings.dedup,
}
PER_PIECE = {"packing", "offending"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_keeps_every_row(spark, name):
    rows = OPERATORS[name](docs(spark)).select("doc_id").collect()
    if name not in PER_PIECE:
        assert sorted(r[0] or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stage(spark, tmp_path, name, stage, rows):
    labels = [(1, 0), (5, 1), (None, 1), (3, None)] if rows else []
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = docs(spark, rows)
    out = stage(spark, given, str(tmp_path))
    got = out.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows}
        return
    assert out.columns == given.columns
    assert all(r[c] == i for r in got for i, c in enumerate(CLASHES))
    ids = {r.doc_id for r in got}
    if name in ("line_dedup", "pii"):
        assert len(got) == len(rows)
    elif rows and name == "simhash":
        # the texts without a word are one group, the repeated row another
        assert ids == {1, 2, 5, None} and len(got) == 4


def test_rows_of_one_id_and_fingerprint(spark):
    """Their least text stays, however they are dealt; nested columns come along."""
    rows = [(1, "b C d e", 2, [1]), (1, "b c d e", 1, [2]), (1, "B c d e", 9, [3]), (1, "B c d e", 4, [4]), (2, "b c d e", 0, [5])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, n_chars bigint, tags array<int>").repartition(3)
        assert [tuple(r) for r in simhash.keep_first(df).collect()] == [(1, "B c d e", 4, [4])]
        assert [tuple(r) for r in simhash.keep_first(df.drop("tags")).collect()] == [(1, "B c d e", 4)]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (5, [2.0, 0.0]), (6, [0.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("leaf", F.lit(1))
    got = sorted(map(tuple, annforest.search(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(0, 1, 5, 1.0), (0, 2, 50, 1.0), (0, 3, 6, 0.0), (50, 1, 0, 1.0), (50, 2, 5, 1.0), (50, 3, 6, 0.0)]
    assert annforest.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("run", [" " * 10_000_000, "\t" * 1_500_000, "\n" * 3_000_000, "\r\n" * 1_000_000], ids=["space", "tab", "lf", "crlf"])
def test_long_runs_of_white_space_get_the_tokenizers_ids(run):
    from tokenizers import Tokenizer

    tokens = packing.Tokens.default()
    text = "a" + run + "b"
    assert tokens.encoder()(text) == Tokenizer.from_file(tokens.tokenizer).encode(text, add_special_tokens=False).ids


def test_a_long_run_goes_through_packing(spark):
    rows = [(1, "a" + " " * 1_200_000 + "b", 0), (2, "\n" * 1_100_000, 0), (3, "word", 0)]
    packed = packing.pack(packing.pieces(docs(spark, rows))).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3}
    assert sum(r.length for r in packed if r.doc_id == 1) == 1_200_000 + 1 + 1


def test_repeated_rows_stay_linear_in_substring_dedup(spark):
    rng = __import__("random").Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(300))
    other = "new words " + text[:900]
    df = spark.createDataFrame([(1, text)] * 400 + [(2, other)] * 400 + [(3, text)], "doc_id bigint, text string")
    spans = substrings.factors(df.select("*", F.xxhash64("text").alias("text_hash")))
    per_text = {r.doc_id: r["count"] for r in spans.groupBy("doc_id").count().collect()}
    assert set(per_text) == {2, 3} and max(per_text.values()) < 300
    out = substrings.dedup(df).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r["count"]) for r in out} == {(1, 400), (2, 400), (3, 1)}
    assert {r.n_removed for r in out if r.doc_id == 1} == {0} and {r.n_removed for r in out if r.doc_id == 3} == {300}
