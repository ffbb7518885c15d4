"""The pipeline against its stages on their own, and its effect on planted cases."""

import corpus_pipeline
from tablewarden.llm import pii, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen[name] = (before, docs)
    before, after = seen["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out())
    low = {r.doc_id for r in toxicity.score(before, model).collect() if r.score < toxicity.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == low and len(low) < before.count()

    before, after = seen["line_dedup"]
    lines = [line for r in after.collect() for line in r.text.split("\n") if line.split()]
    assert before.count() == after.count() and len(lines) == len({tuple(x.split()) for x in lines})

    before, after = seen["simhash"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}

    before, after = seen["pii"]
    assert before.count() == after.count() and all(pii.find_spans(r.text) == [] and r.n_chars == len(r.text) for r in after.collect())

    before, after = seen["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
