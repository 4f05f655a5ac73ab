"""The corpus pipeline from end to end on a small table with nulls, copies, repeated passages and columns of any name."""

from __future__ import annotations

import random

import corpus_pipeline
from fathomflow.llm.storage import written

WORDS = "the of and to in house river table window garden letter music stone cloud paper winter market bridge doctor yellow silver morning".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, mix_size string, dedup_key string, row string"


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n)) + "."
    base, passage = prose(120), prose(60)
    texts = [base, base, base.replace("river", "lake", 1), None, "", "few words", "#$%& |<> " * 60]
    texts += [f"{prose(70)} {passage} {prose(40)}" for _ in range(3)] + [prose(90) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), f"id{i}", f"m{i}", f"k{i}", f"r{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, f"file://{tmp_path}"), "stage")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept[name] = docs.collect()
        assert all((r.id, r.mix_size, r.dedup_key, r.row) == (f"id{r.doc_id}", f"m{r.doc_id}", f"k{r.doc_id}", f"r{r.doc_id}") for r in kept[name])
    ids = {name: sorted(r.doc_id for r in found) for name, found in kept.items()}
    assert ids["quality rules"] == [0, 1, 2, *range(7, len(texts))]
    assert ids["near duplicates"] == [0, *range(7, len(texts))] == ids["repeated passages"]
    without = {r.doc_id: r.text for r in kept["repeated passages"]}
    assert all(passage not in without[i] and len(without[i]) < len(texts[i]) - 100 for i in (7, 8, 9)) and without[0] == base
    assert all(r.n_chars == len(r.text) for r in kept["repeated passages"])
    assert set(ids["source mix"]) <= set(ids["repeated passages"]) and max(map(ids["source mix"].count, ids["source mix"])) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}").collect()
    assert sorted(r.doc_id for r in packed if r.start == 0) == ids["source mix"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect() if r.start == 0) == ids["source mix"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
