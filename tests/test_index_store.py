"""Versions of a retrieval index: reopening, appends of new chunks alone, readers during writes, conflicting writers."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomflow.operators import retrieval
from fathomflow.sources.index_store import Conflict, IndexStore

TEXTS = {"a": "momentum factor momentum 因子", "b": "value factor", "c": "动量因子 factor", "d": "", "e": None, "f": "momentum " * 30}


@pytest.fixture
def chunks(spark, tmp_path):
    rows = [(k, f"s{i % 2}", t) for i, (k, t) in enumerate(TEXTS.items())] + [(None, "s0", "no id"), ("a", "s0", TEXTS["a"])]
    spark.createDataFrame(rows, "chunk_id string, source_id string, text string").write.parquet(f"{tmp_path}/chunks")
    return spark.read.parquet(f"{tmp_path}/chunks")


def queries(spark, *texts):
    return retrieval.postings(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), "query_id")


def by_hand(texts, query):
    """Scores by the formula on all texts at once."""
    docs = {k: Counter(re.findall("[一-鿿]|[A-Za-z0-9]+", t or "")) for k, t in texts.items()}
    n, length = len(docs), {k: sum(c.values()) for k, c in docs.items()}
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((n - m + 0.5) / (m + 0.5)) for t, m in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: low if w < 0 else w for t, w in idf.items()}
    mean = sum(length.values()) / n
    asked = Counter(re.findall("[一-鿿]|[A-Za-z0-9]+", query))
    score = {k: sum(q * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * length[k] / mean)) for t, q in asked.items() if t in c) for k, c in docs.items()}
    return {k: pytest.approx(s) for k, s in score.items() if s > 0}


def test_appends_equal_one_build_and_versions_stay_readable(spark, chunks, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    assert store.snapshot() is None
    first = store.append(chunks.where("chunk_id is null or chunk_id in ('a', 'b')"))
    assert (first.version, first.chunks, len(first.segments)) == (1, 2, 1)
    reader = store.index()
    second = store.append(chunks)
    assert (second.version, second.chunks, len(second.segments)) == (2, 6, 2)
    assert store.append(chunks).segments == second.segments

    again = IndexStore(spark, f"{tmp_path}/index")
    assert again.snapshot(2) == second and again.snapshot().version == 3
    for query in ("momentum factor", "因子", "factor factor value", "absent"):
        found = {r.chunk_id: r.score for r in retrieval.bm25(again.index(), queries(spark, query)).collect()}
        assert found == by_hand(TEXTS, query)
    # The reader that opened the first version still sees that one alone.
    found = {r.chunk_id: r.score for r in retrieval.bm25(reader, queries(spark, "因子 momentum factor")).collect()}
    assert found == by_hand({k: TEXTS[k] for k in "ab"}, "因子 momentum factor")
    assert {r.chunk_id for r in again.table("chunks", second).select("chunk_id").collect()} == set(TEXTS)


def test_rebuild_and_other_dimensions(spark, chunks, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(chunks)
    rebuilt = store.rebuild(chunks.where("source_id = 's1'"), stored=["source_id"])
    assert (rebuilt.version, rebuilt.chunks) == (2, 3)
    assert store.table("chunks", rebuilt).columns == ["chunk_id", "source_id"]
    assert IndexStore(spark, f"{tmp_path}/index", dim=64).snapshot() is None
    with pytest.raises(ValueError):
        IndexStore(spark, f"{tmp_path}/index", dim=64).index()
    assert store.append(chunks.where("false")).chunks == 3


def test_of_two_writers_of_a_version_one_wins(spark, chunks, tmp_path):
    one, other = IndexStore(spark, f"{tmp_path}/index"), IndexStore(spark, f"{tmp_path}/index")
    base = one.append(chunks.where("chunk_id = 'a'"))
    one.append(chunks.where("chunk_id = 'b'"))
    with pytest.raises(Conflict):
        other._commit(base, base.segments, chunks.where("chunk_id = 'c'"), None, True)
    assert other.append(chunks.where("chunk_id = 'c'")).chunks == 3


def test_vectors_rank_by_cosine_in_parts(spark, chunks, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(chunks)
    asked = retrieval.vector_lists(queries(spark, "momentum", "value factor", "", "zzz 因子"), "query_id")
    whole, parts = (retrieval.cosine_top_k(asked, store.index().vectors, 2, together=n).collect() for n in (4096, 1))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
    assert [(r.chunk_id, r["rank"]) for r in whole if r.query_id == 0][0] == ("f", 1)
    assert store.table("vectors", store.snapshot()).where(F.size("v") == 0).count() == 0


def test_a_failing_reranker_leaves_the_fused_order(spark, chunks, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(chunks)
    terms = queries(spark, "momentum factor 因子")
    plain = [r.chunk_id for r in retrieval.retrieve(store.index(), terms, top=4).orderBy("rank").collect()]
    none = retrieval.retrieve(store.index(), terms, top=4, rerank=lambda c: c.withColumn("score", F.lit(None).cast("double")))
    assert [r.chunk_id for r in none.orderBy("rank").collect()] == plain
    last = retrieval.retrieve(store.index(), terms, top=4, rerank=lambda c: c.withColumn("score", F.when(F.col("chunk_id") == plain[-1], 9.0)))
    assert [r.chunk_id for r in last.orderBy("rank").collect()] == [plain[-1], *plain[:-1]]
    weighted = retrieval.retrieve(store.index(), terms, top=1, fusion="weighted").first()
    assert 0 < weighted.score <= 1.0
    with pytest.raises(ValueError):
        retrieval.retrieve(store.index(), terms, fusion="other")


def test_best_scores_of_batches_are_the_best_of_all_and_nothing_is_shuffled(spark, tmp_path):
    """Copies of a text tie; queries come in several groups; vectors of term lists are those of postings."""
    texts = {i: f"w{i % 7} w{i % 3} common {'w1 ' * (i % 5)}" for i in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(rows, stored=[])
    asked = ["w1 w2 common", "w1 w1", "absent", "w6 w0"]
    found = retrieval.bm25(store.index(), queries(spark, *asked), k=4, together=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for q, text in enumerate(asked):
        want = sorted(((k, s.expected) for k, s in by_hand(texts, text).items()), key=lambda x: (-round(x[1], 9), x[0]))[:4]
        got = retrieval.top_k(found, 4).where(f"query_id = {q}").orderBy("rank").collect()
        assert [r.chunk_id for r in got] == [k for k, _ in want] and [r.score for r in got] == pytest.approx([s for _, s in want])
    # Scores of 9 digits rank only: rounded here and again at 6 digits, they would leave the SQL's.
    assert any(r.score != round(r.score, 9) for r in found.collect())
    vectors = {r.chunk_id: {x.bucket: round(x.value, 12) for x in r.v} for r in store.index().vectors.collect()}
    assert vectors == {r.chunk_id: {x.bucket: round(x.value, 12) for x in r.v} for r in retrieval.vector_lists(retrieval.postings(rows, "chunk_id"), "chunk_id").collect()}


def test_term_lists_hold_two_values_a_row_and_every_token(spark, tmp_path):
    """Tokens are marked in bytes: they must be the pattern's, at borders of rows and of the character range as well."""
    texts = ["a", "b1", None, "", "中a一鿿", "䷿ꀀ豈é1ń", "x_y-z", "龥", "中文 中文 2", "٠a", "😀9"] * 7
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(rows, stored=[])
    lists = store.index().lists.drop("segment")
    assert dict(lists.dtypes) == {"chunk_id": "bigint", "length": "bigint", "terms": "string", "tf": "binary"}
    want = {i: Counter(re.findall(retrieval.TOKEN, t or "")) for i, t in enumerate(texts)}
    found = {r.chunk_id: (r.length, Counter(dict(zip(r.terms.split(), memoryview(bytes(r.tf)).cast("i"), strict=True)))) for r in lists.collect()}
    assert found == {i: (c.total(), c) for i, c in want.items()}
    assert {r.term: r.df for r in store.table("terms", store.snapshot()).collect()} == Counter(t for c in want.values() for t in c)
    assert {(r.chunk_id, r.term): r.tf for r in retrieval.postings(rows, "chunk_id").collect()} == {(i, t): n for i, c in want.items() for t, n in c.items()}


def test_texts_are_not_sorted_to_leave_out_those_indexed(spark, monkeypatch):
    given = spark.range(50).select(F.col("id").alias("chunk_id"), F.lit("text").alias("text"))
    known = spark.range(0, 60, 2).select(F.col("id").alias("chunk_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, join in ((100, "BroadcastHashJoin"), (29, "ShuffledHashJoin")):
            monkeypatch.setattr(retrieval, "KNOWN_NUMBERS", most)
            fresh = retrieval.not_indexed(given, known, "chunk_id")
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "SortMergeJoin" not in plan
            assert sorted(r.chunk_id for r in fresh.collect()) == list(range(1, 50, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_least_similarities_count_and_many_ties_are_cut_by_id(spark):
    asked = spark.sql("select 1L as query_id, array(named_struct('bucket', 0, 'value', 1.0D)) as v")
    table = spark.sql("select id as chunk_id, array(named_struct('bucket', 0, 'value', if(id = 7, 1e-10D, 0.5D)), named_struct('bucket', 1, 'value', 1.0D)) as v from range(5, 9)")
    assert [(r.chunk_id, r["rank"]) for r in retrieval.cosine_top_k(asked, table, 4).orderBy("rank").collect()] == [(5, 1), (6, 2), (8, 3), (7, 4)]
    many = spark.range(3000).select(F.col("id").alias("chunk_id"), F.expr("array(named_struct('bucket', 0, 'value', 0.5D))").alias("v"))
    assert [r.chunk_id for r in retrieval.cosine_top_k(asked, many, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_one_pass_lists_terms_packs_vectors_and_tells_document_counts(monkeypatch):
    """Counts are told whenever their terms fill the bound, and at the end; added up they are those of all texts, whatever the bound."""
    texts = [" ".join(f"t{(i * j) % 37} 中{j}" for j in range(i % 9)) or None for i in range(60)]
    want = Counter(t for x in texts for t in set(re.findall(retrieval.TOKEN, x or "")))
    batches = [pa.record_batch({"chunk_id": list(range(i, i + 5)), "text": pa.array(texts[i : i + 5], pa.string())}) for i in range(0, 60, 5)]
    batches.insert(3, batches[0].slice(0, 0))
    for bound, rows in ((1 << 24, 1), (40, 12)):
        monkeypatch.setattr(retrieval, "_TOLD_BYTES", bound)
        listed = pa.Table.from_batches(list(retrieval._listed(16)(batches)))
        assert listed["chunk_id"].to_pylist() == list(range(60))
        told = [(w.split(), np.frombuffer(d, "<i8")) for w, d in zip(listed["words"].to_pylist(), listed["df"].to_pylist(), strict=True) if w is not None]
        assert len(told) == rows
        found = Counter()
        for words, df in told:
            found.update(dict(zip(words, df.tolist(), strict=True)))
        assert found == want
        assert sum(int(np.frombuffer(c, "<i4").sum()) for c in listed["counts"].to_pylist()) == sum(listed["length"].to_pylist())
    assert set(pa.Table.from_batches(list(retrieval._listed(None)(batches)))["buckets"].to_pylist()) == {None}


def test_a_task_passes_on_what_may_be_among_its_best_alone():
    """Later batches pass on nothing that is less than the k best before; ties stay, since ids of later batches may be lesser."""
    rng = np.random.default_rng(0)
    scores = np.round(rng.random((3, 4000)), 2)
    scores[2] = 0.0
    ids = rng.permutation(4000)
    scores[0, ids == 0], scores[0, ids == 3999] = 1e-10, 1.0
    held, passed = np.zeros((3, 5)), []
    for lo in range(0, 4000, 50):
        q, c = retrieval._best(scores[:, lo : lo + 50], pa.array(ids[lo : lo + 50]), 5, held)
        passed += [(int(a), -float(scores[a, lo + b]), int(ids[lo + b])) for a, b in zip(q, c, strict=True)]
    for query in range(2):
        want = sorted((-float(scores[query, j]), int(ids[j])) for j in range(4000))[:5]
        assert sorted(x[1:] for x in passed if x[0] == query)[:5] == want
    assert len(passed) < 3 * 5 * 80 / 4 and all(x[0] < 2 for x in passed)
    few = retrieval._best(np.array([[1e-10, 0.0, 0.5]]), pa.array([1, 2, 3]), 5, np.zeros((1, 5)))
    assert few[1].tolist() == [2, 0]


def test_vectors_are_stored_beside_the_lists_and_other_layouts_read_as_absent(spark, chunks, tmp_path, monkeypatch):
    store = IndexStore(spark, f"{tmp_path}/index")
    store.append(chunks)
    assert set(store.index().packed.columns) >= {"chunk_id", "buckets", "counts"} and not (tmp_path / "index/segments/vectors").exists()
    asked = retrieval.vector_lists(queries(spark, "momentum", "value factor"), "query_id")
    packed, plain = (sorted(map(tuple, retrieval.cosine_top_k(asked, v, 3).collect())) for v in (store.index().packed, store.index().vectors))
    assert packed and packed == plain
    monkeypatch.setattr("fathomflow.sources.index_store.LAYOUT", 3)
    assert store.snapshot() is None
