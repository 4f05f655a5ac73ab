"""Similarity joins and keyed tables against plain loops."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomflow.operators import similarity
from fathomflow.plans import ORACLES, QUERIES
from fathomflow.sources.keyed_table import KeyedTable, append_records

AT = "2024-06-01 00:00:00"


def words(text):
    return set(re.findall(r"\w{3,}", (text or "").lower()))


def overlap(a, b):
    return len(words(a) & words(b)) / max(len(words(a)), 1)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    common, rare = ["momentum", "factor", "price"], [f"word{i}" for i in range(30)]
    out = [" ".join([*rng.sample(common, rng.randrange(4)), *rng.sample(rare, rng.randrange(0, 9))]) for _ in range(80)]
    return [*out, out[3], out[3].upper(), "", None, "ab cd", "momentum", "momentum factor", "momentum factor price", " ".join(rare)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.29])
def test_overlaps(spark, texts, threshold):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {(r.left_id, r.right_id): r.overlap for r in similarity.token_overlaps(rows, rows, threshold).collect()}
    assert found == {(i, j): overlap(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if words(b) and overlap(a, b) > threshold}


def test_only_rare_tokens_are_looked_up(spark):
    rows = spark.createDataFrame([(i, f"everywhere alsothere own{i} pair{i // 2}") for i in range(200)], "id long, text string")
    assert similarity.token_overlaps(rows, rows, 0.7).where("left_id <> right_id").count() == 200
    assert similarity.token_overlaps(rows.where("false"), rows).count() == 0


def inserted(table, new):
    """Records one after another, as they would be added by hand."""
    known = dict(table)
    for name, text in new:
        if name is None or name in known or any(words(t) and overlap(text, t) > 0.8 for t in known.values()):
            continue
        known[name] = text
    return known


def test_guarded_inserts_equal_inserts_one_by_one(spark, texts, tmp_path):
    rng = random.Random(6)
    old = [(f"n{i}", t) for i, t in enumerate(texts[:12])]
    new = [(f"n{rng.randrange(70)}" if i % 9 else None, t, i) for i, t in enumerate(texts)]
    table = KeyedTable(spark, f"{tmp_path}/t", "name", buckets=3).create(spark.createDataFrame(old, "name string, definition string").withColumn("status", F.lit("approved")))
    added = table.insert(spark.createDataFrame(new, "name string, definition string, place int"), AT, place="place", definition="definition")
    first = {}
    for name, t, _ in new:
        first.setdefault(name, t)
    want = inserted(old, first.items())
    rows = table.read().collect()
    assert {r.name: r.definition for r in rows} == want and len(rows) == len(want) == len(old) + added
    assert {r.status for r in rows if r.name not in dict(old)} == {"pending"} and all(r.added_at == AT for r in rows if r.name not in dict(old))
    assert "place" not in table.read().columns
    assert table.insert(spark.createDataFrame(new, "name string, definition string, place int"), AT, place="place", definition="definition") == 0


def test_updates_touch_their_records_alone(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k", buckets=4).create(spark.createDataFrame([(i, "new", None) for i in range(20)] + [(None, "x", "x")], "k long, status string, note string"))
    before = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("t/*/*.parquet")}
    changes = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (4, "", 1), (99, "z", 1), (None, "z", 1)], "k long, status string, n int")
    assert table.update(changes.select("k", "status", "n"), "r1", "formula", AT, order=[F.col("n")], skip_empty=True) == 2
    found = {r.k: r for r in table.read().collect()}
    assert len(found) == 20
    assert (found[3].status, found[3].n, found[3].run_id, found[3].compute_source, found[3].updated_at) == ("b", 2, "r1", "formula", AT)
    assert (found[4].status, found[4].n, found[4].run_id) == ("new", 1, "r1")
    assert all((r.status, r.n, r.run_id) == ("new", None, None) for k, r in found.items() if k not in (3, 4))
    after = {p.name for p in tmp_path.glob("t/*/*.parquet")}
    assert len(after & set(before)) >= 1  # folders without changes keep their files
    assert table.update(changes.where("false").select("k", "status"), "r2", "formula", AT) == 0
    # Once more gives the same.
    table.update(changes.select("k", "status", "n"), "r1", "formula", AT, order=[F.col("n")], skip_empty=True)
    assert {r.k: r for r in table.read().collect()} == found


def test_appended_records_have_defaults(spark, tmp_path):
    append_records(spark.createDataFrame([("a", None), ("b", "user")], "content string, role string"), f"{tmp_path}/m", now="2024-02-03")
    append_records(spark.createDataFrame([("c", "2024-05-01")], "content string, ts string"), f"{tmp_path}/m", now="2024-02-03")
    rows = {r.content: r for r in spark.read.parquet(f"{tmp_path}/m").collect()}
    assert (rows["a"].role, rows["a"].topic, rows["a"].tokens, rows["a"].source, rows["a"].month) == ("", "general", 0, "hot", "2024-02")
    assert rows["b"].role == "user" and rows["c"].month == "2024-05"


def test_copies_of_definitions_are_not_paired(spark, tmp_path):
    """20,000 new rows and 5,000 known ones share a definition: 100 million pairs, of which none is listed."""
    rows = spark.range(25_000).select(F.col("id").alias("name"), F.lit("small blue widget of steel").alias("definition"))
    more = spark.createDataFrame([(30_000, "another green gadget of brass")], "name long, definition string")
    store = KeyedTable(spark, f"{tmp_path}/t", "name").create(rows.where("name < 5000"))
    known = similarity.overlapping(*(t.withColumnsRenamed({"name": "id", "definition": "text"}) for t in (rows.where("name >= 5000").unionByName(more), rows.where("name < 5000"))))
    assert known.count() == 20_000 and known.where("id = 30000").count() == 0
    assert "right_id" not in known._jdf.queryExecution().optimizedPlan().toString()
    assert store.insert(rows.unionByName(more), "2024-01-01 00:00:00", definition="definition", within=False) == 1


def test_columns_do_not_hang_on_rows(spark, tmp_path):
    """Merges that store no row leave the columns that they bring, in tables with and without rows."""
    rows = spark.createDataFrame([(1, "small blue widget", "approved"), (2, "old red anvil", "approved")], "name long, definition string, status string")
    store = KeyedTable(spark, f"{tmp_path}/full", "name").create(rows)
    assert store.insert(rows.drop("status").withColumn("name", F.col("name") + 10), AT, definition="definition", within=False) == 0
    assert store.update(rows.where("false").select("name", F.lit(2.5).alias("revenue")), "run", "formula", AT) == 0
    found = store.read().select("name", "status", "modality", "added_at", "revenue", "run_id").orderBy("name").collect()
    assert [tuple(r) for r in found] == [(1, "approved", None, None, None, None), (2, "approved", None, None, None, None)]
    empty = KeyedTable(spark, f"{tmp_path}/empty", "name").create(rows.where("false"))
    assert empty.read().count() == 0 and empty.read().columns == rows.columns
    assert empty.update(rows.select("name", F.lit(2.5).alias("revenue")), "run", "formula", AT) == 0 and "revenue" in empty.read().columns
    assert empty.insert(rows, AT, definition="definition") == 2
    assert {(r.name, r.status, r.modality, r.revenue) for r in empty.read().collect()} == {(1, "approved", "single", None), (2, "approved", "single", None)}


@pytest.mark.parametrize(
    "parts",
    [[("blue ring", 1), ("ring blue", 9), ("blue ring", 50)], [("blue ring", 9), ("blue ring", 9)], [("blue ring", 1), ("hot rod", 3)], [("hot rod", 2), (None, 9), (None, 3), ("", 9), ("ab", 9), ("hot red", 9)]],
    ids=["all known", "none approved", "none pending", "nulls"],
)
def test_guarded_inserts_of_parts_equal_sql(spark, tmp_path, parts):
    rows = [(k, name, "SMALL" if name else "XL", size) for k, (name, size) in enumerate(parts)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["U01_insert_guarded"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = db.sql(ORACLES["U01_insert_guarded"]).fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
