"""Queries on keyed tables that are merged into and read back: orders stand for factor records, parts for definitions, documents for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed_table import KeyedTable, append_records
from ..sources.shared import new_path
from .registry import query, rounded, table

_AT = "2024-06-01 00:00:00"


def _orders(spark, sf_dir) -> KeyedTable:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.lit("").alias("notes"))
    return KeyedTable(spark, new_path(spark, "records"), "name").create(rows)


@query("U03_batch_status", "SELECT o_orderkey AS name, CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE o_orderstatus END AS status, CASE WHEN c_acctbal < 0 THEN 'balance' ELSE '' END AS notes, CASE WHEN c_acctbal < 0 THEN 'run-1' END AS run_id FROM orders JOIN customer ON o_custkey = c_custkey")
def u03(spark, sf_dir) -> DataFrame:
    records = _orders(spark, sf_dir)
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rejected = table(spark, sf_dir, "orders").join(poor, "o_custkey").select(F.col("o_orderkey").alias("name"), F.lit("rejected").alias("status"), F.lit("balance").alias("notes"))
    records.update(rejected, "run-1", "review", _AT)
    return records.read().select("name", "status", "notes", "run_id")


@query("U04_write_back", "SELECT o_orderkey AS name, o_orderstatus AS status, round(s, 4) AS revenue, n, CASE WHEN n IS NOT NULL THEN 'run-2' END AS run_id, CASE WHEN n IS NOT NULL THEN 'formula' END AS compute_source FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def u04(spark, sf_dir) -> DataFrame:
    records = _orders(spark, sf_dir)
    results = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("revenue"), F.count("*").alias("n"))
    records.update(results.select(F.col("l_orderkey").alias("name"), F.struct("revenue", "n").alias("backtest_result")), "run-2", "formula", _AT)
    return rounded(records.read().select("name", "status", "backtest_result.revenue", "backtest_result.n", "run_id", "compute_source"), 4)


@query("U07_paper_status", "SELECT d.doc_id AS paper_id, CASE WHEN l.n IS NOT NULL THEN 'extracted' ELSE 'new' END AS status, l.n AS factor_count FROM documents d LEFT JOIN (SELECT doc_id, sum(quality + toxic)::BIGINT AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def u07(spark, sf_dir) -> DataFrame:
    papers = KeyedTable(spark, new_path(spark, "papers"), "paper_id").create(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("new").alias("status")))
    counts = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("paper_id")).agg(F.sum(F.col("quality") + F.col("toxic")).alias("factor_count"))
    papers.update(counts.withColumn("status", F.lit("extracted")), "run-3", "extraction", _AT)
    return papers.read().select("paper_id", "status", F.col("factor_count").cast("long").alias("factor_count"))


@query("U08_append_records", "SELECT event_id, 'general' AS topic, 0 AS tokens, 'hot' AS source, '' AS content, coalesce(event_type, '') AS role, strftime(ts, '%Y-%m') AS month FROM events UNION ALL SELECT conv_id * 1000 + turn, 'general', length(text)::INTEGER, 'chat', text, role, '2024-06' FROM conversations")
def u08(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "memory")
    append_records(table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("role")), path)
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "role", F.col("text").alias("content"), F.length("text").alias("tokens"), F.lit("chat").alias("source"))
    append_records(turns, path, now=_AT)
    return spark.read.parquet(path).select("event_id", "topic", "tokens", "source", "content", "role", "month")


@query(
    "U01_insert_guarded",
    r"""WITH rows_ AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS definition, p_size FROM part),
t AS (SELECT DISTINCT id, p_size, unnest(regexp_extract_all(lower(definition), '\w{3,}')) AS token FROM rows_),
n AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
old AS (SELECT DISTINCT o.id AS set_id, o.token FROM t o WHERE p_size <= 3),
known AS (SELECT DISTINCT a.id FROM (SELECT a.id, o.set_id, count(*) AS c FROM t a JOIN old o USING (token) WHERE a.p_size > 3 GROUP BY 1, 2) a JOIN n ON n.id = a.id WHERE c / n > 0.8)
SELECT id AS name, definition, CASE WHEN p_size <= 3 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN p_size > 3 THEN 'single' END AS modality FROM rows_ WHERE p_size <= 3 OR id NOT IN (SELECT id FROM known)""",
)
def u01(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.concat("p_name", F.lit(" "), "p_type").alias("definition"), "p_size")
    records = KeyedTable(spark, new_path(spark, "records"), "name").create(parts.where("p_size <= 3").select("name", "definition", F.lit("approved").alias("status")))
    records.insert(parts.drop("p_size"), _AT, definition="definition", within=False)
    return records.read().select("name", "definition", "status", "modality")
