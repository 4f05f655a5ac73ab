"""Queries on bad cases, verifiers, lineage and state migrations. Orders stand for factor records, customers for decisions and
backtest results, conversations for batches of papers and for states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks
from .registry import query, rounded, table

#: Factor records, in SQL that both engines read.
_FACTORS = r"""SELECT o_orderkey AS id,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Alpha' WHEN 2 THEN 'x' WHEN 4 THEN ' score ' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'momentum of a window' END AS factor_name,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '  ' ELSE 'a definition' END AS definition,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'close, 市值, roe' ELSE 'close' END AS data_needed,
  CASE o_orderkey % 11 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'rank(close) etc' WHEN 2 THEN '' WHEN 3 THEN 'a ... b' WHEN 4 THEN 'n/a' ELSE 'rank(close)' END AS calculation_formula,
  CASE o_orderkey % 4 WHEN 0 THEN '高' WHEN 1 THEN '低' END AS confidence,
  CASE o_custkey % 6 WHEN 0 THEN 'a conclusion that is long enough' WHEN 1 THEN 'short' END AS paper_conclusion,
  o_orderkey % 13 <> 0 AS is_factor,
  CASE o_custkey % 3 WHEN 0 THEN 'it uses close and ROE' WHEN 1 THEN 'it uses 市值' END AS summary,
  CASE o_orderkey % 17 WHEN 0 THEN 'sorry' WHEN 1 THEN '{"error": "JSON_PARSE_FAIL"}' WHEN 2 THEN '{broken' WHEN 3 THEN '```json {"a": 1}```' WHEN 4 THEN ' {"b": [1, 2]} ' END AS raw_response
  FROM orders"""
_DUCK_FACTORS = f"f AS (SELECT *, trim(coalesce(factor_name, '')) AS fname, trim(coalesce(calculation_formula, '')) AS formula FROM ({_FACTORS}))"
_IN_LIST = ", ".join(f"'{w}'" for w in checks.GENERIC_NAMES)
_COMMON = f"""CASE WHEN fname = '' THEN '{{0}}factor_name{{1}}' END, CASE WHEN trim(coalesce(definition, '')) = '' THEN '{{0}}definition{{1}}' END, CASE WHEN trim(coalesce(data_needed, '')) = '' THEN '{{0}}data_needed{{1}}' END,
  CASE WHEN lower(fname) IN ({_IN_LIST}) THEN '{{2}}' END, CASE WHEN length(fname) = 1 THEN '{{3}}' END,
  CASE WHEN regexp_matches(formula, '{{4}}') THEN '{{5}}' END, CASE WHEN formula = '' AND coalesce(definition, '') <> '' THEN '{{6}}' END,
  CASE WHEN trim(coalesce(confidence, '')) = '高' AND length(trim(coalesce(paper_conclusion, ''))) < 20 THEN '{{7}}' END"""
_HALLUCINATED = " OR ".join(f"(contains(lower(data_needed), lower('{w}')) AND NOT contains(lower(summary), lower('{w}')))" for w in checks.DATA_WORDS)
_CASES = f"""{_DUCK_FACTORS},
cases AS (SELECT id, CASE
  WHEN raw_response IS NOT NULL AND (NOT regexp_matches(trim(raw_response), '^(\\{{|```)') OR NOT json_valid(clean) OR CASE WHEN json_valid(clean) THEN coalesce(json_extract_string(clean, '$.error') = 'JSON_PARSE_FAIL', false) END) THEN ['JSON_PARSE_FAIL/HIGH']
  WHEN NOT is_factor THEN []
  ELSE list_filter([{_COMMON.format("MISSING_FIELD:", "/MEDIUM", "GENERIC_NAME/MEDIUM", "GENERIC_NAME/LOW", r"\.\.\.|etc|类似|等|tbd|todo|n/a|待补充", "INCOMPLETE_FORMULA/MEDIUM", "INCOMPLETE_FORMULA/LOW", "OVERCONFIDENT/MEDIUM")},
    CASE WHEN summary IS NOT NULL AND ({_HALLUCINATED}) THEN 'DATA_HALLUCINATION/HIGH' END], lambda x: x IS NOT NULL) END AS issues
  FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(raw_response), '^```(json)?', ''), '```$', '')) AS clean FROM f))"""


def _factors(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("check_orders")
    return spark.sql(_FACTORS.replace("FROM orders", "FROM check_orders"))


def _joined(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.array_join("issues", ",").alias("issues"))


query("Q01_factor_bad_cases", f"WITH {_CASES} SELECT id, coalesce(array_to_string(issues, ','), '') AS issues FROM cases")(lambda s, d: _joined(checks.factor_issues(_factors(s, d)), "id"))

_FIRST = "first AS (SELECT 'f' || o_custkey AS factor_name, arg_min(coalesce(CASE o_orderkey % 4 WHEN 0 THEN '高' WHEN 1 THEN '低' END, '?'), o_orderkey) AS confidence FROM orders GROUP BY 1)"


@query(
    "Q02_session_bad_cases",
    f"""WITH {_FIRST} SELECT factor_name, 'INCONSISTENT' AS type, 'MEDIUM' AS severity FROM customer JOIN first ON factor_name = 'f' || c_custkey WHERE c_nationkey % 2 = 0 AND confidence = '低'
UNION ALL SELECT factor_name, 'OVERCONFIRMED_BY_BACKTEST', 'MEDIUM' FROM customer JOIN first ON factor_name = 'f' || c_custkey WHERE abs(c_acctbal / 100000) < 0.005 AND confidence = '高'""",
)
def q02(spark, sf_dir):
    name = lambda c: F.concat(F.lit("f"), F.col(c)).alias("factor_name")
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    factors = orders.select(name("o_custkey"), F.when(F.col("o_orderkey") % 4 == 0, "高").when(F.col("o_orderkey") % 4 == 1, "低").alias("confidence"), F.col("o_orderkey").alias("place"))
    decisions = customers.select(name("c_custkey"), F.when(F.col("c_nationkey") % 2 == 0, "approved").otherwise("rejected").alias("decision"))
    return checks.session_issues(factors, decisions, customers.select(name("c_custkey"), (F.col("c_acctbal") / 100000).alias("ic")))


@query("A26_bad_case_report", f"WITH {_CASES}, each AS (SELECT id, unnest(issues) AS type FROM cases) SELECT type, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS rate, array_to_string(list_sort(list(id ORDER BY id))[1:3], ',') AS examples FROM each GROUP BY type")
def a26(spark, sf_dir):
    found = checks.factor_issues(_factors(spark, sf_dir))
    report = checks.issue_report(found.select("id", F.explode("issues").alias("type")), table(spark, sf_dir, "orders").count())
    return rounded(report.withColumn("examples", F.array_join("examples", ",")))


_RESULTS = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'error' WHEN 1 THEN 'insufficient_data' WHEN 2 THEN 'odd' WHEN 3 THEN '' ELSE 'ok' END AS status,
  CASE c_custkey % 8 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal / 8000 END AS ic, CASE c_custkey % 10 WHEN 0 THEN CAST('Infinity' AS DOUBLE) ELSE c_acctbal / 700 END AS icir,
  CASE c_custkey % 6 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE c_custkey % 100 END AS n_dates, CAST(c_nationkey - 12 AS DOUBLE) AS long_short FROM customer"""
_VERDICT = "SELECT id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS verified, CASE WHEN len(issues) = 0 THEN 'high' WHEN list_has_any(issues, [{0}]) THEN 'low' ELSE 'medium' END AS confidence_level FROM ({1})"


@query(
    "Q03_verify_backtests",
    _VERDICT.format(
        "'error', 'missing_fields', 'ic_not_finite', 'ic_out_of_range', 'icir_not_finite', 'sign_disagreement'",
        f"""SELECT id, list_filter([CASE WHEN status IN ('error', 'insufficient_data') THEN status END, CASE WHEN status = 'odd' THEN 'unknown_status' END, CASE WHEN (ic IS NULL OR icir IS NULL OR n_dates IS NULL) AND status <> 'error' THEN 'missing_fields' END,
  CASE WHEN NOT isfinite(ic) THEN 'ic_not_finite' END, CASE WHEN isfinite(ic) AND abs(ic) > 1 THEN 'ic_out_of_range' END, CASE WHEN n_dates < 20 THEN 'too_few_dates' END, CASE WHEN NOT isfinite(icir) THEN 'icir_not_finite' END, CASE WHEN isfinite(icir) AND abs(icir) > 10 THEN 'icir_out_of_range' END,
  CASE WHEN isfinite(ic) AND ic * long_short < 0 THEN 'sign_disagreement' END], lambda x: x IS NOT NULL) AS issues FROM ({_RESULTS})""",
    ),
)
def q03(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("check_customer")
    return _joined(checks.verify_backtests(spark.sql(_RESULTS.replace("FROM customer", "FROM check_customer"))), "id", "verified", "confidence_level")


query(
    "Q04_verify_factors",
    f"WITH {_DUCK_FACTORS} "
    + _VERDICT.format(
        "'missing:factor_name', 'missing:definition', 'missing:data_needed', 'generic_name', 'short_name', 'overconfident'",
        f"SELECT id, CASE WHEN NOT is_factor THEN [] ELSE list_filter([{_COMMON.format('missing:', '', 'generic_name', 'short_name', chr(92) + '.' + chr(92) + '.' + chr(92) + '.|etc|类似|等|tbd|todo', 'incomplete_formula', 'empty_formula', 'overconfident')}], lambda x: x IS NOT NULL) END AS issues FROM f",
    ),
)(lambda s, d: _joined(checks.verify_factors(_factors(s, d)), "id", "verified", "confidence_level"))


@query(
    "Q05_verify_papers",
    """WITH p AS (SELECT conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN turn % 4 = 0 THEN '' ELSE role END AS title, CASE WHEN turn % 2 = 0 THEN ' ' ELSE text END AS summary FROM conversations),
l AS (SELECT batch, i, 0 AS k, i || ':title' AS issue FROM p WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT batch, i, 1, i || ':summary' FROM p WHERE trim(coalesce(summary, '')) = '')
SELECT batch, count(*) AS n_papers, NOT EXISTS (SELECT 1 FROM l WHERE l.batch = p.batch) AS verified, coalesce((SELECT array_to_string(list(issue ORDER BY i, k)[1:5], ',') FROM l WHERE l.batch = p.batch), '') AS issues FROM p GROUP BY batch""",
)
def q05(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    papers = turns.select(F.col("conv_id").alias("batch"), F.col("turn").alias("place"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("role")).alias("title"), F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("text")).alias("summary"))
    return _joined(checks.verify_papers(papers), "batch", "n_papers", "verified")


@query(
    "Q07_lineage_chain",
    "SELECT p_partkey AS factor_name, p_brand AS paper, q.method, b.status FROM part LEFT JOIN (SELECT l_partkey, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS method FROM lineitem WHERE l_quantity > 45 GROUP BY 1) q ON q.l_partkey = p_partkey "
    "LEFT JOIN (SELECT l_partkey, arg_min(CASE WHEN l_discount > 0.05 THEN 'success' ELSE 'failed' END, l_orderkey * 10 + l_linenumber) AS status FROM lineitem WHERE l_quantity < 10 GROUP BY 1) b ON b.l_partkey = p_partkey",
)
def q07(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumnRenamed("l_partkey", "factor_name")
    factors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("factor_name"), F.struct(F.col("p_brand").alias("paper")).alias("lineage"))
    quality = lines.where("l_quantity > 45").select("factor_name", "place", F.struct(F.col("l_returnflag").alias("method")).alias("lineage"))
    backtests = lines.where("l_quantity < 10").select("factor_name", "place", F.struct(F.when(F.col("l_discount") > 0.05, "success").otherwise("failed").alias("status")).alias("lineage"))
    return checks.lineage_chain(factors, quality, backtests).select("factor_name", "factor.paper", "quality.method", "backtest.status")


@query(
    "Q08_migrate_state",
    """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '3' WHEN 4 THEN '4' ELSE '3' END AS version,
  CASE turn % 5 WHEN 0 THEN 'compaction_history,cost_summary,cost_usages,goal,memory_tiers,retrieval_context,schema_version' WHEN 1 THEN 'compaction_history,cost_summary,cost_usages,goal,memory_tiers,retrieval_context,schema_version' WHEN 2 THEN 'compaction_history,goal,memory_tiers,retrieval_context,schema_version' ELSE 'goal,schema_version' END AS keys FROM conversations""",
)
def q08(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    version = F.when(F.col("turn") % 5 > 0, (F.col("turn") % 5).cast("string"))
    goal = F.create_map(F.lit("goal"), F.col("role"))
    state = F.when(version.isNotNull(), F.map_concat(goal, F.create_map(F.lit("schema_version"), version))).otherwise(goal)
    moved = turns.select("conv_id", "turn", checks.migrate(state).alias("state"))
    return moved.select("conv_id", "turn", F.element_at("state", "schema_version").alias("version"), F.array_join(F.array_sort(F.map_keys("state")), ",").alias("keys"))
