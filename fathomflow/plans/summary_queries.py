"""Queries on whole summaries: orders stand for factor records and runs, documents for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, strategy, summaries
from ..sources import market, results
from ..sources.shared import new_path
from .panel_queries import _CHOSEN, _EQUAL, _FACTOR, _REBALANCE, _rows
from .registry import on_panel, query, rounded, table

_RECORDS = "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderpriority AS confidence, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS compute_source, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 300000 - 0.5 END AS ic, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100000 - 1 END AS icir"
_DUCK_RECORDS = f"records AS (SELECT {_RECORDS} FROM orders)"


def _factors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{x}" for x in _RECORDS.split(", ")])


query(
    "A21_product_summary",
    f"""WITH {_DUCK_RECORDS} SELECT 'status' AS field, coalesce(status, 'pending') AS value, count(*) AS n, NULL::DOUBLE AS mean FROM records GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*), NULL FROM records GROUP BY 2
UNION ALL SELECT 'compute_source', coalesce(nullif(compute_source, ''), 'none'), count(*), NULL FROM records GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*), NULL FROM records UNION ALL SELECT 'with_backtest', NULL, count(ic), NULL FROM records UNION ALL SELECT 'avg_abs_ic', NULL, count(ic), round(avg(abs(ic)), 4) FROM records""",
)(lambda s, d: summaries.product_summary(_factors(s, d)))

_ISSUES = "CASE WHEN o_totalprice > 250000 THEN 'A/HIGH' WHEN o_orderpriority = '1-URGENT' THEN 'B/MEDIUM' WHEN o_totalprice < 20000 THEN 'C/HIGH' WHEN o_orderstatus = 'P' THEN 'D/MEDIUM' WHEN o_totalprice < 40000 THEN 'E/HIGH' WHEN o_custkey % 7 = 0 THEN 'F/MEDIUM' END"


@query(
    "A26_issue_sections",
    f"""WITH found AS (SELECT session_id, split_part(issue, '/', 1) AS type, split_part(issue, '/', 2) AS severity FROM (SELECT o_custkey AS session_id, {_ISSUES} AS issue FROM orders) WHERE issue IS NOT NULL),
types AS (SELECT type AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, type) AS place, list(session_id ORDER BY session_id)[1:3] AS firsts FROM found GROUP BY type), t AS (SELECT count(*) AS issues FROM found)
SELECT 'overview' AS section, 1 AS place, 'sessions' AS key, count(DISTINCT o_custkey) AS n, NULL::DOUBLE AS share, '' AS examples FROM orders UNION ALL SELECT 'overview', 2, 'records', count(*), NULL, '' FROM orders
UNION ALL SELECT 'overview', 3, 'issues', issues, round(issues / (SELECT count(*) FROM orders), 6), '' FROM t UNION ALL SELECT 'overview', 4, 'sessions with issues', count(DISTINCT session_id), NULL, '' FROM found
UNION ALL SELECT 'severity', p, s, (SELECT count(*) FROM found WHERE severity = s), round((SELECT count(*) FROM found WHERE severity = s) / issues, 6), '' FROM (VALUES (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW')) v(p, s), t
UNION ALL SELECT 'type', place, key, n, round(n / issues, 6), '' FROM types, t UNION ALL SELECT 'top', place, key, n, round(n / issues, 6), array_to_string(list_sort(list_transform(firsts, lambda x: x::VARCHAR)), ',') FROM types, t WHERE place <= 5""",
)
def a26(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    issue = F.split(F.expr(_ISSUES), "/")
    found = orders.select(F.col("o_custkey").alias("session_id"), issue[0].alias("type"), issue[1].alias("severity")).where("type is not null")
    return rounded(summaries.issue_sections(found, orders.select(F.col("o_custkey").alias("session_id"))).withColumn("examples", F.array_join("examples", ",")))


query(
    "A32_whole_dashboard",
    f"""WITH {_DUCK_RECORDS}, runs AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 300000 - 0.5 END AS ic FROM orders), means AS (SELECT run_id, round(avg(coalesce(ic, 0)), 4) AS value FROM runs GROUP BY 1)
SELECT * FROM (SELECT 'recent_mean_ic' AS key, run_id, value + 0.0 AS value FROM means ORDER BY run_id DESC LIMIT 5) UNION ALL SELECT 'best_ic', NULL, round(max(abs(ic)), 4) FROM records UNION ALL SELECT 'best_icir', NULL, round(max(abs(icir)), 4) FROM records UNION ALL SELECT 'total_runs', NULL, count(*)::DOUBLE FROM means""",
)(lambda s, d: rounded(summaries.dashboard(_factors(s, d), table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.expr("CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 300000 - 0.5 END").alias("ic")))))
query("G09_weights_history", on_panel(f"SELECT date, code, round(w, 6) AS weight FROM (SELECT date, code, {_EQUAL} AS w FROM binned WHERE bin = 5) WHERE w <> 0", _FACTOR, _REBALANCE.format("month"), _CHOSEN))(lambda s, d: summaries.weights_history(strategy.target_weights(_rows(s, d), strategy.StrategyConfig())))

_PAPERS = "CASE doc_id % 5 WHEN 0 THEN 'Head. ABSTRACT: ' || text WHEN 1 THEN 'Summary: short' || chr(10) || chr(10) || 'Overview ' || text WHEN 2 THEN '  introduction' || text ELSE text END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _duck_abstract(text: str) -> str:
    part = lambda m: f"substr({_STRIP.format(f'split_part(substr({text}, instr(lower({text}), {m!r}) + {len(m)}), chr(10) || chr(10), 1)')}, 1, 1500)"
    cases = " ".join(f"WHEN instr(lower({text}), '{m}') > 0 AND length({part(m)}) > 50 THEN {part(m)}" for m in ("abstract", "summary", "overview", "introduction"))
    return f"CASE {cases} ELSE {_STRIP.format(f'substr({text}, 1, 1500)')} END"


query("Q09_abstracts", f"SELECT doc_id, {_duck_abstract('t')} AS abstract FROM (SELECT doc_id, {_PAPERS} AS t FROM documents)")(lambda s, d: table(s, d, "documents").select("doc_id", summaries.abstract(F.expr(_PAPERS.replace("chr(10)", "'\\n'"))).alias("abstract")))

_SENTENCE = "CASE " + " ".join(f"WHEN instr(s, {e}) > 1 THEN substr(s, 1, instr(s, {e}))" for e in ("'。'", "'. '", "'.' || chr(10)", "'!'", "'?'", "chr(10)")) + " ELSE substr(s, 1, 100) END"
query(
    "Q10_compacted",
    rf"""WITH placed AS (SELECT conv_id, turn, role, text, {_STRIP.format('text')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
said AS (SELECT *, {_SENTENCE} AS f, sum((role = 'user' AND i > 1 AND i < n)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM placed),
words AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS pos FROM (SELECT conv_id, turn, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS p FROM conversations))),
counts AS (SELECT conv_id, w, count(*) AS n, min(turn * 100000 + pos) AS first FROM (SELECT conv_id, turn, pos, trim(w, '，。、！？,.!?;:"''()（）[]【】') AS w FROM words) WHERE length(w) >= 2 GROUP BY 1, 2 HAVING count(*) >= 2),
keys AS (SELECT conv_id, string_agg(w, ', ' ORDER BY n DESC, first) AS k FROM (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) <= 5) GROUP BY 1),
parts AS (SELECT conv_id, max('开场: ' || substr(f, 1, 80)) FILTER (i = 1 AND f <> '') AS a, max('最近: ' || substr(f, 1, 80)) FILTER (i = n AND n > 1 AND f <> '') AS b, max('用户: ' || substr(f, 1, 60)) FILTER (role = 'user' AND i > 1 AND i < n AND u = 1 AND f <> '') AS c, max('用户: ' || substr(f, 1, 60)) FILTER (role = 'user' AND i > 1 AND i < n AND u = 2 AND f <> '') AS d FROM said GROUP BY 1)
SELECT conv_id, NULL::BIGINT AS turn, 'summary' AS role, coalesce(nullif(concat_ws(' | ', a, b, c, d, '关键词: ' || k), ''), '[history compacted]') AS text FROM parts LEFT JOIN keys USING (conv_id) UNION ALL SELECT conv_id, turn, role, text FROM placed WHERE i > n - 6""",
)(lambda s, d: summaries.compacted(table(s, d, "conversations")))

query("P02_reindexed", on_panel("SELECT m.date, m.code, f.value FROM (SELECT DISTINCT date, code FROM market) m LEFT JOIN (SELECT date, code, max(volume) AS value FROM market WHERE volume > 60 GROUP BY 1, 2) f ON f.date = m.date AND f.code = m.code"))(
    lambda s, d: (lambda m: align.reindexed(m.where("volume > 60").select("date", "code", F.col("volume").alias("value")), m))(market.panel(s, d))
)
query("P03_inner_aligned", on_panel("SELECT a.date, a.code, round(a.close, 6) AS price, b.volume FROM market a JOIN market b ON a.date = b.date AND a.code = b.code WHERE a.close IS NOT NULL AND b.volume > 60"))(
    lambda s, d: (lambda m: rounded(align.inner((m.where("close is not null").withColumn("value", F.col("close")), "price"), (m.where("volume > 60").withColumn("value", F.col("volume")), "volume"))))(market.panel(s, d))
)
query("J01_known_pairs", on_panel("SELECT date, code, round(close, 6) AS factor, volume AS forward FROM market WHERE close IS NOT NULL AND volume > 90 QUALIFY count(*) OVER (PARTITION BY date) >= 3"))(
    lambda s, d: (lambda m: rounded(align.known_pairs(m.withColumn("value", F.col("close")), m.where("volume > 90").withColumn("value", F.col("volume")))))(market.panel(s, d))
)


@query("S16_results_read_back", "SELECT strftime(o_orderdate, '%Y-%m') AS run_id, o_orderpriority AS factor_name, round(avg(o_totalprice), 4) AS ic, count(*) AS n_dates FROM orders GROUP BY 1, 2")
def s16(spark, sf_dir) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderpriority").alias("factor_name")).agg(F.avg("o_totalprice").alias("ic"), F.count("*").alias("n_dates"))
    path = new_path(spark, "results")
    results.write_results(runs, path)
    return rounded(results.read_results(spark, path, "factor_name string, ic double, n_dates long"), 4)
