"""Checks of factor records, backtest results, paper lists and run states, as columns: no row is looked at by Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import issues

# Fields a factor must have, names that say nothing, marks of unfinished formulas, and data words to be found in an abstract.
REQUIRED_FIELDS = ("factor_name", "definition", "data_needed")
GENERIC_NAMES = ("alpha", "factor", "signal", "策略", "方法", "模型", "指标", "score", "ratio", "value", "factor1", "test", "demo", "xxx")
VERIFIER_MARKS = ("...", "etc", "类似", "等", "tbd", "todo")
INCOMPLETE_MARKS = (*VERIFIER_MARKS, "n/a", "待补充")
DATA_WORDS = ("收益率", "市值", "成交量", "换手率", "财务", "净利润", "ROE", "ROA", "PE", "PB", "动量", "反转", "波动率", "情绪", "新闻", "文本", "研报", "公告")
HIGH, LOW = "高", "低"

MIN_DATES = 20
SHORT_CONCLUSION = 20
NEAR_ZERO_IC = 0.005


def _text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def response_failed(response: Column) -> Column:
    """Whether a raw response is no JSON object or fenced JSON, does not parse, or reports a failure itself; null responses do not fail."""
    text = F.trim(response)
    fenced = F.regexp_replace(F.regexp_replace(text, r"^```(json)?", ""), r"```$", "")
    parsed = F.try_parse_json(F.trim(fenced))
    admitted = F.coalesce(F.try_variant_get(parsed, "$.error", "string") == "JSON_PARSE_FAIL", F.lit(False))
    return F.when(response.isNull(), False).otherwise(~(text.startswith("{") | text.startswith("```")) | parsed.isNull() | admitted)


def missing_words(needed: Column, abstract: Column) -> Column:
    """The data words that a factor asks for and its paper's abstract does not hold, whatever their case."""
    lower_needed, lower_abstract = F.lower(needed), F.lower(abstract)
    return issues(*[(lower_needed.contains(w.lower()) & ~lower_abstract.contains(w.lower()), w) for w in DATA_WORDS])


def factor_issues(factors: DataFrame) -> DataFrame:
    """Adds ``issues``, an array of type/severity. A response that does not parse is the only issue; records that are no
    factors have none. Needs factor_name, definition, data_needed, calculation_formula, confidence, paper_conclusion,
    is_factor, raw_response and summary (null without a paper)."""
    name, formula = _text("factor_name"), _text("calculation_formula")
    has_definition = F.length(F.coalesce(F.col("definition"), F.lit(""))) > 0
    found = issues(
        *[(_text(f) == "", f"MISSING_FIELD:{f}/MEDIUM") for f in REQUIRED_FIELDS],
        ((name != "") & F.lower(name).isin(*GENERIC_NAMES), "GENERIC_NAME/MEDIUM"),
        (F.length(name) == 1, "GENERIC_NAME/LOW"),
        ((formula != "") & _any_of(formula, INCOMPLETE_MARKS), "INCOMPLETE_FORMULA/MEDIUM"),
        ((formula == "") & has_definition, "INCOMPLETE_FORMULA/LOW"),
        ((_text("confidence") == HIGH) & (F.length(_text("paper_conclusion")) < SHORT_CONCLUSION), "OVERCONFIDENT/MEDIUM"),
        (F.col("summary").isNotNull() & (F.size(missing_words(F.coalesce("data_needed", F.lit("")), F.col("summary"))) > 0), "DATA_HALLUCINATION/HIGH"),
    )
    none = F.array().cast("array<string>")
    chosen = F.when(response_failed(F.col("raw_response")), F.array(F.lit("JSON_PARSE_FAIL/HIGH"))).when(~F.coalesce("is_factor", F.lit(True)), none).otherwise(found)
    return factors.withColumn("issues", chosen)


def session_issues(factors: DataFrame, decisions: DataFrame, backtests: DataFrame) -> DataFrame:
    """(factor_name, type, severity): approved decisions on factors of low confidence, and coefficients near zero of those of high
    confidence. factors (factor_name, confidence, place): the first of a name counts."""
    first = factors.where("factor_name is not null").groupBy("factor_name").agg(F.min_by(F.struct("confidence"), "place")["confidence"].alias("confidence"))
    unsure = decisions.where("decision = 'approved'").join(first.where(F.col("confidence") == LOW), "factor_name").select("factor_name", F.lit("INCONSISTENT").alias("type"), F.lit("MEDIUM").alias("severity"))
    flat = backtests.where(F.abs("ic") < NEAR_ZERO_IC).join(first.where(F.col("confidence") == HIGH), "factor_name").select("factor_name", F.lit("OVERCONFIRMED_BY_BACKTEST").alias("type"), F.lit("MEDIUM").alias("severity"))
    return unsure.unionByName(flat)


def issue_report(found: DataFrame, total: int, examples: int = 3) -> DataFrame:
    """(type, n, rate, examples) of rows (id, type): how often each type is found, also for one of ``total`` records, and its least ids."""
    place = F.row_number().over(Window.partitionBy("type").orderBy("id"))
    shown = found.withColumn("_place", place).where(F.col("_place") <= examples).groupBy("type").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    counts = found.groupBy("type").agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / F.lit(max(total, 1)))
    return counts.join(shown, "type")


def _verdict(rows: DataFrame, critical: tuple[str, ...]) -> DataFrame:
    """Adds verified and confidence (high without issues, low with a critical one, else medium)."""
    grave = F.exists("issues", lambda x: x.isin(*critical))
    return rows.withColumn("verified", F.size("issues") == 0).withColumn("confidence_level", F.when(F.col("verified"), "high").when(grave, "low").otherwise("medium"))


def verify_backtests(results: DataFrame) -> DataFrame:
    """Adds issues, verified and confidence_level to results (status, ic, icir, n_dates, long_short; a null is a missing field)."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    status = F.coalesce(F.col("status"), F.lit(""))
    missing = F.col("ic").isNull() | F.col("icir").isNull() | F.col("n_dates").isNull()
    found = issues(
        (status == "error", "error"), (status == "insufficient_data", "insufficient_data"), (~status.isin("", "ok", "error", "insufficient_data"), "unknown_status"), (missing & (status != "error"), "missing_fields"),
        (F.col("ic").isNotNull() & ~finite("ic"), "ic_not_finite"), (finite("ic") & (F.abs("ic") > 1), "ic_out_of_range"), (F.col("n_dates") < MIN_DATES, "too_few_dates"),
        (F.col("icir").isNotNull() & ~finite("icir"), "icir_not_finite"), (finite("icir") & (F.abs("icir") > 10), "icir_out_of_range"),
        (finite("ic") & finite("long_short") & (F.signum("ic") * F.signum("long_short") < 0), "sign_disagreement"),
    )
    return _verdict(results.withColumn("issues", found), ("error", "missing_fields", "ic_not_finite", "ic_out_of_range", "icir_not_finite", "sign_disagreement"))


def verify_factors(factors: DataFrame) -> DataFrame:
    """Adds issues, verified and confidence_level to factor records; records that are no factors pass."""
    name, formula = _text("factor_name"), _text("calculation_formula")
    found = issues(
        *[(_text(f) == "", f"missing:{f}") for f in REQUIRED_FIELDS],
        ((name != "") & F.lower(name).isin(*GENERIC_NAMES), "generic_name"), (F.length(name) == 1, "short_name"), ((formula != "") & _any_of(formula, VERIFIER_MARKS), "incomplete_formula"),
        ((formula == "") & (F.length(F.coalesce(F.col("definition"), F.lit(""))) > 0), "empty_formula"),
        ((_text("confidence") == HIGH) & (F.length(_text("paper_conclusion")) < SHORT_CONCLUSION), "overconfident"),
    )
    chosen = F.when(~F.coalesce("is_factor", F.lit(True)), F.array().cast("array<string>")).otherwise(found)
    return _verdict(factors.withColumn("issues", chosen), (*(f"missing:{f}" for f in REQUIRED_FIELDS), "generic_name", "short_name", "overconfident"))


def verify_papers(papers: DataFrame, shown: int = 5) -> DataFrame:
    """(batch, n_papers, verified, issues) of batches of papers (batch, place, title, summary): the first issues, by place in the batch."""
    numbered = papers.withColumn("_i", F.row_number().over(Window.partitionBy("batch").orderBy("place")) - 1)
    lacks = F.array_compact(F.array(F.when(_text("title") == "", F.lit("title")), F.when(_text("summary") == "", F.lit("summary"))))
    bad = numbered.select("batch", "_i", F.posexplode(lacks).alias("_k", "lack"))
    order = F.row_number().over(Window.partitionBy("batch").orderBy("_i", "_k"))
    first = bad.withColumn("_order", order).where(F.col("_order") <= shown)
    said = first.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", F.concat_ws(":", "_i", "lack").alias("issue")))), lambda x: x["issue"]).alias("issues"))
    found = papers.groupBy("batch").agg(F.count("*").alias("n_papers")).join(said, "batch", "left")
    return found.select("batch", "n_papers", F.col("issues").isNull().alias("verified"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def lineage_chain(factors: DataFrame, quality: DataFrame, backtests: DataFrame) -> DataFrame:
    """(factor_name, factor, quality, backtest): lineage structs of a factor and of the first quality and backtest record of its name.

    Each input has factor_name, place and a struct ``lineage``; a side without the name is null."""
    first = lambda t, to: t.groupBy("factor_name").agg(F.min_by("lineage", "place").alias(to))
    return factors.select("factor_name", F.col("lineage").alias("factor")).join(first(quality, "quality"), "factor_name", "left").join(first(backtests, "backtest"), "factor_name", "left")


# What each schema version adds to a state, as JSON.
STATE_DEFAULTS = {2: {"cost_summary": "{}", "cost_usages": "[]"}, 3: {"compaction_history": "[]", "memory_tiers": "{}", "retrieval_context": "null"}}
STATE_VERSION = 3


def migrate(state: Column) -> Column:
    """A state (a map of JSON texts) at the current version: older ones get the later versions' defaults for keys that they
    lack; newer ones stay as they are; one without a version is of the first."""
    version = F.coalesce(F.element_at(state, "schema_version").cast("int"), F.lit(1))
    added = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for number, defaults in STATE_DEFAULTS.items():
        own = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
        added = F.map_concat(added, F.when(version < number, own).otherwise(F.map_filter(own, lambda k, v: F.lit(False))))
    lacking = F.map_filter(added, lambda k, v: ~F.map_contains_key(state, k))
    kept = F.map_filter(state, lambda k, v: k != "schema_version")
    return F.when(version >= STATE_VERSION, state).otherwise(F.map_concat(kept, lacking, F.create_map(F.lit("schema_version"), F.lit(str(STATE_VERSION)))))
