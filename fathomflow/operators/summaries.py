"""Summaries of record stores in whole: products, bad cases, dashboards, abstracts, weights and compacted conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities in order, words that an abstract follows, ends of a sentence in the order in which they are looked for, marks around words.
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
ABSTRACT_MARKERS = ("abstract", "summary", "overview", "introduction")
SENTENCE_ENDS = ("。", ". ", ".\n", "!", "?", "\n")
PUNCTUATION = "，。、！？,.!?;:\"'()（）[]【】"
#: Turns that a compacted conversation keeps as they are.
RECENT = 6
TOP_TYPES, EXAMPLES = 5, 3


def product_summary(records: DataFrame) -> DataFrame:
    """(field, value, n, mean) of records (status, confidence, compute_source, ic; nulls are missing): counts by each of the first three with their
    defaults, all records, those with a result, and the mean absolute coefficient, 0 without any. One pass."""
    defaults = {"status": "pending", "confidence": "中", "compute_source": "none"}
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if c == "compute_source" else F.col(c), F.lit(d)) for c, d in defaults.items()}
    entry = lambda field, value, size=None: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.coalesce(size, F.lit(None).cast("double")).alias("size") if size is not None else F.lit(None).cast("double").alias("size"))
    none = F.lit(None)
    has = F.col("ic").isNotNull()
    each = records.select(F.explode(F.array(*[entry(c, v) for c, v in filled.items()], entry("total", none), F.when(has, entry("with_backtest", none)), F.when(has, entry("avg_abs_ic", none, F.abs("ic").cast("double"))))).alias("x")).where("x is not null")
    counted = each.groupBy("x.field", "x.value").agg(F.count("*").alias("n"), F.avg("x.size").alias("mean"))
    # The three whole figures are there without any record, too.
    whole = records.sparkSession.createDataFrame([(f, None) for f in ("total", "with_backtest", "avg_abs_ic")], "field string, value string")
    found = whole.join(counted.where("value is null").drop("value"), "field", "left").select("field", "value", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("field") == "avg_abs_ic", F.round(F.coalesce("mean", F.lit(0.0)), 4)).alias("mean"))
    return counted.where("value is not null").select("field", "value", "n", F.lit(None).cast("double").alias("mean")).unionByName(found)


def issue_sections(found: DataFrame, records: DataFrame) -> DataFrame:
    """(section, place, key, n, share, examples) of issues (session_id, type, severity) among records (session_id): totals, severities (none is
    missing), types by frequency, and the first sessions of the most frequent types."""
    totals = found.agg(F.count("*").alias("issues"), F.count_distinct("session_id").alias("bad")).join(F.broadcast(records.agg(F.count("*").alias("records"), F.count_distinct("session_id").alias("sessions"))))
    rate = F.coalesce(F.try_divide(F.col("issues"), F.col("records")), F.lit(0.0))
    row = lambda place, key, n, share=None: F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), n.alias("n"), (F.lit(None).cast("double") if share is None else share).alias("share"))
    overview = totals.select(F.explode(F.array(row(1, "sessions", F.col("sessions")), row(2, "records", F.col("records")), row(3, "issues", F.col("issues"), rate), row(4, "sessions with issues", F.col("bad")))).alias("x")).select(F.lit("overview").alias("section"), "x.*", F.array().cast("array<string>").alias("examples"))
    all_issues = F.broadcast(totals.select("issues"))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("issues")), F.lit(0.0)).alias("share")
    known = found.sparkSession.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES, 1)], "place int, key string")
    grave = known.join(found.groupBy(F.col("severity").alias("key")).agg(F.count("*").alias("n")), "key", "left").join(all_issues).select(F.lit("severity").alias("section"), "place", "key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("issues")), F.lit(0.0)).alias("share"), F.array().cast("array<string>").alias("examples"))
    by_type = found.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n"))
    placed = by_type.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "key"))).join(all_issues).select(F.lit("type").alias("section"), "place", "key", "n", share, F.array().cast("array<string>").alias("examples"))
    shown = found.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy("session_id"))).where(F.col("_r") <= EXAMPLES).groupBy(F.col("type").alias("key")).agg(F.sort_array(F.collect_list(F.col("session_id").cast("string"))).alias("first"))
    top = placed.where(F.col("place") <= TOP_TYPES).join(shown, "key").select(F.lit("top").alias("section"), "place", "key", "n", "share", F.col("first").alias("examples"))
    return overview.unionByName(grave).unionByName(placed).unionByName(top)


def dashboard(factors: DataFrame, runs: DataFrame, recent: int = 5) -> DataFrame:
    """(key, run_id, value): the largest absolute ic and icir of factors (ic, icir), the number of runs (run_id, ic; a row a factor), and the mean ic of the
    newest runs."""
    best = factors.agg(*[F.round(F.coalesce(F.max(F.abs(c)), F.lit(0.0)), 4).alias(f"best_{c}") for c in ("ic", "icir")])
    shown = best.select(F.explode(F.create_map(F.lit("best_ic"), F.col("best_ic"), F.lit("best_icir"), F.col("best_icir"))).alias("key", "value"))
    means = runs.groupBy("run_id").agg(F.round(F.avg(F.coalesce("ic", F.lit(0.0))), 4).alias("value"))
    newest = means.orderBy(F.desc("run_id")).limit(recent).select(F.lit("recent_mean_ic").alias("key"), F.col("run_id").cast("string").alias("run_id"), "value")
    none = F.lit(None).cast("string").alias("run_id")
    return newest.unionByName(shown.select("key", none, "value")).unionByName(means.agg(F.count("*").cast("double").alias("value")).select(F.lit("total_runs").alias("key"), none, "value"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def abstract(text: Column, most: int = 1500, least: int = 50) -> Column:
    """The paragraph behind the first marker word that is followed by one of more than ``least`` characters, else the text's beginning; cut at ``most``."""
    lower = F.lower(text)
    found = []
    for marker in ABSTRACT_MARKERS:
        at = F.instr(lower, marker)
        rest = F.substring(text, at + len(marker), F.length(text))
        part = F.substring(_stripped(F.substring_index(rest, "\n\n", 1)), 1, most)
        found.append(F.when((at > 0) & (F.length(part) > least), part))
    return F.coalesce(*found, _stripped(F.substring(text, 1, most)))


def weights_history(weights: DataFrame) -> DataFrame:
    """(date, code, weight) of rebalance dates: the weights that are not zero, to six digits."""
    return weights.where(F.col("code").isNotNull() & (F.col("weight") != 0)).select("date", "code", F.round("weight", 6).alias("weight"))


def first_sentence(text: Column) -> Column:
    """Up to the first end of a sentence that does not stand at the beginning, ends being tried in order, else 100 characters."""
    whole = _stripped(text)
    ends = [F.when(F.instr(whole, end) > 1, F.substring(whole, F.lit(1), F.instr(whole, end))) for end in SENTENCE_ENDS]
    return F.coalesce(*ends, F.substring(whole, 1, 100))


def _keywords(turns: DataFrame, shown: int = 5) -> DataFrame:
    """(conv_id, keywords): words of two characters or more that occur twice or more, most frequent first, then as they come."""
    words = turns.select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("at", "word")).withColumn("word", F.trim(F.col("word"), F.lit(PUNCTUATION))).where(F.length("word") >= 2)
    counts = words.groupBy("conv_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("turn", "at")).alias("first")).where("n >= 2")
    placed = counts.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "first"))).where(F.col("r") <= shown)
    return placed.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ", ").alias("keywords"))


def compacted(turns: DataFrame, keep: int = RECENT) -> DataFrame:
    """(conv_id, turn, role, text) of conversations (conv_id, turn, role, text): a summary (turn null) and the last turns as they are.

    The summary has the first sentences of the first and last turn, of the first two user turns between, and the most frequent words."""
    conversation = Window.partitionBy("conv_id")
    placed = turns.withColumns({"i": F.row_number().over(conversation.orderBy("turn")), "n": F.count("*").over(conversation), "text": F.coalesce("text", F.lit(""))})
    inner = (F.col("role") == "user") & (F.col("i") > 1) & (F.col("i") < F.col("n"))
    ranked = placed.withColumn("u", F.sum(F.when(inner, 1).otherwise(0)).over(conversation.orderBy("turn")))
    sentence = first_sentence(F.col("text"))
    some = F.length(F.col("text")) > 0
    said = lambda fits, label, most: F.max(F.when(fits & some & (F.length(sentence) > 0), F.concat(F.lit(label), F.substring(sentence, 1, most))))
    parts = ranked.groupBy("conv_id").agg(
        said(F.col("i") == 1, "开场: ", 80).alias("a"), said((F.col("i") == F.col("n")) & (F.col("n") > 1), "最近: ", 80).alias("b"), said(inner & (F.col("u") == 1), "用户: ", 60).alias("c"), said(inner & (F.col("u") == 2), "用户: ", 60).alias("d")
    )
    joined = parts.join(_keywords(placed), "conv_id", "left")
    summary = F.concat_ws(" | ", "a", "b", "c", "d", F.concat(F.lit("关键词: "), F.col("keywords")))
    head = joined.select("conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("summary").alias("role"), F.when(summary == "", "[history compacted]").otherwise(summary).alias("text"))
    return head.unionByName(placed.where(F.col("i") > F.col("n") - keep).select("conv_id", "turn", "role", "text"))
