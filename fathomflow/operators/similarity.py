"""Joins by the share of common tokens, with a prefix filter.

A pair counts if more than a share of the left row's tokens is in the right row. Of n left tokens, need = floor(share * n) + 1 must be common, so among
any n - need + 1 of them one is. A left row therefore looks up its n - need + 1 rarest tokens only; frequent ones never meet each other. Candidates are
verified on whole token sets. Rows with the same tokens are one until the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

THRESHOLD = 0.8


def words(text: Column) -> Column:
    """The distinct words of three letters, digits or underscores and more, in lower case and order; none of a null text."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\w{3,}"), F.lit(0)), F.array().cast("array<string>"))))


def _set_pairs(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left_tokens, right_tokens, overlap) of different token sets above the threshold, and the rows (id, tokens) of both sides."""
    a, b = (written(t.select(F.col("id"), words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0), "token-sets") for t in (left, right))
    sets_a, sets_b = (t.select("tokens").distinct() for t in (a, b))
    lists = written(sets_b.withColumn("right_set", F.xxhash64("tokens")).select("right_set", "tokens", F.explode("tokens").alias("token")), "token-lists")
    often = lists.groupBy("token").agg(F.count("*").alias("often"))
    parts = sets_a.withColumn("n", F.size("tokens")).select("tokens", "n", F.explode("tokens").alias("token")).join(often, "token", "left")
    rarest = F.row_number().over(Window.partitionBy("tokens").orderBy(F.col("often").asc_nulls_first(), "token"))
    looked_up = parts.withColumn("place", rarest).where((F.col("place") <= F.col("n") - F.floor(F.col("n") * threshold)) & F.col("often").isNotNull())
    met = looked_up.select(F.col("tokens").alias("left_tokens"), "token").join(lists.select("token", F.col("tokens").alias("right_tokens")), "token").select("left_tokens", "right_tokens").distinct()
    overlap = F.size(F.array_intersect("left_tokens", "right_tokens")) / F.size("left_tokens")
    return met.withColumn("overlap", overlap).where(F.col("overlap") > threshold), a, b


def token_overlaps(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(left_id, right_id, overlap) of rows (id, text) whose shared share of the left's tokens exceeds the threshold."""
    pairs, a, b = _set_pairs(left, right, threshold)
    named = pairs.join(a.select(F.col("id").alias("left_id"), F.col("tokens").alias("left_tokens")), "left_tokens")
    return named.join(b.select(F.col("id").alias("right_id"), F.col("tokens").alias("right_tokens")), "right_tokens").select("left_id", "right_id", "overlap")


def overlapping(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id) of the left rows that have such a right row. Copies are not paired: a left row meets the token sets that do overlap, not their rows."""
    pairs, a, _ = _set_pairs(left, right, threshold)
    return a.join(pairs.select(F.col("left_tokens").alias("tokens")).distinct(), "tokens", "left_semi").select("id")


def first_of_similar(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows (id, place, text) that one after another, by place, would be let in if each is held against those let in before it: a row stays out if one
    of them has more than the share of its tokens. Places are distinct. Each round settles all rows that wait for no undecided one, written between rounds."""
    by_id = rows.select("id", "place")
    pairs = token_overlaps(rows, rows, threshold).join(by_id.select(F.col("id").alias("left_id"), F.col("place").alias("own")), "left_id").join(by_id.select(F.col("id").alias("right_id"), "place"), "right_id")
    before = written(pairs.where("place < own").select(F.col("left_id").alias("id"), F.col("right_id").alias("earlier")), "similar-before")
    state = written(by_id.select("id", F.lit(None).cast("boolean").alias("kept")), "similar-state")
    while state.where("kept is null").limit(1).count():
        seen = before.join(state.select(F.col("id").alias("earlier"), F.col("kept").alias("before_kept")), "earlier")
        told = seen.groupBy("id").agg(F.coalesce(F.max("before_kept"), F.lit(False)).alias("held"), F.count_if(F.col("before_kept").isNull()).alias("waits"))
        decided = F.when(F.col("held"), F.lit(False)).when(F.coalesce("waits", F.lit(0)) == 0, F.lit(True))
        state = written(state.join(told, "id", "left").select("id", F.coalesce("kept", decided).alias("kept")), "similar-state")
    return rows.join(state.where("kept").select("id"), "id", "left_semi")
