"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the corpus's words in proportion to its weight, but at most ``max_repeats`` times
its own words; the excess is shared again by weight (water filling). A source that needs r times its words
takes each document floor(r) times for certain. For the fraction p that is left, a document's inclusion odds are p/(1-p)
times its size over the source's mean size, so that long documents, of which fewer fill a target, are likelier than short
ones; documents are ranked by random odds over inclusion odds, U/(1-U) over these, and taken in that order up to the
target, to the document whose middle the target does not pass, so a source misses its target by at most half a document.

U is a hash of the document, so reruns agree. Ranking a source never sorts it in one task: documents are
counted by bins of their rank, a window over the bins finds the bin that the target falls into, and the same
is done inside that bin; only the documents of that fine bin are sorted, for one cutoff a source. Decisions
follow from the cutoffs in place, so texts are never shuffled. Tables of one row a source are small beside the documents.

Defined results: a null text has size 0, and a document of size 0 is taken as often as its source's documents are for
certain; a null source is a source of its own, last in order, and the only one where there is no such column; sources
without words have target 0; rows with the same id, or null ids with the same text, are taken alike; columns of any name
are left as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
SEED = 11
#: Bins that a source is split into by rank, and each of these again.
BINS = 4096
#: Tables of one row a source are broadcast up to this many rows; beyond, they are joined by shuffle.
SMALL_ROWS = 50_000
_UNIT = float(1 << 52)

def words_of(text: Column) -> Column:
    """The number of words: runs of other than the six ASCII spaces."""
    single = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(single == "", F.lit(0)).otherwise(F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the seed and the document's id alone (on the text where the id is null)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _UNIT


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to one row a source (source, source_size). Weights repeat over sources by code point, null last.

    Sources that end at their cap are those with the least cap over weight; going through them in that order, the
    water level after k capped ones is what remains over the weights that remain."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    placed = totals.withColumn("place", place)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = capped.withColumn("level", level)
    # The first source in that order that stays below its cap gives the level; later ones have no meaning.
    below = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "place", "level"))
    water = F.min(below).over(everything)["level"]
    filled = F.least(F.col("cap"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight"))
    return leveled.withColumn("target", F.coalesce(filled, F.lit(0.0))).select("source", "source_size", "target")


def _hint(table: DataFrame) -> DataFrame:
    """Marks a written table of one row a source for broadcast, if it is small."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def _with_plan(rows: DataFrame, plan: DataFrame, suffix: str) -> DataFrame:
    """Left join of rows (mix_source) with a table of one row a source."""
    key = f"source_{suffix}"
    plan = _hint(plan).withColumnRenamed("source", key)
    return rows.join(plan, F.col("mix_source").eqNullSafe(F.col(key)), "left").drop(key)


def _crossing(ranked: DataFrame, key: str, quota: str) -> DataFrame:
    """Of each source, the bin where its quota is met, and the words of the bins before it."""
    bins = ranked.groupBy("mix_source", key).agg(F.sum("mix_size").alias("bin_size"), F.max(quota).alias("quota"))
    order = Window.partitionBy("mix_source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    found = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(order), F.lit(0)))
    met = found.where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("bin_size") >= F.col("quota")))
    return written(met.select(F.col("mix_source").alias("source"), F.col(key).alias(f"cut_{key}"), (F.col("quota") - F.col("before")).alias(f"{key}_quota")), "mixing-cuts")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan of each row's source, and where the row stands among its documents: odds over odds, mapped in
    order to (0, 1) and cut into bins."""
    joined = _with_plan(rows, plan, "plan")
    inclusion = F.col("mix_p") / (1 - F.col("mix_p")) * (F.col("mix_size") / F.col("mix_mean"))
    odds = F.when((F.col("mix_p") > 0) & (F.col("mix_size") > 0), F.col("mix_u") / (1 - F.col("mix_u")) / inclusion)
    ranked = joined.withColumn("mix_rank", odds / (1 + odds))
    return ranked.withColumn("mix_fine", F.floor(F.col("mix_rank") * (BINS * BINS))).withColumn("mix_bin", F.floor(F.col("mix_fine") / BINS))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(mix_id, mix_source, mix_size, mix_u) of documents (doc_id, text, perhaps source), and given columns."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("mix_id"), source.alias("mix_source"), words_of(F.col("text")).alias("mix_size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("mix_u"), *more)


def _decided(table: DataFrame, weights: tuple[float, ...], max_repeats: int):
    """A function that adds mix_source_size, mix_target and mix_copies to rows like those of the table, which holds all documents."""
    totals = table.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n"))
    means = totals.select(F.col("source").alias("mean_source"), (F.col("source_size") / F.col("n")).alias("mix_mean"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)  # a ratio within rounding of a whole number counts as whole
    targets = source_targets(totals.select("source", "source_size"), weights, max_repeats).join(means, F.col("source").eqNullSafe(F.col("mean_source")))
    planned = targets.select("source", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), whole.alias("mix_certain"), F.greatest(F.lit(0.0), ratio - whole).alias("mix_p"), "mix_mean")
    plan = written(planned, "mixing-plan")

    live = _ranked(table, plan).where("mix_rank is not null").withColumn("mix_quota", F.col("mix_p") * F.col("mix_source_size"))
    coarse = _crossing(live, "mix_bin", "mix_quota")
    inside = _with_plan(live, coarse, "coarse").where(F.col("mix_bin") == F.col("cut_mix_bin"))
    fine = _crossing(inside, "mix_fine", "mix_bin_quota")
    last = _with_plan(live, fine, "fine").where(F.col("mix_fine") == F.col("cut_mix_fine"))
    order = Window.partitionBy("mix_source").orderBy("mix_rank", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    taken = last.withColumn("reach", F.sum("mix_size").over(order) - F.col("mix_size") / 2.0).where(F.col("reach") <= F.col("mix_fine_quota"))
    cutoff = taken.groupBy(F.col("mix_source").alias("source")).agg(F.max(F.struct("mix_rank", "mix_id")).alias("mix_cutoff"))
    cuts = written(fine.join(cutoff, fine["source"].eqNullSafe(cutoff["source"]), "left").select(fine["source"], "cut_mix_fine", "mix_cutoff"), "mixing-cutoffs")

    def decide(rows: DataFrame) -> DataFrame:
        placed = _with_plan(_ranked(rows, plan), cuts, "cut")
        at_cut = (F.col("mix_fine") == F.col("cut_mix_fine")) & (F.struct(F.col("mix_rank"), F.col("mix_id")) <= F.col("mix_cutoff"))
        extra = F.coalesce((F.col("mix_fine") < F.col("cut_mix_fine")) | at_cut, F.lit(False)).cast("long")
        return placed.withColumn("mix_copies", F.least(F.coalesce(F.col("mix_certain"), F.lit(0)) + extra, F.lit(max_repeats)).cast("long"))

    return decide


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document. Texts are read once."""
    table = written(_sized(docs, seed), "mixing-sizes")
    placed = _decided(table, weights, max_repeats)(table)
    return placed.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    decide = _decided(written(_sized(docs, seed), "mixing-sizes"), weights, max_repeats)
    placed = decide(_sized(docs, seed, F.struct(*docs.columns).alias("doc"))).where("mix_copies > 0")
    return placed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("doc.*")
