"""Source divergence audit: how far the terms of each source of a language lie from those of the other sources, and which terms stand out.

A term is a run of ASCII letters and other than ASCII characters, A-Z lower-cased. A language keeps the terms of at least MIN_DOCUMENTS
of its documents, V of them. With count occurrences in a group (a source of the language, or all of it) and N of all
kept terms there, p = 1 + floor(SCALE * (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q).

- Ranking: f of a group's terms against the language, largest first, by radix selection (``radix.top_k``).
- Divergence: the sum of f over all kept terms for every ordered pair of sources. Most terms are missing from most sources, so a
  pair starts from its baseline, all V terms missing from both, and is corrected by what differs: by the counts that occur in
  either source, of which there are few distinct ones, and by the terms that occur in both. Pairs are summed in blocks of
  BLOCK x BLOCK sources and about BUCKET terms, into one number a pair, before they are shuffled.

Tasks count terms of their documents in Arrow and hand on sums; languages, sources and terms may be as hot as they like. All arithmetic is exact:
p and f stay below 1e18 + 1, and a sum over a language's terms below about 1e18, for the p of a group add up to SCALE + V at most.

Defined results: null text, lang and source are empty strings, which are a language and a source like others; rows that share an id are
documents of their own; a language without kept terms has pairs of value 0; a language with one source has no pairs; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import radix
from .storage import bounded_batches, broadcast_if_small, written
from .textops import FOLD, text_chunks
from .workers import tidy

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Sources of a block of pairs, and terms of a bucket.
BLOCK, BUCKET = 128, 2048
#: Rows of counts that a task holds before it sums them up, and pairs of entries that a block looks at together.
HELD_ROWS, TOGETHER = 400_000, 1 << 20

#: A-Z in lower case, and a space for every other ASCII character that is no letter.
_LETTERS = np.where((np.arange(256) < 128) & ~np.isin(FOLD, np.arange(97, 123)), 32, FOLD).astype(np.uint8)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a chunk of texts, and the text of each."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LETTERS[data]))
    parts = pc.split_pattern(texts, " ")
    flat, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    return pc.dictionary_encode(flat.filter(some)), rows.filter(some).to_numpy()


def _counted(held_rows: int):
    """A function that gives (lang, source, term, n, docs) of a task's documents, summed as far as so many rows allow."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return found.rename_columns(["group", "term", "n", "docs"])

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            langs, sources = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
            for batch in table.combine_chunks().to_batches(max_chunksize=50_000):
                group = batch.column("group")
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), batch.column("term").cast(pa.string()), batch.column("n"), batch.column("docs")], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.array([groups.setdefault(key, len(groups)) for key in keys], np.int64)
            for chunk in text_chunks(batch.column("text")):
                terms, rows = _terms(chunk.data, chunk.offsets)
                width = max(1, len(terms.dictionary))
                pairs, n = np.unique(rows * width + terms.indices.to_numpy().astype(np.int64), return_counts=True)
                places, at = np.unique(group[chunk.lo + pairs // width] * width + pairs % width, return_inverse=True)
                total = np.zeros(len(places), np.int64)
                np.add.at(total, at, n)
                held.append(pa.table({"group": places // width, "term": terms.dictionary.take(pa.array(places % width)), "n": total, "docs": np.bincount(at, minlength=len(places))}))
            if sum(map(len, held)) > held_rows:
                held = [summed()]
                if len(held[0]) > held_rows // 2:
                    yield from told(held[0])
                    held = []
        if held:
            yield from told(summed())

    return run


def term_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of kept terms in the sources where they occur, as a written table; ``first`` marks one row a term of a language."""
    bounded_batches(docs.sparkSession)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # Tasks have summed already, so terms are dealt once, and all that is asked of a term stands where it is.
    counts = given.mapInArrow(_counted(HELD_ROWS), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    sums = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    spread = sums.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.col("source") == F.min("source").over(term)})
    return written(spread.where(F.col("in_docs") >= min_documents).select("lang", "source", "term", "n", "lang_n", "first"), "term-counts")


def _totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, place, sources, total, lang_total, kept) of each group: its place among the language's sources, their number, N of both and V."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kept"))
    lang = Window.partitionBy("lang")
    placed = groups.withColumns({"place": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)})
    return written(placed.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"]), "source-totals")


def _p(n: Column, total: Column, kept: Column) -> Column:
    """p of n occurrences; 1 where the language keeps no term."""
    share = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)"))
    return F.when(kept > 0, share + 1).otherwise(1).cast("long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _baselines(rows: pa.Table, crossing: bool, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and their sums with terms that occur in one of them at most: V times the baseline, and counts that occur in either."""
    place, p, p0, m, kept = (rows.column(c).to_numpy() for c in ("place", "p", "p0", "m", "kept"))
    order = np.argsort(place, kind="stable")
    place, p, p0, m = place[order], p[order], p0[order], m[order]
    ids, begins = np.unique(place, return_index=True)
    none = p0[begins]
    total = kept[0] * _f(none[:, None], none[None, :])
    for x in range(len(ids)):
        total[:, x] += np.add.reduceat(m * (_f(p, none[x]) - _f(p0, none[x])), begins)
        total[x, :] += np.add.reduceat(m * (_f(none[x], p) - _f(none[x], p0)), begins)
    block = ids // size
    asked = block[:, None] != block[None, :] if crossing else ids[:, None] != ids[None, :]
    a, b = np.nonzero(asked)
    return ids[a], ids[b], total[a, b]


def _corrections(rows: pa.Table, crossing: bool, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that share terms of the bucket, and what their baselines lack for these."""
    term = pc.dictionary_encode(rows.column("term").combine_chunks()).indices.to_numpy()
    order = np.argsort(term, kind="stable")
    place, p, p0 = (rows.column(c).to_numpy()[order] for c in ("place", "p", "p0"))
    ids, at = np.unique(place, return_inverse=True)
    begins = np.flatnonzero(np.diff(term[order], prepend=-1))
    sizes = np.diff(begins, append=len(order))
    total = np.zeros((len(ids), len(ids)), np.int64)
    squares = np.cumsum(sizes.astype(np.int64) ** 2)
    lo = 0
    while lo < len(sizes):
        done = squares[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(squares, done + TOGETHER, side="right")))
        own = np.repeat(sizes[lo:hi], sizes[lo:hi])
        left = np.repeat(np.arange(begins[lo], begins[lo] + len(own)), own)
        within = np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        right = np.repeat(np.repeat(begins[lo:hi], sizes[lo:hi]), own) + within
        apart = place[left] // size != place[right] // size if crossing else left != right
        left, right = left[apart], right[apart]
        more = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
        np.add.at(total, (at[left], at[right]), more)
        lo = hi
    a, b = np.nonzero(total)
    return ids[a], ids[b], total[a, b]


def _summed_pairs(size: int):
    """A function that gives (lang, a, b, value) of the pairs of two blocks of so many sources, or of one with itself: their baselines, or what a bucket of terms adds."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lang, one, other, bucket = (x.as_py() for x in key)
        a, b, value = (_baselines if bucket < 0 else _corrections)(rows, one != other, size)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64())})

    return run


def _pairs(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    sized = totals.withColumn("p0", _p(F.lit(0), F.col("total"), F.col("kept")))
    cells = counts.join(broadcast_if_small(sized), ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("kept")))
    fields = ["lang", "place", "sources", "kept", "p0"]
    none = F.lit(None).cast("string").alias("term")
    whole = F.lit(-1).cast("long").alias("bucket")
    empty = sized.select(*fields, F.col("p0").alias("p"), F.lit(0).cast("long").alias("m"), none, whole)
    often = cells.groupBy(*fields, "p").agg(F.count("*").alias("m")).select(*fields, "p", "m", none, whole)
    shared = cells.select(*fields, "p", F.lit(1).cast("long").alias("m"), "term", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / BUCKET)).alias("bucket"))
    own = F.floor(F.col("place") / BLOCK)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / BLOCK))).alias("with")
    dealt = empty.unionByName(often).unionByName(shared).select("*", own.alias("own"), blocks)
    dealt = dealt.select("lang", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "bucket", "place", "p0", "p", "m", "kept", "term")
    sums = dealt.groupBy("lang", "one", "other", "bucket").applyInArrow(_summed_pairs(BLOCK), "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = broadcast_if_small(totals.select("lang", "place", "source"))
    named = sums.join(names.withColumnRenamed("place", "a"), ["lang", "a"])
    return named.join(names.withColumnRenamed("place", "b").withColumnRenamed("source", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def _standing_out(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, term, value) of terms likelier in a source than in its language, as a written table."""
    cells = counts.join(broadcast_if_small(totals), ["lang", "source"])
    p, q = _p(F.col("n"), F.col("total"), F.col("kept")), _p(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    apart = cells.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    return written(apart.select("lang", "source", "term", F.expr("(p - q) * (p - q) div q").alias("value")), "term-values")


def audit(docs: DataFrame, top_terms: int = TOP_TERMS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by divergence, part ``term`` the top terms."""
    counts = term_counts(docs, min_documents)
    totals = _totals(docs, counts)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = _pairs(counts, totals).withColumn("rank", rank)
    terms = radix.top_k(_standing_out(counts, totals), ["lang", "source"], "value", "term", top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
