"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct shingles of lower-cased (A-Z) words, as 64-bit hashes; its sketch is the k
least of them. Documents with equal sets form a class, and only classes go on:

1. Inverted lists. Two sets of similarity s share so many retained values that each of them has one of these
   among its rarest ones; so a class is listed under its rarest retained values only (all that a prefix
   bound asks for), and values that no other class retains cost nothing.
2. Stars. Each list pairs its classes with its most central one, whose retained values are the most widely
   shared. The union of two sketches estimates the similarity and drops hopeless pairs; the rest are verified
   on full sets. That joins groups of near copies with as many pairs as they have members.
3. Rest. Classes that are likely near one centre are a family. In a family, the classes that the centre's component did
   not take in are held against all members of other components, on full sets, in blocks of bounded size. Lists
   that hold several families are joined with themselves, between families and components only, and pairs that
   pass the estimate are verified. So no link between components is lost.

Components of the verified links give each document the least document id it can reach.

The sketches' bounds: for small sets (at most ``threshold`` * k shingles) the prefix bound is exact; for larger
ones, two sets at the threshold share under MIN_SHARED of K retained values with a probability of 3.4e-8 (binomial, K
trials at 0.8). The estimate asks for no more than that, so both together lose such a pair as rarely. Nothing else can
reject a pair. Estimates compare the upper halves of values, which can only raise them.

Defined results: documents without words (null or empty texts) are linked with nothing; a document with
fewer words than a shingle has its whole sequence as one; sets are equal if two 64-bit digests and their sizes are; rows with null ids are linked like others but are never a
component's id, and one row is kept of a component without any id; equal rows with ids share their results; other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import may_hold
from .graph import components
from .storage import bounded_batches, unused, written
from .textops import pair_hashes, span_hashes, text_chunks, word_spans
from .workers import tidy

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
#: Retained hash values of a sketch; retained values that two large sets at the threshold share at the least.
K = 48
MIN_SHARED = 22
#: Pairs whose estimated similarity is lower are not verified.
MIN_ESTIMATE = MIN_SHARED / K
#: Members of a star that one block compares with its centre; shingles of left-over and other classes of a family in one block.
STAR_CHUNK = 512
LEFT_SHINGLES = 1 << 18
FAMILY_SHINGLES = 1 << 20


def shingle_sets(chunk, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a chunk."""
    starts, ends, first = word_spans(chunk)
    words = span_hashes(chunk.data, starts, ends)
    rolled = words
    for i in range(1, width):
        rolled = pair_hashes(rolled[: max(0, len(words) - i)], words[i:])
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= width:
            yield np.unique(rolled[a : b - width + 1].view(np.int64))
        elif n:
            whole = words[a : a + 1]
            for i in range(a + 1, b):
                whole = pair_hashes(whole, words[i : i + 1])
            yield pair_hashes(whole, np.array([n], np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set: sums and mixed sums of its hashes."""
    with np.errstate(over="ignore"):
        raw = values.view(np.uint64)
        low = np.uint64(len(values)) * np.uint64(0x9E3779B97F4A7C15) + raw.sum(dtype=np.uint64)
        high = ((raw ^ (raw >> np.uint64(31))) * (raw | np.uint64(1))).sum(dtype=np.uint64)
    return int(low.view(np.int64)), int(high.view(np.int64))


def _key() -> Column:
    """What a row's text is read again by: its id or, without one, the text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _sketch(width: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                sizes, low, high, sketches = [], [], [], []
                for values in shingle_sets(chunk, width):
                    sizes.append(len(values))
                    a, b = _digest(values)
                    low.append(a)
                    high.append(b)
                    sketches.append(values[:K])
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
                ids, keys = (batch.column(c).slice(chunk.lo, chunk.hi - chunk.lo) for c in ("doc_id", "key"))
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketches)))],
                    names=["doc_id", "key", "n", "digest", "check", "sketch"],
                )

    return run


def sketches(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, n, digest, check, sketch): the set's size, its digests and its k least hashes."""
    return docs.select("doc_id", _key().alias("key"), "text").mapInArrow(_sketch(width), "doc_id long, key long, n long, digest long, check long, sketch array<long>")


def _listed(n: Column) -> Column:
    """How many of its rarest retained values list a class of n shingles."""
    exact = n - F.ceil(n * (THRESHOLD_PERCENT / 100)) + 1
    return F.when(n <= int(K * THRESHOLD_PERCENT / 100), exact).otherwise(F.least(n, F.lit(K)) - MIN_SHARED + 1)


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, cid, n, support): classes under those of their rarest retained values that another class lists too.
    Support is how widely the class's retained values are shared."""
    entries = classes.select("cid", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    found = entries.join(shared, "value").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"), F.sum("df").alias("support"))
    alone = F.least(F.col("n"), F.lit(K)) - F.size("values")
    wanted = F.greatest(F.lit(0), _listed(F.col("n")) - alone).cast("int")
    return found.select("cid", "n", "support", F.explode(F.slice("values", F.lit(1), wanted)).alias("entry")).select(F.col("entry.value").alias("value"), "cid", "n", "support")


def _near_sizes(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= THRESHOLD_PERCENT * F.greatest(n, m)


def _estimate(a: Column, b: Column) -> Column:
    """The similarity of two sets by the k least values of their sketches' union."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those whose sizes and sketches allow a link."""
    a = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("upper").alias("upper_a"))
    b = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("upper").alias("upper_b"))
    return pairs.join(a, "a").join(b, "b").where(_near_sizes(F.col("n_a"), F.col("n_b"))).where(_estimate(F.col("upper_a"), F.col("upper_b")) >= MIN_ESTIMATE).select("a", "b")


def _full_sets(width: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                sets = list(shingle_sets(chunk, width))
                found = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                same = (found[:, 0] == part.column("digest").to_numpy()) & (found[:, 1] == part.column("check").to_numpy())
                rows = pa.RecordBatch.from_arrays([part.column("places"), part.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["places", "cid", "values"])
                yield rows.filter(pa.array(same))

    return run


def _sets_in_places(places: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Full sets of classes at their places: (cid, place) becomes the place's fields, cid and values, dealt by the place's
    ``centre``, ``row`` and ``col`` and sorted there. Texts of the named classes are read once; a Bloom filter keeps
    the others out of the shuffle."""
    named = written(places.join(classes.select("cid", "key", "digest", "check"), "cid"), "set-places")
    ids = named.select(F.col("key").alias("id")).distinct()
    count = ids.count()
    keyed = docs.select("doc_id", _key().alias("key"), "text")
    # Copies without an id have one key, so one of them is enough.
    lone = may_hold(keyed.where("doc_id is null").select("key", "text"), "key", ids, count).dropDuplicates(["key"])
    wanted = may_hold(keyed.where("doc_id is not null").select("key", "text"), "key", ids, count).unionByName(lone)
    per_class = named.groupBy("key", "cid", "digest", "check").agg(F.collect_list("place").alias("places"))
    schema = T.StructType([T.StructField("places", per_class.schema["places"].dataType), T.StructField("cid", T.LongType()), T.StructField("values", T.BinaryType())])
    sets = wanted.join(per_class, "key").mapInArrow(_full_sets(width), schema)
    dealt = sets.select(F.explode("places").alias("place"), "cid", "values").select("place.*", "cid", "values")
    return dealt.repartition("centre", "row", "col").sortWithinPartitions("centre", "row", "col", "second", "cid")


_LINKS = "u long, v long, shared long"


def _links(u: list[int], v: list[int], shared: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, shared)], names=["u", "v", "shared"])


@tidy
def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each star's centre, which comes first, with the members behind it."""
    centre, values = None, np.zeros(0, np.int64)
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for star, row, second, cid, raw in zip(*(batch.column(c).to_pylist() for c in ("centre", "row", "second", "cid", "values")), strict=True):
            own = np.frombuffer(raw, np.int64)
            if not second:
                centre, values = (star, row), own
            elif (star, row) == centre:
                common = len(np.intersect1d(values, own, assume_unique=True))
                if 100 * common >= THRESHOLD_PERCENT * (len(values) + len(own) - common):
                    for column, x in zip(out, (star, cid, common), strict=True):
                        column.append(x)
        yield _links(*out)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(u, v, shared): the pairs (a, b) whose full sets reach the threshold. Centres with many members are copied to several blocks."""
    pairs = written(pairs, "candidate-pairs")
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_CHUNK).cast("int").alias("chunks"))
    place = lambda centre, row, second: F.struct(F.col(centre).alias("centre"), row.cast("int").alias("row"), F.lit(0).alias("col"), F.lit(second).alias("second")).alias("place")
    members = pairs.join(stars, "a").select(F.col("b").alias("cid"), place("a", F.pmod(F.xxhash64("b"), F.col("chunks")), 1))
    centres = stars.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(F.col("a").alias("cid"), place("a", F.col("chunk"), 0))
    return _sets_in_places(members.unionByName(centres), classes, docs, width).mapInArrow(_compare, _LINKS).distinct()


def _block_links(members: list[tuple[int, int, np.ndarray]], left: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Links between left-over classes and members, given as (cid, root, set), of different roots: shared values are counted
    through the members' values in order."""
    sizes = np.array([len(m[2]) for m in members])
    values = np.concatenate([m[2] for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cids, roots = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    out: tuple[list, list, list] = ([], [], [])
    for cid, root, own in left:
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
        counts = hi - lo
        at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[at], minlength=len(members))
        for i in np.flatnonzero((100 * shared >= THRESHOLD_PERCENT * (sizes + len(own) - shared)) & (roots != root)):
            for column, x in zip(out, (cid, int(cids[i]), int(shared[i])), strict=True):
                column.append(x)
    return _links(*out)


@tidy
def _compare_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, its members first: links of the left-over classes with them."""
    block, members, left = None, [], []
    for batch in batches:
        for centre, row, col, second, root, cid, raw in zip(*(batch.column(c).to_pylist() for c in ("centre", "row", "col", "second", "root", "cid", "values")), strict=True):
            if (centre, row, col) != block:
                if members and left:
                    yield _block_links(members, left)
                block, members, left = (centre, row, col), [], []
            (left if second else members).append((cid, root, np.frombuffer(raw, np.int64)))
    if members and left:
        yield _block_links(members, left)


def families(lists: DataFrame, likely: DataFrame) -> DataFrame:
    """(cid, n, centre): the most central class that a class is likely near (a and b of likely pairs), and the centre of that,
    as far as three steps lead; a class that is near none is its own centre."""
    supports = lists.select(F.col("cid").alias("a"), "support").distinct()
    best = likely.join(supports, "a").groupBy("b").agg(F.max(F.struct("support", "a")).alias("best")).select(F.col("b").alias("cid"), F.col("best.a").alias("centre"))
    own = written(lists.select("cid", "n").distinct().join(best, "cid", "left").select("cid", "n", F.coalesce("centre", "cid").alias("centre")), "centres")
    for _ in range(2):
        further = own.select(F.col("cid").alias("centre"), F.col("centre").alias("further"))
        own = written(own.join(further, "centre").select("cid", "n", F.col("further").alias("centre")), "centres")
    return own


def _left_over_links(placed: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links inside of families (cid, n, centre, root) between left-over classes and members of other components."""
    main = placed.where("cid = centre").select("centre", F.col("root").alias("main"))
    known = placed.join(main, "centre", "left").withColumn("left_over", F.coalesce(F.col("root") != F.col("main"), F.lit(True)))
    left_size = F.sum(F.when(F.col("left_over"), F.col("n")).otherwise(0))
    counts = known.groupBy("centre").agg(F.ceil(left_size / LEFT_SHINGLES).cast("int").alias("rows"), F.ceil(F.sum("n") / FAMILY_SHINGLES).cast("int").alias("cols")).where("rows > 0")
    open_rows = written(known.join(counts, "centre"), "families")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda second: F.struct("centre", F.col("row"), F.col("col"), F.lit(second).alias("second"), "root").alias("place")
    members = open_rows.withColumn("col", F.pmod(F.xxhash64("cid"), F.col("cols")).cast("int")).withColumn("row", spread("rows")).select("cid", place(0))
    left = open_rows.where("left_over").withColumn("row", F.pmod(F.xxhash64("cid"), F.col("rows")).cast("int")).withColumn("col", spread("cols")).select("cid", place(1))
    return _sets_in_places(members.unionByName(left), classes, docs, width).mapInArrow(_compare_blocks, _LINKS)


def link_classes(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, root) of the classes that have a link."""
    lists = written(inverted_lists(classes), "inverted-lists")
    best = lists.groupBy("value").agg(F.max(F.struct("support", "cid")).alias("best"), F.count("*").alias("n")).where("n > 1").select("value", F.col("best.cid").alias("a"))
    stars = written(lists.join(best, "value").where("cid <> a").select("a", F.col("cid").alias("b")).distinct(), "star-pairs")
    likely = written(_likely(stars, classes), "likely-pairs")
    links = written(verified(likely, classes, docs, width), "star-links")
    joined = written(components(links), "star-components")

    centres = families(lists, likely)
    placed = written(centres.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "placed-classes")
    inside = written(_left_over_links(placed, classes, docs, width), "family-links")

    listed = lists.select("value", "cid").join(placed, "cid")
    # The star of a list of two has tested its only pair.
    mixed = listed.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s"), F.min("centre").alias("c"), F.max("centre").alias("d")).where("n > 2 and r < s and c < d").select("value")
    open_rows = written(listed.join(mixed, "value").join(classes.select("cid", "upper"), "cid"), "open-lists")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    between = (F.col("x.value") == F.col("y.value")) & (F.col("x.centre") < F.col("y.centre")) & (F.col("x.root") != F.col("y.root")) & _near_sizes(F.col("x.n"), F.col("y.n")) & (_estimate(F.col("x.upper"), F.col("y.upper")) >= MIN_ESTIMATE)
    rest = x.join(y, between).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    across = verified(rest, classes, docs, width)
    return components(links.unionByName(inside).unionByName(across).select("u", "v"))


def _judged(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    table = written(sketches(docs, width).withColumn("row", F.monotonically_increasing_id()), "sketches")
    worded = table.where("n > 0")
    key = F.coalesce(F.min("doc_id"), F.min("key")).alias("key")
    grouped = worded.groupBy("digest", "check", "n").agg(F.min("doc_id").alias("doc_id"), key, F.min("row").alias("cid"), F.first("sketch").alias("sketch"))
    classes = written(grouped.withColumn("upper", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))), "classes")
    roots = link_classes(classes, docs, width)
    joined = classes.select("cid", "doc_id", "digest", "check", "n").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("cid").alias("first_row"))
    by_class = written(joined.join(smallest, "root").select("digest", "check", "n", "component_id", "first_row"), "class-components")
    found = table.select("doc_id", "key", "row", "n", "digest", "check").join(by_class, ["digest", "check", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = found.select("doc_id", "key", "row", "first_row", F.col("n").alias("n_shingles"), component.alias("component_id"))
    without_id = F.col("component_id").isNull() & F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), without_id)).drop("row", "first_row")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    return _judged(docs, width).drop("key")


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component, with all its columns; of rows that share an id and a text, one. Rows without an id
    are decided by their texts; those without words all stay.

    Only rows that a Bloom filter cannot clear of being dropped or repeated are shuffled."""
    found = written(_judged(docs, width).select("doc_id", "key", "n_shingles", "kept"), "near-duplicates").where("doc_id is not null or n_shingles > 0")
    counted = found.groupBy(F.col("doc_id").isNull().alias("lone"), "key").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    named = written(counted.where("rows > 1 or not kept").select(F.col("key").alias("id"), "lone", "kept"), "dropped-ids")
    count = named.count()
    own = unused(docs.columns, "dedup_key")
    keyed = docs.withColumn(own, _key())
    rest = may_hold(keyed, own, named, count, invert=True)
    asked = may_hold(keyed, own, named, count)
    same = lambda rows, ids: (rows[own] == ids["id"]) & (rows["doc_id"].isNull() == ids["lone"])
    dropped = named.where(~F.col("kept"))
    kept = asked.join(dropped, same(asked, dropped), "left_anti")
    repeated = named.where("kept")
    once = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    others = kept.join(repeated, same(kept, repeated), "left_anti")
    return rest.unionByName(others).unionByName(once).select(*docs.columns)
