"""Exact duplicates by two passes with a Bloom filter of bounded size, in DataFrame expressions alone.

A text is its SHA-256 after lower-casing A-Z. The first pass sets bits of a filter whose words have 64 bits: a text has one word
and BITS_A_TEXT bits in it, and only bits that two rows or more have set are kept. The second pass holds every row against
the filter: a row whose bits are not all there is the only one of its text and passes straight through; the others, which may
have an equal, are the only ones that are shuffled, and the exact count decides on them. So the filter may be wrong in one
direction only, and past its bound more rows are shuffled, with the same result.

Groups that hold a 1/HOT_GROUPS part of all rows or more number HOT_GROUPS at most and are broadcast, so no group's rows meet
in one task; counts and largest ids are pre-aggregated before their shuffle. Texts are read once for the report, and never
shuffled there; ``keep_last`` shuffles only documents that may have an equal.

Defined results: a null text equals an empty one; of equal texts the row with the largest doc_id stays, a null id being
less than any other, and of rows that share that id too, one; keep_id is null where no row of the group has an id; columns of any
name are left as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS_A_TEXT = 2
#: Bits of the filter for each row: of rows without an equal, about one in 200 passes for one that may have some.
BITS_PER_ROW = 32
#: The filter never exceeds this many bits, 2^24 words of 16 bytes; only words with a bit set twice are kept.
MAX_BITS = 1 << 30
#: At most this many groups can hold as large a part of all rows; they are broadcast.
HOT_GROUPS = 10_000


def folded(text: Column) -> Column:
    """The text with A-Z alone in lower case, null as empty: ASCII texts have a short way."""
    given = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(given) == F.char_length(given), F.lower(given)).otherwise(F.translate(given, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """What equal texts share: 32 bytes."""
    return F.unhex(F.sha2(folded(text), 256))


def _word(key: Column, words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(words - 1)


def _bits(key: Column) -> list[Column]:
    """Places in a word, by six bits each of one hash."""
    hashed = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(63).cast("int") for i in range(BITS_A_TEXT)]


def _mask(key: Column) -> Column:
    found = F.lit(0).cast("long")
    for bit in _bits(key):
        found = found.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return found


def repeat_filter(keys: DataFrame, rows: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """(word, mask) of the bits that two rows of ``keys`` (key binary) or more have set, and the number of words there could be."""
    words = 1 << max(4, min(max_bits, rows * BITS_PER_ROW).bit_length() - 6)
    key = F.col("key")
    bits = F.array_distinct(F.array(*_bits(key)))
    set_bits = keys.select(F.explode(F.transform(bits, lambda bit: F.shiftleft(_word(key, words), 6) + bit)).alias("at"))
    twice = set_bits.groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    return written(twice.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("mask")), "repeat-filter"), words


def _deciding(slim: DataFrame, max_bits: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds keep_id, keep_row and group_size to rows like those of ``slim`` (row, doc_id, key), which holds all documents."""
    rows = slim.count()
    found, words = repeat_filter(slim, rows, max_bits)

    def held(given: DataFrame) -> DataFrame:
        """Adds ``open``: the row may have an equal."""
        marked = given.withColumn("word", _word(F.col("key"), words)).withColumn("own", _mask(F.col("key")))
        return marked.join(F.broadcast(found), "word", "left").withColumn("open", F.coalesce(F.col("mask").bitwiseAND(F.col("own")) == F.col("own"), F.lit(False))).drop("word", "mask", "own")

    last = F.max(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("row"))).alias("last")
    groups = held(slim).where("open").groupBy("key").agg(F.count("*").alias("group_size"), last)
    groups = written(groups.select("key", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row")), "copies")
    large = F.col("group_size") * HOT_GROUPS >= rows
    hot = groups.where(large & (F.col("group_size") > 1))

    def decide(given: DataFrame) -> DataFrame:
        marked = held(given).join(F.broadcast(hot), "key", "left")
        apart = ~F.col("open")
        whole = {"group_size": F.when(apart, F.lit(1).cast("long")).otherwise(F.col("group_size")), "keep_id": F.when(apart, F.col("doc_id")).otherwise(F.col("keep_id")), "keep_row": F.when(apart, F.col("row")).otherwise(F.col("keep_row"))}
        passed = marked.where(apart | F.col("group_size").isNotNull()).withColumns(whole)
        counted = marked.where(F.col("open") & F.col("group_size").isNull()).drop("group_size", "keep_id", "keep_row").join(groups, "key")
        return passed.unionByName(counted).drop("open")

    return decide


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("key"), *more)


def copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each document."""
    slim = written(_keyed(docs), "text-keys")
    decided = _deciding(slim, max_bits)(slim)
    return decided.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))


def keep_last(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with all their columns, one of equal texts each. Pass a table of files: it is read twice."""
    decide = _deciding(written(_keyed(docs), "text-keys"), max_bits)
    return decide(_keyed(docs, F.struct(*docs.columns).alias("doc"))).where("row = keep_row").select("doc.*")
