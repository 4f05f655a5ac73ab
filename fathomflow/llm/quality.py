"""Quality rules: base counts of a text, and Jensen-Shannon distances of its character classes and common
words from language references learned from the whole corpus.

A reference is a language's mean histogram over the documents that pass the base rules and are long enough,
taken twice: the second time over those that lie near the first, so that junk does not shape it. A document
is rejected by the method when the two distances from its nearest reference add up to more than a limit, which
is wider for short documents, whose histograms are noisy; those with too few words for a histogram are left
to the base rules alone.

Defined results: a null text has no words and fails the base rules; null ids, repeated rows and other columns
do not matter, and columns of any name are left as they are; a language that is null, empty or missing is one language
of its own; where a document's language has no reference (fewer than MIN_LANGUAGE_DOCUMENTS documents that pass the base
rules and are long enough), the base rules decide; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, unused, written
from .textops import Chunk, code_points, pair_hashes, span_hashes, text_chunks, word_spans
from .workers import tidy

# Frequent function words of four languages, in the order of their usual frequency.
COMMON_WORDS = (
    "the of and to in a is that for it was on are as with be by this from or at an "
    "de la le et les des en un du une que est pour qui dans par pas au sur "
    "der die das und den von zu mit sich auf für ist nicht ein eine dem im "
    "el los las y se por con para no su del al lo"
).split()
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents with fewer words than this are not held against references.
MIN_HISTOGRAM_WORDS = 40
#: The two distances (each 0 to 1) from the nearest reference may add up to LIMIT + NOISE_WORDS / words.
LIMIT = 0.34
NOISE_WORDS = 14.0
#: A language gets a reference from so many documents on.
MIN_LANGUAGE_DOCUMENTS = 20

_CLASSES = ("lower", "upper", "wide", "digit", "space", "stop", "symbol", "other")
_CLASS_OF = np.full(256, 7, dtype=np.int64)
_CLASS_OF[97:123] = 0
_CLASS_OF[65:91] = 1
_CLASS_OF[128:] = 2
_CLASS_OF[48:58] = 3
_CLASS_OF[[9, 10, 11, 12, 13, 32]] = 4
_CLASS_OF[list(b".,;:'\"-()?")] = 5
_CLASS_OF[list(SYMBOLS)] = 6
_IS_SYMBOL = _CLASS_OF == 6


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    words = [w.encode() for w in dict.fromkeys(COMMON_WORDS)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = span_hashes(data, ends - [len(w) for w in words], ends)
    order = np.argsort(hashes)
    return hashes[order], order


_COMMON_HASHES, _COMMON_ORDER = _common_table()
N_COMMON = len(_COMMON_HASHES)


@dataclass
class Features:
    """Counts of each row of a chunk."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    common: np.ndarray

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicate_lines(chunk: Chunk, has_word: np.ndarray) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of the row."""
    rows = len(chunk.offsets) - 1
    breaks = np.flatnonzero(chunk.data == 10)
    row_of_break = np.searchsorted(chunk.offsets, breaks, side="right") - 1
    starts = np.concatenate([chunk.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, chunk.offsets[1:]])
    owner = np.concatenate([np.arange(rows), row_of_break])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    end_owner = np.concatenate([row_of_break, np.arange(rows)])
    ends = ends[np.lexsort((ends, end_owner))]
    worded = has_word[ends] > has_word[starts]
    starts, ends, owner = starts[worded], ends[worded], owner[worded]
    keys = pair_hashes(span_hashes(chunk.data, starts, ends, fold=False), owner.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(owner, minlength=rows) - np.bincount(owner[first], minlength=rows)


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row within windows of eight words that stand at least twice in the row."""
    rows, n = len(first) - 1, len(hashes)
    if n < WINDOW:
        return np.zeros(rows, np.int64)
    two = pair_hashes(hashes[:-1], hashes[1:])
    four = pair_hashes(two[:-2], two[2:])
    eight = pair_hashes(four[:-4], four[4:])
    owner = np.repeat(np.arange(rows), np.diff(first))
    whole = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    keys = pair_hashes(eight[at], owner[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[at[again]] += 1
    change[at[again] + WINDOW] -= 1
    return np.bincount(owner[np.cumsum(change)[:-1] > 0], minlength=rows)


def chunk_features(chunk: Chunk) -> Features:
    """All counts of a chunk's rows."""
    rows = len(chunk.offsets) - 1
    starts, ends, first = word_spans(chunk)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(rows), n_words)
    begins = code_points(chunk.data)
    points = np.concatenate([[0], np.cumsum(begins)])
    has_word = np.zeros(len(chunk.data) + 1, np.int64)
    has_word[starts + 1] = 1
    has_word = np.cumsum(has_word)
    class_of = _CLASS_OF[chunk.data]
    row_of_byte = np.repeat(np.arange(rows), np.diff(chunk.offsets))
    classes = np.bincount((row_of_byte * len(_CLASSES) + class_of)[begins], minlength=rows * len(_CLASSES)).reshape(rows, -1)
    stops = np.isin(chunk.data[ends - 1], list(b".,")) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    folded = span_hashes(chunk.data, starts, ends - stops)
    at = np.minimum(np.searchsorted(_COMMON_HASHES, folded), N_COMMON - 1)
    known = _COMMON_HASHES[at] == folded
    common = np.bincount(owner[known] * N_COMMON + _COMMON_ORDER[at[known]], minlength=rows * N_COMMON).reshape(rows, -1)
    return Features(
        n_words,
        np.bincount(owner, points[ends] - points[starts], minlength=rows).astype(np.int64),
        _per_row(_IS_SYMBOL[chunk.data], chunk.offsets),
        _duplicate_lines(chunk, has_word),
        _repeated_words(span_hashes(chunk.data, starts, ends, fold=False), first),
        classes,
        common,
    )


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.astype(np.int32).ravel()))


@tidy
def _feature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            f = chunk_features(chunk)
            part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *(pa.array(getattr(f, n)) for n in _NAMES), pa.array(f.base_failed()), _lists(f.classes), _lists(f.common)],
                names=["doc_id", "lang", *_NAMES, "base_failed", "classes", "common"],
            )


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def features(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, and its histograms of character classes and common words."""
    bounded_batches(docs.sparkSession)
    chosen = docs.select("doc_id", _lang(docs).alias("lang"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_feature_batches, f"doc_id long, lang string, {_COUNTS}, classes array<int>, common array<int>")


@dataclass
class References:
    """Mean distributions of the languages: a row each."""

    languages: list[str | None]
    classes: np.ndarray
    common: np.ndarray


def _shares(counts: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Rows of counts as distributions; with a total, the rest of it is one more bin."""
    counts = counts.astype(np.float64)
    if total is not None:
        counts = np.hstack([counts, (total - counts.sum(axis=1))[:, None]])
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (the root of the divergence in bits, 0 to 1) of each row of p from the distribution q."""
    mean = (p + q) / 2

    def toward(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(mean > 0, mean, 1)), 0).sum(axis=1)

    return np.sqrt(np.clip((toward(p) + toward(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(classes: np.ndarray, common: np.ndarray, n_words: np.ndarray, references: References) -> tuple[np.ndarray, np.ndarray]:
    """Both distances from the nearest reference by their sum."""
    p, q = _shares(classes), _shares(common, n_words)
    by_class = np.array([jensen_shannon(p, r) for r in references.classes])
    by_common = np.array([jensen_shannon(q, r) for r in references.common])
    near = (by_class + by_common).argmin(axis=0)
    rows = np.arange(len(n_words))
    return by_class[near, rows], by_common[near, rows]


def verdict(classes: np.ndarray, common: np.ndarray, n_words: np.ndarray, base_failed: np.ndarray, langs: np.ndarray, references: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, distance of classes, distance of common words); distances are NaN where none is taken."""
    far_class, far_common = np.full(len(n_words), np.nan), np.full(len(n_words), np.nan)
    held = (n_words >= MIN_HISTOGRAM_WORDS) & np.isin(langs, references.languages)
    if held.any():
        far_class[held], far_common[held] = distances(classes[held], common[held], n_words[held], references)
    far = far_class + far_common > LIMIT + NOISE_WORDS / np.maximum(n_words, 1)
    return ~base_failed & ~far, far_class, far_common


def _languages(batch: pa.RecordBatch, column: str = "lang") -> np.ndarray:
    return np.array([x if x is not None else "" for x in batch.column(column).to_pylist()], dtype=str)


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    classes, common = (batch.column(c).flatten().to_numpy().reshape(n, -1) for c in ("classes", "common"))
    return classes, common, batch.column("n_words").to_numpy(), batch.column("base_failed").to_numpy(zero_copy_only=False), _languages(batch)


def _sums(references: References | None):
    """Sums of distributions by language over good documents of a partition; with references, only over kept ones."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            classes, common, n_words, failed, langs = _matrices(batch)
            good = ~failed & (n_words >= MIN_HISTOGRAM_WORDS)
            if references is not None:
                good &= verdict(classes, common, n_words, failed, langs, references)[0]
            both = np.hstack([np.ones((len(n_words), 1)), _shares(classes), _shares(common, n_words)])
            for lang in set(langs[good].tolist()):
                sums[lang] = sums.get(lang, 0) + both[good & (langs == lang)].sum(axis=0)
        langs = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], names=["lang", "sums"])

    return run


def _mean_references(table: DataFrame, near: References | None) -> References:
    each = table.mapInArrow(_sums(near), "lang string, sums array<double>")
    width = 1 + len(_CLASSES) + N_COMMON + 1
    # Sums are rounded so that their order in a rerun cannot matter.
    total = each.groupBy("lang").agg(*(F.round(F.sum(F.col("sums")[i]), 6).alias(f"s{i}") for i in range(width)))
    if near is None:
        total = total.where(F.col("s0") >= MIN_LANGUAGE_DOCUMENTS)
    else:
        total = total.where(F.col("lang").isin(near.languages))
    rows = total.orderBy("lang").collect()
    means = np.array([[r[f"s{i}"] for i in range(width)] for r in rows]).reshape(len(rows), width)
    means = means / np.maximum(means[:, :1], 1)
    return References([r.lang for r in rows], means[:, 1 : 1 + len(_CLASSES)], means[:, 1 + len(_CLASSES) :])


def learn_references(table: DataFrame) -> References:
    """References from a table of features(), which covers all documents."""
    first = _mean_references(table, None)
    second = _mean_references(table, first)
    # A language whose documents all lie far from their mean keeps it.
    rest = [i for i, lang in enumerate(first.languages) if lang not in second.languages]
    return References(second.languages + [first.languages[i] for i in rest], np.vstack([second.classes, first.classes[rest]]), np.vstack([second.common, first.common[rest]]))


def _judge(references: References):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, far_class, far_common = verdict(*_matrices(batch), references)
            columns = [batch.column(c) for c in ("doc_id", *_NAMES, "base_failed")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept), pa.array(far_class), pa.array(far_common)], names=["doc_id", *_NAMES, "base_failed", "kept", "class_distance", "common_distance"])

    return run


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, base_failed, kept and both distances (NaN where none is taken)."""
    table = written(features(docs), "quality-features")
    return table.mapInArrow(_judge(learn_references(table)), f"doc_id long, {_COUNTS}, kept boolean, class_distance double, common_distance double")


def _keep(references: References, columns: list[str], lang: str):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                f = chunk_features(chunk)
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                kept, _, _ = verdict(f.classes, f.common, f.n_words, f.base_failed(), _languages(part, lang), references)
                yield part.select(columns).filter(pa.array(kept))

    return run


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with all their columns: texts are read twice and never shuffled."""
    references = learn_references(written(features(docs), "quality-features"))
    own = unused(docs.columns, "quality_lang")
    return docs.withColumn(own, _lang(docs)).mapInArrow(_keep(references, docs.columns, own), T.StructType(docs.schema.fields))
