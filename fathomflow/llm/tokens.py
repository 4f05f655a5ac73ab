"""Token ids by a public tokenizer file, word by word and vectorised over blocks of text.

The tokenizer of word_bpe_49k.json drops white space and never joins characters across it, so the ids of a text are
those of its words in a row. A block's bytes are cut with NumPy into words, and these into a stem of Latin letters and
the ASCII punctuation behind it, which the tokenizer splits there too; words of any other form stay whole. Stems and
words are looked up by a 64-bit hash with a second check, in a table of bounded size that starts anew when full; only
those not found there are given to the tokenizer. Letters are folded to lower case first, as the tokenizer does; words
that may hold a special token are not, and are never kept.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import FOLD, SPACE, span_hashes
from .workers import cached

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Text bytes that one block holds; long texts are cut at white space.
BLOCK_BYTES = 1 << 20
#: Slots of the table of known words (20 bytes each); it starts anew when three quarters of them are taken.
SLOTS = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: The lead byte of U+00C0 to U+00FF; by the byte behind it, what is added to fold a capital, and what is a letter then.
_LEAD = 0xC3
_LATIN_FOLD = np.zeros(256, np.uint8)
_LATIN_FOLD[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = 0x20
_LATIN_LETTER = np.zeros(256, bool)
_LATIN_LETTER[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_FIRST_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _byte_symbols() -> dict[int, int]:
    """The printable character that byte-level models show each byte as: itself, or one from 256 on for the bytes that do not print."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_SYMBOLS = _byte_symbols()
_encoders: dict[str, WordEncoder] = {}
cached("encoders", _encoders.clear)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """The place of an installed public tokenizer file; absolute paths are used as given."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _KnownWords:
    """Ids of words by key: an open-addressing table and one pool of ids."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.keys, self.checks, self.entries = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)  # the first entry is no word's
        self.pool = np.zeros(1024, np.uint32)
        self.used = 0

    def full(self, more: int) -> bool:
        return 4 * (len(self.starts) + more) > 3 * len(self.keys)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entry of each key: -1 where it is not held, -2 where it is held by another word."""
        found = np.full(len(keys), -1, np.int32)
        rest, slots = np.arange(len(keys)), keys & self.mask
        while len(rest):
            held = self.keys[slots]
            hit = held == keys[rest]
            at, own = slots[hit], rest[hit]
            found[own] = np.where(self.checks[at] == checks[own], self.entries[at], -2)
            on = (held != 0) & ~hit
            rest, slots = rest[on], (slots[on] + np.uint64(1)) & self.mask
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list) -> None:
        """Takes in distinct new keys with the ids of each."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], flat, np.zeros(self.used + len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        entries = np.arange(len(self.starts), len(self.starts) + len(ids), dtype=np.int32)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(flat)
        rest, slots = np.arange(len(keys)), keys & self.mask
        while len(rest):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[rest[free]]  # of several that want a slot, one stays there
            won = self.keys[slots] == keys[rest]
            at, own = slots[won], rest[won]
            self.checks[at], self.entries[at] = checks[own], entries[own]
            rest, slots = rest[~won], (slots[~won] + np.uint64(1)) & self.mask


class WordEncoder:
    """Encodes blocks of text to ids."""

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.slots = Tokenizer.from_file(path), slots
        self.known = _KnownWords(slots)

    def _encode_others(self, words: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)] if words else []

    def _encode_stem(self, stem: bytes) -> list[int]:
        """The ids of a lower-case Latin word, which the normaliser and the splitting rule leave as it is: its byte symbols go straight to the model."""
        symbols = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(_BYTE_SYMBOLS)
        return [t.id for t in self.tokenizer.model.tokenize(symbols)]

    def _learn(self, raw: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, stems: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Takes the given distinct new stems and words into the table."""
        plain, source = data.tobytes(), raw.tobytes()
        spans = list(zip(begins.tolist(), ends.tolist(), stems.tolist(), strict=True))
        others = iter(self._encode_others([source[a:b] for a, b, s in spans if not s]))
        self.known.add(keys, checks, [self._encode_stem(plain[a:b]) if s else next(others) for a, b, s in spans])

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of UTF-8 bytes, which no word crosses, and how many of them stand before each of the given
        byte offsets, which no word crosses either."""
        n = len(raw)
        data = FOLD[raw]
        leads = np.flatnonzero(data[:-1] == _LEAD)
        data[leads + 1] += _LATIN_FOLD[data[leads + 1]]
        letter = _LETTER[data]
        pairs = leads[_LATIN_LETTER[data[leads + 1]]]
        letter[pairs] = letter[pairs + 1] = True

        solid = ~SPACE[raw]
        edge = np.diff(np.concatenate([[False], solid, [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(inner := bounds[(bounds > 0) & (bounds < n)]):
            inner = np.unique(inner)
            inner = inner[solid[inner] & solid[inner - 1]]
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))

        # A plain word is a stem and, perhaps, punctuation; its units are these two. Other words are one unit.
        others = np.append(np.flatnonzero(~letter), n)
        stem_ends = np.minimum(others[np.searchsorted(others, starts)], ends)
        tailed = np.flatnonzero(stem_ends < ends)
        marks = np.append(np.flatnonzero(~_PUNCTUATION[data]), n)
        plain = np.ones(len(starts), bool)
        plain[tailed] = (stem_ends[tailed] > starts[tailed]) & (marks[np.searchsorted(marks, stem_ends[tailed])] >= ends[tailed])
        tailed = tailed[plain[tailed]]
        units = np.ones(len(starts), np.int64)
        units[tailed] = 2
        at = np.cumsum(units) - units
        begin, end, stem = np.empty(int(units.sum()), np.int64), np.empty(int(units.sum()), np.int64), np.zeros(int(units.sum()), bool)
        begin[at], end[at], stem[at] = starts, np.where(plain, stem_ends, ends), plain
        begin[at[tailed] + 1], end[at[tailed] + 1] = stem_ends[tailed], ends[tailed]

        keys = span_hashes(data, begin, end, fold=False)
        # What is no stem is known by its bytes as they are: capitals with combining marks do not fold to those of small letters.
        whole = np.flatnonzero(~stem)
        keys[whole] = span_hashes(raw, begin[whole], end[whole], fold=False) ^ np.uint64(0x5851F42D4C957F2D)
        keys[keys == 0] = 1
        size = end - begin
        eight = np.ndarray(n + 1, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        checks = (eight[begin] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        special = np.zeros(len(begin), bool)
        brackets = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        special[np.searchsorted(begin, brackets, side="right") - 1] = True
        own = self._entries(raw, data, begin, end, stem, keys, checks, special)
        rare = np.flatnonzero(own < 0)
        starts_, sizes = self.known.starts[own], self.known.sizes[own]
        sizes[rare] = 0
        total = np.cumsum(sizes)
        ids = self.known.pool[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts_ - total + sizes, sizes)]
        before = np.concatenate([[0], total])[np.searchsorted(begin, bounds)]
        if not len(rare):
            return ids, before
        source = raw.tobytes()
        apart = [np.array(x, np.uint32) for x in self._encode_others([source[begin[i] : end[i]] for i in rare.tolist()])]
        places = (total - sizes)[rare]
        more = np.array([len(x) for x in apart])
        pieces = [part for cut, x in zip(np.split(ids, places), [*apart, np.zeros(0, np.uint32)], strict=True) for part in (cut, x)]
        return np.concatenate(pieces), before + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(begin[rare], bounds)]

    def _entries(self, raw, data, begin, end, stem, keys, checks, special) -> np.ndarray:
        """The table's entry of each unit; negative for those that are to be encoded apart."""
        found = self.known.find(keys, checks)
        missing = np.flatnonzero((found == -1) & ~special)
        _, first = np.unique(keys[missing], return_index=True)
        if self.known.full(len(first)):
            self.known = _KnownWords(max(self.slots, 4 << len(np.unique(keys)).bit_length()))
            return self._entries(raw, data, begin, end, stem, keys, checks, special)
        new = missing[first]
        if len(new):
            self._learn(raw, data, begin[new], end[new], stem[new], keys[new], checks[new])
            found[missing] = self.known.find(keys[missing], checks[missing])
        found[special] = -1
        return found


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file; tasks of one worker share its table."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _blocks(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts bytes into blocks of about the limit, before white space."""
    lo, n = 0, len(data)
    while lo < n:
        hi, step = lo + limit, 1 << 12
        while hi < n:
            spaces = np.flatnonzero(SPACE[data[hi : hi + step]])
            if len(spaces):
                hi += int(spaces[0])
                break
            hi, step = hi + step, 2 * step
        yield lo, min(hi, n)
        lo = min(hi, n)


def encoded_rows(column: pa.Array, path: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(row, ids with end_id, as little-endian unsigned 32-bit integers) of each text of a string column; null is an empty text."""
    if not len(column):
        return
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    end, own, row, held = np.array([end_id], "<u4").tobytes(), encoder(path), 0, []
    for lo, hi in _blocks(data, block_bytes):
        # Rows row .. last - 1 end in this block.
        last = int(np.searchsorted(offsets, hi, side="right")) - 1
        ids, before = own.encode(data[lo:hi], offsets[row + 1 : last + 1] - lo)
        ids = ids.astype("<u4", copy=False).tobytes()
        at = 0
        for stop in (before * 4).tolist():
            yield row, b"".join([*held, ids[at:stop], end])
            row, at, held = row + 1, stop, []
        if at < len(ids):
            held.append(ids[at:])
    for rest in range(row, len(column)):  # empty texts at the end
        yield rest, b"".join([*held, end])
        held = []


def crc32(ids: bytes) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids)
