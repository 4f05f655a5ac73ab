from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fathomflow.llm import packing, token_files, tokens

TEXTS = [
    "The and attion, to THE. thanedble... x,. don't I'LL 3.14 a,b", None, "", " \n\t ", "<|endoftext|> a<|startoftext|>b. <|endoftext|>.",
    "Éclair naïve Straße ΣΑΣ. İstanbul é ́x a b c\x85d", "a\x1cb \x1f.\x1d c", "日本語、テスト. ok!!, **bold**", "A." * 50, "word " * 5000,
]


PLAIN = Tokenizer.from_file(tokens.tokenizer_path())


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def rows_of(texts, **how):
    found = list(tokens.encoded_rows(pa.array(texts, pa.string()), tokens.tokenizer_path(), 2, **how))
    assert [row for row, _ in found] == list(range(len(texts)))
    return [np.frombuffer(ids, "<u4").tolist() for _, ids in found]


def test_words_give_the_ids_of_whole_texts():
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts = TEXTS + real[:60] + ["", None]
    for block in (1 << 20, 1000, 7):
        assert rows_of(texts, block_bytes=block) == [[*whole(t), 2] for t in texts]


def test_capitals_marks_and_punctuation_fold_alike():
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xA0, 0x250)]]
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [" ".join(x + m + "A" for m in marks) for x in letters] + [" ".join(x + y + p for y in letters[:150]) for x in letters for p in ("", "'", "<|", ".'s")]
    assert rows_of(texts) == [[*whole(t), 2] for t in texts]


def test_random_strings():
    rng = np.random.default_rng(8)
    signs = list("aAbB eE .'<|>\n\t09") + ["\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "é", "É", "ß", "ẞ", "Ω", "Σ", "İ", "ı", "ſ", "\u0301", "日", "😀", "<|endoftext|>", "'s", "'ll"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    assert rows_of(texts, block_bytes=300) == [[*whole(t), 2] for t in texts]


def test_a_table_that_starts_anew_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {tokens.tokenizer_path(): tokens.WordEncoder(tokens.tokenizer_path(), slots=8)})
    assert rows_of(TEXTS * 2, block_bytes=50) == [[*whole(t), 2] for t in TEXTS * 2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "x"), (0, TEXTS[0], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def digest(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_round_trip(spark, docs, tmp_path):
    path = token_files.write_token_files(docs, f"file://{tmp_path}/ids", files=3)
    rows = token_files.token_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    texts = dict(enumerate(TEXTS)) | {None: "null id"}
    start = 0
    for r in rows:
        ids = [*whole(texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), digest(ids))
        start += len(ids)
    from pyspark.sql import functions as F

    assert [r.ids for r in token_files.read_token_files(spark, path, F.col("doc_id") == 7).collect()] == [[*whole(TEXTS[7]), 2]]


def test_token_files_have_bloom_filters_and_row_indexes(spark, docs, tmp_path):
    import pyarrow.orc as orc

    path = token_files.write_token_files(docs, f"file://{tmp_path}/ids", files=1)
    file = next(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".orc")
    assert orc.ORCFile(file).nstripes == 1
    assert orc.ORCFile(file).row_index_stride == token_files.ROW_INDEX_STRIDE
    assert token_files.read_token_files(spark, path).count() == 13


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert token_files.token_digests(spark, token_files.write_token_files(none, f"file://{tmp_path}/none")).count() == 0
    assert packing.pack(none).count() == 0


def test_packing_loses_nothing(spark, docs):
    rows = packing.pack(docs, capacity=16, group_docs=5).collect()
    texts = dict(enumerate(TEXTS)) | {None: "null id"}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        ids = [*whole(texts[doc]), 1]
        copies = 2 if doc in (0, 3) else 1
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == sorted([(s, len(ids[s : s + 16]), digest(ids[s : s + 16]), len(ids)) for s in range(0, len(ids), 16)] * copies)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        used = {(p.sequence_tokens, p.padding) for p in pieces}
        assert used == {(at, 0 if at & (at - 1) == 0 else 16 - at)} and at <= 16
    assert set(by_doc) == set(texts)


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(3)
    for capacity in (10, 100, 2048):
        lengths = np.sort(rng.integers(1, capacity + 1, 300))[::-1]
        free, expected = [], []
        for x in lengths:
            k = next((i for i, f in enumerate(free) if f >= x), len(free))
            if k == len(free):
                free.append(capacity)
            free[k] -= x
            expected.append(k)
        assert packing.first_fit_decreasing(lengths, capacity).tolist() == expected
