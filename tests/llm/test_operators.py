"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import itertools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from fathomflow.llm import ann, graph, html, language_model, mixing, near_dedup, passages, quality, suffixes, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = prose(rng, 150)
    passage = prose(rng, 70, 5000)
    out = [(0, base), (1, base), (2, base.upper().replace("W", "w", 3)), (3, base.replace("w7 ", "x ", 1)), (4, base + " tail"), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "one"), (10, "é" * 300), (11, "ab " * 400)]
    out += [(20 + i, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 50)) for i in range(5)]
    near = base.split()
    for i in range(12):
        cut = list(near)
        for _ in range(4 * i):
            cut[rng.randrange(len(cut))] = f"n{rng.randrange(10**6)}"
        out.append((40 + i, " ".join(cut)))
    out += [(60 + i, prose(rng, 80)) for i in range(20)]
    return out + [(None, base), (None, "lone text of no id"), (61, out[-19][1])]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents"
    data = [(d, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 9 else None, "x", 1) for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, value string, root long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def shingles(text, width):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components_of(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {i: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for i in g}
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, width):
    found = near_dedup.near_duplicates(docs, width).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=order) == sorted(components_of(rows, width), key=order)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_near_duplicates_in_small_blocks(docs, rows, monkeypatch):
    for name in ("STAR_CHUNK", "LEFT_SHINGLES", "FAMILY_SHINGLES"):
        monkeypatch.setattr(near_dedup, name, 2 if name == "STAR_CHUNK" else 200)
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert found == {(d, c) for d, _, c in components_of(rows, 2)}


def test_keep_one_keeps_columns_and_one_row_a_document(docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(61) == 1 and ids.count(0) == 1 and 1 not in ids


def test_rows_without_ids_are_linked_and_kept_once(spark, tmp_path):
    def changed(text, *at):
        return " ".join(f"x{i}" if i in at else w for i, w in enumerate(text.split()))

    rng = random.Random(8)
    a, b = prose(rng, 100, 9000), prose(rng, 100, 9000)
    middle = changed(b, 10, 30)
    rows = [(None, a), (None, a), (None, a), (None, changed(a, 50)), (1, b), (None, middle), (2, changed(middle, 60, 80)), (None, None), (None, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    table = spark.read.parquet(f"file://{tmp_path}/docs")
    found = near_dedup.near_duplicates(table).collect()
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert sum(r.kept for r in found if r.doc_id is None and r.n_shingles and r.component_id is None) == 1
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_one(table).collect()]
    assert len(kept) == 4 and {(1, b), (None, None), (None, " ")} < set(kept)


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(300)] + [(5000, 1000 + i) for i in range(50)] + [(rng.randrange(6000, 6200), rng.randrange(6000, 6200)) for _ in range(150)] + [(7, 7), (8000, 8000)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    expected = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    table = spark.createDataFrame(links, "u long, v long").repartition(3)
    for limit in (graph.LOCAL_LINKS, 0, 100):
        found = list(map(tuple, graph.components(table, limit).collect()))
        assert len(found) == len(set(found)) and set(found) == expected
    assert graph.components(table.limit(0)).count() == 0


def covered(rows, length):
    texts = {(t or "").encode() for _, t in rows}
    weight = collections.Counter((t or "").encode() for _, t in rows)
    seen = collections.Counter()
    for raw in texts:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += weight[raw]
    out = {}
    for raw in texts:
        marks = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        out[raw] = np.cumsum(marks)[: len(raw)] > 0
    return out


@pytest.mark.parametrize("place_bytes", [passages.PLACE_BYTES, 300])
def test_repeated_passages(docs, rows, place_bytes):
    marks = covered(rows, 200)
    expected = collections.Counter()
    for d, t in rows:
        raw = (t or "").encode()
        m = marks[raw]
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        expected[(d, len(raw), int(m.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~m].tobytes()).hexdigest())] += 1
    assert collections.Counter(map(tuple, passages.removal_digests(docs, place_bytes=place_bytes).collect())) == expected


def test_long_runs_of_one_byte_are_repeated_whole(spark, tmp_path):
    runs = [" " * n + f"<{n}>" for n in range(200, 2300)]
    rows = [(1, "-" * 3_000_000), (2, "=" * 200), (3, "=" * 199 + "x"), *((10 + i, "".join(runs[i::20])) for i in range(20))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/runs")
    seen = collections.Counter(hash(t[i : i + 200]) for _, t in rows for i in range(len(t) - 199))
    expected = set()
    for d, t in rows:
        again = np.array([seen[hash(t[i : i + 200])] > 1 for i in range(len(t) - 199)])
        kept = np.frombuffer(t.encode(), np.uint8)[np.convolve(again, np.ones(200)) < 0.5]
        expected.add((d, len(t), len(t) - len(kept), hashlib.sha256(kept.tobytes()).hexdigest()))
    found = passages.removal_digests(spark.read.parquet(f"file://{tmp_path}/runs")).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found} == expected


def brute_removed(texts, length):
    """(removed bytes, maximal runs) of each text, every window counted in one dictionary."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for r in raws:
        marks = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                marks[i : i + length] = True
        found.append((int(marks.sum()), len(suffixes.runs(marks[:-1])[0])))
    return found


def test_places_are_thinned_out_and_dealt_again(spark, tmp_path):
    rng = random.Random(31)
    passage = prose(rng, 60, 5000)
    texts = [f"{prose(rng, 8, 5000)} {passage} {prose(rng, 8, 5000)}" for _ in range(60)] + ["ab" * 700, "x" + "ab" * 650, "c" * 900, "c" * 300, passage, passage, "", None]
    for i in range(40):
        words = passage.split()
        words[rng.randrange(60)] = f"w{i}"
        texts.append(" ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/hot")
    for place_bytes in (passages.PLACE_BYTES, 900, 250):
        found = {r.doc_id: (r.n_removed, r.n_spans) for r in passages.removal_digests(spark.read.parquet(f"file://{tmp_path}/hot"), place_bytes=place_bytes).collect()}
        assert [found[i] for i in range(len(texts))] == brute_removed(texts, 200)


def test_long_periodic_texts(spark, tmp_path):
    texts = ["a" * 2_200_000, "xyz" * 500_000, "xyz" * 1000 + "!", "b" * 199, "b" * 200, "c" * 201]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/periods")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in passages.removal_digests(spark.read.parquet(f"file://{tmp_path}/periods")).collect()}
    assert found == {0: (2_200_000, 1), 1: (1_500_000, 1), 2: (3000, 1), 3: (0, 0), 4: (0, 0), 5: (201, 1)}


def test_remove_passages_leaves_columns_of_any_name(spark, tmp_path):
    passage, names = prose(random.Random(5), 60, 5000), ("id", "row", "doc", "ranges", "tid", "sha", "cut_tid", "cut_ranges", "place")
    texts = [f"one {passage}", f"{passage} two", None, "", passage[:100]]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).write.parquet(f"file://{tmp_path}/names")
    found = sorted(map(tuple, passages.remove_passages(spark.read.parquet(f"file://{tmp_path}/names")).collect()))
    assert found == [(i, t, *r[2:]) for i, (t, r) in enumerate(zip(["one ", " two", None, "", passage[:100]], rows, strict=True))]


def test_remove_passages_keeps_columns(docs, rows):
    marks = covered(rows, 200)
    found = passages.remove_passages(docs)
    assert found.columns == docs.columns
    expected = collections.Counter((d, np.frombuffer((t or "").encode(), np.uint8)[~marks[(t or "").encode()]].tobytes().decode(errors="ignore")) for d, t in rows)
    assert collections.Counter((r.doc_id, r.text or "") for r in found.collect()) == expected


def test_interval_expansion_against_brute_force():
    rng = random.Random(1)
    for _ in range(120):
        length, alphabet = rng.choice([1, 2, 3, 8, 20, 60]), rng.choice([b"ab", b"a", bytes(range(97, 123))])
        base = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        pieces = []
        for _ in range(rng.randint(1, 6)):
            i = rng.randint(0, len(base))
            pieces.append(bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + base[i : rng.randint(i, len(base))])
        seen = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        expected = [x for p in pieces for x in [*(i <= len(p) - length and seen[p[i : i + length]] > 1 for i in range(len(p))), False]]
        assert suffixes.repeated_starts(pieces, length).tolist() == expected


def test_quality_counts(docs, rows):
    found = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    expected = collections.Counter()
    for d, text in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        expected[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))] += 1
    assert found == expected


def divergence(p, q):
    """The Jensen-Shannon distance of two lists of shares, in plain loops."""
    toward = lambda x: sum(a * math.log2(a / ((a + b) / 2)) for a, b in zip(x, q if x is p else p, strict=True) if a > 0)
    return math.sqrt(max(0.0, (toward(p) + toward(q)) / 2))


def plain_verdicts(rows):
    """kept of each (text, lang) by plain loops over characters and words."""
    common = list(dict.fromkeys(quality.COMMON_WORDS))

    def shares(text):
        kinds = ["lower", "upper", "wide", "digit", "space", "stop", "symbol", "other"]
        counts = collections.Counter()
        for c in text:
            o = ord(c)
            counts["wide" if o > 127 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "space" if c in " \t\n\r\x0b\x0c" else "stop" if c in ".,;:'\"-()?" else "symbol" if c in "#*$%&|<>" else "other"] += 1
        words = [(w[:-1] if len(w) > 1 and w[-1] in ".," else w).translate(FOLD) for w in WORD.findall(text)]
        found = [words.count(x) for x in common]
        return [counts[k] / len(text) for k in kinds], [x / len(words) for x in [*found, len(words) - sum(found)]]

    base = [quality_base(t) for t, _ in rows]
    held = [not failed and n >= quality.MIN_HISTOGRAM_WORDS for failed, n in base]
    both = [shares(t) if h else None for (t, _), h in zip(rows, held, strict=True)]

    def mean(chosen, least):
        langs = collections.defaultdict(list)
        for i in chosen:
            langs[rows[i][1]].append(both[i])
        return {k: tuple([sum(x) / len(v) for x in zip(*(s[j] for s in v), strict=True)] for j in (0, 1)) for k, v in langs.items() if len(v) >= least}

    first = mean([i for i, h in enumerate(held) if h], quality.MIN_LANGUAGE_DOCUMENTS)
    far = lambda i, refs: min(divergence(both[i][0], c) + divergence(both[i][1], w) for c, w in refs.values()) > quality.LIMIT + quality.NOISE_WORDS / base[i][1]
    near = [i for i, h in enumerate(held) if h and rows[i][1] in first and not far(i, first)]
    second = first | mean(near, 1)
    return [not failed and not (held[i] and rows[i][1] in second and far(i, second)) for i, (failed, _) in enumerate(base)]


def quality_base(text):
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w) < 20 or 100 * len(again) > 30 * len(w), len(w)


def test_quality_verdicts_against_plain_loops(spark):
    rng = random.Random(12)
    stock = {"en": "the of and to in house river Table window, garden. letter music it's 1990".split(), "fr": "le la les des maison rivière table fenêtre, jardin. lettre musique dans pour".split()}
    rows = []
    for i in range(240):
        lang = ("en", "fr")[i % 2]
        words = [rng.choice(stock[lang]) for _ in range(rng.randrange(15, 160))]
        for k in range(len(words)):  # growing shares of junk
            if rng.random() < (i // 12) / 22:
                words[k] = rng.choice(["#$%&", "XKCD", "99817", "zq" * 9, "|<>|"])
        rows.append((" ".join(words), lang))
    table = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r.kept for r in quality.judge(table).collect()}
    expected = plain_verdicts(rows)
    assert [found[i] for i in range(len(rows))] == expected and 30 < sum(expected) < 230


def test_quality_rejects_symbol_junk_and_keeps_prose(spark):
    rng = random.Random(2)
    words = "the of and to in house river table window garden letter music".split()
    clean = [(i, " ".join(rng.choice(words) for _ in range(120)) + ".", "en") for i in range(60)]
    junk = [(100 + i, " ".join(rng.choice(words) + "&&&%%%" for _ in range(120)), "en") for i in range(8)]
    table = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.judge(table).where("kept").collect()} == {i for i, _, _ in clean}
    assert quality.keep_good(table).count() == len(clean)
    assert quality.judge(table.limit(0)).count() == 0


def test_quality_keeps_prose_of_rare_languages(spark, monkeypatch):
    rng = random.Random(5)
    words = "the of and to in house river table window garden letter music".split()
    greek = "και το της σπίτι ποτάμι τραπέζι παράθυρο κήπος γράμμα μουσική".split()
    common = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(2000)]
    rare = [(5000 + i, " ".join(rng.choice(greek) for _ in range(80)), "el") for i in range(3)]
    table = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.judge(table).where("doc_id >= 5000").collect()}
    assert all(found[d].kept and math.isnan(found[d].class_distance) for d, _, _ in rare)
    assert quality.keep_good(table).where("lang = 'el'").count() == 3
    monkeypatch.setattr(quality, "MIN_LANGUAGE_DOCUMENTS", 3)
    found = {r.doc_id: r for r in quality.judge(table).where("doc_id >= 5000").collect()}
    assert all(found[d].kept and found[d].class_distance < 0.2 for d, _, _ in rare)


def test_mixing_meets_targets_and_repeats(docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    total = sum(len(WORD.findall(t or "")) for _, t in rows)
    by_source = collections.defaultdict(list)
    for r in found:
        by_source[(r.source_size, r.target)].append(r)
    assert math.isclose(sum(t for _, t in by_source), total)
    for (size, target), group in by_source.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in group) - target) <= 2 * max(r.size for r in group)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, found))
    copies = collections.Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    assert sum(copies.values()) >= sum(r.taken > 0 for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_prefers_long_documents_of_a_source(spark):
    # Two sources of equal weight: the large one is taken in part, the small one more than whole.
    data = [(i, "long", "w " * 40) for i in range(1500)] + [(5000 + i, "long", "w " * 10) for i in range(6000)] + [(20000 + i, "small", "w " * 10) for i in range(5000)]
    table = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(4)
    found = mixing.mix(table, weights=(1.0, 1.0)).where("source_size = 120000").collect()
    share = {size: sum(r.taken > 0 for r in found if r.size == size) / sum(r.size == size for r in found) for size in (10, 40)}
    assert abs(sum(r.taken for r in found) - found[0].target) <= 20 and all(r.taken <= r.size for r in found)
    # The inclusion odds of long documents are four times those of short ones.
    odds = {size: p / (1 - p) for size, p in share.items()}
    assert 3 < odds[40] / odds[10] < 5.3


def test_mixing_leaves_columns_of_any_name(spark):
    names = ("mix_size", "mix_source", "mix_u", "mix_copies", "doc", "source_plan", "col")
    rows = [(i, "a b c" if i % 3 else None, *[f"{n}{i}" for n in names]) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(tuple, mixing.mix_documents(table).collect())) == rows  # one source of all words
    assert mixing.mix_documents(table.limit(0)).count() == 0


def test_language_model(docs, rows):
    found = language_model.score(docs, block_bytes=3000).collect()
    fold = lambda d: (zlib.crc32(str(d).encode()) if d is not None else 0) % 5
    tokens = [[*WORD.findall((t or "").translate(FOLD)), None] for _, t in rows]
    counts = collections.Counter(x for (d, _), w in zip(rows, tokens, strict=True) if fold(d) != 1 for x in w)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((d is None, d or 0, fold(d) == 1, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for (d, _), w in zip(rows, tokens, strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    other = language_model.score(docs).collect()
    assert sorted(round(r.score, 6) for r in other) == sorted(round(r.score, 6) for r in found)
    assert language_model.score(docs.limit(0)).count() == 0


def test_language_model_scores_against_plain_counts(docs, rows):
    fold = lambda d: (zlib.crc32(str(d).encode()) if d is not None else 0) % 5
    tokens = [([*WORD.findall((t or "").translate(FOLD)), None], fold(d)) for d, t in rows]

    def counted(folds):
        one, two = collections.Counter(), collections.Counter()
        for w, f in tokens:
            if f in folds:
                one.update(w)
                two.update(itertools.pairwise([None, *w]))  # a document's start is the end before it
        return one, two, sum(one.values()), len(one)

    bucket = lambda c: min(c.bit_length(), language_model.CONTEXT_BUCKETS - 1)
    parts = lambda a, b, m: (m[1][a, b] / max(m[0][a], 1), m[0][b] / m[2], 1 / (m[3] + 1))
    every, held = set(range(5)) - {language_model.HELD_OUT_FOLD}, language_model.DELETED_FOLD
    kept = counted(every - {held})
    weights = {i: [1 / 3] * 3 if i else [0, 0.5, 0.5] for i in range(language_model.CONTEXT_BUCKETS)}
    events = [(bucket(kept[0][a]), parts(a, b, kept)) for w, f in tokens if f == held for a, b in itertools.pairwise([None, *w])]
    for _ in range(language_model.EM_ROUNDS):
        sums = {i: [1.0 if i else 0.0, 1.0, 1.0] for i in weights}
        for i, p in events:
            joint = [x * y for x, y in zip(weights[i], p, strict=True)]
            sums[i] = [s + x / sum(joint) for s, x in zip(sums[i], joint, strict=True)]
        weights = {i: [x / sum(s) for x in s] for i, s in sums.items()}
    model = counted(every)
    expected = sorted(sum(math.log10(sum(x * y for x, y in zip(weights[bucket(model[0][a])], parts(a, b, model), strict=True))) for a, b in itertools.pairwise([None, *w])) for w, _ in tokens)
    found = sorted(r.score for r in language_model.score(docs).collect())
    # Held-out cells are kept in steps of 1/RATIO_STEPS octaves.
    assert np.allclose(found, expected, rtol=0.01, atol=0.01), np.abs(np.array(found) - expected).max()


def test_mixture_weights_find_the_better_part():
    cells = np.array([[5, 160, 40, 1000], [5, 0, 40, 10]])
    weights = language_model.learn_weights(cells)
    assert weights[5, 0] > 0.8 and np.allclose(weights.sum(axis=1), 1) and (weights[1:] > 0).all()


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[300:500] = x[0]  # one common vector
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, None] * 8, 0), (1080, [1.0] * 3, 0), (None, x[5].tolist(), 0), (40, x[40].tolist(), 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    found = collections.defaultdict(list)
    for r in ann.nearest(table).collect():
        found[r.query_id].append(r)
    exact, hits = x.astype(np.float64), 0
    assert set(found) == {i for i in range(900) if i % 20 == 0}
    for q, got in found.items():
        got.sort(key=lambda r: r.rank)
        scores = exact @ exact[q]
        true = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
        assert [r.rank for r in got] == list(range(1, 21)) and q not in {r.vec_id for r in got}
        assert all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({r.vec_id for r in got} & set(true))
    assert hits >= 0.95 * 20 * len(found)
    assert ann.nearest(table.limit(0)).count() == 0
    assert [(r.query_id, r.vec_id) for r in ann.nearest(table.where("vec_id in (20, 21)")).collect()] == [(20, 21)]


@pytest.mark.parametrize("shape", ["gaussian", "mild norms", "wide norms"])
def test_recall_of_nearest_where_norms_differ(spark, shape):
    rng = np.random.default_rng(2)
    n, size = (8000, 32) if shape == "gaussian" else (2000, 32)
    x = rng.standard_normal((n, size))
    if shape != "gaussian":
        x *= np.exp((0.5 if shape == "mild norms" else 3) * rng.standard_normal((n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, hits = collections.defaultdict(list), 0
    for r in ann.nearest(table).collect():
        found[r.query_id].append(r.score)
    for q in range(0, n, 20):
        scores = np.delete(x @ x[q], q)
        assert len(found[q]) == 20
        hits += sum(s >= np.sort(scores)[-20] * (1 - 1e-12) - 1e-300 for s in found[q])
    assert hits >= 0.95 * 20 * len(range(0, n, 20))


def test_the_exact_check_of_nearest_finds_what_a_narrow_beam_misses(spark):
    rng = np.random.default_rng(4)
    points, k = rng.standard_normal((6000, 32)), 20
    targets, true = points[:64], np.argsort(-(points[:64] @ points.T), axis=1, kind="stable")[:, : k + 1]
    nodes, _ = ann.Graph(points).build().search(np.hstack([targets, np.zeros((64, 1))]), ann.SEARCH_BEAM)
    assert any(set(t) - set(n) for t, n in zip(true, nodes, strict=True))
    for t, found in zip(true, ann._confirmed(points, targets, nodes, k), strict=True):
        assert set(t) <= set(found) and len(found) < 200
    # Before: beams of 320 and 640 nodes a query and shard.
    assert ann.SEARCH_BEAM <= 64


def test_every_node_is_reached_and_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(9)
    for n in [*range(2, 40, 5), 900]:
        graph = ann.Graph(rng.standard_normal((n, 4)) * np.exp(4 * rng.standard_normal((n, 1)))).build()
        assert graph._reached().all()
    rows = [(i, (rng.standard_normal(3) * np.exp(4 * rng.standard_normal())).tolist()) for i in range(40)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=60).collect()
    assert collections.Counter(r.query_id for r in found) == {0: 39, 20: 39}


def test_scores_of_double_vectors_are_exact(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 8)) * np.where(np.arange(300) % 50 == 0, 1e100, 1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(table, k=5).collect()
    for r in found:
        assert math.isclose(r.score, float(x[r.query_id] @ x[r.vec_id]), rel_tol=1e-12)
    assert len(found) == 15 * 5 and all(r.vec_id % 50 == 0 for r in found if r.rank == 1)


def test_url_rules_and_verdicts(spark):
    given = [
        (1, "http://a.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "https://x.com/en/9#f", "x.com", "/en/9", "com/en/", "block"),
        (3, "https://xcom/en/9", "xcom", "/en/9", None, "allow"),
        (4, "http://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
        (5, "no scheme", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "ftp://host", "host", "", None, "allow"),
        (8, "http://q?://z/en/", "q", "", None, "allow"),
    ]
    more = [(100 + i, f"http://www.casino-win{i % 3}.example.org/fr/{i}", None, None, None, "block") for i in range(30)]
    more += [(200 + i, f"http://blog.garden{i % 7}.example.org/fr/{i}", None, None, None, "allow") for i in range(60)]
    more += [(300, "http://casinowin.example.org/fr/3", None, None, None, "block")]
    table = spark.createDataFrame([(r[0], r[1], "h") for r in given + more] + [(1, given[0][1], "h")], "page_id long, url string, host string")
    found = collections.defaultdict(list)
    for r in urls.judge(table).collect():
        found[r.page_id].append(r)
    assert len(found[1]) == 2
    for page, _, host, path, rule, verdict in given:
        assert all((r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) for r in found[page]), found[page]
    for page, _, _, _, _, verdict in more:
        assert found[page][0].verdict == verdict, found[page]
    assert urls.judge(table.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    assert [(r.verdict, r.pattern) for r in urls.RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    table = spark.createDataFrame([(1, "http://a.net/de/1"), (2, "http://example.net/de/7"), (3, "http://example.net/de/8"), (4, "http://a.org/es/")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(table).collect()} == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("org/es/", "block")}


def test_seed_words_alone_block_nothing_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    blocked = {r.host for r in urls.judge(pages).where("rule is null and verdict = 'block'").select("host").distinct().collect()}
    assert blocked
    # A seed word's odds over the prior stay below even: it takes the learned weights of the other words.
    hosts = urls.judge(pages).where("host != ''").groupBy("host").count().collect()
    share = sum(r["count"] for r in hosts if r.host in blocked) / sum(r["count"] for r in hosts)
    assert urls.SEED_LOG_ODDS + math.log(share / (1 - share)) < 0


def test_segmentation():
    p = {"casino": -3.0, "win": -4.0, "online": -4.0}
    assert urls.segment("casinowinonline", p, -9.0) == ["casino", "win", "online"]
    assert urls.segment("qzx", p, -9.0) == ["qzx"] and urls.segment("", p, -9.0) == []


def test_segmentation_against_all_splits():
    rng = random.Random(2)
    known = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): -rng.random() * 9 for _ in range(14)}
    unknown = -11.0
    price = lambda w: known[w] if w in known else unknown - len(w) * math.log(10)
    for _ in range(60):
        label = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        splits = [[label[i:j] for i, j in itertools.pairwise([0, *cuts, len(label)])] for k in range(len(label)) for cuts in itertools.combinations(range(1, len(label)), k)]
        best = max(sum(map(price, words)) for words in splits)
        assert math.isclose(sum(map(price, urls.segment(label, known, unknown))), best)


def test_verdicts_of_naive_bayes_that_no_seed_word_decides(spark):
    data = [f"http://casino-lucky-{w}.example.org/spin/{i}" for i in range(40) for w in ("star", "wheel")]
    data += [f"http://luckywheel.example.org/spin/{i}" for i in range(3)]
    data += [f"http://adult-education-school.example.org/course/{i}" for i in range(3)]
    data += [f"http://education-school{i % 5}.example.org/course/{i}" for i in range(120)]
    table = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    found = {r.page_id: r for r in urls.judge(table).collect()}
    verdicts = {}
    for i, url in enumerate(data):
        verdicts.setdefault(found[i].host, set()).add(found[i].verdict)
    assert verdicts["casino-lucky-star.example.org"] == {"block"} and verdicts["education-school0.example.org"] == {"allow"}
    assert verdicts["luckywheel.example.org"] == {"block"}  # no seed word
    assert verdicts["adult-education-school.example.org"] == {"allow"}  # a seed word
    # The same scores by plain counting.
    words = {i: [w for w in re.findall("[a-z]+", found[i].host.replace("luckywheel", "lucky-wheel"))] for i in found}
    seeds = {i: sum(w in urls.SEED_WORDS for w in words[i]) for i in found}
    tokens = {i: [w for w in words[i] if w not in urls.SEED_WORDS] + ["0"] * len(re.findall("[0-9]+", found[i].host)) + ["/" + t for t in re.findall("[a-z]+", found[i].path)] + ["/0"] for i in found}
    labels, score = {i: seeds[i] > 0 for i in found}, {}
    for _ in range(urls.ROUNDS):
        counts = [collections.Counter(t for i in found if labels[i] == c for t in tokens[i]) for c in (False, True)]
        seen, vocabulary = collections.Counter(labels.values()), len(counts[0] | counts[1])
        weight = lambda t: math.log((counts[1][t] + 0.1) / (counts[1].total() + 0.1 * (vocabulary + 1))) - math.log((counts[0][t] + 0.1) / (counts[0].total() + 0.1 * (vocabulary + 1)))  # noqa: B023, E731
        score = {i: math.log(seen[True] / seen[False]) + sum(map(weight, tokens[i])) + seeds[i] * urls.SEED_LOG_ODDS for i in found}
        labels = {i: score[i] > 0 for i in found}
    assert all(math.isclose(found[i].log_odds, score[i], abs_tol=1e-6) for i in found)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="ad-free"><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="box"><p>Shared box</p></div><!-- x --><article><h1>Title {0} &amp; more</h1><p><b>First   {0}<br>line<p>Second &#233;&nbsp;x</p>
<div class="comments"><p>nice</p></div><form><input><label>Mail</label></form></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_html_extraction(spark):
    pages = [(i, f"http://h.example.com/{i}", PAGE.format(i)) for i in range(8)]
    plain = [(20 + i, f"http://p.example.org/{i}", f"<body><div class=x><p>Recurring line</p></div><div><p>Own text {i}</p>tail {i}</div>") for i in range(8)]
    odd = [(40, None, None), (41, "http://q/", ""), (42, "http://q/", "just &lt;text"), (43, "http://q/", "<article><p>cut <a hre"), (44, "http://q/", "<p>" * 3000 + "deep")]
    table = spark.createDataFrame([(*r, "n") for r in pages + plain + odd], "page_id long, url string, html string, text string")
    for limit in (html.BROADCAST_SUBTREES, 0):
        found = {r.page_id: r for r in html.extract_text(table, limit).collect()}
        for i in range(8):
            assert found[i].text == f"Title {i} & more\nFirst {i} line\nSecond é x"
            assert found[20 + i].text == f"Own text {i}\ntail {i}"
        assert [found[i].text for i in range(40, 45)] == ["", "", "just <text", "cut", "deep"]
        assert all(r.n_chars == len(r.text) for r in found.values())
    assert html.extract_text(table.limit(0)).count() == 0


def test_text_removed_by_one_rule_only():
    assert html.extract(html.parse('<main><div id="related-posts">r</div><p hidden>h</p><p style="display: none">n</p><p>kept</p></main>'))[0] == "kept"


def test_classes_that_only_mention_what_is_dropped():
    for opening in ('<article class="post has-sidebar" id="social-policy">', '<div class="no-sidebar ad-free">', '<div class="content-with-sidebar"><main>'):
        assert html.extract(html.parse(f"<body>{opening}<p>kept</p>"))[0] == "kept"
    for opening in ('<div class="site-nav">', '<div class="x cookie-banner">', '<div id="comments">'):
        assert html.extract(html.parse(f"<body>{opening}<p>gone</p></div><p>kept</p>"))[0] == "kept"


SITE = """<body><div class="m1"><ul><li>Start<li>Shop</ul></div><div class="m2">Find us in {1}</div><div><h2>Part {0}</h2><p>Text {0} of many</p><p>Ends {0}</p></div><div class="m3"><p>All rights</p></div></body>"""


def test_templates_are_found_by_counting_alone(spark, monkeypatch):
    # No kind, role or class tells these menus and notices. The notice has two wordings, each on half of the pages, and each of three sections a menu of its own.
    own = lambda i: SITE.format(i, "Rome" if i % 2 else "Oslo").replace("Shop", f"Shop {i % 3}")
    pages = [(i, f"http://big.example.org/{i}", own(i)) for i in range(30)] + [(100 + i, f"http://few.example.org/{i}", SITE.format(i, "Rome")) for i in range(3)]
    pages += [(200, "http://big.example.org/0", own(0))]  # a copy, which counts once
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in html.extract_text(table).collect()}
    for i in range(30):
        assert (found[i].text, found[i].n_templates) == (f"Part {i}\nText {i} of many\nEnds {i}", 3)
    assert found[100].n_templates == 0 and found[100].text.startswith("Start\nShop\nFind us in Rome")
    # The counts by brute force.
    counts = collections.Counter(k for i in range(30) for k in html.subtree_keys(html.parse(own(i)))[0])
    template = {k for k, n in counts.items() if n >= html.MIN_PAGES + math.log2(30)}
    assert all(n < 20 for k, n in counts.items() if k in html.subtree_keys(html.parse('<body><div class="m2">Find us in Rome</div>'))[0])
    assert all(html.extract(html.parse(own(i)), template) == (found[i].text, 3) for i in range(30))
    monkeypatch.setattr(html, "MIN_PAGES", 1000)  # without the method
    assert all(r.text.startswith("Start\nShop") for r in html.extract_text(table).collect())


def test_copies_of_an_article_count_once(spark):
    # Twenty pages show one article, with a few lines below it that differ from page to page only in their number.
    page = "<body><div><p>Line of site {0}</p></div><article><p>{1}</p></article><div><p>Below</p></div></body>"
    same = [(i, f"http://c.example.org/{i}", page.format(i, "One article")) for i in range(20)]
    table = spark.createDataFrame(same, "page_id long, url string, html string")
    assert all((r.text, r.n_templates) == ("One article", 0) for r in html.extract_text(table).collect())
    others = spark.createDataFrame([(i, f"http://c.example.org/{i}", page.format(i, f"Article {i}")) for i in range(20)], "page_id long, url string, html string")
    assert all(r.n_templates == 1 for r in html.extract_text(others).collect())


@pytest.mark.parametrize(
    "page",
    ["<b>" * 400_000 + "</i>" * 400_000 + "x", "<b>" * 400_000 + "<hr>" * 400_000 + "x", "<p><span>" * 200_000 + "<div></p>" * 200_000 + "x", "<ul><li>" * 200_000 + "</em>" * 200_000 + "x", "<a \">\"'" * 200_000 + "x", "<!-- " * 400_000, "<script>" * 400_000, "<td><b>" * 200_000 + "<tr>" * 200_000 + "x"],
    ids=lambda p: p[:9],
)
def test_broken_pages_are_parsed_in_linear_time(page):
    began = time.process_time()
    root = html.parse(page)
    assert time.process_time() - began < 5
    html.extract(root)


def test_nearest_open_elements_are_closed():
    lines = lambda page: html.extract(html.parse(page))[0].split("\n")
    assert lines("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>") == ["a", "b", "c", "d", "e"]
    assert lines("<p>a<p>b<div>c<p>d</div>e") == ["a", "b", "c", "d", "e"]
    assert lines("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f") == ["a", "b", "c", "d", "e", "f"]
    assert lines("<p>a <b>b <i>c</b> d</i> e</p></x>f") == ["a b c d e", "f"]
    assert lines("<a title='>'>x</a> y <a \"> z <b>w") == ["x y z w"]


def test_shared_headings_and_phrases_of_div_pages_are_kept():
    page = "<body><div><p>Site line</p></div><div><h2>Abstract</h2><p><b>Note</b> that page {0} says {0} things</p></div></body>"
    roots = [html.parse(page.format(i)) for i in range(8)]
    shared = set.intersection(*(html.subtree_keys(r)[0] for r in roots))
    assert len(shared) == 3  # the first div, its line and the heading, but not the inline note
    assert [html.extract(r, shared)[0] for r in roots] == [f"Abstract\nNote that page {i} says {i} things" for i in range(8)]
