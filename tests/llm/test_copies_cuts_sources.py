"""Exact duplicates, fill-in-middle and the source audit against plain Python on small tables with nulls, empty and long texts, ties and clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from fathomflow.llm import exact_dedup, infill, radix, source_audit

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, row string, key string, n string, form string, output string, word long, open string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["river", "House", "WATER", "über", "ÜBER", "naïve", "日本語", "x1y2", "😀", "it's", "a_b", "tail\t", "end\n\n"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    texts = [None, "", "", " ", base, base.upper(), base.translate(FOLD), "Straße", "STRASSE", "ÉTÉ", "été", "É", "é", "\x00\x01", "<P>a", "b<S>", "<M>", "a < b <S", ">", "😀" * 3000, "\n" * 50, "ab\n" * 4000, "one"]
    texts += [prose(rng.randrange(1, 80)) for _ in range(60)] + [base] * 30
    out = [(i, t, ["en", "de", None, "", "solo"][i % 5 if i % 7 else 0], f"s{i % 4}" if i % 6 else None) for i, t in enumerate(texts)]
    out += [(None, base, "en", "s1"), (None, "lone", "en", "s9"), (None, "pair", "xx", "s1"), (None, "Pair", "xx", "s1"), (4, base, "en", "s0"), (200, "twice", "en", "s0"), (200, "TWICE", "en", "s0"), (200, "twice", "en", "s0")]
    return [x for i, x in enumerate(out) if not (x[2] == "solo" and x[3] != "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('cuts')}/documents"
    spark.createDataFrame([(*r, f"r{i}", "k", "n", "f", "o", i, "w") for i, r in enumerate(rows)], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/documents"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 1024])
def test_copies(docs, rows, max_bits):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(d)
    found = exact_dedup.copies(docs, max_bits).collect()
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in groups.items()}
    want = collections.Counter((d, last[k := (t or "").translate(FOLD)], len(groups[k]), sha(k)) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("hot_groups", [exact_dedup.HOT_GROUPS, 4])
def test_keep_last_keeps_columns(docs, rows, hot_groups, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot_groups)
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted((r.text or "").translate(FOLD) for r in found) == sorted({(t or "").translate(FOLD) for _, t, *_ in rows})
    assert all(r.row == f"r{r.word}" and rows[r.word][:2] == (r.doc_id, r.text) for r in found)


def test_filter_lets_single_texts_pass(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', if(id < 200, id div 2, id)) AS text").write.parquet(f"file://{tmp_path}/docs")
    keys = exact_dedup._keyed(spark.read.parquet(f"file://{tmp_path}/docs")).cache()
    found, words = exact_dedup.repeat_filter(keys, 20_000)
    held = {r.word: r.mask for r in found.collect()}
    given = keys.select("doc_id", exact_dedup._word(keys.key, words).alias("word"), exact_dedup._mask(keys.key).alias("own")).collect()
    open_ids = {r.doc_id for r in given if held.get(r.word, 0) & r.own == r.own}
    assert set(range(200)) <= open_ids and len(open_ids) < 500


UNITS = {infill.CODE_POINT: r"(?s:.)", infill.WORD: r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", infill.LINE: r"[^\n]*\n|[^\n]+"}


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("run", [3, infill.RUN])
def test_infill(docs, rows, unit, run):
    found = infill.infill(docs, unit, run)
    assert sorted(found.columns) == sorted([c for c in docs.columns if c not in ("n", "form", "output")] + ["n", "form", "prefix_chars", "middle_chars", "output"])
    found = {r.word: r for r in found.withColumn("back", infill.restored(found.form, found.output)).collect()}
    assert len(found) == len(rows)
    for i, (doc_id, text, *_) in enumerate(rows):
        got, given = found[i], text or ""
        parts = re.findall(UNITS[unit], given)
        digits = sha(f"1:{'null' if doc_id is None else doc_id}")
        h = [int(digits[8 * j : 8 * j + 8], 16) for j in range(4)]
        a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
        prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
        form = "plain" if not given or any(m in given for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": given, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
        assert (got.doc_id, got.text, got.n, got.form, got.prefix_chars, got.middle_chars, got.output, got.back) == (doc_id, text, len(parts), form, *lengths, output, given)


def test_infill_of_a_long_text_in_every_unit(spark, tmp_path):
    text = "word 日本\n" * 200_000
    spark.createDataFrame([(5, text)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/docs")
    for unit in UNITS:
        made = infill.infill(spark.read.parquet(f"file://{tmp_path}/docs"), unit)
        found = made.withColumn("back", infill.restored(made.form, made.output)).first()
        assert found.back == text and found.n == len(re.findall(UNITS[unit], text))


def audited(rows):
    """The audit by its definition."""
    counts, docs_of, sources = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        counts[lang, source].update(words)
        docs_of[lang].update(set(words))
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in docs_of[lang].items() if n >= 3)
        whole = collections.Counter()
        for s in names:
            whole.update(counts[lang, s])
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        share, q = {s: shares(counts[lang, s]) for s in names}, shares(whole)
        for s in names:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(f(share[s][t], q[t]), t) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_audit(docs, rows, small, monkeypatch):
    if small:
        for name, value in (("BLOCK", 2), ("BUCKET", 3), ("HELD_ROWS", 10)):
            monkeypatch.setattr(source_audit, name, value)
    found = source_audit.audit(docs)
    assert sorted(map(tuple, found.collect())) == audited(rows)


def test_corrections_in_small_steps(monkeypatch):
    rng = random.Random(2)
    rows = sorted({(rng.randrange(9), f"t{rng.randrange(40)}") for _ in range(200)}, key=lambda x: rng.random())
    table = pa.table({"place": [a for a, _ in rows], "term": [t for _, t in rows], "p": [rng.randrange(50, 900) for _ in rows], "p0": [20 + a for a, _ in rows]})
    whole = [x.tolist() for x in source_audit._corrections(table, False, 128)]
    monkeypatch.setattr(source_audit, "TOGETHER", 7)
    assert [x.tolist() for x in source_audit._corrections(table, False, 128)] == whole and len(whole[0]) == 72


@pytest.mark.parametrize(("k", "sortable"), [(5, 1), (40, 3), (200, radix.SORTABLE)])
def test_top_k(spark, k, sortable, tmp_path):
    rng = random.Random(k)
    long = "prefix that all of them share " * 5
    rows = [("a", rng.choice([7, 7, 7, 8]), long + "".join(rng.choice("aé日😀") for _ in range(rng.randrange(9))) + str(i)) for i in range(300)]
    rows += [("b", rng.randrange(10**18), f"t{i}") for i in range(300)] + [("c", 0, "x"), ("d", 3, ""), ("d", 3, "a"), ("d", 2**61, "b")] + [("e", 1, "same")] * 12
    rows += [("f", 10**6 + i % 3, f"{i % 50}") for i in range(200)] + [(None, 1, "no group")]
    spark.createDataFrame(rows, "g string, v long, t string").repartition(3).write.parquet(f"file://{tmp_path}/rows")
    found = collections.defaultdict(list)
    for r in radix.top_k(spark.read.parquet(f"file://{tmp_path}/rows").where("g is not null"), ["g"], "v", "t", k, sortable).collect():
        found[r.g].append((r["rank"], r.value, r.item))
    for g in "abcdef":
        want = sorted(((v, t) for x, v, t in rows if x == g), key=lambda x: (-x[0], x[1].encode()))[:k]
        assert [(v, t) for _, v, t in sorted(found[g])] == want and [r for r, *_ in sorted(found[g])] == list(range(1, len(want) + 1))


def test_empty_tables(none):
    assert exact_dedup.copies(none).count() == exact_dedup.keep_last(none).count() == infill.infill(none).count() == infill.infill_digests(none).count() == source_audit.audit(none).count() == 0
