"""PDF pages from hand-made files: compression, object streams, trees, maps, and broken files."""

from __future__ import annotations

import zlib

import pytest

from fathomflow.sources import pdf


def made(*parts, tail=b"trailer << /Root 1 0 R >>\n%%EOF"):
    return b"%PDF-1.5\n" + b"\n".join(parts) + b"\n" + tail


def obj(number, dictionary, stream=None, packed=False):
    if stream is None:
        return b"%d 0 obj\n%s\nendobj" % (number, dictionary)
    body = zlib.compress(stream) if packed else stream
    return b"%d 0 obj\n<< /Length %d %s %s >>\nstream\n%s\nendstream\nendobj" % (number, len(body), b"/Filter /FlateDecode" if packed else b"", dictionary, body)


CATALOG = obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")
PAGE = b"<< /Type /Page /Parent 2 0 R /Contents %s >>"
MAP = b"2 beginbfchar <0001> <56E0> <0002> <5B50> endbfchar 1 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079007A>] endbfrange"

FILES = {
    "plain": made(CATALOG, obj(2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>"), obj(3, PAGE % b"5 0 R"), obj(4, PAGE % b"[6 0 R 7 0 R]"), obj(5, b"", b"BT /F1 12 Tf 72 700 Td (NBER Working Paper) Tj 0 -14 Td (A Study \\(of\\) Momentum\\041) Tj T* [(Mo) -20 (men) 3 (tum) -300 (pays)] TJ ET"), obj(6, b"", b"BT (second ) Tj", True), obj(7, b"", b"(page) Tj ET", True)),
    # Later objects replace earlier ones, the tree is nested and out of order in the file, and no trailer is left.
    "nested": made(obj(9, PAGE % b"12 0 R"), obj(2, b"<< /Type /Pages /Kids [4 0 R 9 0 R] >>"), obj(4, b"<< /Type /Pages /Parent 2 0 R /Kids [7 0 R 8 0 R] >>"), obj(8, PAGE % b"11 0 R"), obj(7, PAGE % b"10 0 R"), *[obj(10 + i, b"", b"BT (part %d) Tj ET" % i) for i in range(3)], CATALOG, obj(11, b"", b"BT (part one, new) Tj ET"), tail=b""),
    "mapped": made(CATALOG, obj(2, b"<< /Type /Pages /Kids [3 0 R] /Resources 8 0 R >>"), obj(3, PAGE % b"5 0 R"), obj(5, b"", b"BT /F1 9 Tf <00010002> Tj (q) Tj <00100011001200200021> Tj /F2 9 Tf (caf\\351) Tj ET"), obj(8, b"<< /Font 10 0 R >>"), obj(10, b"<< /F1 6 0 R /F2 7 0 R >>"), obj(6, b"<< /Type /Font /ToUnicode 9 0 R >>"), obj(7, b"<< /Type /Font >>"), obj(9, b"", MAP, True)),
    "packed": made(CATALOG, obj(20, b"/Type /ObjStm /N 2 /First 10", b"2 0 3 45 \n<< /Type /Pages /Kids [3 0 R] /Count 1 >>   " + PAGE % b"5 0 R", True), obj(5, b"", b"BT (from an object stream) Tj ET")),
    "cut": made(CATALOG, obj(2, b"<< /Type /Pages /Kids [3 0 R] >>"), obj(3, PAGE % b"5 0 R"), obj(5, b"", b"BT (" + b"word " * 400 + b") Tj ET (" + bytes(range(97, 123)) * 50 + b") Tj", True)[:-60], tail=b""),
    "empty": made(CATALOG, obj(2, b"<< /Type /Pages /Kids [3 0 R] >>"), obj(3, b"<< /Type /Page >>")),
    "locked": made(CATALOG, obj(2, b"<< /Type /Pages /Kids [3 0 R] >>"), obj(3, PAGE % b"5 0 R"), obj(5, b"", b"BT (secret) Tj ET"), tail=b"trailer << /Encrypt 9 0 R >>"),
    "loop": made(CATALOG, obj(2, b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>"), obj(3, PAGE % b"5 0 R"), obj(5, b"", b"BT (again) Tj ET")),
    "none": b"no document at all",
    "void": b"",
}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    for name, content in FILES.items():
        (folder / f"{name}.pdf").write_bytes(content)
    return pdf.read_pages(spark, f"{folder}/*.pdf", max_pages=3).cache()


def test_pages(pages):
    found = {(r.file.rsplit("/", 1)[1][:-4], r.page): r.text for r in pages.collect()}
    assert found["plain", 1] == "NBER Working Paper A Study (of) Momentum! Momentum pays" and found["plain", 2] == "second page"
    assert [found["nested", i] for i in (1, 2, 3)] == ["part 0", "part one, new", "part 2"]
    assert found["mapped", 1].replace(" ", "") == "因子qabcxyzcafé"
    assert found["packed", 1] == "from an object stream"
    assert found["empty", 1] == "" and found["loop", 1] == "again"
    assert not {n for n, _ in found} & {"locked", "none", "void"}
    assert ("cut", 1) in found


def test_titles_and_papers(pages):
    titles = {r.file.rsplit("/", 1)[1][:-4]: r.title for r in pages.where("page = 1").collect()}
    assert titles["plain"] == "A Study (of) Momentum!" and titles["packed"] == "from an object stream"
    assert pages.where("page > 1 and title <> ''").count() == 0
    found = {r.link.rsplit("/", 1)[1][:-4]: r for r in pdf.papers(pages).collect()}
    assert found["nested"].summary == "## Page 1\npart 0\n\n## Page 2\npart one, new\n\n## Page 3\npart 2"
    assert found["empty"].title == "empty" and found["empty"].summary == "" and len(found["plain"].source_id) == 16


def test_cut_streams_count_as_far_as_they_go():
    whole = zlib.compress(b"BT (abc) Tj ET " * 300)
    assert b"BT (abc) Tj ET" in pdf.inflated(b"/FlateDecode", whole[:-9]) and pdf.inflated(b"/FlateDecode", b"nonsense") == b""
