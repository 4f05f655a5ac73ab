"""Text of PDF pages as a table of objects that is joined: pages come from the page tree, their texts from content streams, and characters from
font maps.

Objects are found by scanning a file for their marks, so missing or broken cross-reference tables do not matter; those inside of object streams are
unpacked, and of objects with one number the last in the file counts. Spark deals files to tasks and joins the tree, the streams and the maps;
Python reads single objects: their marks, the text operators of a stream, and character maps.

Defined results: a file that is no PDF, is encrypted or has no page tree gives no rows; a stream that cannot be inflated counts as far as it can; a page
without text has an empty one; characters without a map are taken as Latin-1; of a tree that loops only the first visit of MAX_DEPTH levels counts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

MAX_PAGES, MAX_DEPTH = 5, 32
# Beginnings of lines that are no title.
NO_TITLE = r"(?i)^(NBER\b|Working Paper|arXiv:|Submitted|Preprint|JEL No\.|\d+$|©)"

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:endobj|(?=\d+\s+\d+\s+obj\b)|\Z)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)(?:\r?\nendstream|endstream|\Z)", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_OBJECTS = "file string, number int, place int, dict string, stream binary"


def inflated(dictionary: bytes, stream: bytes) -> bytes:
    """A stream without its compression, as far as it goes."""
    if b"/FlateDecode" not in dictionary and b"/Fl " not in dictionary:
        return stream
    try:
        return zlib.decompressobj().decompress(stream)
    except zlib.error:
        decoder, out = zlib.decompressobj(), bytearray()
        for byte in stream:
            try:
                out += decoder.decompress(bytes([byte]))
            except zlib.error:
                break
        return bytes(out)


def objects(content: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(number, dictionary, stream) of all objects, those of object streams behind their own."""
    if not content.lstrip()[:5] == b"%PDF-" or re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        return
    for m in _OBJECT.finditer(content):
        found = _STREAM.search(m[2])
        dictionary = m[2][: found.start()] if found else m[2]
        stream = inflated(dictionary, found[1]) if found else None
        yield int(m[1]), dictionary, stream
        if stream is not None and b"/ObjStm" in dictionary and (first := re.search(rb"/First\s+(\d+)", dictionary)):
            heads = [int(x) for x in stream[: int(first[1])].split() if x.isdigit()]
            starts = [int(first[1]) + x for x in heads[1::2]]
            for number, a, b in zip(heads[::2], starts, [*starts[1:], len(stream)], strict=False):
                yield number, stream[a:b], None


def _objects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = [(number, place, dictionary.decode("latin-1"), stream) for place, (number, dictionary, stream) in enumerate(objects(content or b""))]
            for lo in range(0, len(rows), 256):
                part = list(zip(*rows[lo : lo + 256], strict=True))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(part[0]), pa.string()), *[pa.array(c, k) for c, k in zip(part, kinds, strict=True)]], names=["file", "number", "place", "dict", "stream"])


def character_map(stream: bytes) -> dict[int, str]:
    """Characters by code, of a map's single entries and ranges."""
    text = lambda h: bytes.fromhex(re.sub(r"\s", "", h.decode())).decode("utf-16-be", "replace")
    found: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        found |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, single, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            codes = range(int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF) + 1)
            if single:
                base = text(single)
                found |= {code: base[:-1] + chr(ord(base[-1]) + i) for i, code in enumerate(codes) if base}
            else:
                found |= {code: text(h) for code, h in zip(codes, re.findall(rb"<([0-9A-Fa-f\s]+)>", several), strict=False)}
    return found


def _shown(token: bytes, known: dict[int, str] | None) -> str:
    """The text of a string operand; codes have two bytes where the font's map has codes above 255 or all strings of it are hexadecimal pairs."""
    if token[:1] == b"(":
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])
    else:
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if known is None:
        return raw.decode("latin-1")
    if token[:1] == b"<" and len(raw) % 2 == 0 or max(known, default=0) > 255:
        return "".join(known.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
    return "".join(known.get(b, chr(b)) for b in raw)


def stream_text(stream: bytes, fonts: dict[str, dict[int, str]]) -> str:
    """What the text operators of a content stream show, with line ends where a new line is set."""
    out: list[str] = []
    held: list[bytes] = []
    known: dict[int, str] | None = None
    for m in _TOKEN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<[]/+-." or token[:1].isdigit():
            held.append(token)
            continue
        if token == b"Tf":
            names = [t for t in held if t[:1] == b"/"]
            known = fonts.get(names[-1][1:].decode("latin-1")) if names else None
        elif token in (b"T*", b"'", b'"', b"TD", b"Td", b"Tm") and out and (token not in (b"Td", b"TD") or held[-1:] not in ([b"0"], [b"0.0"], [b"-0"])):
            out.append("\n")
        elif token == b"ET":
            out.append("\n")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for t in held:
                if t[:1] in b"(<":
                    out.append(_shown(t, known))
                elif token == b"TJ" and t[:1] == b"-" and t[1:].replace(b".", b"").isdigit() and float(t) < -200:
                    out.append(" ")
        held.clear()
    return "".join(out)


def _page_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for streams, fonts in zip(batch.column("streams").to_pylist(), batch.column("fonts").to_pylist(), strict=True):
            maps = {f["name"]: character_map(f["map"]) for f in fonts or [] if f["map"]}
            # A page's streams are one: an operator's operands may stand in two.
            texts.append(stream_text(b"\n".join(s["stream"] for s in streams or [] if s["stream"]), maps))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("page"), pa.array(texts, pa.string())], names=["file", "page", "raw"])


def _refs(column, name: str):
    """Numbers of the objects that an entry refers to, in order."""
    entry = F.regexp_extract(column, rf"/{name}\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", 1)
    return F.transform(F.regexp_extract_all(entry, F.lit(r"(\d+)\s+\d+\s+R"), F.lit(1)), lambda x: x.cast("int"))


def _of_type(name: str):
    return F.rlike(F.col("dict"), F.lit(rf"/Type\s*/{name}\b"))


def read_pages(spark: SparkSession, path: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """(file, page, text, title): the first pages of each file, white space as one blank; the first page's first meaningful line is the title, others have none."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    table = written(files.mapInArrow(_objects, _OBJECTS), "pdf-objects")
    last = F.row_number().over(Window.partitionBy("file", "number").orderBy(F.desc("place")))
    table = written(table.withColumn("r", last).where("r = 1").drop("r", "place"), "pdf-objects")
    tree = table.where(_of_type("Pages") | _of_type("Page")).select("file", "number", "dict")
    roots = table.where(_of_type("Catalog")).select("file", F.explode(_refs(F.col("dict"), "Pages")).alias("number"), F.array(F.lit(0)).alias("path"), F.lit("").alias("inherited"))
    # One join a level: nodes become their children, whose order is that of their paths.
    level, leaves = roots, None
    for _ in range(MAX_DEPTH):
        level = written(level.join(tree, ["file", "number"]).withColumn("inherited", F.concat(F.col("dict"), F.lit("\n"), F.col("inherited"))), "pdf-level")
        here = level.where(_of_type("Page"))
        leaves = here if leaves is None else leaves.unionByName(here)
        level = level.where(_of_type("Pages")).select("file", "inherited", "path", F.posexplode(_refs(F.col("dict"), "Kids")).alias("at", "number")).select("file", "number", F.concat("path", F.array("at")).alias("path"), "inherited")
        if not level.limit(1).count():
            break
    order = F.row_number().over(Window.partitionBy("file").orderBy("path"))
    pages = written(leaves.withColumn("page", order).where(F.col("page") <= max_pages).select("file", "page", "dict", "inherited"), "pdf-pages")

    numbered = table.select("file", "number", F.col("dict").alias("other"), "stream")
    contents = pages.select("file", "page", F.posexplode(_refs(F.col("dict"), "Contents")).alias("at", "number")).join(numbered, ["file", "number"])
    # What is referred to may be an array of streams itself.
    direct = contents.select("file", "page", "at", F.lit(0).alias("within"), "stream").where("stream is not null")
    arrays = contents.where("stream is null").select("file", "page", "at", F.posexplode(F.transform(F.regexp_extract_all("other", F.lit(r"(\d+)\s+\d+\s+R"), F.lit(1)), lambda x: x.cast("int"))).alias("within", "number")).join(numbered.drop("other"), ["file", "number"]).drop("number")
    streams = direct.unionByName(arrays.select(direct.columns)).groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("at", "within", "stream"))).alias("streams"))

    # Resources and their fonts stand in the page, above it in the tree, or in objects of their own.
    named = pages.select("file", "page", F.col("inherited").alias("text"))
    resources = named.unionByName(pages.select("file", "page", F.explode(_refs(F.col("inherited"), "Resources")).alias("number")).join(numbered, ["file", "number"]).select("file", "page", F.col("other").alias("text")))
    lists = resources.unionByName(resources.select("file", "page", F.explode(_refs(F.col("text"), "Font")).alias("number")).join(numbered, ["file", "number"]).select("file", "page", F.concat(F.lit("/Font <<"), F.col("other"), F.lit(">>")).alias("text")))
    block = F.regexp_extract("text", r"(?s)/Font\s*<<(.*?)>>", 1)
    pairs = lists.select("file", "page", F.explode(F.regexp_extract_all(F.regexp_replace(block, "<<", ""), F.lit(r"/(\S+\s+\d+)\s+\d+\s+R"), F.lit(1))).alias("pair"))
    fonts = pairs.select("file", "page", F.split("pair", r"\s+")[0].alias("name"), F.split("pair", r"\s+")[1].cast("int").alias("number")).distinct().join(numbered, ["file", "number"])
    maps = fonts.select("file", "page", "name", F.explode(_refs(F.col("other"), "ToUnicode")).alias("number")).join(numbered.drop("other"), ["file", "number"])
    by_page = maps.groupBy("file", "page").agg(F.collect_list(F.struct("name", F.col("stream").alias("map"))).alias("fonts"))
    joined = pages.select("file", "page").join(streams, ["file", "page"], "left").join(by_page, ["file", "page"], "left")
    texts = joined.mapInArrow(_page_texts, "file string, page int, raw string")
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x).between(5, 200) & ~F.rlike(x, F.lit(NO_TITLE)))
    text = F.trim(F.regexp_replace("raw", r"\s+", " "))
    return texts.select("file", "page", text.alias("text"), F.when(F.col("page") == 1, F.coalesce(F.try_element_at(lines, F.lit(1)), F.substring(text, 1, 200))).otherwise("").alias("title"))


def papers(pages: DataFrame) -> DataFrame:
    """(source_id, title, summary, link) of files: pages under marks that chunks are cut at."""
    marked = F.when(F.col("text") != "", F.concat(F.lit("## Page "), F.col("page"), F.lit("\n"), F.col("text")))
    one = pages.groupBy("file").agg(F.max(F.when(F.col("page") == 1, F.col("title"))).alias("title"), F.array_sort(F.collect_list(F.struct("page", marked.alias("part")))).alias("parts"))
    name = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    return one.select(F.substring(F.md5("file"), 1, 16).alias("source_id"), F.coalesce(F.nullif(F.col("title"), F.lit("")), name).alias("title"), F.concat_ws("\n\n", F.transform("parts", lambda p: p["part"])).alias("summary"), F.col("file").alias("link"))
