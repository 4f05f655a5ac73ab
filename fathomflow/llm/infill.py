"""Fill-in-middle transformation with relational units.

A text is tiled by units (code points, words with the space behind them, or lines). Runs of up to RUN units are matched and
exploded with their positions; running sums over them give each run its first unit and its first character. A document asks
for two cuts by unit ordinal; the requests join the runs by ordinal, the offsets found are gathered per document, and the
text is cut by substring. A cut's last step is taken inside of its run, which is short.

Runs are exploded where the texts are read, and only their lengths are shuffled, 24 bytes a run; a text's lengths go to one window. Texts
that are cut are shuffled once, to their offsets, which number as many as the texts do; texts that stay plain are not.

Form and cuts depend on the seed and the document's id alone: of the eight-digit groups of the SHA-256 of ``seed:doc_id``, the
first two are cuts modulo the number of units plus one, the third leaves PLAIN_PERCENT of documents as they are, the fourth
puts SPM_PERCENT of the others suffix first.

Defined results: a null text equals an empty one and stays plain, as do texts that hold a mark themselves; a null id counts as
the text ``null``, so rows without an id share their digits, not their cuts; rows that share an id are rows of their own;
cuts may fall on either end or on each other and then leave empty parts; columns of any name are left as they are; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written


#: Patterns that tile any text.
CODE_POINT = r"(?s:.)"
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"
LINE = r"[^\n]*+\n|[^\n]++"
RUN = 2048
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
PLAIN_PERCENT = 10
SPM_PERCENT = 20


def _digits(doc_id: Column, seed: str, place: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def _units(text: Column, unit: str) -> Column:
    return (F.char_length(text) if unit == CODE_POINT else F.regexp_count(text, F.lit(unit))).cast("long")


def _runs(numbered: DataFrame, unit: str, run: int) -> DataFrame:
    """(row, doc_id, run, chars, first_unit, first_char, n) of each run of up to ``run`` units of a text that is not empty; n is the text's number of units."""
    matches = numbered.select("row", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{run}}}+"), F.lit(0))).alias("run", "piece"))
    sized = matches.select("row", "doc_id", "run", _units(F.col("piece"), unit).alias("units"), F.char_length("piece").cast("long").alias("chars"))
    text = Window.partitionBy("row")
    before = text.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumns({"first_unit": F.sum("units").over(before) - F.col("units"), "first_char": F.sum("chars").over(before) - F.col("chars"), "n": F.sum("units").over(text)})
    return written(summed.drop("units"), "unit-runs")


def _offsets(runs: DataFrame, run: int, seed: str) -> DataFrame:
    """(row, n, cut0, cut1): the units of each text, and for both cuts where their run begins, how long it is and how many of its units stand before the cut."""
    first, second = (_digits(F.col("doc_id"), seed, i) % (F.col("n") + 1) for i in (1, 2))
    requests = runs.where("run = 0").select("row", "n", F.posexplode(F.array(F.least(first, second), F.greatest(first, second))).alias("cut", "ordinal"))
    # Every run but the last has `run` units, so an ordinal names its run; the end of a text belongs to the last one.
    placed = requests.withColumn("run", F.floor(F.least(F.col("ordinal"), F.col("n") - 1) / run).cast("int"))
    found = placed.join(runs.select("row", "run", "first_unit", "first_char", "chars"), ["row", "run"])
    rest = F.col("ordinal") - F.col("first_unit")
    at = lambda i, value: F.max(F.when(F.col("cut") == i, value))
    return found.groupBy("row").agg(F.max("n").alias("n"), *(at(i, value).alias(f"{name}{i}") for i in (0, 1) for name, value in (("begin", F.col("first_char")), ("chars", F.col("chars")), ("rest", rest))))


def _chars_before(cut: int, unit: str) -> Column:
    """Characters before a cut."""
    begin, rest = F.col(f"begin{cut}"), F.col(f"rest{cut}")
    if unit == CODE_POINT:
        return begin + rest
    piece = F.substring(F.col("text"), begin.cast("int") + 1, F.col(f"chars{cut}").cast("int"))
    return begin + F.char_length(F.call_function("regexp_extract", piece, F.concat(F.lit(f"^(?:{unit}){{"), rest.cast("string"), F.lit("}+")), F.lit(0)))


def infill(docs: DataFrame, unit: str = CODE_POINT, run: int = RUN, seed: str = SEED) -> DataFrame:
    """All columns of a table of files (doc_id, text), which is read three times, with n (units), form, prefix_chars, middle_chars (code points; null where plain) and output, the
    transformed text. Given columns of these names make place for the new ones; ``text`` stays."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    text = F.coalesce("text", F.lit(""))
    third, fourth = (_digits(F.col("doc_id"), seed, i) % 100 for i in (3, 4))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (third >= 100 - PLAIN_PERCENT), "plain").when(fourth < SPM_PERCENT, "spm").otherwise("psm")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", form.alias("form"), F.struct(*(c for c in docs.columns if c != "text")).alias("doc"))
    kept = [(F.col("text") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns if c.lower() not in names]

    plain = numbered.where("form = 'plain'")
    none = F.lit(None).cast("long")
    same = plain.select(*kept, _units(text, unit).alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), text.alias("output"))

    asked = numbered.where("form <> 'plain'")
    offsets = _offsets(_runs(asked.select("row", "doc_id", "text"), unit, run), run, seed)
    joined = asked.join(offsets.hint("shuffle_hash"), "row").withColumns({"at": _chars_before(0, unit).cast("int"), "to": _chars_before(1, unit).cast("int")})
    text, at, to = F.col("text"), F.col("at"), F.col("to")
    parts = joined.withColumns({"prefix": F.substring(text, F.lit(1), at), "middle": F.substring(text, at + 1, to - at), "suffix": F.substring(text, to + 1, F.char_length(text))})
    psm, spm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix"), F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix")
    output = F.concat(F.when(F.col("form") == "psm", psm).otherwise(spm), F.lit(MIDDLE), F.col("middle"))
    cut = parts.select(*kept, "n", "form", at.cast("long").alias("prefix_chars"), (to - at).cast("long").alias("middle_chars"), output.alias("output"))
    return same.unionByName(cut)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No mark can arise where parts meet: each begins with < and ends with >, and has neither inside."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each document, cut at code points."""
    made = infill(docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
