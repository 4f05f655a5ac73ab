"""Readers and sinks of record files: JSON documents and lines, text with unknown encoding, CSV, Markdown and HTML reports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030")


def read_json_documents(spark: SparkSession, pattern: str, schema: T.StructType, member: str = "papers") -> DataFrame:
    """Rows of JSON files that hold a list, or an object with a list under ``member``; broken files give no rows. Adds ``file``."""
    text = spark.read.text(pattern, wholetext=True).withColumn("file", F.input_file_name())
    rows = T.ArrayType(schema)
    as_list = F.from_json("value", rows)
    as_member = F.from_json("value", T.StructType([T.StructField(member, rows)]))[member]
    starts_list = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
    return text.select("file", F.explode(F.when(starts_list, as_list).otherwise(as_member)).alias("r")).select("r.*", "file").where(F.coalesce(*[F.col(f.name).isNotNull() for f in schema.fields]))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def decoded(content: Column) -> Column:
    """Bytes as text by the first encoding that fits."""

    def run(series):
        def one(raw):
            for name in ENCODINGS:
                try:
                    return bytes(raw).decode(name)
                except UnicodeDecodeError:
                    continue
            return None

        return series.map(one, na_action="ignore")

    return F.pandas_udf(run, T.StringType(), F.PandasUDFType.SCALAR)(content)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Appends rows as JSON lines, in folders by a column if one is named."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the first name carries the byte-order mark that spreadsheet programs look for."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _first_rows(df: DataFrame, limit: int) -> tuple[list, str]:
    """The first rows, and what to say where there are more."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], f"The first {limit} rows of {df.count()}." if len(rows) > limit else ""


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A Markdown table of the first rows of a report; a line below it says so if there are more."""
    found, more = _first_rows(df, limit)
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v).replace("|", "\\|") for v in r] for r in found]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n" + (f"\n{more}\n" if more else "")


def html_report(title: str, tables: dict[str, DataFrame], series: dict[str, Sequence[float]] | None = None, limit: int = 500) -> str:
    """A report page that needs no other file: tables of small aggregates (a line says where rows are left out), and series as embedded JSON drawn as lines."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        found, more = _first_rows(df, limit)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in found)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>" + (f"<p>{more}</p>" if more else ""))
    for name, values in (series or {}).items():
        lo, hi = min(values, default=0), max(values, default=1)
        points = " ".join(f"{600 * i / max(1, len(values) - 1):.1f},{200 - 200 * (v - lo) / ((hi - lo) or 1):.1f}" for i, v in enumerate(values))
        data = json.dumps(list(values)).replace("<", "\\u003c")
        parts.append(f'<h2>{html.escape(name)}</h2><svg viewBox="0 0 600 200"><polyline fill="none" stroke="black" points="{points}"/></svg><script type="application/json">{data}</script>')
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{"".join(parts)}</body></html>'
