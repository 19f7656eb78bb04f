"""BibTeX files as tables and back.

A file is parsed as one row, and files are read in parallel. Fields keep their order as an array of (k, v). Quotes count
only at the outer level of an entry; an entry that never closes is kept aside instead of hiding those after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, pos int, entrytype string, id string, fields array<struct<k:string,v:string>>, problem string"
_HEAD = re.compile(r"@\s*([A-Za-z]+)\s*\{\s*([^,\s{}]*)\s*,?")
_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*")


def _value(text: str, at: int) -> tuple[str, int]:
    """The value that starts at a place, without one layer of braces or quotes, and the place after it."""
    if at < len(text) and text[at] == "{":
        depth = 0
        for i in range(at, len(text)):
            if text[i] == "\\":
                continue
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[at + 1 : i].strip(), i + 1
        raise ValueError("a value isn't closed")
    if at < len(text) and text[at] == '"':
        depth = 0
        for i in range(at + 1, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if text[i] == '"' and not depth and text[i - 1] != "\\":
                return text[at + 1 : i].strip(), i + 1
        raise ValueError("a value isn't closed")
    found = re.compile(r"[^,}\n]*").match(text, at)
    return found[0].strip(), found.end()


def parse(text: str) -> Iterator[tuple[str, str, list[tuple[str, str]], str | None]]:
    """(entry type, id, fields, problem) of each entry of a BibTeX text; comments, preambles and strings are passed over."""
    at = 0
    while found := _HEAD.search(text, at):
        at, kind = found.end(), found[1].lower()
        if kind in ("comment", "preamble", "string"):
            continue
        fields: list[tuple[str, str]] = []
        try:
            while (name := _FIELD.match(text, at)) is not None:
                value, at = _value(text, name.end())
                fields.append((name[1].lower(), value))
            yield kind, found[2], fields, None
        except ValueError as error:
            yield kind, found[2], fields, str(error)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all BibTeX files under a path; ``problem`` tells why an entry is incomplete."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_bibtex(files, "path", "value")


def parse_bibtex(df: DataFrame, key: str, text: str) -> DataFrame:
    """The entries in a column of BibTeX texts, numbered from 1 in each."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, kind, name, [{"k": a, "v": b} for a, b in fields], problem) for k, value in frame.itertuples(index=False, name=None) for i, (kind, name, fields, problem) in enumerate(parse(value or ""), 1)]
            yield pd.DataFrame(rows, columns=["path", "pos", "entrytype", "id", "fields", "problem"])

    return df.select(F.col(key).cast("string"), F.col(text)).mapInPandas(entries, SCHEMA)


def render(entrytype: Column, key: Column, fields: Column) -> Column:
    """An entry as BibTeX, fields in their order; empty ones are left out."""
    given = F.filter(fields, lambda x: F.coalesce(x["v"], F.lit("")) != "")
    lines = F.transform(given, lambda x: F.concat(F.lit("  "), x["k"], F.lit(" = {"), x["v"], F.lit("},\n")))
    return F.concat(F.lit("@"), entrytype, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ""), F.lit("}\n"))


def write_bibtex(entries: DataFrame, path: str) -> None:
    """Entries (entrytype, id, fields) as BibTeX files under a path, one for each partition."""
    entries.select(render(F.col("entrytype"), F.col("id"), F.col("fields")).alias("value")).write.text(path, lineSep="\n")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        import glob
        import os

        files = sorted(glob.glob(os.path.join(self.path, "**", "*.bib"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8-sig") as file:
            text = file.read()
        for i, (kind, key, fields, problem) in enumerate(parse(text), 1):
            yield partition.path, i, kind, key, fields, problem


class BibtexSource(DataSource):
    """``spark.read.format("bibtex").load(folder or pattern)`` on a file system that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BibtexSource)
