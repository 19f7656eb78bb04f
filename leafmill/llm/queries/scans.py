"""Traces of scanned pages in the chunks (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...session import table
from ..scans import page_traces, repaired_text


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return page_traces(table(spark, directory, "chunks")).select("row_id", "line_no", "kind").distinct()


def p4_repaired(spark: SparkSession, directory: str) -> DataFrame:
    """Every chunk's text; those of scanned pages as continuous paragraphs."""
    return repaired_text(table(spark, directory, "chunks"))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}
