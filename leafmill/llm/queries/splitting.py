"""Splitting of oversized documents (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...session import table
from ..splitting import split_oversized


def p9_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every oversized document."""
    return split_oversized(table(spark, directory, "documents"), table(spark, directory, "split_limits"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return p9_pieces(spark, directory).where("piece_no = 1").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_pieces": p9_pieces}
SQL = {
    "p9_found": r"""SELECT doc_id FROM documents JOIN split_limits USING (doc_kind)
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+')) > max_tokens""",
}
