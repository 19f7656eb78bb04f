"""Evaluation items leaked into the documents (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import table
from ..leakage import leaked_items


def p7_leaks(spark: SparkSession, directory: str) -> DataFrame:
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return p7_leaks(spark, directory).select("doc_id", "item_id")


def p7_items(spark: SparkSession, directory: str) -> DataFrame:
    """Which items leaked, into how many documents and how fully at most."""
    leaks = p7_leaks(spark, directory)
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max("share"), 4).alias("max_share"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
