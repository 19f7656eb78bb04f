"""Mapping of typed terms to the vocabulary (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...session import table
from ..canonical import map_values, unmatched_values


def p6_mapping(spark: SparkSession, directory: str) -> DataFrame:
    return map_values(table(spark, directory, "entity_mentions"), table(spark, directory, "vocab_terms"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return p6_mapping(spark, directory).select("mention_id", "canonical_id")


def p6_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    return unmatched_values(table(spark, directory, "entity_mentions"), p6_mapping(spark, directory))


QUERIES = {"p6_found": p6_found, "p6_mapping": p6_mapping, "p6_unmatched": p6_unmatched}
SQL: dict[str, str] = {}
