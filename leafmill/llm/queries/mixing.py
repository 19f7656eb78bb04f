"""Mix of the documents' sources (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ...session import table
from ..mixing import mix_shares, mix_sources


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of the mix, in its order."""
    return mix_sources(table(spark, directory, "documents"), table(spark, directory, "mix_targets")).orderBy("position")


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    targets = table(spark, directory, "mix_targets")
    return mix_shares(mix_sources(table(spark, directory, "documents"), targets), targets)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
