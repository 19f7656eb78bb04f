"""Surviving values of duplicate import candidates (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import table
from ..fusion import learnt_order, surviving_members, surviving_records, surviving_values


def _survivors(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    return surviving_values(*(table(spark, directory, name) for name in ("import_candidates", "bib_changes", "import_sources")))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return surviving_members(*_survivors(spark, directory))


def p5_records(spark: SparkSession, directory: str) -> DataFrame:
    return surviving_records(_survivors(spark, directory)[0])


def p5_undated(spark: SparkSession, directory: str) -> DataFrame:
    """The surviving values if no time of import were known: currency and trust alone decide."""
    candidates = table(spark, directory, "import_candidates").withColumn("imported_at", F.lit(None).cast("timestamp"))
    return surviving_values(candidates, table(spark, directory, "bib_changes"), table(spark, directory, "import_sources"))[0]


def p5_learnt_order(spark: SparkSession, directory: str) -> DataFrame:
    """Which values regularly replace which, learnt from the timestamped changes."""
    return learnt_order(table(spark, directory, "bib_changes"))


_STEP = """CASE WHEN suffix({0}, {1}) THEN 'prefix' WHEN starts_with({0}, {1}) THEN 'suffix' ELSE 'pair' END kind,
    CASE WHEN suffix({0}, {1}) THEN left({0}, length({0}) - length({1})) WHEN starts_with({0}, {1}) THEN substr({0}, length({1}) + 1) ELSE {0} END old,
    CASE WHEN suffix({0}, {1}) OR starts_with({0}, {1}) THEN '' ELSE {1} END new"""
QUERIES = {"p5_found": p5_found, "p5_records": p5_records, "p5_undated": p5_undated, "p5_learnt_order": p5_learnt_order}
SQL = {
    "p5_learnt_order": f"""WITH told AS (SELECT DISTINCT field, old_value, new_value FROM bib_changes WHERE old_value <> new_value AND trim(old_value) <> '' AND trim(new_value) <> '' AND changed_at IS NOT NULL),
      forth AS (SELECT field, {_STEP.format("old_value", "new_value")} FROM told), back AS (SELECT field, {_STEP.format("new_value", "old_value")} FROM told),
      n AS (SELECT field, kind, old, new, count(*) n FROM forth GROUP BY ALL), m AS (SELECT field, kind, old, new, count(*) m FROM back GROUP BY ALL)
      SELECT field, kind, old, new FROM n LEFT JOIN m USING (field, kind, old, new) WHERE n >= 5 AND n >= 4 * coalesce(m, 0)"""
}
