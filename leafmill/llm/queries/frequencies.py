"""Term frequencies of the chunks (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import table
from ..ngrams import mark_terms, term_frequencies

FIELDS = ["text", "section_title"]


def _marked(spark: SparkSession, directory: str) -> DataFrame:
    chunks = table(spark, directory, "chunks")
    return mark_terms(term_frequencies(chunks, FIELDS), chunks.count())


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return _marked(spark, directory).where("n = 1 AND mark IS NOT NULL").select("field", "term", "mark")


def p1_frequencies(spark: SparkSession, directory: str) -> DataFrame:
    """Every term and pair of neighbouring terms with its counts and mark."""
    return _marked(spark, directory).withColumn("mark", F.coalesce("mark", F.lit("")))


_WORDS = " UNION ALL ".join(
    rf"SELECT '{field}' field, row_id, list_filter(list_transform(regexp_extract_all(lower({field}), '[\p{{L}}\p{{N}}_.+-]+'), lambda x: trim(x, '._+-')), lambda x: length(x) >= 2) w FROM chunks"
    for field in FIELDS
)
_COUNTS = f"""WITH words AS ({_WORDS}),
terms AS (SELECT field, row_id, unnest(w) term, 1 n FROM words UNION ALL SELECT field, row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM words),
counts AS (SELECT field, term, CAST(n AS INTEGER) n, count(*) occurrences, count(DISTINCT row_id) records FROM terms GROUP BY ALL),
marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN 5 * records > (SELECT count(*) FROM chunks) THEN 'common' ELSE '' END mark FROM counts)
"""
QUERIES = {"p1_found": p1_found, "p1_frequencies": p1_frequencies}
SQL = {"p1_found": _COUNTS + "SELECT field, term, mark FROM marked WHERE n = 1 AND mark <> ''", "p1_frequencies": _COUNTS + "SELECT * FROM marked"}
