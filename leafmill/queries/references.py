"""Orphan references of the evidence tables (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import PARENTS, REFERENCES, evidence_references, orphan_references, orphan_report
from ..session import table


def _inputs(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    names = {spec.table for spec in REFERENCES} | {name for name, *_ in PARENTS}
    return evidence_references({name: table(spark, directory, name) for name in names})


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return orphan_references(*_inputs(spark, directory)).select("ref_table", "ref_field", "row_id")


def p2_report(spark: SparkSession, directory: str) -> DataFrame:
    refs, periods = _inputs(spark, directory)
    return orphan_report(refs, orphan_references(refs, periods))


def _key(column: str) -> str:
    around = rf"regexp_replace(lower({column}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
    resolver = rf"regexp_replace({around}, '^(https?://)?(www\.|dx\.)?(doi\.org|arxiv\.org/(abs|pdf|html))/', '')"
    scheme = rf"regexp_replace({resolver}, '^(info:)?(doi|arxiv)[:/]\s*', '')"
    return rf"regexp_replace({scheme}, '^(\d{{4}}\.\d{{4,5}}|[a-z.-]+/\d{{7}})(v\d+)?(\.pdf)?$', '\1')"


_ORPHANS = f"""
refs AS (
  SELECT 'chunks' ref_table, 'citation_key' ref_field, 'bib_entries' parent, row_id, {_key('citation_key')} k, CAST(created_at[1:10] AS DATE) d FROM chunks
  UNION ALL SELECT 'chunks', 'doc_id', 'manifests', row_id, {_key('doc_id')}, CAST(created_at[1:10] AS DATE) FROM chunks
  UNION ALL SELECT 'edge_items', 'canonical_id', 'vocab_terms', edge_id, {_key('canonical_id')}, CAST(planned_at AS DATE) FROM edge_items
), live AS (SELECT * FROM refs WHERE k <> ''),
periods AS (
  SELECT 'bib_entries' parent, {_key('id')} k, CAST(added_at AS DATE) a, CAST(deleted_at AS DATE) z FROM bib_entries
  UNION ALL SELECT 'manifests', {_key('doc_id')}, CAST(created_at[1:10] AS DATE), CAST(removed_at[1:10] AS DATE) FROM manifests
  UNION ALL SELECT 'vocab_terms', {_key('canonical_id')}, CAST(added_at AS DATE), CAST(retired_at AS DATE) FROM vocab_terms
), firsts AS (SELECT parent, k, min(a) first_day FROM periods GROUP BY ALL),
orphans AS (
  SELECT r.*, CASE WHEN f.k IS NULL THEN 'never' WHEN d < first_day THEN 'not_yet' ELSE 'gone' END reason
  FROM live r LEFT JOIN firsts f ON r.parent = f.parent AND r.k = f.k
  WHERE NOT EXISTS (SELECT 1 FROM periods p WHERE p.parent = r.parent AND p.k = r.k AND a <= d AND (z IS NULL OR d < z))
)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": f"WITH {_ORPHANS} SELECT ref_table, ref_field, row_id FROM orphans",
    "p2_report": f"""WITH {_ORPHANS}, o AS (
        SELECT ref_table, ref_field, strftime(d, '%Y-%m') period, count(*) n, count(*) FILTER (reason = 'never') v, count(*) FILTER (reason = 'not_yet') y, count(*) FILTER (reason = 'gone') g FROM orphans GROUP BY ALL)
        SELECT r.ref_table, r.ref_field, r.period, CAST(r.n AS BIGINT) n_refs, coalesce(o.n, 0) n_orphans, coalesce(v, 0) n_never, coalesce(y, 0) n_not_yet, coalesce(g, 0) n_gone
        FROM (SELECT ref_table, ref_field, strftime(d, '%Y-%m') period, count(*) n FROM live GROUP BY ALL) r LEFT JOIN o USING (ref_table, ref_field, period)""",
}
