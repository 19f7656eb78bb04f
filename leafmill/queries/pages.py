"""Source pages made from entries, manifests, edges and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import pages as P
from ..operators import vocabulary as W
from ..session import table
from ..sources import files as S
from .records import _safe

TODAY = "2026-01-01"
NEEDLES = ("cryogenic bolometer", "superconducting resonator", "[@", "charge carrier")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return P.page_skeletons(table(spark, d, "bib_entries"), TODAY)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return P.with_evidence(_pages(spark, d), table(spark, d, "manifests"))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return P.with_edges(_evidence(spark, d), table(spark, d, "edge_items"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_kind = 'parsed_paper'").select("citation_key", F.col("doc_id").alias("order"), "text")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The PDFs of manifests that are still there."""
    return table(spark, d, "manifests").where("removed_at IS NULL AND original_pdf <> ''").select(F.col("original_pdf").alias("path"))


def page_skeletons(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return p.select("citation_key", "doc_id", F.col("identifiers.arxiv").alias("arxiv"), "identifiers.doi", "source.title", "source.year", "source.venue", "source.source_type", F.size("source.authors").alias("n_authors"), F.length("body").alias("body_length"), P.summary_status(F.col("body")).alias("status"))


def new_pages(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose key has no source page among the documents."""
    existing = table(spark, d, "documents").where("doc_kind = 'source_page'")
    return P.new_pages(_pages(spark, d), existing).select("citation_key", "source.title")


def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    p = _evidence(spark, d)
    return p.select("citation_key", "doc_id", "source.source_type", "source.primary_evidence", "source.source_sha256", "source.parsed_at", "chunk_manifest", F.array_join("quality.metadata_conflicts", "; ").alias("conflicts"))


def pages_without_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pages of removed manifests with their evidence blanked."""
    gone = table(spark, d, "manifests").where("removed_at IS NOT NULL").select("citation_key").distinct()
    p = P.without_evidence(_evidence(spark, d).join(gone, "citation_key", "left_semi"))
    return p.select("citation_key", "doc_id", "source.primary_evidence", "source.parser", "chunk_manifest")


def edge_pages(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "vocab_terms").where("retired_at IS NULL").select("category", T.page_name(F.col("canonical_id")).alias("name"))
    return P.edge_pages(_whole(spark, d), terms)


def page_issues(spark: SparkSession, d: str) -> DataFrame:
    manifests = table(spark, d, "manifests").where("removed_at IS NULL")
    paths = manifests.select(F.col("parsed_markdown").alias("path")).unionByName(table(spark, d, "chunks").where("doc_id IS NOT NULL").select(T.evidence_path(F.col("doc_id"), "chunks").alias("path")))
    return P.page_issues(_whole(spark, d), table(spark, d, "vocab_terms"), table(spark, d, "chunks"), paths)


def pdfs_missing(spark: SparkSession, d: str) -> DataFrame:
    return P.files_missing(_pages(spark, d), _files(spark, d))


def texts_that_mention(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("citation_key"), "text")
    return P.pages_that_mention(docs, NEEDLES, "text").withColumnRenamed("citation_key", "doc_id")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages summarised from the parsed papers of their keys."""
    return P.text_summaries(_evidence(spark, d), _texts(spark, d))


def page_index(spark: SparkSession, d: str) -> DataFrame:
    return P.page_index(_pages(spark, d))


def reading_list(spark: SparkSession, d: str) -> DataFrame:
    return P.reading_list(_pages(spark, d), _files(spark, d))


def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "edge_items")
    return P.wiki_pages(W.wiki_nodes(items, table(spark, d, "vocab_terms"))[0], items)


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the graph with their terms by category."""
    edges = P.page_edges(_whole(spark, d))
    return edges.groupBy("citation_key", "category").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids")).select("citation_key", "category", F.array_join("ids", ",").alias("ids"))


def synced_notes(spark: SparkSession, d: str) -> DataFrame:
    return P.notes_by_bucket(S.note_items(table(spark, d, "documents").where("doc_kind = 'note'"), "doc_id", "text"))


def page_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d).select(F.concat(F.lit("/data/kb/"), "source.primary_evidence").alias("input"), "quality.needs_human_review").where("input <> '/data/kb/'")
    return P.operation_log(rows.select("input", F.when(F.col("needs_human_review"), "review").otherwise("parsed").alias("result")), "ingest", TODAY)


_V = lambda name: f"coalesce(list_filter(fields, lambda x: lower(x.k) = '{name}')[-1].v, '')"
_FIRST = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) rn FROM bib_entries) WHERE rn = 1)"
_AUTHORS = f"len(list_filter(regexp_split_to_array(regexp_replace({_V('author')}, '[{{}}]', '', 'g'), '(?i)[\\s\\p{{Z}}]+and[\\s\\p{{Z}}]+'), lambda x: trim(x) <> ''))"
_YEAR = f"CASE WHEN trim({_V('year')}) <> '' THEN trim({_V('year')}) ELSE left({_V('date')}, 4) END"
_PG = f"""{_FIRST}, pg AS (SELECT id citation_key, CASE WHEN trim({_V('eprint')}) <> '' THEN 'arxiv:' || trim({_V('eprint')}) ELSE trim({_V('doi')}) END doc_id, nullif(trim({_V('eprint')}), '') arxiv, nullif(trim({_V('doi')}), '') doi,
  trim(regexp_replace({_V('title')}, '[{{}}]', '', 'g')) title, {_YEAR} "year", nullif(trim({_V('journal')}), '') venue, CASE WHEN trim({_V('eprint')}) <> '' THEN 'arxiv_source' ELSE 'pdf_pymupdf' END source_type, CAST({_AUTHORS} AS INTEGER) n_authors FROM e)"""
_EV = f"""{_PG}, mm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation_key ORDER BY created_at DESC, doc_id DESC, parser_version DESC) rn FROM manifests WHERE citation_key IS NOT NULL) WHERE rn = 1),
  ev AS (SELECT pg.citation_key, coalesce(mm.doc_id, pg.doc_id) doc_id, pg.arxiv, coalesce(mm.route, pg.source_type) source_type, CASE WHEN mm.rn = 1 THEN coalesce(parsed_markdown, '') ELSE '' END primary_evidence, CASE WHEN mm.rn = 1 THEN coalesce(source_sha256, '') ELSE '' END source_sha256, CASE WHEN mm.rn = 1 THEN coalesce(created_at, '') ELSE '' END parsed_at,
    CASE WHEN mm.rn = 1 THEN 'reference/chunks/' || {_safe('mm.doc_id')} || '.jsonl' ELSE '' END chunk_manifest, CASE WHEN mm.rn = 1 AND mm.route <> pg.source_type AND mm.route <> '' THEN 'route fallback: ' || pg.source_type || ' -> ' || mm.route ELSE '' END conflicts, mm.rn has FROM pg LEFT JOIN mm USING (citation_key))"""
_PE = "pe AS (SELECT DISTINCT i.citation_key, i.category, i.canonical_id FROM edge_items i JOIN pg USING (citation_key) WHERE i.category IS NOT NULL AND i.canonical_id IS NOT NULL AND trim(i.canonical_id) <> '')"
_NAME = "replace(replace(trim({}), ':', '_'), '/', '_')"
_CATEGORIES = "(" + ", ".join(f"'{c}'" for c in V.EDGE_CATEGORIES) + ")"
_BASE = "split_part({0}, '/', -1)"
_THERE = f"SELECT DISTINCT {_BASE.format('original_pdf')} n FROM manifests WHERE removed_at IS NULL AND original_pdf <> ''"
_BODY = sum(len(f"\n## {s}\n{{#{s}}}\n\n{P.PLACEHOLDER}\n") for s in P.SECTIONS) + 4

QUERIES = {f.__name__: f for f in (page_skeletons, new_pages, page_evidence, pages_without_evidence, edge_pages, page_issues, pdfs_missing, texts_that_mention, page_texts, page_index, reading_list, wiki_pages, graph_nodes, synced_notes, page_log)}
SQL = {
    "page_skeletons": f"WITH {_PG} SELECT *, CAST(length(title) + {_BODY} AS INTEGER) body_length, 'placeholder' status FROM pg",
    "new_pages": f"WITH {_PG} SELECT citation_key, title FROM pg WHERE citation_key NOT IN (SELECT citation_key FROM documents WHERE doc_kind = 'source_page' AND citation_key IS NOT NULL)",
    "page_evidence": f"WITH {_EV} SELECT citation_key, doc_id, source_type, primary_evidence, source_sha256, parsed_at, chunk_manifest, conflicts FROM ev",
    "pages_without_evidence": f"WITH {_EV} SELECT citation_key, doc_id, '' primary_evidence, '' parser, '' chunk_manifest FROM ev WHERE citation_key IN (SELECT citation_key FROM manifests WHERE removed_at IS NOT NULL)",
    "edge_pages": f"WITH {_PG}, {_PE} SELECT DISTINCT pe.*, CASE WHEN v.n IS NULL THEN '' ELSE 'summary/' || pe.category || '/' || v.n || '.md' END path FROM pe LEFT JOIN (SELECT DISTINCT category, {_NAME.format('canonical_id')} n FROM vocab_terms WHERE retired_at IS NULL) v ON v.category = pe.category AND v.n = {_NAME.format('pe.canonical_id')}",
    "page_issues": f"""WITH {_EV}, {_PE}, paths AS (SELECT parsed_markdown path FROM manifests WHERE removed_at IS NULL UNION SELECT 'reference/chunks/' || {_safe('doc_id')} || '.jsonl' FROM chunks WHERE doc_id IS NOT NULL)
      SELECT citation_key subject, 'doc_id_not_arxiv' rule, 'error' severity, doc_id detail FROM ev WHERE arxiv <> '' AND doc_id <> '' AND 'arxiv:' || arxiv <> doc_id
      UNION ALL SELECT citation_key, 'unknown_source_type', 'error', source_type FROM ev WHERE source_type NOT IN ('', 'arxiv_source', 'pdf_mineru', 'pdf_pymupdf')
      UNION ALL SELECT citation_key, 'no_edges', 'warning', '' FROM ev WHERE citation_key NOT IN (SELECT citation_key FROM edge_items WHERE citation_key IS NOT NULL AND category IS NOT NULL AND canonical_id IS NOT NULL)
      UNION ALL SELECT DISTINCT citation_key, 'unknown_edge_category', 'error', '' FROM pe WHERE category NOT IN {_CATEGORIES}
      UNION ALL SELECT citation_key, 'off_vocabulary', 'error', category || ':' || trim(canonical_id) FROM pe WHERE category IN {_CATEGORIES} AND trim(canonical_id) NOT IN (SELECT canonical_id FROM vocab_terms)
      UNION ALL SELECT citation_key, 'missing_primary_evidence', 'error', primary_evidence FROM ev WHERE primary_evidence <> '' AND primary_evidence NOT IN (SELECT path FROM paths WHERE path IS NOT NULL)
      UNION ALL SELECT citation_key, 'missing_chunk_manifest', 'error', chunk_manifest FROM ev WHERE chunk_manifest <> '' AND chunk_manifest NOT IN (SELECT path FROM paths WHERE path IS NOT NULL)""",
    "pdfs_missing": f"WITH {_PG} SELECT citation_key, '../../reference/pdfs/' || citation_key || '.pdf' path FROM pg WHERE citation_key || '.pdf' NOT IN ({_THERE})",
    "texts_that_mention": "SELECT doc_id, needle FROM documents JOIN (VALUES " + ", ".join(f"('{n}')" for n in NEEDLES) + ") v(needle) ON contains(text, needle)",
    "page_index": f"WITH {_PG} SELECT citation_key, '- [' || citation_key || '](summary/sources/' || citation_key || '.md)' line FROM pg",
    "reading_list": f"""WITH {_PG} SELECT citation_key, '- **' || title || '** (' || year || ')' || chr(10) || '  - Key: `' || citation_key || '`' || CASE WHEN arxiv IS NULL THEN '' ELSE chr(10) || '  - arXiv: ' || arxiv END || CASE WHEN doi IS NULL THEN '' ELSE chr(10) || '  - DOI: ' || doi END
      || chr(10) || '  - Source: [' || citation_key || '](summary/sources/' || citation_key || '.md)' || CASE WHEN citation_key || '.pdf' IN ({_THERE}) THEN chr(10) || '  - PDF: [' || citation_key || '.pdf](reference/pdfs/' || citation_key || '.pdf)' ELSE '' END || chr(10) || '  - Summary status: placeholder' item FROM pg""",
    "wiki_pages": f"""WITH k AS (SELECT canonical_id, list_sort(list(DISTINCT citation_key)) ks FROM edge_items WHERE canonical_id IS NOT NULL AND citation_key IS NOT NULL GROUP BY 1), v AS (SELECT canonical_id, arg_min(label, pos) AS label, arg_min(category, pos) category FROM vocab_terms GROUP BY 1)
      SELECT 'summary/' || category || '/' || {_NAME.format('canonical_id')} || '.md' path, '# ' || label || chr(10) || chr(10) || '`' || canonical_id || '`' || chr(10) || chr(10) || '{P.AUTO_BEGIN}' || chr(10) || '## Source pages (' || len(ks) || ')' || chr(10) || array_to_string(list_transform(ks, lambda x: '- [[../sources/' || x || ']]' || chr(10)), '') || '{P.AUTO_END}' || chr(10) body FROM k JOIN v USING (canonical_id)""",
    "graph_nodes": f"WITH {_PG}, {_PE} SELECT citation_key, category, array_to_string(list_sort(list(canonical_id)), ',') ids FROM pe GROUP BY ALL",
    "page_log": f"WITH {_EV} SELECT '{TODAY}' AS day, 'ingest' operation, primary_evidence AS input, CASE WHEN has = 1 THEN 'parsed' ELSE 'review' END result FROM ev WHERE primary_evidence <> ''",
}
