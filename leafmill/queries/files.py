"""Queries over files' contents derived from the tables, and over arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..sources import bibtex as B
from ..sources import files as S
from ..streaming import incremental as I
from ..session import table


def bibtex_rendered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "bib_entries")
    return e.select("id", "pos", B.render(F.col("entrytype"), F.col("id"), F.col("fields")).alias("bibtex"))


def bibtex_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entries rendered as BibTeX and parsed again, field by field."""
    parsed = B.parse_bibtex(bibtex_rendered(spark, d).withColumn("k", F.concat_ws("|", "id", "pos")), "k", "bibtex")
    return parsed.select("path", "entrytype", "id", F.explode("fields").alias("f")).select("path", "entrytype", "id", F.col("f.k").alias("field"), F.col("f.v").alias("value"))


def entry_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each field of an entry is there and filled."""
    f = table(spark, d, "bib_entries").select("entrytype", F.explode("fields").alias("f"))
    return f.groupBy("entrytype", F.lower("f.k").alias("field")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("f.v", F.lit("")) != "").alias("n_filled"))


def pdf_paths(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").where("original_pdf <> ''")
    return m.select("doc_id", F.explode(S.file_paths(F.col("original_pdf"))).alias("pdf"))


def note_items(spark: SparkSession, d: str) -> DataFrame:
    return S.note_items(table(spark, d, "documents"), "doc_id", "text")


def note_buckets(spark: SparkSession, d: str) -> DataFrame:
    return note_items(spark, d).groupBy("bucket", "category").agg(F.count("*").alias("n"), F.sum(F.size("citations")).alias("n_citations"))


def notes_not_yet_synced(spark: SparkSession, d: str) -> DataFrame:
    """Items of the later half of the notes whose text no earlier note has; the earlier half is what was synced."""
    docs = table(spark, d, "documents").where("added_at IS NOT NULL")
    bound = docs.agg(F.percentile_approx("added_at", 0.5, 10_000)).first()[0]
    items = note_items(spark, d).join(docs.select(F.col("doc_id").cast("string").alias("note"), "added_at"), "note")
    synced = items.where(F.col("added_at") < bound)
    return items.where(F.col("added_at") >= bound).join(synced.select("text").distinct(), "text", "left_anti").select("note", "id", "line_no", "text")


def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of each vector, rounded and joined."""
    v = S.hash_vectors(table(spark, d, "chunks").select("row_id", "text"), "row_id", "text")
    return v.where("embedding[0] IS NOT NULL").select("row_id", F.size("embedding").alias("dimensions"), F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x)), ",").alias("numbers"))


def category_pages(spark: SparkSession, d: str) -> DataFrame:
    return G.category_pages(table(spark, d, "edge_items"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", "p.k")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return I.event_windows(table(spark, d, "events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return I.sessions(table(spark, d, "events"))


def first_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.first_chunks(table(spark, d, "chunks")).select("chunk_id")


def upsert_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a vector store would get for each document: how many chunks and the first of them."""
    c = table(spark, d, "chunks").where("doc_id IS NOT NULL")
    return c.groupBy(T.safe_doc_id(F.col("doc_id")).alias("collection")).agg(F.countDistinct("chunk_id").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


QUERIES = {f.__name__: f for f in (bibtex_rendered, bibtex_round_trip, entry_fields, pdf_paths, note_items, note_buckets, notes_not_yet_synced, hash_vectors, category_pages, json_props, event_windows, event_sessions, first_chunk_rows, upsert_plan)}
_LINES = "array_to_string(list_transform(list_filter(fields, lambda x: coalesce(x.v, '') <> ''), lambda x: '  ' || x.k || ' = {' || x.v || '},' || chr(10)), '')"
_SAFE = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(doc_id), '[:/]', '_', 'g'), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"
_MARK = r"(?i)^\s*(?:[-*]\s*|\d+\.\s+)?(?:\*\*)?(decision|consensus|open question|failed|dispute|finding|method)(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.+)$"
_NOTES = f"""l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) n, unnest(x) raw FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents WHERE text IS NOT NULL)),
  h AS (SELECT doc_id, n, raw, last_value(CASE WHEN starts_with(trim(raw), '#') THEN trim(regexp_replace(trim(raw), '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) heading FROM l),
  i AS (SELECT CAST(doc_id AS VARCHAR) note, CAST(n AS INTEGER) line_no, coalesce(heading, '') heading, regexp_replace(raw, '\\r$', '') line FROM h),
  it AS (SELECT note, line_no, heading, lower(regexp_extract(line, '{_MARK}', 1)) category, trim(regexp_extract(line, '{_MARK}', 2)) AS text, regexp_extract_all(line, '\\[@([\\p{{L}}\\p{{N}}_:-]+)\\]', 1) citations FROM i WHERE regexp_matches(line, '{_MARK}')),
  items AS (SELECT *, CASE WHEN category = 'decision' THEN 'decisions' WHEN category = 'method' THEN 'methods' WHEN category = 'failed' THEN 'failures' WHEN category IN ('open question', 'dispute') THEN 'open_questions' ELSE 'claims' END bucket, 'note:' || left(sha1(note || ':' || line_no || ':' || text), 10) id FROM it)"""
SQL = {
    "note_items": f"WITH {_NOTES} SELECT note, id, line_no, heading, category, bucket, text, citations FROM items",
    "note_buckets": f"WITH {_NOTES} SELECT bucket, category, count(*) n, CAST(sum(len(citations)) AS BIGINT) n_citations FROM items GROUP BY ALL",
    "bibtex_rendered": f"SELECT id, pos, '@' || entrytype || '{{' || id || ',' || chr(10) || {_LINES} || '}}' || chr(10) bibtex FROM bib_entries",
    "bibtex_round_trip": "SELECT id || '|' || pos path, entrytype, id, lower(f.k) field, trim(f.v) AS value FROM (SELECT entrytype, id, pos, unnest(fields) f FROM bib_entries) WHERE coalesce(f.v, '') <> ''",
    "entry_fields": "SELECT entrytype, lower(f.k) field, count(*) n, count(*) FILTER (coalesce(f.v, '') <> '') n_filled FROM (SELECT entrytype, unnest(fields) f FROM bib_entries) GROUP BY ALL",
    "pdf_paths": "SELECT doc_id, original_pdf pdf FROM manifests WHERE original_pdf <> ''",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events",
    "event_windows": "SELECT date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL",
    "event_sessions": "SELECT user_id, min(ts) session_start, max(ts) + INTERVAL 30 MINUTE session_end, count(*) n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END fresh FROM events)) GROUP BY user_id, s",
    "first_chunk_rows": "SELECT DISTINCT chunk_id FROM chunks",
    "hash_vectors": "WITH h AS (SELECT row_id, sha256(text || '#0') || sha256(text || '#1') || sha256(text || '#2') || sha256(text || '#3') h FROM chunks) SELECT row_id, CAST(CASE WHEN h IS NULL THEN -1 ELSE 128 END AS INTEGER) dimensions, array_to_string(list_transform(range(0, 128), lambda i: printf('%.4f', CAST('0x' || substr(h, CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) / 127.5 - 1.0)), ',') numbers FROM h WHERE h IS NOT NULL",
    "upsert_plan": f"SELECT {_SAFE} collection, count(DISTINCT chunk_id) n_chunks, min(chunk_id) first_chunk FROM chunks WHERE doc_id IS NOT NULL GROUP BY 1",
    "category_pages": "WITH x AS (SELECT category, canonical_id, count(DISTINCT citation_key) n FROM edge_items WHERE category IS NOT NULL AND canonical_id IS NOT NULL AND citation_key IS NOT NULL GROUP BY ALL) SELECT category, string_agg('- ' || canonical_id || ' (' || n || ')', chr(10) ORDER BY canonical_id) body FROM x GROUP BY category",
}
