"""Records, identifiers and chunks of the evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import chunking as C
from ..operators import records as R
from ..session import table
from .search import section_type_sql


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest_records(table(spark, d, "bib_entries"))


def normalised_records(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return m.select("key", "pos", "title_norm", "year", "doi", "arxiv", F.size("authors").alias("n_authors"), T.slugify(F.col("title")).alias("slug"))


def resolved_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_sources(_manifest(spark, d)).select("key", "pos", "doc_id", "source_type", "needs_review", T.safe_doc_id(F.col("doc_id")).alias("safe_id"), T.evidence_path(F.col("doc_id"), "chunks").alias("chunk_path"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d).withColumn("k", R.dedup_key(_manifest(spark, d)))
    return R.keep_first(m, ["k"], ["pos", "key"]).select("key", "pos", "k.kind", "k.value")


def title_norm_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_first(_manifest(spark, d), ["title_norm"], ["pos", "key"]).select("title_norm", "key", "pos")


def last_per_key(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "bib_changes").where("changed_at IS NOT NULL")
    return R.keep_last(changes, ["entry_key", "field"], ["changed_at", "change_id"]).select("entry_key", "field", "change_id", "new_value")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """An issue for every row of a chunk id but its first."""
    return R.extra_rows(table(spark, d, "chunks"), ["chunk_id"], ["row_id"]).select("chunk_id", "row_id", "nth")


def dedup_semi(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents whose DOI an entry has."""
    parsed = table(spark, d, "manifests").withColumn("d", T.normalize_doi(F.col("doi"))).where("d <> ''")
    return parsed.join(_manifest(spark, d).select(F.col("doi").alias("d")), "d", "left_semi").select("doc_id", "citation_key", "created_at")


def dedup_anti(spark: SparkSession, d: str) -> DataFrame:
    """Search results with a DOI or arXiv id that are new to the manifest."""
    m = _manifest(spark, d)
    results = table(spark, d, "search_results").select("result_id", T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("d"), T.normalize_arxiv(F.coalesce("arxiv", F.lit(""))).alias("a")).where("d <> '' OR a <> ''")
    return results.join(m.select(F.col("doi").alias("d")).where("d <> ''"), "d", "left_anti").join(m.select(F.col("arxiv").alias("a")).where("a <> ''"), "a", "left_anti").select("result_id")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "import_candidates").select(R.field("entry", "id").alias("id"), F.col("cand_id").alias("pos"), F.col("entry").alias("fields"))
    return R.manifest_records(c)


def multikey_match(spark: SparkSession, d: str) -> DataFrame:
    """For each candidate the first candidate that it is the same work as, by its best key."""
    return R.multi_key_match(_candidates(spark, d), _candidates(spark, d))


def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    base = _manifest(spark, d).withColumn("base", F.concat(F.coalesce(F.lower(F.regexp_extract(F.get("authors", F.lit(0)), r"^([\p{L}]+)", 1)), F.lit("")), "year"))
    return R.unique_keys(base.withColumn("o", F.struct("pos", "key")), "base", "o").select("key", "pos", "unique_key")


def pdf_actions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "import_candidates").select("cand_id", F.coalesce(R.field("entry", "file"), F.lit("")).alias("f"), T.normalize_arxiv(F.coalesce(R.field("entry", "eprint"), F.lit(""))).alias("a"), F.coalesce("pdf_url", F.lit("")).alias("u"))
    return c.select("cand_id", T.pdf_action(F.lit(False), F.col("f"), F.col("a"), F.col("u")).alias("action"), T.arxiv_pdf_url(F.col("a")).alias("url"))


def section_extract(spark: SparkSession, d: str) -> DataFrame:
    return C.explode_sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section_no", "title", "char_start", "char_end")


def section_anchors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("section_title IS NOT NULL")
    return c.select("row_id", T.stable_anchor(F.col("section_title")).alias("anchor"))


def section_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("row_id", T.section_type(F.col("section_title"), F.col("text")).alias("section_type"))


def section_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return section_types(spark, d).groupBy("section_type").agg(F.count("*").alias("n"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select("row_id", T.chunk_id(F.col("doc_id"), F.col("section_anchor"), F.col("chunk_index"), F.col("text")).alias("chunk_id")).where("chunk_id IS NOT NULL")


def equations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    ids = T.equation_ids(F.col("text"), F.coalesce("section_anchor", F.lit("")), F.coalesce("chunk_index", F.lit(0)))
    return c.select("row_id", F.explode(ids).alias("equation_id"))


def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut into evidence chunks."""
    return C.build_chunks(table(spark, d, "documents"), "doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "text").select("chunk_id", "chunk_index", "section_title", "section_type", "char_start", "char_end")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    built = built_chunks(spark, d)
    return built.groupBy("section_type").agg(F.count("*").alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("n_chars"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.sentence(F.col("text")).alias("first_sentence"), T.truncate(F.col("text"), 120).alias("cut"), F.size(T.key_findings(F.col("text"))).alias("n_findings"))


def abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.abstract_of(F.col("text")).alias("abstract")).where("abstract <> ''")


def best_identifiers(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return m.select("key", "pos", T.best_identifier(F.col("doi"), F.col("arxiv"), F.col("title_norm"), F.col("key")).alias("identifier"))


def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select("row_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha1("text"), 1, 10).alias("short_id"))


_F = "list_filter(fields, lambda x: lower(x.k) = '{}')[-1].v"
_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_DOI_RE = r"10\.\d{4,9}/[-._;()/:a-z0-9]+"
_ARXIV_RE = r"(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+/\d{7}(v\d+)?)"
_ARXIV_DOI_RE = r"10\.\d{4,}/arxiv[./-](\d{4}\.\d{4,5}(v\d+)?)"


def _doi(x: str) -> str:
    return f"(CASE WHEN regexp_matches(lower({x}), '{_DOI_RE}') THEN rtrim(regexp_extract(lower({x}), '{_DOI_RE}'), '.') ELSE lower(trim({x})) END)"


def _arxiv(x: str) -> str:
    return f"coalesce(nullif(regexp_extract(lower({x}), '{_ARXIV_RE}', 1), ''), lower(trim({x})))"


def manifest_sql(name: str, source: str, key: str, pos: str, fields: str) -> str:
    f = lambda n: f"coalesce({_F.format(n).replace('fields', fields)}, '')"
    return f"""{name} AS (SELECT key, pos, title, {_NORM.format('title')} title_norm, authors, CASE WHEN trim(y) <> '' THEN y ELSE left(dt, 4) END AS "year",
        CASE WHEN regexp_matches(d, '{_ARXIV_DOI_RE}') THEN '' ELSE d END doi, CASE WHEN a <> '' THEN a ELSE regexp_extract(d, '{_ARXIV_DOI_RE}', 1) END arxiv, file
      FROM (SELECT {key} AS key, {pos} AS pos, {f('title')} title, list_filter(list_transform(regexp_split_to_array(regexp_replace({f('author')}, '[{{}}]', '', 'g'), '(?i)[\\s\\p{{Z}}]+and[\\s\\p{{Z}}]+'), lambda x: trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '') authors,
        {f('year')} y, {f('date')} dt, {_doi(f('doi'))} d, {_arxiv(f('eprint'))} a, {f('file')} file FROM {source}))"""


_M = manifest_sql("m", "bib_entries", "id", "pos", "fields")
_C = manifest_sql("c", "import_candidates", _F.format("id").replace("fields", "entry"), "cand_id", "entry")
_PEOPLE = "array_to_string(authors[1:3], ',') || '|' || year"
_RESOLVED = "CASE WHEN arxiv <> '' THEN 'arxiv:' || arxiv WHEN doi <> '' THEN doi WHEN file <> '' THEN 'pdf:' || key ELSE 'unresolved:' || key END"


def _safe(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim({x}), '[:/]', '_', 'g'), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"


def _anchor(x: str) -> str:
    return rf"('#' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}_\s\p{{Z}}-]', '', 'g'), '[\s\p{{Z}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section'))"


def _keys(name: str) -> str:
    parts = [("doi", "doi"), ("arxiv", "arxiv"), ("title", "title_norm"), ("fallback", f"CASE WHEN {_PEOPLE} = '|' THEN '' ELSE {_PEOPLE} END")]
    return " UNION ALL ".join(f"SELECT key, pos, {i} priority, '{kind}' kind, {value} v FROM {name} WHERE {value} <> ''" for i, (kind, value) in enumerate(parts))


_KIND = "CASE WHEN doi <> '' THEN 'doi' WHEN arxiv <> '' THEN 'arxiv' WHEN title_norm <> '' THEN 'title' ELSE 'fallback' END"
_VALUE = f"CASE WHEN doi <> '' THEN doi WHEN arxiv <> '' THEN arxiv WHEN title_norm <> '' THEN title_norm ELSE {_PEOPLE} END"
_EQ = "len(regexp_extract_all(text, '(?s)\\$\\$(.*?)\\$\\$'))"
_SQUEEZED = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"
_PARTS = "string_split(regexp_replace(text, '(?m)^(#{1,6}[ \\t]+\\S)', chr(1) || '\\1', 'g'), chr(1))"
QUERIES = {f.__name__: f for f in (normalised_records, resolved_sources, dedup_first, title_norm_dedup_first, last_per_key, duplicate_ids, dedup_semi, dedup_anti, multikey_match, unique_keys, pdf_actions, section_extract, section_anchors, section_types, section_type_counts, chunk_ids, equations, built_chunks, chunk_counts, excerpts, abstracts, best_identifiers, record_hashes)}
SQL = {
    "normalised_records": f"WITH {_M} SELECT key, pos, title_norm, year, doi, arxiv, CAST(len(authors) AS INTEGER) n_authors, replace({_NORM.format('title')}, ' ', '-') slug FROM m",
    "resolved_sources": f"WITH {_M} SELECT key, pos, {_RESOLVED} doc_id, CASE WHEN arxiv <> '' THEN 'arxiv_source' WHEN file <> '' THEN 'pdf_pymupdf' ELSE 'unresolved' END source_type, arxiv = '' AND file = '' needs_review, {_safe(_RESOLVED)} safe_id, 'reference/chunks/' || {_safe(_RESOLVED)} || '.jsonl' chunk_path FROM m",
    "dedup_first": f"WITH {_M} SELECT key, pos, kind, value FROM (SELECT *, {_KIND} kind, {_VALUE} AS value, row_number() OVER (PARTITION BY {_KIND}, {_VALUE} ORDER BY pos, key) rn FROM m) WHERE rn = 1",
    "title_norm_dedup_first": f"WITH {_M} SELECT title_norm, key, pos FROM (SELECT *, row_number() OVER (PARTITION BY title_norm ORDER BY pos, key) rn FROM m) WHERE rn = 1",
    "last_per_key": "SELECT entry_key, field, change_id, new_value FROM (SELECT *, row_number() OVER (PARTITION BY entry_key, field ORDER BY changed_at DESC, change_id DESC) rn FROM bib_changes WHERE changed_at IS NOT NULL) WHERE rn = 1",
    "duplicate_ids": "SELECT chunk_id, row_id, CAST(nth AS INTEGER) nth FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) nth FROM chunks) WHERE nth > 1",
    "dedup_semi": f"WITH {_M} SELECT doc_id, citation_key, created_at FROM manifests WHERE doi IS NOT NULL AND {_doi('manifests.doi')} <> '' AND {_doi('manifests.doi')} IN (SELECT doi FROM m)",
    "dedup_anti": f"WITH {_M}, r AS (SELECT result_id, {_doi(chr(99) + 'oalesce(doi, ' + chr(39) * 2 + ')')} d, {_arxiv(chr(99) + 'oalesce(arxiv, ' + chr(39) * 2 + ')')} a FROM search_results) SELECT result_id FROM r WHERE (d <> '' OR a <> '') AND NOT EXISTS (SELECT 1 FROM m WHERE m.doi <> '' AND m.doi = r.d) AND NOT EXISTS (SELECT 1 FROM m WHERE m.arxiv <> '' AND m.arxiv = r.a)",
    "multikey_match": f"WITH {_C}, e AS ({_keys('c')}), i AS ({_keys('c')}), first AS (SELECT kind, v, arg_min(key, (pos, key)) existing_key FROM e GROUP BY ALL) SELECT key, pos, kind match_kind, existing_key FROM (SELECT i.key, i.pos, i.kind, existing_key, row_number() OVER (PARTITION BY i.key, i.pos ORDER BY priority) rn FROM i JOIN first USING (kind, v)) WHERE rn = 1",
    "unique_keys": f"WITH {_M}, b AS (SELECT *, coalesce(lower(regexp_extract(authors[1], '^([\\p{{L}}]+)', 1)), '') || year base FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos, key) n FROM b) SELECT key, pos, CASE WHEN n = 1 THEN base ELSE base || '-' || n END unique_key FROM n",
    "section_extract": f"""WITH p AS (SELECT doc_id, {_PARTS} l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) i, unnest(l) s, len(l) n FROM p), o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) st FROM e),
      k AS (SELECT * FROM o WHERE regexp_matches(s, '[^\\s\\p{{Z}}]') OR n = 1)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) section_no, CASE WHEN regexp_matches(s, '^#{{1,6}}[ \\t]+\\S') THEN trim(regexp_replace(regexp_replace(string_split(s, chr(10))[1], '^#{{1,6}}[ \\t]+', ''), '^[\\s#]+|[\\s#]+$', '', 'g')) ELSE 'Document' END title, CAST(st AS INTEGER) char_start, CAST(st + length(s) AS INTEGER) char_end FROM k""",
    "section_anchors": f"SELECT row_id, {_anchor('section_title')} anchor FROM chunks WHERE section_title IS NOT NULL",
    "section_types": f"SELECT row_id, {section_type_sql(None)} section_type FROM chunks",
    "section_type_counts": f"SELECT {section_type_sql(None)} section_type, count(*) n FROM chunks GROUP BY 1",
    "chunk_ids": f"SELECT row_id, {_safe('doc_id')} || '::' || coalesce(nullif(ltrim(section_anchor, '#'), ''), 'section') || '::chunk-' || lpad(CAST(chunk_index AS VARCHAR), greatest(3, length(CAST(chunk_index AS VARCHAR)))::INTEGER, '0') || '-' || left(sha1(text), 10) chunk_id FROM chunks WHERE section_anchor IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL",
    "equations": f"SELECT row_id, 'eq-' || coalesce(nullif(ltrim(coalesce(section_anchor, ''), '#'), ''), 'section') || '-' || lpad(CAST(coalesce(chunk_index, 0) AS VARCHAR), 3, '0') || '-' || lpad(CAST(unnest(range(1, {_EQ} + 1)) AS VARCHAR), 2, '0') equation_id FROM chunks WHERE {_EQ} > 0",
    "best_identifiers": f"WITH {_M} SELECT key, pos, coalesce(nullif(doi, ''), nullif(arxiv, ''), nullif(title_norm, ''), key) identifier FROM m",
    "abstracts": rf"""WITH t AS (SELECT doc_id, regexp_replace(replace(text, chr(13), ''), '(?m)^\s*\d+\s*$', '', 'g') t FROM documents WHERE text IS NOT NULL),
      p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'))), lambda x: length(x) >= 180 AND NOT ({" OR ".join(f"contains(lower(x), '{w}')" for w in V.BOILERPLATE)})) ps FROM t),
      a AS (SELECT doc_id, left(CASE WHEN regexp_matches(t, '{V.ABSTRACT_PATTERN}') THEN trim(regexp_replace(trim(regexp_replace(regexp_extract(t, '{V.ABSTRACT_PATTERN}', 1), '[\s\p{{Z}}]+', ' ', 'g')), 'Abstract[—-]', '', 'g'), ' :-') ELSE coalesce(ps[1], '') END, 1200) abstract FROM p)
      SELECT doc_id, abstract FROM a WHERE abstract <> ''""",
    "record_hashes": "SELECT row_id, sha256(text) sha256, left(sha1(text), 10) short_id FROM chunks",
}
