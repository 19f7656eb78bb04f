"""Context packs, provenance, data-quality rules and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import context as X
from ..operators import pages as G
from ..operators import phrases as L
from ..operators import records as R
from ..operators import validation as K
from ..plans import changes as P
from ..plans import imports as M
from ..session import table
from ..sources import bibtex as B
from .records import _C, _M, _RESOLVED, _arxiv, _doi, _keys
from .search import QUERY, section_type_sql

PARSERS = {"pymupdf4llm": "1.2.0", "pandoc": "3.1", "scan2md": "1.1.5"}


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Source pages of the keys that have evidence, with their edges."""
    entries = table(spark, d, "bib_entries").join(table(spark, d, "manifests").select(F.col("citation_key").alias("id")).distinct(), "id", "left_semi")
    return G.with_edges(G.with_evidence(G.page_skeletons(entries, "2026-01-01"), table(spark, d, "manifests")), table(spark, d, "edge_items"))


def _pack(spark: SparkSession, d: str, **options) -> dict[str, DataFrame]:
    terms = table(spark, d, "vocab_terms").where("retired_at IS NULL").select("category", T.page_name(F.col("canonical_id")).alias("name"))
    return X.context_pack(table(spark, d, "chunks"), table(spark, d, "bib_entries"), _pages(spark, d), category_pages=terms, **options)


def context_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d, query=QUERY)["evidence"].select("rank", "chunk_id", "source_page", "score", "snippet", "cut")


def context_entries(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d, query=QUERY)["entries"]


def context_edges(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d, query=QUERY, top_k=50)["edges"]


def context_of_key(spark: SparkSession, d: str) -> DataFrame:
    """The pack of the key with the most chunks."""
    key = table(spark, d, "chunks").where("citation_key <> ''").groupBy("citation_key").count().orderBy(F.desc("count"), "citation_key").first()["citation_key"]
    return _pack(spark, d, key=key, compact=False)["evidence"].select("rank", "chunk_id", "score")


def context_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d, query=QUERY, top_k=50)["gaps"]


def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    """A query's hits, one line each."""
    found = X.hybrid_query(table(spark, d, "chunks"), table(spark, d, "bib_entries"), _pages(spark, d), QUERY)
    return X.rendered_hits(found["hits"])


def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each key, newest first, up to 5,000 characters."""
    docs = table(spark, d, "documents").where("citation_key IS NOT NULL").select("citation_key", "doc_id", F.col("n_chars").alias("size"))
    return X.within_budget(docs, F.col("size"), 5_000, ["citation_key"], [F.desc("doc_id")]).select("citation_key", "doc_id", F.col("running_size").cast("long").alias("running_size"), "cut")


def rank_in_group(spark: SparkSession, d: str) -> DataFrame:
    """First-seen chunk of each chunk id with its place in its document."""
    return R.keep_first(table(spark, d, "chunks").select("chunk_id", "row_id", "doc_id", "chunk_index"), ["chunk_id"], ["row_id"])


def keys_in_order(spark: SparkSession, d: str) -> DataFrame:
    pack = table(spark, d, "chunks").select("citation_key", F.col("row_id").alias("rank"))
    return X.keys_in_order(pack)


def traced_chunks(spark: SparkSession, d: str) -> DataFrame:
    return X.trace(table(spark, d, "chunks"), table(spark, d, "manifests"), table(spark, d, "bib_entries"))


def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    return X.page_summaries(table(spark, d, "chunks"))


def topic_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.topic_summary(table(spark, d, "chunks"), table(spark, d, "bib_entries"), QUERY)


def manifest_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the manifests and of rows that stand in for those that chunks tell of and nobody wrote."""
    m = table(spark, d, "manifests")
    told = table(spark, d, "chunks").where("doc_id IS NOT NULL").select("doc_id", "citation_key", "parser", "source_sha256", F.col("source_type").alias("route"), "schema_version").distinct()
    return K.summary(K.manifest_issues(m.unionByName(told.join(m.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)))


def chunk_issues(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_issues(table(spark, d, "chunks"))


def vocabulary_issues(spark: SparkSession, d: str) -> DataFrame:
    return K.vocabulary_issues(table(spark, d, "vocab_terms"))


def edge_issues(spark: SparkSession, d: str) -> DataFrame:
    return K.edge_issues(table(spark, d, "edge_items"), table(spark, d, "vocab_terms"))


def issues_union(spark: SparkSession, d: str) -> DataFrame:
    return K.summary(K.evidence_issues(table(spark, d, "chunks"), table(spark, d, "manifests")))


def keys_without_entry(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose key, as written, no entry has."""
    return K.unmatched_issues(table(spark, d, "chunks"), "row_id", "citation_key", table(spark, d, "bib_entries"), "id", "key_without_entry")


def cited_keys_missing(spark: SparkSession, d: str) -> DataFrame:
    """Keys cited by texts that no entry has; the texts are chunks that end with the citation of their key."""
    cited = table(spark, d, "chunks").select("row_id", F.concat_ws(" ", "text", F.concat(F.lit("[@"), F.trim("citation_key"), F.lit("]"))).alias("text"))
    links = K.link_targets(cited, "row_id", "text", r"\[@([\p{L}\p{N}_:-]+)\]")
    return links.join(table(spark, d, "bib_entries").select(F.col("id").alias("target")), "target", "left_anti").select("row_id", "target")


def unbalanced_marks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks in which brackets open or close that don't in the same line."""
    lines = table(spark, d, "chunks").where("text IS NOT NULL").select("row_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return K.marker_issues(lines.select(F.concat_ws(":", F.col("row_id").cast("string"), (F.col("n") + 1).cast("string")).alias("place"), "line"), "place", "line", r"\(", r"\)")


def staleness(spark: SparkSession, d: str) -> DataFrame:
    records = R.resolve_sources(R.manifest_records(table(spark, d, "bib_entries")))
    return K.summary(K.staleness(records, table(spark, d, "manifests"), table(spark, d, "chunks"), PARSERS))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest_records(table(spark, d, "import_candidates").select(R.field("entry", "id").alias("id"), F.col("cand_id").alias("pos"), F.col("entry").alias("fields")))


def import_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.import_plan(_candidates(spark, d), R.manifest_records(table(spark, d, "bib_entries")))


def import_summary(spark: SparkSession, d: str) -> DataFrame:
    return import_plan(spark, d).groupBy("status", "duplicate_match").agg(F.count("*").alias("n"))


def provider_plan(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest's entries, taken for a provider's answer, tell about the newest evidence of each key."""
    newest = R.keep_last(table(spark, d, "manifests").where("citation_key IS NOT NULL"), ["citation_key"], ["created_at", "doc_id"])
    records = newest.select(F.col("citation_key").alias("key"), T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi"), T.normalize_arxiv(F.coalesce("arxiv_id", F.lit(""))).alias("arxiv"), F.lit("").alias("title_norm"))
    found = R.manifest_records(table(spark, d, "bib_entries")).select(F.col("pos").alias("result_id"), "doi", "arxiv", F.col("key").alias("control_number"), "title")
    return P.provider_plan(records, found)


def delete_plan(spark: SparkSession, d: str) -> DataFrame:
    """What goes with the entries whose title holds a phrase."""
    targets = P.delete_targets(R.manifest_records(table(spark, d, "bib_entries")), title="detector")
    return P.cascade_counts(targets, {"chunks": (table(spark, d, "chunks"), "citation_key"), "manifests": (table(spark, d, "manifests"), "citation_key"), "documents": (table(spark, d, "documents"), "citation_key")})


def applied_delete(spark: SparkSession, d: str) -> DataFrame:
    targets = P.delete_targets(R.manifest_records(table(spark, d, "bib_entries")), title="detector")
    return P.apply_delete(table(spark, d, "chunks"), "citation_key", targets).select("row_id")


def applied_updates(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the recorded changes of their fields put in."""
    changes = table(spark, d, "bib_changes").where("new_value <> '' AND changed_at IS NOT NULL").select(F.col("entry_key").alias("key"), "field", "new_value", F.struct("changed_at", "change_id").alias("at"))
    applied = P.apply_updates(table(spark, d, "bib_entries"), changes)
    return applied.select("id", "pos", F.explode("fields").alias("f")).select("id", "pos", F.col("f.k").alias("field"), F.col("f.v").alias("value"))


def merge_report(spark: SparkSession, d: str) -> DataFrame:
    """Manifests against what chunks tell: shared keys, and documents under other keys."""
    told = table(spark, d, "chunks").where("citation_key <> ''").select("citation_key", "doc_id").distinct()
    return P.merge_report(table(spark, d, "manifests"), told, "citation_key", "doc_id")


def key_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("citation_key").where("citation_key <> ''").intersect(table(spark, d, "documents").select("citation_key"))


def key_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("citation_key").where("citation_key <> ''").subtract(table(spark, d, "documents").select("citation_key"))


def provider_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Search results written as a provider's JSON and read again."""
    r = table(spark, d, "search_results").withColumn("a", F.coalesce("authors", F.array().cast("array<string>")))
    one = lambda name, value: F.when(value != "", F.array(F.struct(value.alias(name))))
    meta = F.struct(F.col("control_number"), one("title", F.col("title")).alias("titles"), F.transform("a", lambda x: F.struct(x.alias("full_name"))).alias("authors"), one("date", F.col("pub_year")).alias("imprints"), one("value", F.col("doi")).alias("dois"), one("value", F.col("arxiv")).alias("arxiv_eprints"))
    hits = M.provider_rows(r.select(F.to_json(F.struct(F.col("record_id").alias("id"), meta.alias("metadata"))).alias("hit")))
    return hits.select("record_id", "title", F.size("authors").alias("n_authors"), "pub_year", "doi", "arxiv", "control_number")


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return M.import_inputs(table(spark, d, "import_candidates"), table(spark, d, "search_results"))


def import_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("id") == "").alias("n_without_key"), F.sum(F.size("fields")).alias("n_fields"))


def planned_imports(spark: SparkSession, d: str) -> DataFrame:
    plan = M.planned_imports(_inputs(spark, d), table(spark, d, "bib_entries"))
    return plan.groupBy("origin", "manifest_action", "duplicate_match").agg(F.count("*").alias("n"))


def applied_imports(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after the import of everything that is new."""
    entries = table(spark, d, "bib_entries")
    return M.applied_imports(M.planned_imports(_inputs(spark, d), entries), entries).select("id", "pos", F.size("fields").alias("n_fields"))


def valid_cache(spark: SparkSession, d: str) -> DataFrame:
    """Documents of chunks for which a manifest of the same parser version and source stands."""
    m = table(spark, d, "manifests")
    wanted = table(spark, d, "chunks").where("doc_id IS NOT NULL").select("doc_id", "source_sha256").distinct().join(m.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("parser_version").alias("parser_version")), "doc_id")
    return M.valid_cache(wanted, m).select("doc_id", "source_sha256", "hit")


def upserted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by id, with rows that were ingested later put in for earlier ones."""
    c = table(spark, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "row_id", "ingested_at")
    first = R.keep_first(c, ["chunk_id"], ["row_id"])
    return M.upserted(first, c.join(first.select("row_id"), "row_id", "left_anti"), "chunk_id", "row_id").select("chunk_id", "row_id")


def registered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Manifests with a row for each parsed paper that has none."""
    papers = table(spark, d, "documents").where("doc_kind = 'parsed_paper' AND text IS NOT NULL AND citation_key IS NOT NULL")
    parsed = papers.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("doc_id"), "citation_key", F.lit("pdf_mineru").alias("route"), F.lit("external").alias("parser"), F.lit("1").alias("parser_version"), "text")
    return M.register_parsed(table(spark, d, "manifests"), parsed, "2026-01-01").where("parser = 'external'").select("doc_id", "citation_key", "parsed_markdown", "source_sha256", "created_at")


def linked_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the PDFs of their manifests, named from either side."""
    m = table(spark, d, "manifests").where("original_pdf <> ''").select("doc_id", "citation_key", "original_pdf").distinct()
    items = R.keep_first(table(spark, d, "bib_entries"), ["id"], ["pos"]).select(F.col("id").alias("item"), F.array(F.concat(F.lit("pdf:"), "id")).alias("links"))
    attachments = m.select(F.concat(F.lit("pdf:"), "citation_key").alias("attachment"), F.lit(None).cast("string").alias("of"), "original_pdf").unionByName(m.select(F.col("doc_id").alias("attachment"), F.col("citation_key").alias("of"), "original_pdf"))
    return M.linked_attachments(items, attachments.withColumnRenamed("original_pdf", "path"), m.select(F.concat(F.lit("/tmp/import/"), "original_pdf").alias("path")).distinct())


def suggested_edges(spark: SparkSession, d: str) -> DataFrame:
    """The terms of the vocabulary that the best phrases of the chunks mean."""
    terms = table(spark, d, "vocab_terms")
    phrases = L.extract_terms([(table(spark, d, "chunks"), "text")], 60)
    return M.suggested_edges(phrases, terms)


def appended_terms(spark: SparkSession, d: str) -> DataFrame:
    """Edge items' terms that the vocabulary has neither by id nor by label."""
    items = table(spark, d, "edge_items").select("canonical_id", "label", "category", F.col("label").alias("raw_term"))
    return M.appended_terms(table(spark, d, "vocab_terms"), items).select("canonical_id", "label", "namespace")


def migrated_tags(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of entries as edges."""
    tags = table(spark, d, "bib_entries").select(F.col("id").alias("citation_key"), F.explode(F.split(F.coalesce(R.field("fields", "keywords"), F.lit("")), r"\s*[,;]\s*")).alias("tag"))
    return M.migrated_tags(tags, table(spark, d, "vocab_terms"))


def cached_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Typed terms with what the edge items' labels, taken for earlier searches, give for them or for one of their words."""
    cache = table(spark, d, "edge_items").where("label <> '' AND canonical_id <> ''").select(F.col("label").alias("query"), F.col("edge_id").alias("rank"), "canonical_id", "label")
    return M.cached_concepts(table(spark, d, "entity_mentions").select("mention_id", "raw_term"), cache).where("cached_id IS NOT NULL").select("mention_id", "cached_id", "by_word")


def fallback_bibtex(spark: SparkSession, d: str) -> DataFrame:
    """Entries' BibTeX, a provider's where search results know the DOI."""
    e = R.keep_first(table(spark, d, "bib_entries"), ["id"], ["pos"])
    local = e.select(F.col("id").alias("key"), B.render(F.col("entrytype"), F.col("id"), F.col("fields")).alias("bibtex"))
    told = table(spark, d, "search_results").withColumn("d", T.normalize_doi(F.col("doi"))).where("d <> ''").groupBy("d").agg(F.min("record_id").alias("r"))
    provider = R.manifest_records(e).where("doi <> ''").join(told, F.col("doi") == F.col("d")).select("key", F.concat(F.lit("@article{"), "r", F.lit("}")).alias("bibtex"))
    return M.fallback_bibtex(provider, local)


def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the parser of their document's newest manifest where they have none of their own."""
    newest = table(spark, d, "manifests").where("doc_id <> ''").groupBy("doc_id").agg(F.max(F.struct("created_at", "parser")).alias("m"))
    return table(spark, d, "chunks").join(newest, "doc_id", "left").select("row_id", F.coalesce(F.nullif("parser", F.lit("")), "m.parser", F.lit("")).alias("parser"))


def _rules(subject: str, rules: list[tuple[str, str, str]], source: str, severity: str = "error") -> str:
    return " UNION ALL ".join(f"SELECT CAST({subject} AS VARCHAR) subject, '{name}' rule, '{severity}' severity, coalesce({detail}, '') detail FROM {source} WHERE {broken}" for name, broken, detail in rules)


def _miss(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), '') = ''"


_IDS = "len(coalesce(equation_ids, []))"
_CHUNK_RULES = _rules("row_id", [("wrong_schema", f"coalesce(schema_version, '') <> '{V.CHUNK_SCHEMA}'", "schema_version"), *[(f"missing_{c}", _miss(c), "''") for c in V.CHUNK_FIELDS], ("equation_without_ids", f"coalesce(contains_equation, false) AND {_IDS} = 0", "''"), ("ids_without_equation", f"NOT coalesce(contains_equation, false) AND {_IDS} > 0", "''"), ("char_range", "char_start IS NULL OR char_end IS NULL OR char_start < 0 OR char_end < char_start", "concat_ws('-', char_start, char_end)")], "chunks")
_ROUTES = "(" + ", ".join(f"'{r}'" for r in V.ALLOWED_ROUTES) + ")"
_MANIFEST_RULES = _rules("coalesce(doc_id, '')", [("wrong_schema", f"coalesce(schema_version, '') <> '{V.MANIFEST_SCHEMA}'", "schema_version"), *[(f"missing_{c}", _miss(c), "''") for c in V.MANIFEST_FIELDS], ("unknown_route", f"NOT ({_miss('route')}) AND route NOT IN {_ROUTES}", "route")], "manifests")
_DUPLICATES = "SELECT CAST(row_id AS VARCHAR) subject, 'duplicate_chunk_id' rule, 'error' severity, chunk_id detail FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n > 1"
_CATEGORIES = "(" + ", ".join(f"'{c}'" for c in V.EDGE_CATEGORIES) + ")"
_TARGETS = f"{_M}, tg AS (SELECT DISTINCT key FROM m WHERE title_norm <> '' AND (title_norm = 'detector' OR contains(title_norm, 'detector') OR contains('detector', title_norm)))"
_PLAN = f"""{_C}, {_M}, e AS ({_keys('m')}), i AS ({_keys('c')}), h AS (SELECT kind, v, arg_min(key, (pos, key)) old_key FROM e GROUP BY ALL),
  f AS (SELECT i.*, old_key, first_value(pos) OVER w fp, first_value(key) OVER w fk FROM i LEFT JOIN h USING (kind, v) WINDOW w AS (PARTITION BY kind, v ORDER BY pos, key)),
  b AS (SELECT key, pos, arg_min({{'t': target, 'k': kind}}, (late, priority, kind, target)) b FROM (SELECT *, coalesce(old_key, CASE WHEN pos > fp THEN fk END) target, old_key IS NULL late FROM f) WHERE target IS NOT NULL GROUP BY key, pos),
  pl AS (SELECT c.key, c.pos, coalesce(b.t, '') duplicate_of, coalesce(b.k, '') duplicate_match, CASE WHEN b IS NULL THEN 'new' ELSE 'duplicate' END status FROM c LEFT JOIN b ON b.key = c.key AND b.pos = c.pos)"""
_STALE = f"""{_M}, r AS (SELECT key, {_RESOLVED} doc_id FROM m), n AS (SELECT doc_id, max({{'c': created_at, 'p': parser, 'v': parser_version, 's': source_sha256}}) x FROM manifests GROUP BY 1),
  h AS (SELECT doc_id, count(*) n, min(source_sha256) lo, max(source_sha256) hi FROM chunks GROUP BY 1),
  j AS (SELECT r.*, x, h.n held, lo, hi, CASE x.p {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARSERS.items())} END cur FROM r LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)),
  q AS (SELECT unnest([CASE WHEN x IS NULL THEN 'manifest_missing' END, CASE WHEN cur IS NOT NULL AND coalesce(x.v, '') <> '' AND x.v <> cur THEN 'parser_changed' END, CASE WHEN held IS NULL THEN 'chunks_missing' END, CASE WHEN x.s IS NOT NULL AND held IS NOT NULL AND (lo <> x.s OR hi <> x.s) THEN 'source_changed' END]) rule FROM j)"""
QUERIES = {f.__name__: f for f in (context_evidence, context_entries, context_edges, context_of_key, context_gaps, hybrid_query, running_budget, rank_in_group, keys_in_order, traced_chunks, page_summaries, topic_summary, manifest_issues, chunk_issues, vocabulary_issues, edge_issues, issues_union, keys_without_entry, cited_keys_missing, unbalanced_marks, staleness, import_plan, import_summary, provider_plan, delete_plan, applied_delete, applied_updates, merge_report, key_intersect, key_except, provider_round_trip, import_inputs, planned_imports, applied_imports, valid_cache, upserted_chunks, registered_documents, linked_attachments, suggested_edges, appended_terms, migrated_tags, cached_concepts, fallback_bibtex, coalesce_merge)}
SQL = {
    "import_plan": f"WITH {_PLAN} SELECT * FROM pl",
    "import_summary": f"WITH {_PLAN} SELECT status, duplicate_match, count(*) n FROM pl GROUP BY ALL",
    "import_inputs": "SELECT CASE WHEN source = 'zip_batch' THEN 'zip' ELSE 'bib' END origin, count(*) n, count(*) FILTER (coalesce(list_filter(entry, lambda x: lower(x.k) = 'id')[-1].v, '') = '') n_without_key, CAST(sum(len(entry)) AS BIGINT) n_fields FROM import_candidates GROUP BY 1 UNION ALL SELECT 'search', count(*), 0, CAST(sum(CAST(coalesce(title, '') <> '' AS INTEGER) + CAST(array_to_string(coalesce(authors, []), ' and ') <> '' AS INTEGER) + CAST(coalesce(pub_year, '') <> '' AS INTEGER) + CAST(coalesce(doi, '') <> '' AS INTEGER) + CAST(coalesce(arxiv, '') <> '' AS INTEGER)) AS BIGINT) FROM search_results",
    "staleness": f"WITH {_STALE} SELECT rule, 'warning' severity, count(*) n FROM q WHERE rule IS NOT NULL GROUP BY rule",
    "context_of_key": f"WITH k AS (SELECT citation_key FROM chunks WHERE citation_key <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT CAST(row_number() OVER (ORDER BY chunk_index NULLS FIRST, row_id) AS INTEGER) rank, chunk_id, 1.0::DOUBLE score FROM chunks WHERE citation_key = (SELECT citation_key FROM k) AND {section_type_sql()} NOT IN ('references', 'metadata') ORDER BY chunk_index NULLS FIRST, row_id LIMIT 8",
    "running_budget": "SELECT citation_key, doc_id, CAST(s AS BIGINT) running_size, s > 5000 cut FROM (SELECT *, sum(n_chars) OVER w s, row_number() OVER w n FROM documents WHERE citation_key IS NOT NULL WINDOW w AS (PARTITION BY citation_key ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE s <= 5000 OR n = 1",
    "rank_in_group": "SELECT chunk_id, row_id, doc_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) n FROM chunks) WHERE n = 1",
    "keys_in_order": "SELECT citation_key, min(row_id) best_rank FROM chunks WHERE citation_key <> '' GROUP BY 1",
    "traced_chunks": "WITH p AS (SELECT doc_id, max({'c': created_at, 'v': parser_version, 'p': parsed_markdown, 'k': citation_key}) m FROM manifests GROUP BY 1), k AS (SELECT DISTINCT id FROM bib_entries) SELECT row_id, chunk_id, coalesce(m.p, '') parsed_markdown, coalesce(m.v, '') parser_version, CASE WHEN a.id IS NOT NULL THEN citation_key WHEN b.id IS NOT NULL THEN m.k ELSE '' END source_key, m IS NOT NULL has_manifest FROM chunks LEFT JOIN p USING (doc_id) LEFT JOIN k a ON a.id = citation_key LEFT JOIN k b ON b.id = m.k",
    "manifest_issues": f"WITH told AS (SELECT * FROM manifests UNION ALL BY NAME SELECT DISTINCT doc_id, citation_key, parser, source_sha256, source_type AS route, schema_version FROM chunks WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM manifests WHERE doc_id IS NOT NULL)) SELECT rule, severity, count(*) n FROM ({_MANIFEST_RULES.replace('FROM manifests', 'FROM told')}) GROUP BY ALL",
    "chunk_issues": _CHUNK_RULES,
    "vocabulary_issues": _rules("pos", [*[(f"missing_{c}", _miss(c), "''") for c in ("canonical_id", "label", "namespace", "category", "source")], ("unknown_category", f"NOT ({_miss('category')}) AND category NOT IN {_CATEGORIES}", "category"), ("alias_namespace", "coalesce(namespace, '') = 'alias'", "''"), ("namespace_of_id", "starts_with(coalesce(canonical_id, ''), 'physh:') AND coalesce(namespace, '') <> 'physh'", "namespace"), ("id_of_namespace", "namespace = 'physh' AND NOT starts_with(coalesce(canonical_id, ''), 'physh:')", "canonical_id"), ("aliases_missing", "aliases IS NULL", "''"), ("blank_in_alias", "len(list_filter(coalesce(aliases, []), lambda x: x <> trim(x))) > 0", "''")], "vocab_terms"),
    "edge_issues": "WITH e AS (SELECT e.*, v.canonical_id IS NOT NULL AS is_known, f.canonical_id IS NOT NULL AS fits FROM edge_items e LEFT JOIN (SELECT DISTINCT canonical_id FROM vocab_terms) v USING (canonical_id) LEFT JOIN (SELECT DISTINCT canonical_id, category FROM vocab_terms) f ON f.canonical_id = e.canonical_id AND f.category = e.category) "
    + _rules("edge_id", [("missing_id", _miss("canonical_id"), "''"), ("unknown_category", f"coalesce(category, '') NOT IN {_CATEGORIES}", "category"), ("off_vocabulary", f"NOT ({_miss('canonical_id')}) AND NOT is_known", "canonical_id"), ("other_category", "is_known AND NOT fits", "canonical_id"), ("no_confidence", "confidence IS NULL", "''")], "e"),
    "issues_union": f"SELECT rule, severity, count(*) n FROM ({_MANIFEST_RULES} UNION ALL {_CHUNK_RULES} UNION ALL {_DUPLICATES}) GROUP BY ALL",
    "keys_without_entry": "SELECT CAST(row_id AS VARCHAR) subject, 'key_without_entry' rule, 'error' severity, citation_key detail FROM chunks WHERE coalesce(citation_key, '') <> '' AND citation_key NOT IN (SELECT id FROM bib_entries WHERE id IS NOT NULL)",
    "cited_keys_missing": r"SELECT row_id, target FROM (SELECT row_id, unnest(list_distinct(regexp_extract_all(concat_ws(' ', text, '[@' || trim(citation_key) || ']'), '\[@([\p{L}\p{N}_:-]+)\]', 1))) target FROM chunks) WHERE target NOT IN (SELECT id FROM bib_entries WHERE id IS NOT NULL)",
    "unbalanced_marks": r"SELECT row_id || ':' || n subject, 'unbalanced_marks' rule, 'error' severity, o || '/' || c detail FROM (SELECT row_id, n, len(regexp_extract_all(line, '\(')) o, len(regexp_extract_all(line, '\)')) c FROM (SELECT row_id, unnest(range(1, len(l) + 1)) n, unnest(l) line FROM (SELECT row_id, string_split(text, chr(10)) l FROM chunks WHERE text IS NOT NULL))) WHERE o <> c",
    "delete_plan": f"WITH {_TARGETS} " + " UNION ALL ".join(f"SELECT key, '{t}' AS \"table\", count(*) n FROM tg JOIN {t} ON citation_key = key GROUP BY key" for t in ("chunks", "manifests", "documents")),
    "applied_delete": f"WITH {_TARGETS} SELECT row_id FROM chunks WHERE citation_key IS NULL OR citation_key NOT IN (SELECT key FROM tg)",
    "merge_report": "WITH u AS (SELECT DISTINCT citation_key, doc_id FROM chunks WHERE citation_key <> '') SELECT 'key' kind, citation_key AS value FROM (SELECT citation_key FROM manifests INTERSECT SELECT citation_key FROM u) UNION ALL SELECT DISTINCT 'doc_id', b.doc_id FROM manifests b JOIN u ON b.doc_id = u.doc_id AND b.doc_id <> '' AND b.citation_key <> u.citation_key",
    "applied_updates": "WITH t AS (SELECT entry_key, field, arg_max(new_value, (changed_at, change_id)) v FROM bib_changes WHERE new_value <> '' AND changed_at IS NOT NULL GROUP BY ALL), f AS (SELECT id, pos, unnest(fields) f FROM bib_entries) SELECT id, pos, f.k field, coalesce(t.v, f.v) AS value FROM f LEFT JOIN t ON t.entry_key = id AND t.field = f.k UNION ALL SELECT id, pos, t.field, t.v FROM bib_entries JOIN t ON t.entry_key = id WHERE NOT list_contains(list_transform(fields, lambda x: x.k), t.field)",
    "provider_plan": f"""WITH {_M}, r AS (SELECT citation_key AS key, {_doi("coalesce(doi, '')")} doi, {_arxiv("coalesce(arxiv_id, '')")} arxiv, '' title_norm FROM (SELECT *, row_number() OVER (PARTITION BY citation_key ORDER BY created_at DESC, doc_id DESC) rn FROM manifests WHERE citation_key IS NOT NULL) WHERE rn = 1),
      f AS (SELECT pos result_id, doi, arxiv, key control, title_norm FROM m),
      met AS (SELECT r.key, r.doi od, r.arxiv oa, f.*, CASE WHEN r.doi <> '' AND r.doi = f.doi THEN 0 WHEN r.arxiv <> '' AND r.arxiv = f.arxiv THEN 1 ELSE 2 END p FROM r JOIN f ON (r.doi <> '' AND r.doi = f.doi) OR (r.arxiv <> '' AND r.arxiv = f.arxiv) OR (r.title_norm <> '' AND r.title_norm = f.title_norm)),
      b AS (SELECT *, count(*) OVER (PARTITION BY key) n FROM (SELECT *, min(p) OVER (PARTITION BY key) best FROM met) WHERE p = best),
      x AS (SELECT key, result_id, n, 'eprint' field, oa old_value, arxiv new_value FROM b UNION ALL SELECT key, result_id, n, 'doi', od, doi FROM b UNION ALL SELECT key, result_id, n, 'inspire', '', control FROM b)
      SELECT key, result_id, field, old_value, new_value, CASE WHEN n > 1 THEN 'review: several candidates' WHEN old_value = '' THEN 'fill' ELSE 'review: conflict' END AS "action" FROM x WHERE new_value <> '' AND old_value <> new_value""",
    "provider_round_trip": f"SELECT record_id, coalesce(title, '') title, CAST(len(list_filter(coalesce(authors, [])[1:5], lambda x: trim(coalesce(x, '')) <> '')) AS INTEGER) n_authors, coalesce(left(pub_year, 4), '') pub_year, {_doi(chr(99) + 'oalesce(doi, ' + chr(39) * 2 + ')')} doi, {_arxiv(chr(99) + 'oalesce(arxiv, ' + chr(39) * 2 + ')')} arxiv, coalesce(nullif(control_number, ''), record_id) control_number FROM search_results",
    "valid_cache": "WITH w AS (SELECT DISTINCT doc_id, c.source_sha256, v FROM chunks c JOIN (SELECT doc_id, max(parser_version) v FROM manifests WHERE doc_id IS NOT NULL GROUP BY 1) USING (doc_id)) SELECT doc_id, source_sha256, EXISTS (SELECT 1 FROM manifests m WHERE m.doc_id = w.doc_id AND m.parser_version = w.v AND m.source_sha256 = w.source_sha256) hit FROM w",
    "upserted_chunks": "SELECT chunk_id, max(row_id) row_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1",
    "registered_documents": "SELECT 'doc:' || doc_id doc_id, citation_key, 'reference/parsed/doc_' || doc_id || '.md' parsed_markdown, sha256(text) source_sha256, '2026-01-01' created_at FROM documents WHERE doc_kind = 'parsed_paper' AND text IS NOT NULL AND citation_key IS NOT NULL",
    "linked_attachments": "SELECT DISTINCT citation_key item, '/tmp/import/' || original_pdf path FROM manifests WHERE original_pdf <> '' AND citation_key IN (SELECT id FROM bib_entries)",
    "appended_terms": "SELECT canonical_id, label, CASE WHEN contains(canonical_id, ':') THEN split_part(canonical_id, ':', 1) ELSE '' END AS namespace FROM (SELECT canonical_id, arg_min(label, label) AS label FROM edge_items WHERE canonical_id <> '' AND label <> '' GROUP BY 1) WHERE canonical_id NOT IN (SELECT canonical_id FROM vocab_terms) AND lower(trim(label)) NOT IN (SELECT lower(trim(label)) FROM vocab_terms)",
    "cached_concepts": "WITH b AS (SELECT lower(trim(label)) q, arg_min(canonical_id, edge_id) id FROM edge_items WHERE label <> '' AND canonical_id <> '' GROUP BY 1), t AS (SELECT mention_id, unnest([lower(trim(raw_term))] || list_filter(regexp_extract_all(lower(raw_term), '[a-z0-9]+'), lambda x: length(x) >= 4)) q, unnest(range(0, 1 + len(list_filter(regexp_extract_all(lower(raw_term), '[a-z0-9]+'), lambda x: length(x) >= 4)))) n FROM entity_mentions WHERE raw_term IS NOT NULL) SELECT mention_id, arg_min(id, n) cached_id, min(n) > 0 by_word FROM t JOIN b USING (q) GROUP BY mention_id",
    "key_intersect": "SELECT citation_key FROM chunks WHERE citation_key <> '' INTERSECT SELECT citation_key FROM documents",
    "key_except": "SELECT citation_key FROM chunks WHERE citation_key <> '' EXCEPT SELECT citation_key FROM documents",
    "coalesce_merge": "WITH n AS (SELECT doc_id, arg_max(parser, (created_at, parser)) parser FROM manifests WHERE doc_id <> '' GROUP BY 1) SELECT row_id, coalesce(nullif(chunks.parser, ''), n.parser, '') parser FROM chunks LEFT JOIN n USING (doc_id)",
}
