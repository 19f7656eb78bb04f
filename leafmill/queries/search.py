"""Search queries over documents, chunks and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators.records import manifest_records
from ..session import table

QUERY = "cryogenic detector threshold calibration"
PHRASE = "superconducting resonator"
TITLE = "cryogenic detector"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = S.bm25_scores(table(spark, d, "documents"), QUERY, "doc_id", "text").where("bm25 > 0")
    return scored.select("doc_id", F.round("bm25", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def bm25_chunks_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = S.bm25_scores(table(spark, d, "chunks"), QUERY, "row_id", "text").where("bm25 > 0")
    return scored.select("row_id", F.round("bm25", 4).alias("score")).orderBy(F.desc("score"), "row_id").limit(20)


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = S.tfidf(table(spark, d, "documents").select("doc_id", "text"), QUERY, "doc_id", "text")
    return scored.select("doc_id", F.round("tfidf", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid score of every chunk that has one."""
    scored = S.hybrid_scores(table(spark, d, "chunks"), PHRASE, max_features=None).where("score > 0")
    return scored.select("row_id", "section_type", F.round("raw_score", 4).alias("raw_score"), F.round("score", 4).alias("score"))


def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    hits = S.search_chunks(table(spark, d, "chunks"), QUERY, top_k=10)
    return hits.select("row_id", "chunk_id", "citation_key", "section_type", "raw_score", "score")


def token_df(spark: SparkSession, d: str) -> DataFrame:
    return S.document_frequencies(table(spark, d, "documents"), "doc_id", "text")


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return S.term_frequencies(table(spark, d, "documents"), "doc_id", "text")


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_stats(table(spark, d, "documents"), "text").select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    by_kind = table(spark, d, "documents").select("doc_kind", F.size(T.tokenize(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    return by_kind.groupBy("doc_kind").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_len"))


def max_normalised(spark: SparkSession, d: str) -> DataFrame:
    """BM25 divided by the best score."""
    scored = S.bm25_scores(table(spark, d, "documents"), QUERY, "doc_id", "text")
    best = scored.agg(F.max("bm25")).first()[0] or 0.0
    return scored.select("doc_id", F.round(F.col("bm25") / best if best > 0 else F.lit(0.0), 4).alias("norm_score")).where("norm_score > 0")


def structured_search(spark: SparkSession, d: str) -> DataFrame:
    found = S.record_scores(manifest_records(table(spark, d, "bib_entries")), TITLE)
    return found.select("key", "pos", "score", F.array_join("matched_fields", ",").alias("matched"))


def structured_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.structured_search(manifest_records(table(spark, d, "bib_entries")), TITLE).select("key", "pos", "score")


def local_search_scores(spark: SparkSession, d: str) -> DataFrame:
    found = S.local_scores(manifest_records(table(spark, d, "bib_entries")), [TITLE, "thermal sensor"])
    return found.select("key", "pos", "score", F.array_join("reasons", ",").alias("reasons"))


def local_search_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """Records with an edge to a term, the most frequent term of a category."""
    edges = table(spark, d, "edge_items").where("citation_key IS NOT NULL AND canonical_id IS NOT NULL AND category IS NOT NULL")
    top = edges.where("category = 'techniques'").groupBy("canonical_id").count().orderBy(F.desc("count"), "canonical_id").first()["canonical_id"]
    found = S.local_search(manifest_records(table(spark, d, "bib_entries")), tags=[("techniques", top)], limit=20, edges=edges)
    return found.select("key", "pos", "score", F.array_join("reasons", ",").alias("reasons"))


def local_search_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Records by the keys of the first search results' matches in the manifest, without case."""
    first = table(spark, d, "bib_entries").agg(F.min("id"), F.max("id")).first()
    return S.local_search(manifest_records(table(spark, d, "bib_entries")), keys=[first[0].upper(), first[1]], limit=20).select("key", "pos", "score")


def query_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words of a query in each document's text."""
    tokens = F.array(*[F.lit(w) for w in QUERY.split()])
    text = T.normalize_title(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(tokens, lambda x: text.contains(x))).alias("matched")).where("matched > 0")


def grep(spark: SparkSession, d: str) -> DataFrame:
    return S.grep_lines(table(spark, d, "documents"), "doc_id", "text", PHRASE)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return S.cosine_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_.+-]+'), lambda x: length(trim(x, '._-')) >= 2)"
_WORDS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)"


def _bm25_sql(source: str, key: str, query: str) -> str:
    terms = query.lower().split()
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * greatest(len(w), 1) / greatest(mean, 1))) ELSE 0 END" for i in range(len(terms)))
    return f"toks AS (SELECT {key}, {_TOKENS} w FROM {source}), tfs AS (SELECT *, {tf} FROM toks), stats AS (SELECT count(*) n, avg(len(w)) mean, {df} FROM tfs), bm AS (SELECT {key}, {score} bm25 FROM tfs, stats)"


def _tfidf_sql(source: str, key: str, query: str, most: int | None = None) -> str:
    cap = f" ORDER BY sum(tf) DESC, word LIMIT {most}" if most else ""
    asked = ", ".join(f"('{w}')" for w in query.lower().split())
    return f"""wd AS (SELECT {key}, unnest({_WORDS}) word FROM {source}), tf AS (SELECT {key}, word, count(*) tf FROM wd GROUP BY ALL),
      idf AS (SELECT word, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1 idf FROM tf GROUP BY word{cap}),
      q AS (SELECT word, count(*) * any_value(idf) q FROM (VALUES {asked}) v(word) JOIN idf USING (word) GROUP BY word),
      ti AS (SELECT {key}, sum(tf * idf * q) / (sqrt(sum(tf * idf * tf * idf)) * (SELECT sqrt(sum(q * q)) FROM q)) tfidf FROM tf JOIN idf USING (word) LEFT JOIN q USING (word) GROUP BY {key} HAVING sum(tf * idf * q) > 0)"""


def _contains_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def section_type_sql(stored: str | None = "section_type") -> str:
    """Section type of the chunks as SQL over section_title and text."""
    from ..functions import fixed_values as V

    hay = "lower(trim(concat_ws(' ', coalesce(section_title, ''), left(coalesce(text, ''), 500)), ' '))"
    told = f"""CASE WHEN starts_with(ltrim(left(coalesce(text, ''), 2000)), '---') AND (contains(left(ltrim(text), 500), 'doc_id:') OR contains(left(ltrim(text), 500), 'citation_key:')) THEN 'metadata'
      WHEN {hay} = '' THEN 'body'
      WHEN {_contains_any(hay, V.REFERENCE_MARKERS)} OR len(regexp_extract_all(left(text, 2000), '(?m)^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+\\S+')) >= 3 THEN 'references'
      WHEN {_contains_any(hay, V.METADATA_MARKERS)} THEN 'metadata' WHEN {_contains_any(hay, ('appendix', 'supplement'))} THEN 'appendix' WHEN contains({hay}, 'abstract') THEN 'abstract'
      WHEN contains({hay}, 'introduction') OR starts_with({hay}, 'intro') THEN 'introduction' WHEN {_contains_any(hay, V.METHOD_MARKERS)} THEN 'methods'
      WHEN {_contains_any(hay, V.RESULT_MARKERS)} THEN 'results' WHEN contains({hay}, 'discussion') THEN 'discussion' WHEN {_contains_any(hay, V.CONCLUSION_MARKERS)} THEN 'conclusion' ELSE 'body' END"""
    return f"coalesce(nullif(trim({stored}), ''), {told})" if stored else told


def _weight_sql(column: str) -> str:
    from ..functions import fixed_values as V

    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.SECTION_WEIGHTS.items()) + " ELSE 1.0 END"


def _hybrid_sql(query: str, most: int | None = None) -> str:
    return f"""{_bm25_sql('chunks', 'row_id', query)}, {_tfidf_sql('chunks', 'row_id', query, most)},
      raw AS (SELECT c.row_id, chunk_id, citation_key, {section_type_sql()} section_type, 0.55 * coalesce(tfidf, 0) + 0.45 * bm25 / (SELECT max(bm25) FROM bm) + CASE WHEN contains(lower(text), '{query}') THEN 0.05 ELSE 0 END raw
              FROM chunks c JOIN bm USING (row_id) LEFT JOIN ti USING (row_id)),
      hy AS (SELECT *, raw * {_weight_sql('section_type')} score FROM raw)"""


_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_MANIFEST = "m AS (SELECT pos, id AS key, coalesce(list_filter(fields, lambda x: x.k = 'title')[1].v, '') title, coalesce(list_filter(fields, lambda x: x.k = 'author')[1].v, '') author FROM bib_entries)"

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_chunks_topk, tfidf_topk, hybrid_scores, search_evidence, token_df, term_frequencies, corpus_totals, corpus_stats, max_normalised, structured_search, structured_search_topk, local_search_scores, local_search_by_tag, local_search_by_key, query_overlap, grep, vector_topk)}
SQL = {
    "bm25_topk": f"WITH {_bm25_sql('documents', 'doc_id', QUERY)} SELECT doc_id, round(bm25, 4) score FROM bm WHERE bm25 > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_chunks_topk": f"WITH {_bm25_sql('chunks', 'row_id', QUERY)} SELECT row_id, round(bm25, 4) score FROM bm WHERE bm25 > 0 ORDER BY score DESC, row_id LIMIT 20",
    "tfidf_topk": f"WITH {_tfidf_sql('documents', 'doc_id', QUERY)} SELECT doc_id, round(tfidf, 4) score FROM ti ORDER BY score DESC, doc_id LIMIT 10",
    "hybrid_scores": f"WITH {_hybrid_sql(PHRASE)} SELECT row_id, section_type, round(raw, 4) raw_score, round(score, 4) score FROM hy WHERE score > 0",
    "search_evidence": f"""WITH {_hybrid_sql(QUERY, 10_000)}, kept AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, row_id) rn FROM hy WHERE section_type NOT IN ('references', 'metadata') AND score >= 0.05)
        SELECT row_id, chunk_id, citation_key, section_type, round(raw, 4) raw_score, round(score, 4) score FROM kept WHERE rn = 1 ORDER BY kept.score DESC, row_id LIMIT 10""",
    "token_df": f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) term FROM documents) SELECT term, count(DISTINCT doc_id) df, count(*) cf FROM t GROUP BY term",
    "term_frequencies": f"SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({_TOKENS}) term FROM documents) GROUP BY ALL",
    "corpus_totals": f"SELECT count(*) n_docs, round(avg(len({_TOKENS})), 6) avg_len FROM documents",
    "corpus_stats": f"SELECT doc_kind, count(*) n_docs, CAST(sum(len({_TOKENS})) AS BIGINT) n_tokens, round(avg(len({_TOKENS})), 6) avg_len FROM documents GROUP BY doc_kind",
    "max_normalised": f"WITH {_bm25_sql('documents', 'doc_id', QUERY)} SELECT doc_id, round(bm25 / (SELECT max(bm25) FROM bm), 4) norm_score FROM bm WHERE round(bm25 / (SELECT max(bm25) FROM bm), 4) > 0",
    "structured_search": f"WITH {_MANIFEST} SELECT key, pos, CAST(CASE WHEN {_NORM.format('title')} = '{TITLE}' THEN 90 ELSE 50 END AS INTEGER) score, CASE WHEN {_NORM.format('title')} = '{TITLE}' THEN 'title' ELSE 'title-substring' END matched FROM m WHERE contains({_NORM.format('title')}, '{TITLE}')",
    "structured_search_topk": f"WITH {_MANIFEST} SELECT key, pos, CAST(CASE WHEN {_NORM.format('title')} = '{TITLE}' THEN 90 ELSE 50 END AS INTEGER) score FROM m WHERE contains({_NORM.format('title')}, '{TITLE}') ORDER BY score DESC, lower(key), key, pos LIMIT 10",
    "local_search_by_tag": "WITH t AS (SELECT canonical_id FROM edge_items WHERE category = 'techniques' AND canonical_id IS NOT NULL AND citation_key IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id AS key, pos, CAST(60 AS INTEGER) score, 'tag' reasons FROM bib_entries WHERE id IN (SELECT citation_key FROM edge_items WHERE category = 'techniques' AND canonical_id = (SELECT canonical_id FROM t)) ORDER BY lower(id), id LIMIT 20",
    "local_search_by_key": "SELECT id AS key, pos, CAST(100 AS INTEGER) score FROM bib_entries WHERE lower(id) IN (SELECT lower(min(id)) FROM bib_entries UNION ALL SELECT lower(max(id)) FROM bib_entries) ORDER BY lower(id), id LIMIT 20",
    "query_overlap": "SELECT doc_id, CAST(matched AS INTEGER) matched FROM (SELECT doc_id, " + " + ".join(f"CAST(contains({_NORM.format('text')}, '{w}') AS INTEGER)" for w in QUERY.split()) + " matched FROM documents) WHERE matched > 0",
    "grep": f"SELECT doc_id, CAST(line_no AS INTEGER) line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) rn FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) line_no, regexp_replace(unnest(l), '\\r$', '') line FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)) WHERE contains(lower(line), '{PHRASE}')) WHERE rn <= 5",
    "vector_topk": "SELECT * FROM (SELECT q.vec_id query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) cosine, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS INTEGER) rank FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5",
}
