"""Phrases, vocabulary and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import graph as G
from ..operators import phrases as P
from ..operators import records as R
from ..operators import vocabulary as W
from ..session import table


def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.phrase_counts(table(spark, d, "chunks"), "text")


def useful_phrases(spark: SparkSession, d: str) -> DataFrame:
    return P.useful_phrases(P.phrase_counts(table(spark, d, "chunks"), "text")).select("term", "count", "quality")


def undominated_phrases(spark: SparkSession, d: str) -> DataFrame:
    return P.undominated(P.useful_phrases(P.phrase_counts(table(spark, d, "chunks"), "text"))).select("term", "count", "quality")


def extracted_terms(spark: SparkSession, d: str) -> DataFrame:
    """The best phrases of the chunks, of section titles that say something, and of the entries' titles and abstracts."""
    terms, chunks, entries = (table(spark, d, name) for name in ("vocab_terms", "chunks", "bib_entries"))
    protected = W.names(terms).select(F.array_join(T.term_tokens(F.col("name")), " ").alias("norm")).where("norm <> ''")
    about = entries.where("deleted_at IS NULL").select(R.field("fields", "title").alias("title"), R.field("fields", "abstract").alias("abstract"))
    return P.extract_terms([(chunks, "text"), (chunks.where(P.keeps_section_title(F.col("section_title"))), "section_title"), (about, "title"), (about, "abstract")], 40, protected)


def kept_section_titles(spark: SparkSession, d: str) -> DataFrame:
    """Section titles that say something of the domain, with their rows."""
    title = F.col("section_title")
    return table(spark, d, "chunks").where(P.keeps_section_title(title)).groupBy(T.squeeze(F.lower(title)).alias("title")).agg(F.count("*").alias("n"))


def phrase_containment(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the vocabulary that stand, word by word, within a longer label."""
    terms = table(spark, d, "vocab_terms").select("canonical_id", F.array_join(T.term_tokens(F.col("label")), " ").alias("norm"))
    tokens = F.split("norm", " ")
    n = F.size(tokens)
    lengths = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.array_join(F.slice(tokens, s, k), " ")))))
    longer = terms.select(F.col("canonical_id").alias("longer_id"), F.explode(grams).alias("norm"))
    return terms.join(longer, "norm").where("canonical_id <> longer_id").select("canonical_id", "longer_id")


def vocabulary_lookup(spark: SparkSession, d: str) -> DataFrame:
    return W.lookup(table(spark, d, "entity_mentions"), table(spark, d, "vocab_terms")).where("found_id IS NOT NULL").select("mention_id", "found_id", "found_label")


def similar_terms(spark: SparkSession, d: str) -> DataFrame:
    return W.best_similar(table(spark, d, "entity_mentions"), table(spark, d, "vocab_terms"))


def resolved_terms(spark: SparkSession, d: str) -> DataFrame:
    return W.resolve_terms(table(spark, d, "entity_mentions").select("mention_id", "raw_term"), table(spark, d, "vocab_terms"))


def guessed_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab_terms").select("canonical_id", T.guess_category(F.col("label"), F.lit("")).alias("guessed"), T.namespace_of(F.col("canonical_id")).alias("ns"))


def category_of_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_items").select("edge_id", T.guess_category(F.coalesce("label", F.lit("")), F.coalesce("category", F.lit(""))).alias("guessed"))


def term_plan(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the edge plan as suggestions for the vocabulary, with status and namespace."""
    items = table(spark, d, "edge_items").where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.bool_or("needs_review").alias("needs_review"))
    return W.term_plan(items, table(spark, d, "vocab_terms"))


def accepted_terms(spark: SparkSession, d: str) -> DataFrame:
    return W.accepted(term_plan(spark, d), accept_local=True).select("canonical_id", "namespace")


def status_plan(spark: SparkSession, d: str) -> DataFrame:
    return W.edge_plan(table(spark, d, "edge_items"), table(spark, d, "vocab_terms"), G.page_edges(table(spark, d, "chunks"))).select("edge_id", "planned_status")


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    plan = W.edge_plan(table(spark, d, "edge_items"), table(spark, d, "vocab_terms"), G.page_edges(table(spark, d, "chunks")))
    return plan.groupBy("category").agg(*[F.count_if(F.col("planned_status") == s).alias(f"n_{s}") for s in ("new", "existing", "unresolved")], F.count_if("needs_review").alias("n_review"))


def wiki_nodes(spark: SparkSession, d: str) -> DataFrame:
    return W.wiki_nodes(table(spark, d, "edge_items"), table(spark, d, "vocab_terms"), "physh")[0]


def wiki_skipped(spark: SparkSession, d: str) -> DataFrame:
    return W.wiki_nodes(table(spark, d, "edge_items"), table(spark, d, "vocab_terms"), "physh")[1]


def ids_by_category(spark: SparkSession, d: str) -> DataFrame:
    return W.ids_by_category(table(spark, d, "vocab_terms"))


def edge_index(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_index(table(spark, d, "edge_items"))


def edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first pages of every term."""
    return G.pages_of_terms(table(spark, d, "edge_items"), 10)


def edge_lookup_one(spark: SparkSession, d: str) -> DataFrame:
    return G.pages_of(table(spark, d, "edge_items"), "local:charge-carrier-trapping", 10)


def graph_size(spark: SparkSession, d: str) -> DataFrame:
    return G.size(table(spark, d, "edge_items"))


def chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.page_edges(table(spark, d, "chunks"))


def alias_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that were typed as if they were terms."""
    aliases = table(spark, d, "vocab_terms").select(F.explode("aliases").alias("a")).select(T.slugify(F.col("a")).alias("alias"))
    return aliases.join(table(spark, d, "entity_mentions").select(T.slugify(F.col("raw_term")).alias("alias")), "alias", "left_semi").distinct()


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _has(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _guess_sql(label: str, given: str) -> str:
    lower = f"lower({label})"
    listed = " ".join(f"WHEN {_has(lower, words)} THEN '{name}'" for name, words in V.CATEGORY_WORDS.items())
    return f"CASE WHEN {given} IN {_in(V.EDGE_CATEGORIES)} THEN {given} WHEN {lower} IN {_in(V.EXPERIMENT_NAMES)} THEN 'experiments' WHEN {_has(lower, V.PROPERTY_WORDS)} THEN 'properties' {listed} ELSE 'research_areas' END"


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_NAMES = "names AS (SELECT lower(trim(unnest([label] || coalesce(aliases, [])))) nm, pos, canonical_id, label, category FROM vocab_terms), firsts AS (SELECT nm, arg_min(canonical_id, pos) found_id, arg_min(label, pos) found_label FROM names WHERE nm <> '' GROUP BY nm)"
_PAGE_EDGES = "pe AS (SELECT DISTINCT citation_key, category, canonical_id FROM (SELECT citation_key, category, unnest(edges[category]) canonical_id FROM (SELECT citation_key, edges, unnest(map_keys(edges)) category FROM chunks)) WHERE canonical_id IS NOT NULL)"
_PLAN = f"{_PAGE_EDGES}, " + """plan AS (SELECT e.*, CASE WHEN v.canonical_id IS NULL THEN 'unresolved' WHEN g.canonical_id IS NOT NULL THEN 'existing' ELSE 'new' END planned_status FROM edge_items e
  LEFT JOIN (SELECT DISTINCT canonical_id FROM vocab_terms) v USING (canonical_id) LEFT JOIN pe g ON g.citation_key = e.citation_key AND g.category = e.category AND g.canonical_id = e.canonical_id)"""
_WIKI = """w AS (SELECT canonical_id, count(DISTINCT citation_key) n_pages, min(citation_key) first_page FROM edge_items WHERE canonical_id IS NOT NULL GROUP BY 1),
  v AS (SELECT canonical_id, arg_min(label, pos) AS label, arg_min(category, pos) category, arg_min(len(coalesce(aliases, [])), pos) n_aliases, true AS known FROM vocab_terms GROUP BY 1),
  j AS (SELECT w.*, label, category, n_aliases, CASE WHEN known IS NULL THEN 'not in vocabulary' WHEN NOT starts_with(w.canonical_id, 'physh:') THEN 'not in physh' END reason FROM w LEFT JOIN v USING (canonical_id))"""
_SLUG = r"replace(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ', '-')"
_TITLE = r"trim(regexp_replace(lower(section_title), '[\s\p{Z}]+', ' ', 'g'))"
_COMPACT = f"regexp_replace({_TITLE}, '[^A-Za-z0-9]', '', 'g')"
# a lower-case title looks like an acronym only without letters that have a case, which an acronym must have
_ACRONYM = f"(length({_COMPACT}) BETWEEN 2 AND 12 AND regexp_matches({_COMPACT}, '[A-Za-z]') AND upper({_COMPACT}) = {_COMPACT})"
QUERIES = {f.__name__: f for f in (phrase_counts, useful_phrases, undominated_phrases, extracted_terms, kept_section_titles, phrase_containment, vocabulary_lookup, similar_terms, resolved_terms, guessed_categories, category_of_mentions, term_plan, accepted_terms, status_plan, plan_summary, wiki_nodes, wiki_skipped, ids_by_category, edge_index, edge_lookup, edge_lookup_one, graph_size, chunk_edges, alias_leaks)}
SQL = {
    "kept_section_titles": f"SELECT {_TITLE} title, count(*) n FROM chunks WHERE {_TITLE} <> '' AND {_TITLE} NOT IN {_in(V.SECTION_TITLES_LEFT_OUT)} AND NOT ends_with({_TITLE}, ' run') AND len({_TOKENS.format(_TITLE)}) > 0 AND (list_has_any({_TOKENS.format(_TITLE)}, {_list(V.DOMAIN_WORDS)}) OR {_ACRONYM}) GROUP BY 1",
    "phrase_containment": f"WITH t AS (SELECT canonical_id, array_to_string({_TOKENS.format('label')}, ' ') norm FROM vocab_terms) SELECT a.canonical_id, b.canonical_id longer_id FROM t a JOIN t b ON a.norm <> b.norm AND contains(' ' || b.norm || ' ', ' ' || a.norm || ' ') AND a.canonical_id <> b.canonical_id",
    "vocabulary_lookup": f"WITH {_NAMES} SELECT mention_id, found_id, found_label FROM entity_mentions JOIN firsts ON nm = lower(trim(raw_term))",
    "guessed_categories": f"SELECT canonical_id, {_guess_sql('label', chr(39) * 2)} guessed, CASE WHEN contains(canonical_id, ':') THEN split_part(canonical_id, ':', 1) ELSE '' END ns FROM vocab_terms",
    "category_of_mentions": f"SELECT edge_id, {_guess_sql('coalesce(label, ' + chr(39) * 2 + ')', 'coalesce(category, ' + chr(39) * 2 + ')')} guessed FROM edge_items",
    "term_plan": "SELECT canonical_id, bool_or(needs_review) needs_review, CASE WHEN canonical_id IN (SELECT canonical_id FROM vocab_terms) THEN 'existing' ELSE 'new' END status, CASE WHEN contains(canonical_id, ':') THEN split_part(canonical_id, ':', 1) ELSE '' END AS namespace FROM edge_items WHERE canonical_id IS NOT NULL GROUP BY canonical_id",
    "accepted_terms": "SELECT canonical_id, split_part(canonical_id, ':', 1) AS namespace FROM edge_items WHERE canonical_id NOT IN (SELECT canonical_id FROM vocab_terms) GROUP BY canonical_id HAVING (starts_with(canonical_id, 'physh:') AND NOT bool_or(needs_review)) OR starts_with(canonical_id, 'local:')",
    "status_plan": f"WITH {_PLAN} SELECT edge_id, planned_status FROM plan",
    "plan_summary": f"WITH {_PLAN} SELECT category, " + ", ".join(f"count(*) FILTER (planned_status = '{s}') n_{s}" for s in ("new", "existing", "unresolved")) + ", count(*) FILTER (needs_review) n_review FROM plan GROUP BY category",
    "wiki_nodes": f"WITH {_WIKI} SELECT canonical_id, label, category, CAST(n_aliases AS INTEGER) n_aliases, n_pages, first_page, replace(replace(canonical_id, ':', '_'), '/', '_') page FROM j WHERE reason IS NULL",
    "wiki_skipped": f"WITH {_WIKI} SELECT canonical_id, n_pages, reason FROM j WHERE reason IS NOT NULL",
    "ids_by_category": f"SELECT category, count(DISTINCT canonical_id) n_ids FROM vocab_terms WHERE category IN {_in(V.EDGE_CATEGORIES)} GROUP BY category",
    "edge_index": "SELECT category, canonical_id, count(DISTINCT citation_key) n_pages, min(citation_key) first_page, max(citation_key) last_page FROM edge_items WHERE canonical_id IS NOT NULL AND category IS NOT NULL AND citation_key IS NOT NULL GROUP BY ALL",
    "edge_lookup": "SELECT canonical_id, citation_key, CAST(n AS INTEGER) n FROM (SELECT canonical_id, citation_key, row_number() OVER (PARTITION BY canonical_id ORDER BY citation_key) n FROM (SELECT DISTINCT canonical_id, citation_key FROM edge_items WHERE canonical_id IS NOT NULL AND citation_key IS NOT NULL)) WHERE n <= 10",
    "edge_lookup_one": "SELECT DISTINCT citation_key FROM edge_items WHERE canonical_id = 'local:charge-carrier-trapping' AND citation_key IS NOT NULL ORDER BY citation_key LIMIT 10",
    "graph_size": "SELECT count(DISTINCT citation_key) n_nodes, count(DISTINCT canonical_id) n_terms, count(DISTINCT (category, canonical_id, citation_key)) n_edges FROM edge_items WHERE canonical_id IS NOT NULL AND category IS NOT NULL AND citation_key IS NOT NULL",
    "chunk_edges": f"WITH {_PAGE_EDGES} SELECT * FROM pe",
    "alias_leaks": f"SELECT DISTINCT a AS alias FROM (SELECT {_SLUG.format('unnest(aliases)')} a FROM vocab_terms) WHERE a IN (SELECT {_SLUG.format('raw_term')} FROM entity_mentions WHERE raw_term IS NOT NULL)",
}
