"""Imports from several inputs: provider rows, batches and archives as one table of candidates, planned and applied.

Caches and vector tables are keyed tables here: a cached row counts where its keys and the hash of its content agree, and
an upsert keeps the newest row of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vocabulary as W
from ..operators.records import field, keep_first, keep_last, manifest_records, unique_keys
from .changes import import_plan

#: What is read of a provider's record.
HIT = (
    "id string, metadata struct<control_number:string, titles:array<struct<title:string>>, authors:array<struct<full_name:string,full_name_unicode_normalized:string>>, imprints:array<struct<date:string>>, "
    "preprint_date:string, publication_info:array<struct<year:string>>, dois:array<struct<value:string>>, arxiv_eprints:array<struct<value:string>>>"
)


def provider_rows(df: DataFrame, column: str = "hit", provider: str = "inspire", most_authors: int = 5) -> DataFrame:
    """Rows of a search from a provider's records as JSON: first title, first authors, year, first DOI and arXiv id.

    The year is the imprint's, else the preprint's, else the publication's; what is missing is ``''``, and text that
    isn't JSON gives a row of empty values.
    """
    h = df.select(F.from_json(column, HIT).alias("h")).select(F.col("h.id").alias("id"), F.coalesce(F.col("h.metadata"), F.from_json(F.lit("{}"), HIT)["metadata"]).alias("m"))
    first = lambda name, of: F.coalesce(F.get(F.col(f"m.{name}"), F.lit(0))[of], F.lit(""))
    names = F.transform(F.slice(F.coalesce("m.authors", F.array()), 1, most_authors), lambda a: F.trim(F.coalesce(F.nullif(a["full_name"], F.lit("")), a["full_name_unicode_normalized"], F.lit(""))))
    year = F.coalesce(F.nullif(F.substring(first("imprints", "date"), 1, 4), F.lit("")), F.nullif(F.substring("m.preprint_date", 1, 4), F.lit("")), first("publication_info", "year"))
    number = F.coalesce(F.nullif("m.control_number", F.lit("")), F.lit(""))
    record = F.coalesce(F.nullif("id", F.lit("")), number)
    return h.select(
        F.lit(provider).alias("provider"), record.alias("record_id"), first("titles", "title").alias("title"), F.filter(names, lambda x: x != "").alias("authors"), year.alias("pub_year"),
        T.normalize_doi(first("dois", "value")).alias("doi"), T.normalize_arxiv(first("arxiv_eprints", "value")).alias("arxiv"), F.coalesce(F.nullif(number, F.lit("")), record).alias("control_number"),
    )


def nth_result(results: DataFrame, n: int, order: list) -> DataFrame:
    """The n-th row of a result list, counted from 1; an error where there is none."""
    rows = results.orderBy(*order).limit(n)
    if n < 1 or rows.count() < n:
        raise ValueError(f"no result number {n}")
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") == n).drop("_n")  # n rows


def import_inputs(batch: DataFrame, results: DataFrame) -> DataFrame:
    """(origin, cand_id, id, fields, record_id) of all inputs: a batch's entries as they are, search results as entries.

    ``batch`` has cand_id, entry, source and record_id; a result without a usable key gets one of its first author and year.
    """
    kv = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    some = lambda c: F.coalesce(c, F.lit(""))
    told = F.array(kv("title", some(F.col("title"))), kv("author", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " and ")), kv("year", some(F.col("pub_year"))), kv("doi", some(F.col("doi"))), kv("eprint", some(F.col("arxiv"))))
    name = F.regexp_extract(F.get("authors", F.lit(0)), r"([\p{L}]+)\s*(?:,.*)?$", 1)
    key = T.sanitize_key(F.concat(F.lower(some(name)), some(F.col("pub_year"))))
    found = results.select(F.lit("search").alias("origin"), F.col("result_id").alias("cand_id"), key.alias("id"), F.filter(told, lambda x: x["v"] != "").alias("fields"), some(F.col("record_id")).alias("record_id"))
    own = batch.select(F.when(F.col("source") == "zip_batch", "zip").otherwise("bib").alias("origin"), "cand_id", F.coalesce(field("entry", "id"), F.lit("")).alias("id"), F.col("entry").alias("fields"), some(F.col("record_id")).alias("record_id"))
    return own.unionByName(found)


def planned_imports(inputs: DataFrame, entries: DataFrame) -> DataFrame:
    """Each input with what it duplicates, by existing entries first, then by earlier inputs; and the action for the manifest."""
    records = manifest_records(inputs.select(F.col("cand_id").cast("string").alias("id"), F.col("cand_id").alias("pos"), "fields"))
    plan = import_plan(records, manifest_records(entries)).select(F.col("pos").alias("cand_id"), "duplicate_of", "duplicate_match", "status")
    return inputs.join(plan, "cand_id").withColumn("manifest_action", F.when(F.col("status") == "new", "append").otherwise("skip-duplicate"))


def applied_imports(plan: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries`` (id, pos, fields) followed by the new inputs of a plan, each under a key that nobody else has."""
    last = entries.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    fresh = plan.where("manifest_action = 'append'").withColumn("base", F.coalesce(F.nullif("id", F.lit("")), F.lit("untitled")))
    keyed = unique_keys(fresh, "base", "cand_id", entries.select("id"))
    # places follow the candidates' ids, so numbering needs no single task
    placed = keyed.select(F.col("unique_key").alias("id"), (F.col("cand_id") + last).cast("long").alias("pos"), "fields")
    return entries.select("id", F.col("pos").cast("long").alias("pos"), "fields").unionByName(placed)


def valid_cache(wanted: DataFrame, cache: DataFrame, content: str = "content") -> DataFrame:
    """``wanted`` (doc_id, parser_version and the content or its source_sha256) with ``hit``: whether the cache has it, made by the same parser from the same content."""
    sha = F.sha2(content, 256) if content in wanted.columns else F.col("source_sha256")
    keys = ["doc_id", "parser_version", "_sha"]
    have = cache.select("doc_id", "parser_version", F.col("source_sha256").alias("_sha")).where("doc_id IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    return wanted.withColumn("_sha", sha).join(have, keys, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit", "_sha")


def upserted(df: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with the rows of ``changes`` put in by key: a key's row of the changes replaces the old one, its newest by ``order`` counts."""
    fresh = keep_last(changes, [key], [order])
    return df.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(df.columns))


def register_parsed(manifests: DataFrame, parsed: DataFrame, today: str) -> DataFrame:
    """``manifests`` with a row for each externally parsed text (doc_id, citation_key, route, parser, parser_version, text), hashed from the text."""
    columns = {"parsed_markdown": T.evidence_path(F.col("doc_id"), "parsed"), "source_sha256": F.sha2("text", 256), "created_at": F.lit(today)}
    rows = parsed.withColumns(columns)
    kept = [c for c in manifests.columns if c in rows.columns]
    fresh = rows.select(*kept, *[F.lit(None).cast(dict(manifests.dtypes)[c]).alias(c) for c in manifests.columns if c not in kept])
    return upserted(manifests, keep_first(fresh, ["doc_id"], ["source_sha256"]), "doc_id", "source_sha256")


def linked_attachments(items: DataFrame, attachments: DataFrame, files: DataFrame) -> DataFrame:
    """(item, path): the files of the attachments of each item.

    An item names its attachments (``links``) or an attachment names its item (``of``); both ways count, each pair once.
    An attachment's file is the one with its file name; ``files`` has path.
    """
    down = items.select("item", F.explode("links").alias("attachment"))
    up = attachments.where("of IS NOT NULL").select(F.col("of").alias("item"), "attachment").join(items.select("item"), "item", "left_semi")
    name = lambda c: F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    pairs = down.unionByName(up).distinct().join(attachments.select("attachment", name(F.col("path")).alias("name")).where("name <> ''").distinct(), "attachment")
    return pairs.join(files.select("path", name(F.col("path")).alias("name")), "name").select("item", "path").distinct()


def suggested_edges(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(category, canonical_id, label, count, confidence, needs_review): extracted phrases resolved to terms, each term once by its best phrase."""
    found = W.resolve_terms(phrases.select(F.col("term").alias("raw_term"), "count", "rank"), terms)
    first = keep_first(found, ["resolved_id"], ["rank"])
    return first.select(F.col("resolved_category").alias("category"), F.col("resolved_id").alias("canonical_id"), F.col("resolved_label").alias("label"), "count", "confidence", F.col("unresolved").alias("needs_review"))


def appended_terms(terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """The rows of ``resolved`` (canonical_id, label, category, raw_term) to be added to the vocabulary: neither id nor label is there yet."""
    fresh = keep_first(resolved.where("canonical_id <> '' AND label <> ''"), ["canonical_id"], ["raw_term"])
    fresh = fresh.join(terms.select("canonical_id").distinct(), "canonical_id", "left_anti")
    names = terms.select(F.lower(F.trim("label")).alias("_l")).distinct()
    fresh = fresh.withColumn("_l", F.lower(F.trim("label"))).join(names, "_l", "left_anti").drop("_l")
    aliases = F.when(F.lower("raw_term") != F.lower("label"), F.array("raw_term")).otherwise(F.array().cast("array<string>"))
    return fresh.select("canonical_id", "label", T.namespace_of(F.col("canonical_id")).alias("namespace"), "category", aliases.alias("aliases"))


def migrated_tags(tags: DataFrame, terms: DataFrame) -> DataFrame:
    """(citation_key, tag, category, canonical_id, confidence, unresolved) of pages' tags as edges; the tags stay as they are.

    A tag that the vocabulary hasn't becomes a local id that needs review, with confidence 0.
    """
    clean = tags.select("citation_key", F.trim("tag").alias("raw_term")).where("raw_term <> ''").distinct()
    found = W.resolve_terms(clean, terms)
    return found.select("citation_key", F.col("raw_term").alias("tag"), F.col("resolved_category").alias("category"), F.col("resolved_id").alias("canonical_id"), F.when(F.col("unresolved"), 0.0).otherwise(1.0).alias("confidence"), "unresolved")


def cached_concepts(terms: DataFrame, cache: DataFrame, column: str = "raw_term") -> DataFrame:
    """``terms`` with cached_id and cached_label: what an earlier search for a term, or for one of its words, found first.

    ``cache`` has query, rank, canonical_id and label. The whole term counts before its words, those in their order.
    """
    best = cache.groupBy(F.lower(F.trim("query")).alias("_q")).agg(F.min(F.struct("rank", "canonical_id", "label")).alias("_hit"))
    asked = terms.select(F.col(column).alias("_t")).where("_t IS NOT NULL").distinct()
    words = F.transform(F.filter(T.term_tokens(F.col("_t")), lambda x: F.length(x) >= 4), lambda x: x)
    tries = F.concat(F.array(F.lower(F.trim("_t"))), words)
    hits = asked.select("_t", F.posexplode(tries).alias("_n", "_q")).join(best, "_q").groupBy("_t").agg(F.min(F.struct("_n", "_hit")).alias("_b"))
    return terms.join(hits, F.col(column) == F.col("_t"), "left").select(terms["*"], F.col("_b._hit.canonical_id").alias("cached_id"), F.col("_b._hit.label").alias("cached_label"), (F.col("_b._n") > 0).alias("by_word"))


def fallback_bibtex(provider: DataFrame, local: DataFrame) -> DataFrame:
    """(key, bibtex, fallback_used): a provider's BibTeX of each key, else the local one."""
    joined = local.join(provider.select("key", F.col("bibtex").alias("_p")), "key", "left")
    told: Column = F.nullif(F.trim("_p"), F.lit(""))
    return joined.select("key", F.coalesce(told, "bibtex").alias("bibtex"), told.isNull().alias("fallback_used"))
