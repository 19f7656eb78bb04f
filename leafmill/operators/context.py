"""Context for a question: the best chunks within a budget, with records, edges, gaps and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import cut_lineage, small_side
from .pages import edge_pages, is_placeholder
from .records import keep_last, manifest_records
from .search import known_section_type, search_chunks

TOP_K, BUDGET_TOKENS, CHARS_PER_TOKEN, LEAST_CHARS, CHARS_PER_CHUNK, SNIPPET = 8, 2_500, 4, 800, 900, 500


def pack_rows(hits: DataFrame, max_chars: int | None = CHARS_PER_CHUNK, pages: DataFrame | None = None) -> DataFrame:
    """Hits as rows of a pack: ids, section, scores, the text cut to ``max_chars``, a snippet and the page of the key, ``''`` where it has none."""
    there = pages.select("citation_key").distinct().withColumn("_page", F.lit(True)) if pages is not None else None
    hits = hits.withColumn("_page", F.lit(False)) if there is None else there.join(F.broadcast(hits), "citation_key", "right")  # top-k rows
    text = F.col("text") if max_chars is None else T.truncate(F.col("text"), max_chars)
    return hits.select(
        "rank", "chunk_id", "citation_key", "doc_id", F.when(F.col("_page"), F.concat(F.lit("summary/sources/"), "citation_key", F.lit(".md"))).otherwise("").alias("source_page"),
        T.evidence_path(F.col("doc_id"), "parsed").alias("parsed_markdown"), "section_anchor", "section_title", "section_type", "score", "raw_score",
        F.col("source_type").alias("route"), "equation_ids", text.alias("text"), T.truncate(F.col("text"), min(max_chars or SNIPPET, SNIPPET)).alias("snippet"),
    )


def ranked(hits: DataFrame, order: list) -> DataFrame:
    """At most top-k rows with their rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def chunks_of_key(chunks: DataFrame, key: str, top_k: int = TOP_K, include_low_quality: bool = False) -> DataFrame:
    """The first chunks of one key, each scored 1."""
    own = chunks.where(F.col("citation_key") == key).withColumn("section_type", known_section_type(F.col("section_type"), F.col("section_title"), F.col("text")))
    if not include_low_quality:
        own = own.where(~F.col("section_type").isin(*V.LOW_QUALITY_SECTIONS))
    return own.orderBy("chunk_index", "row_id").limit(top_k).withColumns({"score": F.lit(1.0), "raw_score": F.lit(1.0)})


def within_budget(rows: DataFrame, size: Column, budget: int, partition: list[str], order: list) -> DataFrame:
    """The front of each partition whose running size stays within the budget; the first row is kept in any case, flagged ``cut``."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    sized = rows.withColumn("running_size", F.sum(size).over(w)).withColumn("_n", n)
    return sized.where((F.col("running_size") <= budget) | (F.col("_n") == 1)).withColumn("cut", F.col("running_size") > budget).drop("_n")


def fit_budget(pack: DataFrame, budget_tokens: int = BUDGET_TOKENS, beside: int = 0) -> DataFrame:
    """The rows of a pack that fit beside ``beside`` characters of its other tables, lowest ranks dropped; where none fits, the first with its text cut to the budget."""
    budget = max(budget_tokens * CHARS_PER_TOKEN, LEAST_CHARS)
    fitted = within_budget(pack, F.length(F.to_json(F.struct(*pack.columns))), budget - beside, [], ["rank"])
    room = max(200, budget - 1000)
    return fitted.withColumns({"text": F.when(F.col("cut"), T.truncate(F.col("text"), room)).otherwise(F.col("text")), "snippet": F.when(F.col("cut"), T.truncate(F.col("snippet"), min(room, SNIPPET))).otherwise(F.col("snippet"))})


def _size(df: DataFrame) -> int:
    """Characters of a small table as JSON."""
    return df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0


def keys_in_order(pack: DataFrame) -> DataFrame:
    """(citation_key, best_rank): distinct keys in the order of their best hit."""
    return pack.where("citation_key <> ''").groupBy("citation_key").agg(F.min("rank").alias("best_rank"))


def gaps(keys: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(citation_key, gap): what is missing about the keys of a pack."""
    no_entry = keys.join(entries.select(F.col("id").alias("citation_key")), "citation_key", "left_anti").select("citation_key", F.concat(F.lit("missing BibTeX entry for "), "citation_key").alias("gap"))
    no_page = keys.join(pages.select("citation_key"), "citation_key", "left_anti").select("citation_key", F.concat(F.lit("missing source page for "), "citation_key").alias("gap"))
    return no_entry.unionByName(no_page)


def compact_entries(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Records of the keys; of entries with equal ids the last counts."""
    own = keep_last(entries, ["id"], ["pos"])
    records = manifest_records(own)
    return keys.join(records, F.col("citation_key") == F.col("key")).select("citation_key", "best_rank", "title", "author", "year", "doi", "arxiv")


def source_summaries(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(citation_key, title, year, source_type, primary_evidence, metadata_only) of the pages of some keys."""
    source = "source" in pages.columns
    own = [F.col(f"source.{c}") if source else F.lit("").alias(c) for c in ("title", "year", "source_type", "primary_evidence")]
    only = is_placeholder(F.col("body")) if "body" in pages.columns else F.lit(True)
    return pages.join(F.broadcast(keys.select("citation_key")), "citation_key", "left_semi").select("citation_key", *own, only.alias("metadata_only"))


def context_pack(chunks: DataFrame, entries: DataFrame, pages: DataFrame, query: str = "", key: str = "", top_k: int = TOP_K, budget_tokens: int = BUDGET_TOKENS, compact: bool = True, category_pages: DataFrame | None = None, hits: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a pack: evidence, entries, pages, edges with the pages of their terms, and gaps.

    Exactly one of query and key is given; ``pages`` are source pages, or any table with citation_key. A compact pack
    stays within the budget, all tables counted: evidence goes from the lowest rank on, which is a gap too. ``hits`` are
    those of the query where they are already there.
    """
    if bool(query) == bool(key):
        raise ValueError("give a query or a key")
    if key:
        hits, order = chunks_of_key(chunks, key, top_k), ["chunk_index", "row_id"]
    else:
        hits, order = search_chunks(chunks, query, top_k) if hits is None else hits, [F.desc("score"), "row_id"]
    hits = cut_lineage(hits)  # top_k rows that all tables are made from
    pack = pack_rows(ranked(hits, order), CHARS_PER_CHUNK if compact else None, pages)
    keys = cut_lineage(keys_in_order(pack) if not key else chunks.sparkSession.createDataFrame([(key, 1)], "citation_key string, best_rank int"))
    found = {"entries": compact_entries(keys, entries), "pages": source_summaries(keys, pages)}
    missing = gaps(keys, entries, pages)
    if "edges" in pages.columns:
        none = chunks.sparkSession.createDataFrame([], "category string, name string")
        found["edges"] = edge_pages(pages.join(F.broadcast(keys.select("citation_key")), "citation_key", "left_semi"), category_pages if category_pages is not None else none)
    if hits.isEmpty():
        said = f"metadata_only: no evidence chunks for {key}" if key else "no evidence chunks matched query"
        missing = missing.unionByName(chunks.sparkSession.createDataFrame([(key, said)], missing.schema))
    if compact:
        beside = sum(_size(df) for df in found.values())
        if beside + _size(pack) > max(budget_tokens * CHARS_PER_TOKEN, LEAST_CHARS):
            missing = missing.unionByName(chunks.sparkSession.createDataFrame([("", f"context_budget_exceeded: compact pack trimmed to about {budget_tokens} tokens")], missing.schema))
        pack = fit_budget(pack, budget_tokens, beside)
    return {"evidence": pack, **found, "gaps": missing}


def hybrid_query(chunks: DataFrame, entries: DataFrame, pages: DataFrame, query: str, top_k: int = TOP_K, **options) -> dict[str, DataFrame]:
    """The hits of a query and the pack made of them, from one search."""
    hits = cut_lineage(search_chunks(chunks, query, top_k))
    return {"hits": ranked(hits, [F.desc("score"), "row_id"]), **context_pack(chunks, entries, pages, query, top_k=top_k, hits=hits, **options)}


def trace(chunks: DataFrame, manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """Each chunk with the manifest of its document and the entry of its key: by key, else by document."""
    parsed = manifests.groupBy("doc_id").agg(F.max(F.struct("created_at", "parser_version", "parsed_markdown", "citation_key")).alias("m"))
    known = entries.select(F.col("id").alias("k")).distinct()
    rows = chunks.select("row_id", "chunk_id", "doc_id", "citation_key").join(parsed, "doc_id", "left")
    known = small_side(known)  # keys that hold a tenth of all chunks aren't shuffled where the entries are few
    by_key = known.withColumn("key_known", F.lit(True))
    rows = rows.join(by_key, F.col("citation_key") == F.col("k"), "left").drop("k")
    by_doc = known.withColumn("doc_known", F.lit(True))
    rows = rows.join(by_doc, F.col("m.citation_key") == F.col("k"), "left").drop("k")
    source = F.when(F.col("key_known"), F.col("citation_key")).when(F.col("doc_known"), F.col("m.citation_key")).otherwise("")
    return rows.select("row_id", "chunk_id", F.coalesce("m.parsed_markdown", F.lit("")).alias("parsed_markdown"), F.coalesce("m.parser_version", F.lit("")).alias("parser_version"), source.alias("source_key"), F.col("m").isNotNull().alias("has_manifest"))


def page_summaries(chunks: DataFrame, most_results: int = 5, most_rows: int = 8) -> DataFrame:
    """An extract of each key's first chunks: one line, key results with their chunk ids, and how many can be traced.

    Only the first chunks of a key are gathered; a window numbers them, so a key of any size stays sorted on disk.
    """
    n = F.row_number().over(Window.partitionBy("citation_key").orderBy("doc_id", "chunk_index", "row_id"))
    first = chunks.where("citation_key <> '' AND text IS NOT NULL").select("citation_key", "chunk_id", "text", "section_anchor", n.alias("n")).where(F.col("n") <= most_rows)
    line = F.concat(F.lit("- "), T.sentence(F.col("text"), 220), F.lit(" [`"), "chunk_id", F.lit("`]"))
    rows = first.groupBy("citation_key").agg(
        F.max(F.when(F.col("n") == 1, T.sentence(F.col("text")))).alias("one_line"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= most_results, F.struct("n", line.alias("line"))))).alias("lines"),
        F.count("*").alias("n_traced"),
    )
    return rows.select("citation_key", "one_line", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("key_results"), "n_traced")


def topic_summary(chunks: DataFrame, entries: DataFrame, query: str, top_k: int = TOP_K) -> DataFrame:
    """The best chunks of a topic as statements with their references."""
    hits = ranked(search_chunks(chunks, query, top_k), [F.desc("score"), "row_id"])
    titles = manifest_records(keep_last(entries, ["id"], ["pos"])).select(F.col("key").alias("citation_key"), "title", "year")
    return hits.join(titles, "citation_key", "left").select("rank", "citation_key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("year", F.lit("")).alias("year"), T.truncate(F.col("text"), SNIPPET).alias("statement"), "chunk_id")


def rendered_hits(hits: DataFrame, most: int = 500) -> DataFrame:
    """(rank, line): hits as text."""
    head = F.format_string("[%d] score=%.4f %s | %s", F.col("rank"), F.col("score"), F.coalesce("citation_key", F.lit("")), F.coalesce("section_title", F.lit("")))
    return hits.select("rank", F.concat(head, F.lit("\n"), T.truncate(F.col("text"), most)).alias("line"))
