"""The bipartite graph of pages and vocabulary terms as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_edges(chunks: DataFrame) -> DataFrame:
    """(citation_key, category, canonical_id), each once, of a map from category to ids."""
    by_category = chunks.select("citation_key", F.explode("edges").alias("category", "ids"))
    return by_category.select("citation_key", "category", F.explode("ids").alias("canonical_id")).where("canonical_id IS NOT NULL").distinct()


def _edges(items: DataFrame) -> DataFrame:
    return items.select("category", "canonical_id", "citation_key").where("category IS NOT NULL AND canonical_id IS NOT NULL AND citation_key IS NOT NULL").distinct()


def edge_index(items: DataFrame) -> DataFrame:
    """Pages of each (category, term): how many, the first and the last; a page counts once."""
    return _edges(items).groupBy("category", "canonical_id").agg(F.count("*").alias("n_pages"), F.min("citation_key").alias("first_page"), F.max("citation_key").alias("last_page"))


def pages_of_terms(items: DataFrame, k: int) -> DataFrame:
    """(canonical_id, citation_key, n): the first ``k`` pages of every term in order of their keys."""
    pages = items.where("canonical_id IS NOT NULL AND citation_key IS NOT NULL").select("canonical_id", "citation_key").distinct()
    return pages.withColumn("n", F.row_number().over(Window.partitionBy("canonical_id").orderBy("citation_key"))).where(F.col("n") <= k)


def pages_of(items: DataFrame, canonical_id: str, k: int = 10) -> DataFrame:
    return items.where((F.col("canonical_id") == canonical_id) & F.col("citation_key").isNotNull()).select("citation_key").distinct().orderBy("citation_key").limit(k)


def size(items: DataFrame) -> DataFrame:
    """One row: pages, terms and edges."""
    edges = _edges(items)
    return edges.agg(F.countDistinct("citation_key").alias("n_nodes"), F.countDistinct("canonical_id").alias("n_terms"), F.count("*").alias("n_edges"))


def category_pages(items: DataFrame) -> DataFrame:
    """(category, body): the list of a category's terms with their numbers of pages, in order of their ids, as text."""
    index = edge_index(items)
    line = F.concat(F.lit("- "), "canonical_id", F.lit(" ("), F.col("n_pages").cast("string"), F.lit(")"))
    listed = index.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("canonical_id", line.alias("line")))).alias("lines"))
    return listed.select("category", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))
