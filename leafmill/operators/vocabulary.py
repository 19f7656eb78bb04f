"""The controlled vocabulary: lookup of terms, similarity, plans for terms and edges, and the wiki of terms."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import broadcast_if_small, small_side

#: Least similarity at which a term is taken for a vocabulary entry.
LEAST_SIMILARITY = 0.84
LOCAL_CONFIDENCE = 0.9


def names(terms: DataFrame) -> DataFrame:
    """(name, pos, canonical_id, label, category): every label and alias in lower case, blanks cut."""
    listed = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return terms.select(F.explode(F.transform(listed, lambda x: F.lower(F.trim(x)))).alias("name"), "pos", "canonical_id", "label", "category").where("name <> ''")


def lookup(mentions: DataFrame, terms: DataFrame, column: str = "raw_term") -> DataFrame:
    """``mentions`` with canonical_id, label and category of the first entry whose label or alias they are, without case."""
    first = names(terms).groupBy("name").agg(F.min(F.struct("pos", "canonical_id", "label", "category")).alias("hit"))
    side = broadcast_if_small(first, first.count(), 300)
    return mentions.withColumn("name", F.lower(F.trim(column))).join(side, "name", "left").select(mentions["*"], F.col("hit.canonical_id").alias("found_id"), F.col("hit.label").alias("found_label"), F.col("hit.category").alias("found_category"))


@F.pandas_udf(DoubleType())
def sequence_ratio(one: pd.Series, other: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(one, other, strict=True)])


def match_score(one: Column, other: Column) -> Column:
    """How safely a label may stand for a term: 1 if equal but for plurals, else a mix of recall, precision and similarity.

    A single word, opposite words and no common word give 0; a label that only adds words loses points.
    """
    a, b = T.label_tokens(one), T.label_tokens(other)
    x, y, sa, sb = F.array_join(a, " "), F.array_join(b, " "), F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(sa, sb))
    base = 0.65 * common / F.size(sa) + 0.25 * common / F.size(sb) + 0.10 * sequence_ratio(x, y)
    front = y.startswith(x) | x.startswith(y)
    score = base + F.when(front, 0.04).when(F.size(F.array_except(sa, sb)) == 0, -0.12).otherwise(0.0)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when((F.size(sa) < 2) | T.opposed(sa, sb) | (common == 0), 0.0).otherwise(F.least(score, F.lit(0.99)))


def best_similar(mentions: DataFrame, terms: DataFrame, column: str = "raw_term", least: float = LEAST_SIMILARITY) -> DataFrame:
    """(raw term, canonical_id, label, score): for each distinct term the best label, ties to the first entry.

    A score of ``least`` needs most of the term's words, so only labels that share one of the rarer words of the term
    are scored: as many of its words, the rarest first, as it can lose and still reach the score, and one more.
    """
    asked = mentions.select(F.col(column).alias("raw")).where("raw IS NOT NULL").distinct().withColumn("tokens", F.array_distinct(T.label_tokens(F.col("raw"))))
    labels = terms.select("pos", "canonical_id", "label", F.array_distinct(T.label_tokens(F.col("label"))).alias("words"))
    df = labels.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    weighed = asked.select("raw", F.size("tokens").alias("n"), F.explode("tokens").alias("w")).join(F.broadcast(df) if df.count() < 100_000 else df, "w", "left").fillna(0, ["df"])
    # 0.35 are reached without the words: recall must be at least (least - 0.39) / 0.65
    may_lose = F.floor(F.col("n") * (1 - (least - 0.39) / 0.65)) + 1
    front = weighed.groupBy("raw", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws")).select("raw", F.explode(F.slice("ws", F.lit(1), may_lose.cast("int"))).alias("x")).select("raw", F.col("x.w").alias("w"))
    pairs = front.join(labels.select("pos", "canonical_id", "label", F.explode("words").alias("w")), "w").select("raw", "pos", "canonical_id", "label").distinct()
    scored = pairs.withColumn("score", match_score(F.col("raw"), F.col("label"))).where(F.col("score") >= least)
    best = scored.groupBy("raw").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), "canonical_id", "label")).alias("b"))
    return best.select(F.col("raw").alias(column), F.col("b.canonical_id").alias("canonical_id"), F.col("b.label").alias("label"), F.round("b.score", 4).alias("score"))


def resolve_terms(mentions: DataFrame, terms: DataFrame, column: str = "raw_term") -> DataFrame:
    """``mentions`` with resolved_id, resolved_label, category, source, confidence and needs_review.

    Label or alias first, then similarity, else a local placeholder id that needs review.
    """
    direct = lookup(mentions, terms, column)
    rest = direct.where(F.col("found_id").isNull()).select(column)
    near = best_similar(rest, terms, column).withColumnsRenamed({column: "near_term", "canonical_id": "near_id", "label": "near_label", "score": "near_score"})
    joined = direct.join(near, F.col(column) == F.col("near_term"), "left")
    source = F.when(F.col("found_id").isNotNull(), "local_cache").when(F.col("near_id").isNotNull(), "physh_api").otherwise("unresolved")
    label = F.coalesce("found_label", "near_label", F.trim(column))
    return joined.select(
        mentions["*"], F.coalesce("found_id", "near_id", F.concat(F.lit("local:"), T.slugify(F.col(column)))).alias("resolved_id"), label.alias("resolved_label"),
        T.guess_category(label, F.coalesce("found_category", F.lit(""))).alias("resolved_category"), source.alias("resolved_source"),
        T.confidence_of(source, F.col("near_score")).alias("confidence"), (source == "unresolved").alias("unresolved"),
    )


def term_plan(suggested: DataFrame, terms: DataFrame) -> DataFrame:
    """``suggested`` (canonical_id, label) with the status new or existing and whether it may be applied unreviewed."""
    have = terms.select("canonical_id").distinct().withColumn("_have", F.lit(True))
    rows = suggested.join(have, "canonical_id", "left").withColumn("status", F.when(F.col("_have"), "existing").otherwise("new")).drop("_have")
    return rows.withColumn("namespace", T.namespace_of(F.col("canonical_id")))


def accepted(plan: DataFrame, accept: tuple[str, ...] = (), accept_local: bool = False) -> DataFrame:
    """The new rows that may be applied: ``physh`` ones that need no review or are accepted, ``local`` ones only if accepted."""
    named = F.col("canonical_id").isin(*accept) if accept else F.lit(False)
    gate = F.when(F.col("namespace") == "physh", ~F.col("needs_review") | named).when(F.col("namespace") == "local", named | F.lit(accept_local)).otherwise(F.lit(False))
    return plan.where((F.col("status") == "new") & gate)


def edge_plan(items: DataFrame, terms: DataFrame, page_edges: DataFrame) -> DataFrame:
    """``items`` with planned_status: unresolved (no such term), existing (the page has the edge) or new."""
    have = small_side(terms.select("canonical_id").distinct()).withColumn("_term", F.lit(True))
    edges = page_edges.select("citation_key", "category", "canonical_id").distinct().withColumn("_edge", F.lit(True))
    rows = items.join(have, "canonical_id", "left").join(edges, ["citation_key", "category", "canonical_id"], "left")
    return rows.withColumn("planned_status", F.when(F.col("_term").isNull(), "unresolved").when(F.col("_edge"), "existing").otherwise("new")).drop("_term", "_edge")


def wiki_nodes(edges: DataFrame, terms: DataFrame, strict: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, skipped): for each term with edges its label, category, aliases and pages; and ids left out with the reason."""
    pages = edges.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.countDistinct("citation_key").alias("n_pages"), F.min("citation_key").alias("first_page"))
    first = terms.groupBy("canonical_id").agg(F.min(F.struct("pos", "label", "category", "aliases")).alias("t"))
    joined = pages.join(first, "canonical_id", "left")
    reason = F.when(F.col("t").isNull(), "not in vocabulary")
    if strict:
        reason = reason.when(T.namespace_of(F.col("canonical_id")) != strict, f"not in {strict}")
    judged = joined.withColumn("reason", reason)
    nodes = judged.where("reason IS NULL").select("canonical_id", "t.label", "t.category", F.size(F.coalesce("t.aliases", F.array().cast("array<string>"))).alias("n_aliases"), "n_pages", "first_page", T.page_name(F.col("canonical_id")).alias("page"))
    return nodes, judged.where("reason IS NOT NULL").select("canonical_id", "n_pages", "reason")


def ids_by_category(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("category").isin(*V.EDGE_CATEGORIES)).groupBy("category").agg(F.countDistinct("canonical_id").alias("n_ids"))
