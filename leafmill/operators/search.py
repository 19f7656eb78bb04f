"""Ranking of chunks, documents and records.

A query's terms are counted where the text lies: a search reads the texts once into narrow rows of numbers, from which
corpus statistics, scores and ranks are taken, and fetches the texts of the best hits only. TF-IDF reads them once more for
the document frequency of every word, and a third time for the norms of those texts that have a word of the query.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import MAX_BROADCAST_BYTES, broadcast_if_small, cut_lineage


def query_tokens(df: DataFrame, query: str) -> list[str]:
    """The search tokens of a query string, with repetition."""
    return df.sparkSession.range(1).select(T.tokenize(F.lit(query)).alias("t")).first()["t"]


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): how often each search token occurs in each text."""
    return df.select(key, F.explode(T.tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, cf): texts with a token and its occurrences, in one pass whose counts are merged before the shuffle."""
    tokens = T.tokenize(F.col(text))
    each = F.transform(tokens, lambda x: F.struct(x.alias("term"), F.lit(0).alias("first")))
    once = F.transform(F.array_distinct(tokens), lambda x: F.struct(x.alias("term"), F.lit(1).alias("first")))
    rows = df.select(F.explode(F.concat(each, once)).alias("x")).select("x.term", "x.first")
    return rows.groupBy("term").agg(F.sum("first").alias("df"), F.sum(1 - F.col("first")).alias("cf"))


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: number of texts and mean number of tokens; texts without tokens count."""
    size = F.size(T.tokenize(F.coalesce(F.col(text), F.lit(""))))
    return df.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avg_len"))


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, F.lit(term)))


def _bm25(df: DataFrame, query: str, key: str, text: str, k1: float, b: float, extra: Sequence[Column] = ()) -> tuple[DataFrame, float]:
    """(key, bm25 and the extra columns) of every text, from one pass over the texts that shuffles nothing; and the best bm25."""
    terms = query_tokens(df, query)
    distinct = sorted(set(terms))
    tokens = df.select(F.col(key), T.tokenize(F.coalesce(F.col(text), F.lit(""))).alias("_t"), *extra)
    counted = cut_lineage(tokens.withColumns({"_len": F.size("_t"), **{f"_tf{i}": _occurrences("_t", t) for i, t in enumerate(distinct)}}).drop("_t"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))]).first()
    n, mean = stats["n"], max(stats["mean"] or 0.0, 1.0)
    score = F.lit(0.0)
    for term in terms:
        i = distinct.index(term)
        tf = F.col(f"_tf{i}")
        idf = math.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        score = score + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.greatest("_len", F.lit(1)) / mean))).otherwise(0.0)
    scored = counted.withColumn("bm25", score).drop("_len", *[f"_tf{i}" for i in range(len(distinct))])
    return scored, scored.agg(F.max("bm25")).first()[0] or 0.0


def bm25_scores(df: DataFrame, query: str, key: str, text: str, k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """(key, bm25) of every text; a token that the query repeats counts again.

    Null texts are empty; a query without tokens gives scores of 0 and an empty table no rows.
    """
    return _bm25(df, query, key, text, k1, b)[0]


def bm25(df: DataFrame, query: str, key: str, text: str, k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """``df`` with ``bm25``."""
    return df.join(bm25_scores(df, query, key, text, k1, b), key)


def tfidf(df: DataFrame, query: str, key: str, text: str, stop_words: Sequence[str] = (), max_features: int | None = None) -> DataFrame:
    """(key, tfidf): cosine of query and text under smooth idf ``ln((1 + n) / (1 + df)) + 1`` and L2 norm.

    ``max_features`` keeps the most frequent words of the corpus, ties by word. Rows are those with a word in common.
    """
    spark = df.sparkSession
    words = T.words(F.col(text))
    if stop_words:
        words = F.filter(words, lambda x: ~x.isin(*stop_words))
    texts = df.select(F.col(key).alias("key"), words.alias("words"))
    # each word once for its documents, again for its occurrences; merged before the shuffle
    seen = texts.select(F.explode(F.array_distinct("words")).alias("word"), F.lit(1).alias("first"))
    if max_features is not None:
        seen = seen.unionByName(texts.select(F.explode("words").alias("word"), F.lit(0).alias("first")))
    vocabulary = seen.groupBy("word").agg(F.sum("first").alias("df"), F.sum(1 - F.col("first")).alias("cf"))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("cf"), "word").limit(max_features)
    n = df.count()
    weighted = cut_lineage(vocabulary.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).select("word", "idf"))
    size = weighted.agg(F.sum(F.octet_length("word") + 48)).first()[0] or 0
    asked_words = spark.range(1).select(F.array_distinct(T.words(F.lit(query))).alias("w")).first()["w"]
    asked = spark.range(1).select(F.explode(T.words(F.lit(query))).alias("word")).groupBy("word").agg(F.count("*").alias("qf"))
    asked = asked.join(weighted, "word").withColumn("q", F.col("qf") * F.col("idf"))
    asked = asked.select("word", "q", F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy())).alias("q_norm"))  # as many rows as the query has words
    # a text without a word of the query scores 0 whatever its norm
    near = texts.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in asked_words]).cast("array<string>")))
    counts = near.select("key", F.explode("words").alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
    entries = counts.join(broadcast_if_small(weighted, 1, size), "word").withColumn("w", F.col("tf") * F.col("idf"))
    scored = entries.join(F.broadcast(asked), "word", "left").groupBy("key")
    dot = scored.agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.max("q_norm").alias("q_norm"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return dot.where("dot > 0").select(F.col("key").alias(key), (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("tfidf"))


def known_section_type(stored: Column, title: Column, text: Column) -> Column:
    """The stored section type, or what title and text tell where it is missing."""
    return F.coalesce(F.nullif(F.trim(stored), F.lit("")), T.section_type(title, text))


def hybrid_scores(chunks: DataFrame, query: str, key: str = "row_id", stop_words: Sequence[str] = (), max_features: int | None = 10_000) -> DataFrame:
    """(key, chunk_id, section_type, raw_score, score) of the chunks with a query word.

    TF-IDF and BM25 mixed, a bonus for the whole phrase, times the section's weight; section_type is filled. ``key`` is unique.
    """
    phrase = query.lower().strip()
    kind = known_section_type(F.col("section_type"), F.col("section_title"), F.col("text"))
    holds = F.coalesce(F.lower("text").contains(phrase), F.lit(False)) if phrase else F.lit(False)
    ranked, best = _bm25(chunks, query, key, "text", V.BM25_K1, V.BM25_B, [F.col("chunk_id"), kind.alias("section_type"), holds.alias("_phrase")])
    numbers = ranked.join(tfidf(chunks, query, key, "text", stop_words, max_features), key, "left").where("bm25 > 0 OR tfidf > 0")
    raw = V.TFIDF_WEIGHT * F.coalesce("tfidf", F.lit(0.0)) + V.BM25_WEIGHT * (F.col("bm25") / best if best > 0 else F.lit(0.0))
    raw = raw + F.when(F.col("_phrase"), V.PHRASE_BONUS).otherwise(0.0)
    return numbers.select(key, "chunk_id", "section_type", raw.alias("raw_score")).withColumn("score", F.col("raw_score") * T.section_weight(F.col("section_type")))


def search_chunks(chunks: DataFrame, query: str, top_k: int = 10, include_low_quality: bool = False, min_score: float = V.MIN_SCORE, order: str = "row_id", **options) -> DataFrame:
    """The best chunks: by score, then by ``order``; of equal chunk ids the first; low-quality sections and scores under ``min_score`` only if asked for.

    Ranks are made from numbers alone and only the texts of the ``top_k`` are fetched. Null and empty texts score 0 and
    never come out; an empty table and a query without words give no rows.
    """
    scored = hybrid_scores(chunks, query, order, **options).where("score > 0")
    if not include_low_quality:
        scored = scored.where(~F.col("section_type").isin(*V.LOW_QUALITY_SECTIONS) & (F.col("score") >= min_score))
    first = Window.partitionBy("chunk_id").orderBy(F.desc("score"), order)
    hits = scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy(F.desc("score"), order).limit(top_k).select(order, "section_type", "raw_score", "score")
    whole = chunks.drop("section_type").join(F.broadcast(hits) if top_k <= 10_000 else hits, order)
    return whole.select(*chunks.columns, "raw_score", "score").orderBy(F.desc("score"), order).withColumns({"score": F.round("score", 4), "raw_score": F.round("raw_score", 4)})


def record_scores(records: DataFrame, query: str) -> DataFrame:
    """``records`` (key, title, doi, arxiv, body) with the additive score of an exact search and what matched.

    Key 100, DOI 95, arXiv id 95, title 90 or within the title 50, within the body 25. Rows without a match go.
    """
    q = F.lit(query)
    norm, doi, arxiv = T.normalize_title(q), T.normalize_doi(q), T.normalize_arxiv(q)
    title, body = T.normalize_title(F.col("title")), T.normalize_title(F.col("body"))
    filled = F.length(norm) > 0
    rules = [
        ("citation_key", F.lower("key") == F.lower(q), 100),
        ("doi", (F.length(doi) > 0) & (T.normalize_doi(F.col("doi")) == doi) & (F.col("doi") != ""), 95),
        ("arxiv", (F.length(arxiv) > 0) & (T.normalize_arxiv(F.col("arxiv")) == arxiv), 95),
        ("title", filled & (title == norm), 90),
        ("title-substring", filled & (title != norm) & title.contains(norm), 50),
        ("source_body", filled & body.contains(norm), 25),
    ]
    score = F.lit(0)
    for _, holds, points in rules:
        score = score + F.when(F.coalesce(holds, F.lit(False)), points).otherwise(0)
    matched = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds, _ in rules])))
    return records.withColumn("score", score).withColumn("matched_fields", matched).where("score > 0")


def structured_search(records: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return record_scores(records, query).orderBy(F.desc("score"), F.lower("key"), "key").limit(limit)


def local_scores(records: DataFrame, queries: Sequence[str]) -> DataFrame:
    """``records`` (key, title, authors, doi, arxiv, body) with the best score over several queries and the reasons of it.

    As an exact search, but a title within the query counts too, any text 25 and each query word in it 4.
    """
    title = T.normalize_title(F.col("title"))
    hay = T.normalize_title(F.concat_ws(" ", "key", "title", F.array_join("authors", " "), "body"))
    scored = []
    for query in queries:
        q = F.lit(query.strip())
        norm, doi, arxiv = T.normalize_title(q), T.normalize_doi(q), T.normalize_arxiv(q)
        filled, tokens = F.length(norm) > 0, F.filter(F.split(norm, " "), lambda x: F.length(x) > 2)
        within = filled & (title != "") & (title != norm) & (title.contains(norm) | norm.contains(title))
        found = F.size(F.filter(tokens, lambda x: hay.contains(x)))
        rules = [
            ("key", F.lower("key") == F.lower(q), F.lit(100)),
            ("doi", (F.length(doi) > 0) & (F.col("doi") != "") & (T.normalize_doi(F.col("doi")) == doi), F.lit(95)),
            ("arxiv", (F.length(arxiv) > 0) & (T.normalize_arxiv(F.col("arxiv")) == arxiv), F.lit(95)),
            ("title", filled & (title == norm), F.lit(90)),
            ("title-substring", within, F.lit(50)),
            ("text", filled & hay.contains(norm), F.lit(25)),
            ("tokens", found > 0, found * 4),
        ]
        score = F.lit(0)
        for _, holds, points in rules:
            score = score + F.when(F.coalesce(holds, F.lit(False)), points).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds, _ in rules])).alias("reasons")))
    best = F.array_max(F.transform(F.array(*scored), lambda x: x["score"]))
    reasons = F.flatten(F.transform(F.filter(F.array(*scored), lambda x: x["score"] == F.col("score")), lambda x: x["reasons"]))
    return records.withColumn("score", best).withColumn("reasons", F.array_sort(F.array_distinct(reasons))).where("score > 0")


def local_search(records: DataFrame, queries: Sequence[str] = (), keys: Sequence[str] = (), tags: Sequence[tuple[str, str]] = (), limit: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """Records by key or by tag, else by the best score of the queries.

    A tag is an edge category and id, all of which must hold; ``edges`` has citation_key, category and canonical_id.
    """
    if tags and edges is None:
        raise ValueError("tags need the edges of the records")
    if keys:
        records = records.where(F.lower("key").isin(*[k.lower() for k in keys]))
    for axis, value in tags:
        own = edges.where((F.col("category") == axis) & (F.col("canonical_id") == value)).select(F.col("citation_key").alias("key"))
        records = records.join(own, "key", "left_semi")
    if keys or tags:
        found = records.withColumn("score", F.lit(100 if keys else 60)).withColumn("reasons", F.array(F.lit("key" if keys else "tag")))
    else:
        found = local_scores(records, queries)
    return found.orderBy(F.desc("score"), F.lower("key"), "key").limit(limit)


def grep_lines(df: DataFrame, key: str, text: str, needle: str, per_text: int = 5) -> DataFrame:
    """(key, line_no, line): the first lines of each text that hold the needle, without case."""
    lines = df.select(F.col(key), F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(x, "\r$", "").alias("line"))), lambda x: F.lower(x["line"]).contains(needle.lower())).alias("lines"))
    return lines.select(key, F.explode(F.slice("lines", 1, per_text)).alias("x")).select(key, "x.line_no", "x.line")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", query_limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(query_id, key, cosine) of the k nearest vectors of each query, itself left out; every vector is compared.

    The queries, a stated set, are one array that goes to all tasks; each row of vectors gives its similarities in place
    and the best k of every query are merged from partial heaps, so no pair is shuffled before it is among the best of a
    task.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(dot(v, v))
    asked = queries.select(F.col(key).alias("query_id"), F.col(column).alias("q"), norm(F.col(column)).alias("q_norm"))
    asked = broadcast_if_small(asked, asked.count(), 16 * 1024, query_limit)
    pairs = vectors.select(F.col(key), F.col(column).alias("v"), norm(F.col(column)).alias("v_norm")).join(asked, F.col(key) != F.col("query_id"))
    scored = pairs.select("query_id", key, F.round(dot(F.col("v"), F.col("q")) / (F.col("v_norm") * F.col("q_norm")), 6).alias("cosine"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
