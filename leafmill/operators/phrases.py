"""Candidate phrases of texts: extraction, counts, and suppression of what a longer phrase says better.

Suppression is an equality join of a phrase with the token n-grams of the longer ones, not a comparison of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import cut_lineage

_PART = r"(?:[A-Z][A-Za-z0-9+-]{2,}|[a-z][a-z0-9+-]{3,})"
_W = T.WORD
#: A candidate: a capitalised word of three characters or a small one of four, with up to four more over blanks, ``/`` and ``-``.
CANDIDATE = rf"(?<![{_W}]){_PART}(?:[{T.BLANK}/-]+{_PART}){{0,4}}(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
_EDGE, _END, _STOP = frozenset(V.EDGE_WORDS), frozenset(V.EDGE_WORDS + V.TRAILING_WORDS), frozenset(V.STOPWORDS)


def candidates(text: Column) -> Column:
    """The candidates in a text, one after the other, as they are spelled, with single blanks."""
    found = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))
    clean = F.transform(found, lambda x: F.btrim(T.squeeze(x), F.lit(" -/")))
    return F.filter(clean, lambda x: F.length(x) >= 4)


def variants(candidate: str) -> list[str]:
    """A candidate and its parts of two words and more, without generic words at the ends and without stop words, each once without case."""
    parts = candidate.split()
    spans = [parts] + [parts[i:j] for i in range(len(parts)) for j in range(len(parts), i + 1, -1) if j - i < len(parts)]
    found: dict[str, str] = {}
    for n, span in enumerate(spans):
        if n and sum(map(len, span)) + len(span) - 1 < 4:
            continue
        first, last = 0, len(span)
        while last - first > 1 and span[first].lower() in _EDGE:
            first += 1
        while last - first > 1 and span[last - 1].lower() in _END:
            last -= 1
        phrase = " ".join(span[first:last])
        if not _STOP.intersection(phrase.lower().split()) and phrase.lower() not in _STOP:
            found.setdefault(phrase.lower(), phrase)
    return list(found.values())


def _vary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(term, n) for candidate, n in zip(frame["c"], frame["n"], strict=True) for term in variants(candidate)]
        yield pd.DataFrame(rows, columns=["term", "n"])


def phrase_counts(df: DataFrame, text: str) -> DataFrame:
    """(term, count) of the variants of all candidates, as they are spelled.

    Equal candidates are merged before they are varied, in batches; null texts have none.
    """
    found = df.select(F.explode(candidates(F.col(text))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return found.mapInPandas(_vary, "term string, n long").groupBy("term").agg(F.sum("n").alias("count"))


def is_useful(term: Column, count: Column, protected: Column | None = None) -> Column:
    words = F.split(F.lower(term), " ")
    n, signal, acronym = F.size(words), T.has_domain_signal(term), T.looks_like_acronym(term)
    single = F.array(*[F.lit(w) for w in V.GENERIC_SINGLE_WORDS + V.STOPWORDS])
    stop = F.arrays_overlap(words, F.array(*[F.lit(w) for w in V.STOPWORDS])) | F.lower(term).rlike(r"\b(?:hep|astro|nucl|cond-mat|quant-ph)-[a-z]{2}\b")
    bad_single = (n == 1) & (((count <= 1) & ~acronym) | F.array_contains(single, F.lower(term)) | ~(signal | acronym))
    useful = ~stop & ~bad_single & (F.length(term) >= 5) & (signal | (n >= 2) | acronym)
    return useful if protected is None else protected | useful


def useful_phrases(counts: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(term, count, quality, protected) of the useful candidates; ``protected`` has the normalised terms that always stay."""
    rows = counts.withColumn("norm", F.array_join(T.term_tokens(F.col("term")), " "))
    if protected is not None:
        rows = rows.join(protected.select(F.col("norm"), F.lit(True).alias("protected")).distinct(), "norm", "left")
    rows = rows.withColumn("protected", F.coalesce(F.col("protected") if protected is not None else F.lit(None), F.lit(False)))
    useful = rows.where(is_useful(F.col("term"), F.col("count"), F.col("protected"))).select("term", "count", "norm", "protected", T.quality_score(F.col("term"), F.col("count")).alias("quality"))
    return cut_lineage(useful)  # looked at as phrases and as what is longer than them


def undominated(useful: DataFrame) -> DataFrame:
    """The phrases that no useful longer phrase holds and outdoes, by its count or by two points of quality."""
    tokens = F.split("norm", " ")
    n = F.size(tokens)
    lengths = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.array_join(F.slice(tokens, s, k), " "))))
    longer = useful.select(F.explode(F.array_distinct(grams)).alias("norm"), "count", "quality").groupBy("norm").agg(F.max("count").alias("longer_count"), F.max("quality").alias("longer_quality"))
    fragment, broad = F.col("norm").isin(*V.FRAGMENT_PHRASES), F.col("norm").isin(*V.BROAD_WORDS)
    outdone = F.col("longer_count").isNotNull() & (fragment | (F.col("longer_count") >= F.col("count")) | (F.col("longer_quality") >= F.col("quality") + 2))
    spared = F.col("protected") | T.looks_like_acronym(F.col("term"))
    return useful.join(longer, "norm", "left").where(spared | ~(F.coalesce(outdone, F.lit(False)) | broad)).drop("longer_count", "longer_quality")


def keeps_section_title(title: Column) -> Column:
    """Whether a section title says something of its own: no standard heading, and a word of the domain or an acronym."""
    norm = T.squeeze(F.lower(title))
    says = T.has_domain_signal(norm) | T.looks_like_acronym(norm)
    return F.coalesce((norm != "") & ~norm.isin(*V.SECTION_TITLES_LEFT_OUT) & (F.size(T.term_tokens(norm)) > 0) & ~norm.endswith(" run") & says, F.lit(False))


def without_fragments(phrases: DataFrame, limit: int = 40, front: int = 400) -> DataFrame:
    """Greedily the best ``limit`` of ``phrases`` (term, norm, count, quality, protected) of which none is part of a better one.

    The list is read front by front until enough are kept or it ends; each front leaves out what is part of a kept
    phrase, so whatever its length no more than ``front`` rows are at the driver at once.
    """
    spark, order = phrases.sparkSession, [F.desc("quality"), F.desc("count"), F.desc(F.length("term")), "term"]
    kept: list[tuple] = []
    rest = cut_lineage(phrases.select("term", "norm", "count", "quality", "protected"))
    rows = rest.orderBy(*order).limit(front).collect()
    while rows and len(kept) < limit:
        for row in rows:
            part = " " in row["norm"] and not row["protected"] and any(row["norm"] != norm and f" {row['norm']} " in f" {norm} " for _, norm, *_ in kept)
            if not part:
                kept.append((row["term"], row["norm"], row["count"], row["quality"]))
            if len(kept) == limit:
                break
        last = rows[-1]
        after = F.struct((-F.col("quality")).alias("q"), (-F.col("count")).alias("c"), (-F.length("term")).alias("l"), F.col("term").alias("t")) > F.struct(F.lit(-last["quality"]).alias("q"), F.lit(-last["count"]).alias("c"), F.lit(-len(last["term"])).alias("l"), F.lit(last["term"]).alias("t"))
        inside = F.lit(False)
        for _, norm, *_ in kept:
            inside = inside | ((F.col("norm") != norm) & F.lit(f" {norm} ").contains(F.concat(F.lit(" "), "norm", F.lit(" "))))
        rows = rest.where(after & (F.col("protected") | ~F.col("norm").contains(" ") | ~inside)).orderBy(*order).limit(front).collect() if len(rows) == front and len(kept) < limit else []
    ranked = [(term, count, quality, n) for n, (term, _, count, quality) in enumerate(kept, 1)]
    return spark.createDataFrame(ranked, "term string, count long, quality double, rank int")


def extract_terms(texts: Sequence[tuple[DataFrame, str]], limit: int = 40, protected: DataFrame | None = None) -> DataFrame:
    """(term, count, quality, rank) of the best phrases of all texts: by quality, count, length and term.

    ``texts`` are tables with a column each, so that no phrase reaches from one field into another; ``protected`` has the
    normalised terms that are always useful.
    """
    rows = None
    for df, column in texts:
        own = df.select(F.col(column).alias("text"))
        rows = own if rows is None else rows.unionByName(own)
    return without_fragments(undominated(useful_phrases(phrase_counts(rows, "text"), protected)), limit)
