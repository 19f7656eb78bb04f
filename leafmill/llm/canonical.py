"""Mapping of free-entered values to a canonical list, in SQL only.

A value and every label and alias of the list are brought to one spelling without case, blanks and marks. Equal
spellings match at once. The others go through a pigeonhole join: a reference string that may differ in ``k`` edits is
cut into ``k + 1`` segments, of which a match must hold one unchanged and nearly in place; so segments are joined by
equality with the substrings of the value around that place, and the pairs found are verified by ``levenshtein``.
Values without a match come out of an anti-join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

#: Most edits by the length of the reference spelling: (up to length, edits); longer ones allow the last.
EDITS = ((4, 0), (7, 1), (11, 2), (15, 3))
MOST_EDITS = 4

#: What is written around a term and isn't part of it: notes, numbers of references, list marks and an article.
AROUND = r"\[[^\]]*\]|#\s*\d+|\((see|cf|ref|fig|sec)[^)]*\)|[,;]?\s*(cf\.|see (also )?(sec|ref|fig|note|p)).*$"
ARTICLE = r"^[^\p{L}\p{N}]*(the|an|a)[^\p{L}\p{N}]+"
#: Letters that are also written out; a written letter counts as one character where the permitted edits are concerned.
GREEK = (("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("delta", "δ"))


def _edits(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} <= {most} THEN {k}" for most, k in EDITS) + f" ELSE {MOST_EDITS} END"


def _clean(value: str) -> str:
    text = rf"regexp_replace(regexp_replace(lower({value}), r'{AROUND}', ' '), r'{ARTICLE}', '')"
    for name, letter in GREEK:
        text = f"replace({text}, '{letter}', '{name}')"
    return f"trim({text})"


def _spellings(value: str) -> str:
    """The value as written and with the inversions "b of (the) a (type)" and "b, a" turned to "a b"."""
    return rf"array_distinct(array({value}, regexp_replace(regexp_replace({value}, r'^(.+?)\s+of\s+(the\s+)?(.+?)(\s+type)?[^\p{{L}}]*$', '$3 $1'), r'^([^,]+?)\s*,\s*([^,]+)$', '$2 $1')))"


_FORM = r"regexp_replace(spelling, r'[^\p{L}\p{N}]+', '')"
_WORDS = r"filter(split(spelling, r'[^\p{L}\p{N}]+'), x -> x <> '')"
_REFERENCES = f"""
SELECT DISTINCT pos, canonical_id, category, name, is_label, {_FORM} AS form, {_WORDS} AS words FROM (
  SELECT *, explode({_spellings('clean')}) AS spelling FROM (
    SELECT *, {_clean('name')} AS clean FROM (
      SELECT pos, canonical_id, category, label AS name, 1 AS is_label FROM {{terms}}
      UNION ALL
      SELECT pos, canonical_id, category, trim(alias) AS name, 0 AS is_label FROM {{terms}} LATERAL VIEW explode(aliases) a AS alias)))
WHERE length({_FORM}) > 0"""

_VALUES = f"""
SELECT DISTINCT raw_term, category, {_FORM} AS form, {_WORDS} AS words FROM (
  SELECT *, explode({_spellings('clean')}) AS spelling FROM (
    SELECT DISTINCT raw_term, coalesce(nullif(trim(category), ''), '') AS category, {_clean('raw_term')} AS clean FROM {{mentions}}))
WHERE length({_FORM}) > 0"""

_EXACT = """
SELECT v.raw_term, v.category, r.canonical_id, r.name, r.is_label, r.pos, 0 AS edits, length(r.form) AS size
FROM {values} v JOIN {refs} r ON v.form = r.form AND (v.category = '' OR v.category = r.category)"""

# segment i of a reference of a given length starts at i * floor(length / (k + 1)), the last segments being one longer
_LENGTH = "length(regexp_replace(form, '" + "|".join(name for name, _ in GREEK) + "', 'x'))"
_SEGMENTS = f"""
SELECT pos, canonical_id, category, name, is_label, form, words, size, k, seg_no, seg_start, seg_len, substring(form, seg_start, seg_len) AS segment FROM (
  SELECT *, CAST(1 + seg_no * base + greatest(0, seg_no - (k + 1 - longer)) AS INT) AS seg_start, CAST(base + IF(seg_no >= k + 1 - longer, 1, 0) AS INT) AS seg_len FROM (
    SELECT *, CAST(size - (k + 1) * base AS INT) AS longer, explode(sequence(0, k)) AS seg_no FROM (
      SELECT *, CAST(floor(size / (k + 1)) AS INT) AS base FROM (
        SELECT *, length(form) AS size, {_edits(_LENGTH)} AS k FROM {{refs}})))
) WHERE k > 0"""

# a value asks, for every length, segment and shift that a match within k edits can have
_PROBES = """
SELECT DISTINCT raw_term, category, form, words, size, seg_no, substring(form, seg_start + shift, seg_len) AS segment
FROM (
  SELECT v.*, h.*, length(v.form) AS n
  FROM (SELECT *, explode(sequence(greatest(1, length(form) - {most}), length(form) + {most})) AS asked FROM {values}) v
  JOIN {shapes} h ON v.asked = h.size AND abs(length(v.form) - h.size) <= h.k
) LATERAL VIEW explode(sequence(-CAST(floor((k - (n - size)) / 2) AS INT), CAST(floor((k + (n - size)) / 2) AS INT))) p AS shift
WHERE seg_start + shift >= 1 AND seg_start + shift + seg_len - 1 <= n"""

_NEAR = """
SELECT * FROM (
  SELECT raw_term, category, ref_category, canonical_id, name, is_label, pos, levenshtein(form, ref_form) AS edits, size, k,
    filter(p.words, w -> NOT array_contains(p.ref_words, w)) AS other_words
  FROM (SELECT DISTINCT p.raw_term, p.category, p.form, p.words, s.pos, s.name, s.form AS ref_form, s.canonical_id, s.category AS ref_category, s.is_label, s.size, s.k, s.words AS ref_words
        FROM {probes} p JOIN {segments} s ON p.size = s.size AND p.seg_no = s.seg_no AND p.segment = s.segment) p
) WHERE edits <= k"""

# a word of the value that the list has, but not this entry, makes it another term; so does another number
_OTHER = r"""
SELECT DISTINCT raw_term, category, canonical_id, name FROM {near} LATERAL VIEW explode(other_words) o AS word
WHERE word RLIKE r'^\d+$' OR word IN (SELECT DISTINCT word FROM {refs} LATERAL VIEW explode(words) w AS word)"""

_BEST = """
SELECT raw_term, category, best.canonical_id, best.name AS matched_alias, best.edits, 1 - best.edits / best.size AS match_score FROM (
  SELECT raw_term, category, min_by(struct(canonical_id, name, edits, size), struct(edits, -is_label, pos, name)) AS best FROM {all} GROUP BY raw_term, category)"""


def _run(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """``query`` over DataFrames named in braces; their views go once the query is analysed."""
    named = {name: f"canonical_{name}_{uuid.uuid4().hex}" for name in views}
    for name, df in views.items():
        df.createOrReplaceTempView(named[name])
        query = query.replace(f"{{{name}}}", named[name])
    found = spark.sql(query)
    for view in named.values():
        spark.catalog.dropTempView(view)
    return found


def map_values(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """``mentions`` (mention_id, raw_term, category) with canonical_id, matched_alias, match_score, match_type.

    ``terms`` has pos, canonical_id, label, category and aliases. Of several entries the one with the fewest edits is
    taken, a label before an alias, then the first of the list; a value with a category matches only entries of it.
    ``match_type`` is ``exact``, ``near`` or ``none``; then the id is ``''``, the alias null and the score 0.

    Defined cases: null values, values without letter or digit and an empty list give ``none``; a null or blank
    category permits all; null alias lists are empty, blanks around an alias don't count; values of any length are looked
    at, those longer than every entry by more than its edits ask for none; repeated values each come out; other columns
    are never looked at.
    """
    spark = mentions.sparkSession
    refs = cut_lineage(_run(spark, _REFERENCES, terms=terms.select("pos", "canonical_id", "label", "category", "aliases")))
    values = cut_lineage(_run(spark, _VALUES, mentions=mentions.select("raw_term", "category")))
    exact = _run(spark, _EXACT, values=values, refs=refs)
    rest = values.join(exact, ["raw_term", "category"], "left_anti")
    segments = _run(spark, _SEGMENTS, refs=refs)
    shapes = segments.select("size", "k", "seg_no", "seg_start", "seg_len").distinct()
    probes = _run(spark, _PROBES.replace("{most}", str(MOST_EDITS)), values=rest, shapes=shapes)
    near = cut_lineage(_run(spark, _NEAR, probes=probes, segments=segments))
    other = _run(spark, _OTHER, near=near, refs=refs)
    columns = ["raw_term", "category", "canonical_id", "name", "is_label", "pos", "edits", "size"]
    kept = near.join(other, ["raw_term", "category", "canonical_id", "name"], "left_anti").where("category = '' OR category = ref_category")
    best = cut_lineage(_run(spark, _BEST, all=exact.select(columns).unionByName(kept.select(columns))))
    side = broadcast_if_small(best.withColumnsRenamed({"raw_term": "best_term", "category": "best_category"}), best.count(), 400)
    given = F.coalesce(F.expr("nullif(trim(category), '')"), F.lit(""))
    rows = mentions.select("mention_id", "raw_term", "category").join(side, (F.col("raw_term") == F.col("best_term")) & (given == F.col("best_category")), "left")
    kind = F.when(F.col("edits").isNull(), "none").when(F.col("edits") == 0, "exact").otherwise("near")
    return rows.select("mention_id", "raw_term", F.coalesce("canonical_id", F.lit("")).alias("canonical_id"), "matched_alias", F.coalesce(F.round("match_score", 4), F.lit(0.0)).alias("match_score"), kind.alias("match_type"))


def unmatched_values(mentions: DataFrame, mapped: DataFrame) -> DataFrame:
    """(raw_term, n) of every value that no mention of it could be mapped."""
    matched = mapped.where("match_type <> 'none'").select("mention_id")
    return mentions.join(matched, "mention_id", "left_anti").groupBy("raw_term").agg(F.count("*").alias("n"))
