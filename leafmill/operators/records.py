"""Bibliography records: fields of an entry, normalised records, and keys by which records are the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fields that become columns of a normalised record.
PROMOTED = ("title", "author", "year", "date", "doi", "eprint", "journal", "file")


def field(fields: str, name: str) -> Column:
    """The last value of a field in an array of (k, v), as a parser that overwrites leaves it; names without case."""
    own = F.filter(F.col(fields), lambda x: F.lower(x["k"]) == name)
    return F.when(F.size(own) > 0, F.element_at(own, -1)["v"])


def manifest_records(entries: DataFrame) -> DataFrame:
    """One row for each entry: key, pos, title, title_norm, authors, author, year, doi, arxiv, journal and an empty body.

    A DOI that only wraps an arXiv id becomes that id and no DOI; missing fields are ``''``.
    """
    value = {name: F.coalesce(field("fields", name), F.lit("")) for name in PROMOTED}
    wrapped = T.arxiv_of_doi(T.normalize_doi(value["doi"]))
    wraps = wrapped != ""
    arxiv = F.coalesce(F.nullif(T.normalize_arxiv(value["eprint"]), F.lit("")), wrapped)
    return entries.select(
        F.col("id").alias("key"),
        "pos",
        value["title"].alias("title"),
        T.normalize_title(value["title"]).alias("title_norm"),
        T.normalize_authors(value["author"]).alias("authors"),
        value["author"].alias("author"),
        T.year_of(value["year"], value["date"]).alias("year"),
        F.when(wraps, "").otherwise(T.normalize_doi(value["doi"])).alias("doi"),
        arxiv.alias("arxiv"),
        value["journal"].alias("journal"),
        value["file"].alias("file"),
        F.lit("").alias("body"),
    )


def resolve_sources(records: DataFrame, pdfs: DataFrame | None = None) -> DataFrame:
    """``records`` with doc_id, source_type and needs_review: an arXiv id first, then a PDF that is there, else unresolved.

    ``pdfs`` has the keys whose PDF exists. A DOI names a document that has a PDF, else its key does.
    """
    if pdfs is not None:
        records = records.join(pdfs.select("key").distinct().withColumn("_pdf", F.lit(True)), "key", "left")
    else:
        records = records.withColumn("_pdf", F.col("file") != "")
    has_arxiv, has_pdf = F.col("arxiv") != "", F.coalesce("_pdf", F.lit(False))
    doc_id = F.when(has_arxiv, F.concat(F.lit("arxiv:"), "arxiv")).when(F.col("doi") != "", F.col("doi")).when(has_pdf, F.concat(F.lit("pdf:"), "key")).otherwise(F.concat(F.lit("unresolved:"), "key"))
    kind = F.when(has_arxiv, "arxiv_source").when(has_pdf, "pdf_pymupdf").otherwise("unresolved")
    return records.withColumns({"doc_id": doc_id, "source_type": kind, "needs_review": ~(has_arxiv | has_pdf)}).drop("_pdf")


def dedup_key(records: DataFrame) -> Column:
    """The first of DOI, arXiv id, title and authors with year that a record has, as (kind, value)."""
    people = F.concat(F.array_join(F.slice("authors", 1, 3), ","), F.lit("|"), "year")
    kinds = [("doi", F.col("doi")), ("arxiv", F.col("arxiv")), ("title", F.col("title_norm"))]
    return F.coalesce(*[F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("value"))) for kind, value in kinds], F.struct(F.lit("fallback").alias("kind"), people.alias("value")))


def match_keys(records: DataFrame, key: str = "key", order: str = "pos") -> DataFrame:
    """(key, order, kind, value, priority): every key by which a record may be found, the best first."""
    people = F.concat(F.array_join(F.slice("authors", 1, 3), ","), F.lit("|"), "year")
    kinds = [("doi", F.col("doi")), ("arxiv", F.col("arxiv")), ("title", F.col("title_norm")), ("fallback", F.when(people != "|", people).otherwise(""))]
    listed = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(kind).alias("kind"), value.alias("value")) for i, (kind, value) in enumerate(kinds)])
    return records.select(key, order, F.explode(F.filter(listed, lambda x: x["value"] != "")).alias("m")).select(key, order, "m.priority", "m.kind", "m.value")


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key; stable, as ties go to the order given."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def extra_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every row of a key but its first, with ``nth`` from 2."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(own)).where("nth > 1")


def multi_key_match(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, order, match_kind, existing_key): for each incoming record the existing one it is, if any.

    The record's best key that any existing record has decides, and of those the first. One equality join over exploded
    keys, reduced to the first record of each key before it, so a shared key never multiplies rows.
    """
    have = match_keys(existing).groupBy("kind", "value").agg(F.min_by("key", F.struct("pos", "key")).alias("existing_key"))
    found = match_keys(incoming).join(have, ["kind", "value"])
    return found.groupBy("key", "pos").agg(F.min(F.struct("priority", "kind", "existing_key")).alias("best")).select("key", "pos", F.col("best.kind").alias("match_kind"), F.col("best.existing_key").alias("existing_key"))


def unique_keys(df: DataFrame, base: str, order: str, used: DataFrame | None = None) -> DataFrame:
    """``df`` with ``unique_key``: the base for the first row of it, then ``base-2``, ``base-3`` and so on.

    Numbers that would give the key of another base, or of ``used`` (a table of keys that are taken), are passed over, and
    a base that is itself taken starts with a number. Numbers are counted, not tried: the k-th free one is k and as many
    as there are taken ones up to it.
    """
    bases = df.select(F.col(base).alias("_k")).distinct()
    taken = bases if used is None else bases.unionByName(used.select(F.col(used.columns[0]).alias("_k"))).distinct()
    numbers = taken.select(F.regexp_extract("_k", r"^(.*)-([2-9]|[1-9]\d{1,8})$", 1).alias("_b"), F.regexp_extract("_k", r"^(.*)-([2-9]|[1-9]\d{1,8})$", 2).alias("_n")).where("_n <> ''")
    numbers = numbers.groupBy("_b").agg(F.array_sort(F.collect_set(F.col("_n").cast("int"))).alias("_taken"))
    rows = df.join(numbers, F.col(base) == F.col("_b"), "left").withColumn("_n", F.row_number().over(Window.partitionBy(base).orderBy(order)))
    if used is None:
        first = F.lit(1)
    else:
        own = used.select(F.col(used.columns[0]).alias("_u")).where("_u IS NOT NULL").distinct()
        rows = rows.join(own, F.col(base) == F.col("_u"), "left")
        first = F.when(F.col("_u").isNull(), 1).otherwise(0)
    want = F.col("_n") + 1 - first
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), want, lambda v, t: F.when(t <= v, v + 1).otherwise(v))
    return rows.withColumn("unique_key", F.when(want == 1, F.col(base)).otherwise(F.concat_ws("-", base, free.cast("string")))).select(*df.columns, "unique_key")
