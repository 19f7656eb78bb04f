"""Data-quality rules as rows: each rule gives (subject, rule, severity, detail) for what breaks it.

Rules of a row are one array per row; rules between rows are joins and windows. Streams of issues are unions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from ..session import small_side


def row_issues(df: DataFrame, subject: Column, rules: list[tuple[str, Column, Column | None]], severity: str = "error") -> DataFrame:
    """An issue for each rule (name, broken, detail) that a row breaks; a rule that gives null isn't broken."""
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.coalesce(detail if detail is not None else F.lit(""), F.lit("")).alias("detail"))) for name, broken, detail in rules])
    return df.select(subject.cast("string").alias("subject"), F.explode(F.array_compact(found)).alias("i")).select("subject", "i.rule", F.lit(severity).alias("severity"), "i.detail")


def missing(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """Wrong schema and missing fields of parsed manifests."""
    rules = [("wrong_schema", F.coalesce(F.col("schema_version"), F.lit("")) != V.MANIFEST_SCHEMA, F.col("schema_version"))]
    rules += [(f"missing_{name}", missing(name), None) for name in V.MANIFEST_FIELDS]
    rules += [("unknown_route", ~missing("route") & ~T.is_allowed_route(F.col("route")), F.col("route"))]
    return row_issues(manifests, F.coalesce("doc_id", F.lit("")), rules)


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """Wrong schema, missing fields, equation flags that don't fit and impossible places of chunks."""
    flag, ids = F.coalesce("contains_equation", F.lit(False)), F.size(F.coalesce("equation_ids", F.array().cast("array<string>")))
    start, end = F.col("char_start"), F.col("char_end")
    rules = [("wrong_schema", F.coalesce(F.col("schema_version"), F.lit("")) != V.CHUNK_SCHEMA, F.col("schema_version"))]
    rules += [(f"missing_{name}", missing(name), None) for name in V.CHUNK_FIELDS]
    rules += [("equation_without_ids", flag & (ids == 0), None), ("ids_without_equation", ~flag & (ids > 0), None)]
    rules += [("char_range", start.isNull() | end.isNull() | (start < 0) | (end < start), F.concat_ws("-", start.cast("string"), end.cast("string")))]
    return row_issues(chunks, F.col("row_id"), rules)


def repeated_issues(df: DataFrame, key: str, order: str, rule: str) -> DataFrame:
    """An issue for each further row of a key, in order; the first is none."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.where(F.col(key).isNotNull()).select(F.col(order).cast("string").alias("subject"), F.col(key).cast("string").alias("detail"), n.alias("n")).where("n > 1").select("subject", F.lit(rule).alias("rule"), F.lit("error").alias("severity"), "detail")


def vocabulary_issues(terms: DataFrame) -> DataFrame:
    cid, ns = F.coalesce("canonical_id", F.lit("")), F.coalesce("namespace", F.lit(""))
    required = ("canonical_id", "label", "namespace", "category", "source")
    rules = [(f"missing_{name}", missing(name), None) for name in required]
    rules += [
        ("unknown_category", ~missing("category") & ~F.col("category").isin(*V.EDGE_CATEGORIES), F.col("category")),
        ("alias_namespace", ns == "alias", None),
        ("namespace_of_id", cid.startswith("physh:") & (ns != "physh"), ns),
        ("id_of_namespace", (ns == "physh") & ~cid.startswith("physh:"), cid),
        ("aliases_missing", F.col("aliases").isNull(), None),
        ("blank_in_alias", F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: x != F.trim(x)), None),
    ]
    return row_issues(terms, F.col("pos"), rules)


def edge_issues(items: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges of unknown categories, without id, with an id the vocabulary hasn't at all or hasn't in their category."""
    ids = terms.select("canonical_id").distinct().withColumn("_known", F.lit(True))
    own = terms.select("canonical_id", "category").distinct().withColumn("_fits", F.lit(True))
    rows = items.join(ids, "canonical_id", "left").join(own, ["canonical_id", "category"], "left")
    rules = [
        ("missing_id", missing("canonical_id"), None),
        ("unknown_category", ~F.coalesce("category", F.lit("")).isin(*V.EDGE_CATEGORIES), F.col("category")),
        ("off_vocabulary", ~missing("canonical_id") & F.col("_known").isNull(), F.col("canonical_id")),
        ("other_category", F.col("_known").isNotNull() & F.col("_fits").isNull(), F.col("canonical_id")),
        ("no_confidence", F.col("confidence").isNull(), None),
    ]
    return row_issues(rows, F.col("edge_id"), rules)


def unmatched_issues(df: DataFrame, subject: str, key: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """An issue for each row whose key, given, is not among the known ones."""
    rows = df.where(F.coalesce(F.col(key), F.lit("")) != "").join(small_side(known.select(F.col(known_key).alias(key)).where(F.col(key).isNotNull()).distinct()), key, "left_anti")
    return rows.select(F.col(subject).cast("string").alias("subject"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), F.col(key).alias("detail"))


def link_targets(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, target) of every link in a text, each once."""
    return df.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("target"))


def marker_issues(df: DataFrame, subject: str, text: str, start: str, end: str) -> DataFrame:
    """Texts in which start and end marks don't balance."""
    opened, closed = F.regexp_count(text, F.lit(start)), F.regexp_count(text, F.lit(end))
    return row_issues(df, F.col(subject), [("unbalanced_marks", opened != closed, F.concat_ws("/", opened.cast("string"), closed.cast("string")))])


def staleness(records: DataFrame, manifests: DataFrame, chunks: DataFrame, parser_versions: dict[str, str]) -> DataFrame:
    """What is out of date about each record: no manifest, an older parser, no chunks, or chunks of another source.

    ``records`` has key and doc_id. The newest manifest of a document counts.
    """
    newest = manifests.groupBy("doc_id").agg(F.max(F.struct("created_at", "parser", "parser_version", "source_sha256")).alias("m"))
    versions = F.create_map(*[F.lit(x) for pair in parser_versions.items() for x in pair]) if parser_versions else F.create_map(F.lit(""), F.lit(""))
    held = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("source_sha256").alias("sha_min"), F.max("source_sha256").alias("sha_max"))
    rows = records.select("key", "doc_id").join(newest, "doc_id", "left").join(held, "doc_id", "left")
    current = F.try_element_at(versions, F.col("m.parser"))
    sha = F.col("m.source_sha256")
    rules = [
        ("manifest_missing", F.col("m").isNull(), F.col("doc_id")),
        ("parser_changed", current.isNotNull() & (F.coalesce("m.parser_version", F.lit("")) != "") & (F.col("m.parser_version") != current), F.col("m.parser_version")),
        ("chunks_missing", F.col("n_chunks").isNull(), F.col("doc_id")),
        ("source_changed", sha.isNotNull() & F.col("n_chunks").isNotNull() & ((F.col("sha_min") != sha) | (F.col("sha_max") != sha)), None),
    ]
    return row_issues(rows, F.col("key"), rules, "warning")


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def evidence_issues(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """All rules about parsed evidence in one stream."""
    return manifest_issues(manifests).unionByName(chunk_issues(chunks)).unionByName(repeated_issues(chunks, "chunk_id", "row_id", "duplicate_chunk_id"))
