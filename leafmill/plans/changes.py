"""Plans of imports, updates, deletions and merges over the evidence tables.

A plan is a DataFrame that says row by row what would happen. ``apply`` functions give the changed table as a DataFrame;
``write_version`` writes it beside the old versions and moves a pointer, so a reader never sees half of a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.records import match_keys
from ..session import small_side


def import_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``incoming`` (normalised records) with duplicate_of, duplicate_match and status new or duplicate.

    A record is a duplicate of an existing one, else of an earlier one of its batch, by its best key that either has.
    """
    have = match_keys(existing).groupBy("kind", "value").agg(F.min_by("key", F.struct("pos", "key")).alias("old_key"))
    keys = match_keys(incoming)
    earlier = Window.partitionBy("kind", "value").orderBy("pos", "key")
    keys = keys.withColumn("first_pos", F.first("pos").over(earlier)).withColumn("batch_key", F.when(F.col("pos") > F.col("first_pos"), F.first("key").over(earlier)))
    found = keys.join(have, ["kind", "value"], "left").withColumn("target", F.coalesce("old_key", "batch_key")).where("target IS NOT NULL")
    # every key is tried against the existing records before any against the batch
    best = found.groupBy("key", "pos").agg(F.min(F.struct(F.col("old_key").isNull().alias("late"), "priority", "kind", "target")).alias("b"))
    rows = incoming.join(best, ["key", "pos"], "left")
    return rows.select("key", "pos", F.coalesce("b.target", F.lit("")).alias("duplicate_of"), F.coalesce("b.kind", F.lit("")).alias("duplicate_match"), F.when(F.col("b").isNull(), "new").otherwise("duplicate").alias("status"))


def provider_plan(records: DataFrame, found: DataFrame) -> DataFrame:
    """(key, field, old_value, new_value, action) of what a provider's rows tell about the records.

    Rows belong to a record by DOI, else by arXiv id, and where a record has neither, or no row has it, all rows of its
    title are its candidates. A missing value is filled; a different one and several candidates are for review; equal
    values give no row.
    """
    own = [("doi", F.col("doi")), ("arxiv", F.col("arxiv")), ("title", F.col("title_norm"))]
    asked = records.select("key", F.explode(F.array(*[F.struct(F.lit(n).alias("priority"), F.lit(by).alias("by"), value.alias("id")) for n, (by, value) in enumerate(own)])).alias("x")).select("key", "x.*").where("id <> ''")
    told = found.select("result_id", T.normalize_doi(F.coalesce("doi", F.lit(""))).alias("doi"), T.normalize_arxiv(F.coalesce("arxiv", F.lit(""))).alias("arxiv"), F.coalesce("control_number", F.lit("")).alias("control"), T.normalize_title(F.coalesce("title", F.lit(""))).alias("title_norm"))
    ids = told.select("*", F.explode(F.array(*[F.struct(F.lit(by).alias("by"), value.alias("id")) for by, value in own])).alias("x")).select("result_id", "doi", "arxiv", "control", "x.by", "x.id").where("id <> ''")
    met = asked.join(ids, ["by", "id"])
    first = met.groupBy("key").agg(F.min("priority").alias("priority"))
    pairs = met.join(first, ["key", "priority"]).join(records.select("key", F.col("doi").alias("own_doi"), F.col("arxiv").alias("own_arxiv")), "key")
    several = F.count("*").over(Window.partitionBy("key")) > 1
    fields = F.array(F.struct(F.lit("eprint").alias("field"), F.col("own_arxiv").alias("old_value"), F.col("arxiv").alias("new_value")), F.struct(F.lit("doi").alias("field"), F.col("own_doi").alias("old_value"), F.col("doi").alias("new_value")), F.struct(F.lit("inspire").alias("field"), F.lit("").alias("old_value"), F.col("control").alias("new_value")))
    rows = pairs.withColumn("several", several).select("key", "result_id", "several", F.explode(fields).alias("f")).select("key", "result_id", "several", "f.*").where("new_value <> '' AND old_value <> new_value")
    return rows.withColumn("action", F.when(F.col("several"), "review: several candidates").when(F.col("old_value") == "", "fill").otherwise("review: conflict")).drop("several")


def delete_targets(records: DataFrame, key: str = "", doi: str = "", arxiv: str = "", title: str = "") -> DataFrame:
    """The records a selector means and why, the first rule that holds: key, DOI, arXiv id, title, title within a title.

    Exactly one selector is given.
    """
    if sum(map(bool, (key, doi, arxiv, title))) != 1:
        raise ValueError("give one of key, doi, arxiv and title")
    t = T.normalize_title(F.lit(title))
    reason = F.lit(None).cast("string")
    if key:
        reason = F.when(F.lower("key") == key.lower(), "key")
    elif doi:
        reason = F.when((F.col("doi") != "") & (F.col("doi") == T.normalize_doi(F.lit(doi))), "doi")
    elif arxiv:
        reason = F.when((F.col("arxiv") != "") & (F.col("arxiv") == T.normalize_arxiv(F.lit(arxiv))), "arxiv")
    else:
        reason = F.when(F.col("title_norm") == t, "title").when((F.col("title_norm") != "") & (F.col("title_norm").contains(t) | t.contains(F.col("title_norm"))), "title-substring")
    return records.withColumn("reason", reason).where("reason IS NOT NULL")


def cascade_counts(targets: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, table, n): the rows of each table that go with a deleted key."""
    keys = targets.select("key").distinct()
    parts = [keys.join(df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")), "key").select("key", F.lit(name).alias("table"), "n") for name, (df, column) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apply_delete(df: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """``df`` without the rows of deleted keys."""
    return df.join(small_side(targets.select(F.col("key").alias(column)).distinct()), column, "left_anti")


def apply_updates(entries: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """``entries`` (id, fields as array of k, v) with the values of ``updates`` (key, field, new_value, at) put in, in field order.

    Updated fields keep their place, new ones follow by name. Of several updates of a field the last by ``at`` counts, a
    tie by value; without ``at`` the value alone decides.
    """
    at = F.col("at") if "at" in updates.columns else F.lit(0)
    told = updates.groupBy(F.col("key").alias(key), "field").agg(F.max(F.struct(at.alias("at"), F.col("new_value").alias("v")))["v"].alias("v"))
    maps = told.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v")))).alias("_new"))
    joined = entries.join(maps, key, "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    kept = F.transform("fields", lambda x: F.struct(x["k"].alias("k"), F.coalesce(F.try_element_at("_new", x["k"]), x["v"]).alias("v")))
    have = F.transform("fields", lambda x: x["k"])
    added = F.transform(F.filter(F.map_entries("_new"), lambda e: ~F.array_contains(have, e["key"])), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return joined.withColumn("fields", F.concat(kept, added)).drop("_new")


def merge_report(base: DataFrame, update: DataFrame, key: str, doc_id: str) -> DataFrame:
    """(kind, value): keys that both sides have, and documents that both have under different keys."""
    shared = base.select(F.col(key).alias("value")).intersect(update.select(F.col(key).alias("value"))).select(F.lit("key").alias("kind"), "value")
    left = base.select(F.col(doc_id).alias("value"), F.col(key).alias("a")).where("value <> ''").distinct()
    right = update.select(F.col(doc_id).alias("value"), F.col(key).alias("b")).where("value <> ''").distinct()
    docs = left.join(right, "value").where("a <> b").select(F.lit("doc_id").alias("kind"), "value").distinct()
    return shared.unionByName(docs)


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new version under ``root`` and point to it; returns its path."""
    spark = df.sparkSession
    path = f"{root}/version={spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]}"
    df.write.parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The version of a table that its pointer names."""
    return spark.read.parquet(spark.read.schema("path string").json(f"{root}/current").first()[0])
