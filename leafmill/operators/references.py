"""References to records that do not exist: orphans per table and period.

The keys of all parents make a blocked Bloom filter, an ordinary table of bit masks. A reference that the filter rejects
is an orphan for certain. The others are verified by an exact join of their distinct (key, day) pairs with the periods
in which each parent was there. No step groups rows by the key alone, so a key that holds a third of all rows costs one
row a day in the exact join, and the orphan pairs meet the rows again under a salt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import reference_key
from ..session import MAX_BROADCAST_BYTES

#: Bits of the filter for each distinct parent key; with four bits set a key, about one orphan in a hundred passes.
BITS_PER_KEY = 14
WORDS, WORD_BITS = 4, 64
#: Memory of one filter row in a broadcast hash table.
BLOCK_ROW_BYTES = 96
#: Shards over which the rows of one orphan (key, day) are spread when they meet it again.
SALTS = 16


@dataclass(frozen=True)
class Reference:
    """A column of ``table`` that refers to keys of ``parent``: names, the row's key and the column with its day."""

    table: str
    field: str
    parent: str
    row_id: str
    day: str


def as_day(column: Column, kind: str) -> Column:
    """The day of an ISO date, an ISO timestamp or a timestamp column; null where it isn't one."""
    return F.to_date(column) if kind == "timestamp" else F.to_date(F.try_to_timestamp(F.substring(column, 1, 10), F.lit("yyyy-MM-dd")))


def parent_periods(parent: DataFrame, name: str, key: str, added: str, removed: str) -> DataFrame:
    """(parent, key, from_day, to_day): each period in which a parent was there, ``to_day`` excluded and null if open."""
    kinds = dict(parent.dtypes)
    periods = parent.select(
        F.lit(name).alias("parent"),
        reference_key(parent[key]).alias("key"),
        as_day(parent[added], kinds[added]).alias("from_day"),
        as_day(parent[removed], kinds[removed]).alias("to_day"),
    )
    return periods.where(F.length("key") > 0)


def references(df: DataFrame, spec: Reference) -> DataFrame:
    """(ref_table, ref_field, parent, row_id, key, day) of every reference that is neither null nor empty."""
    rows = df.select(
        F.lit(spec.table).alias("ref_table"),
        F.lit(spec.field).alias("ref_field"),
        F.lit(spec.parent).alias("parent"),
        df[spec.row_id].cast("long").alias("row_id"),
        reference_key(df[spec.field]).alias("key"),
        as_day(df[spec.day], dict(df.dtypes)[spec.day]).alias("day"),
    )
    return rows.where(F.length("key") > 0)


def _with_bits(df: DataFrame, blocks: int) -> DataFrame:
    bits = F.xxhash64("key", "parent")
    df = df.withColumn("block", F.pmod(F.xxhash64("parent", "key"), F.lit(blocks))).withColumn("bits", bits)
    return df.select("*", *[F.expr(f"shiftleft(1L, cast((bits >> {6 * w}) & {WORD_BITS - 1} AS INT))").alias(f"bit{w}") for w in range(WORDS)]).drop("bits")


def bloom_filter(keys: DataFrame, distinct_keys: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of (parent, key) as a table of masks by block, and its number of blocks."""
    blocks = max(1, -(-distinct_keys * BITS_PER_KEY // (WORDS * WORD_BITS)))
    masks = [F.bit_or(f"bit{w}").alias(f"mask{w}") for w in range(WORDS)]
    return _with_bits(keys, blocks).groupBy("block").agg(*masks), blocks


def might_contain(refs: DataFrame, filter_table: DataFrame, blocks: int, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``refs`` with ``maybe``: false where the filter proves that the parent has no such key.

    A filter beyond the limit of a broadcast meets the references under a salt, so a key that many rows have is spread.
    """
    if blocks * BLOCK_ROW_BYTES <= limit:
        joined = _with_bits(refs, blocks).join(F.broadcast(filter_table), "block", "left")
    else:
        side = filter_table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = _with_bits(refs, blocks).withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_field"), F.lit(SALTS)).cast("int")).join(side, ["block", "salt"], "left")
    found = F.lit(True)
    for w in range(WORDS):
        found = found & (F.col(f"mask{w}").bitwiseAND(F.col(f"bit{w}")) == F.col(f"bit{w}"))
    return joined.withColumn("maybe", F.coalesce(found, F.lit(False))).select(*refs.columns, "maybe")


def orphan_references(refs: DataFrame, periods: DataFrame, broadcast_limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """References without a target on their day: (ref_table, ref_field, row_id, key, day, reason).

    ``reason`` is ``never`` (no such parent), ``not_yet`` (the parent comes later) or ``gone`` (it went before).

    Defined cases: null and empty references aren't references; a reference without a day is an orphan only if its
    parent never existed; a parent without a first day was always there; repeated references each come out; without
    parents every reference is an orphan; other columns of the inputs are never looked at.
    """
    keys = periods.select("parent", "key").distinct()
    distinct_keys = keys.count()
    filter_table, blocks = bloom_filter(keys, distinct_keys)
    marked = might_contain(refs, filter_table, blocks, broadcast_limit)
    proven = marked.where(~F.col("maybe")).withColumn("reason", F.lit("never"))

    positive = marked.where("maybe")
    pairs = positive.select("parent", "key", "day").distinct()
    day, start, end = F.col("day"), F.col("from_day"), F.col("to_day")
    there = F.coalesce(day.isNull() | ((start.isNull() | (start <= day)) & (end.isNull() | (day < end))), F.lit(False))
    known = F.col("known").isNotNull()
    checked = (
        pairs.join(periods.withColumn("known", F.lit(1)), ["parent", "key"], "left")
        .groupBy("parent", "key", "day")
        .agg(F.max(known & there).alias("there"), F.max(known).alias("known"), F.min(F.coalesce(start, F.to_date(F.lit("0001-01-01")))).alias("first_day"))
        .where(~F.col("there"))
    )
    reason = F.when(~F.col("known"), "never").when(F.col("day") < F.col("first_day"), "not_yet").otherwise("gone")
    orphans = checked.select("parent", "key", F.coalesce("day", F.to_date(F.lit("0001-01-01"))).alias("pair_day"), reason.alias("reason"))
    salted = orphans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    verified = (
        positive.withColumn("pair_day", F.coalesce("day", F.to_date(F.lit("0001-01-01"))))
        .withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_field"), F.lit(SALTS)).cast("int"))
        .join(salted, ["parent", "key", "pair_day", "salt"])
    )
    columns = ["ref_table", "ref_field", "row_id", "key", "day", "reason"]
    return proven.select(columns).unionByName(verified.select(columns))


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans of each table, field and month: one aggregate over both, so each side shuffles counts only."""
    period = F.date_format("day", "yyyy-MM").alias("period")
    every = refs.select("ref_table", "ref_field", period, F.lit(1).alias("refs"), F.lit(None).cast("string").alias("reason"))
    lost = orphans.select("ref_table", "ref_field", period, F.lit(0).alias("refs"), "reason")
    counts = [F.count_if(F.col("reason") == reason).alias(f"n_{reason}") for reason in ("never", "not_yet", "gone")]
    return every.unionByName(lost).groupBy("ref_table", "ref_field", "period").agg(F.sum("refs").alias("n_refs"), F.count("reason").alias("n_orphans"), *counts)


#: The references and parents of the evidence tables.
REFERENCES = (
    Reference("chunks", "citation_key", "bib_entries", "row_id", "created_at"),
    Reference("chunks", "doc_id", "manifests", "row_id", "created_at"),
    Reference("edge_items", "canonical_id", "vocab_terms", "edge_id", "planned_at"),
)
PARENTS = (
    ("bib_entries", "id", "added_at", "deleted_at"),
    ("manifests", "doc_id", "created_at", "removed_at"),
    ("vocab_terms", "canonical_id", "added_at", "retired_at"),
)


def evidence_references(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The references and the parents' periods of the evidence tables, by table name."""
    refs = [references(tables[spec.table], spec) for spec in REFERENCES]
    periods = [parent_periods(tables[name], name, *columns) for name, *columns in PARENTS]
    return refs[0].unionByName(refs[1]).unionByName(refs[2]), periods[0].unionByName(periods[1]).unionByName(periods[2])
