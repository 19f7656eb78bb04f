"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order, over and over up to its cap. A document's virtual finish time is the
number of the source's tokens up to and with it, divided by the source's weight. Served in the order of finish times,
every source has at any moment its share of the tokens served; the mix is the front of that order up to the budget.

Neither a source nor the order is ever one task's work: a source's running sums are taken within buckets of the shuffle
order, the mix is range-sorted by finish time, and buckets and ranges are offset by the sums of those before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .tokens import token_count

#: Documents that a bucket of a source's shuffled order, and uses that a range of the mix, holds on average.
BUCKET_ROWS = 20_000
_SPREAD = 2**62


def _order(key: str, seed: int) -> Column:
    """A shuffled order of keys as a number from 0 to under 1."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(_SPREAD)) / F.lit(float(_SPREAD))


def finish_times(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The queue (key, source, tokens, shuffle, upto) of first uses, and (source, weight, repeats, source_tokens).

    ``upto`` is the number of tokens of the source up to and with the document in the shuffled order.
    """
    own = targets.groupBy(targets[source].alias("source")).agg(F.max("target_share").cast("double").alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats")).where("weight > 0 AND repeats > 0")
    docs = df.select(df[key].alias("key"), df[source].alias("source"), token_count(df[text].cast("string")).alias("tokens"))
    docs = docs.where("tokens > 0").join(own.select("source"), "source", "left_semi").withColumn("shuffle", _order("key", seed))
    docs = cut_lineage(docs)  # texts are counted once; from here on a document is a few numbers
    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    docs = docs.withColumn("bucket", F.floor(F.col("shuffle") * buckets))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("shuffle", "key").rowsBetween(Window.unboundedPreceding, 0)
    queue = docs.withColumn("upto", F.sum("tokens").over(within)).join(offsets, ["source", "bucket"]).withColumn("upto", F.col("upto") + F.col("offset"))
    totals = own.join(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_tokens")), "source", "left").fillna(0, ["source_tokens"])
    return queue.select("key", "source", "tokens", "shuffle", "upto"), totals


def served_at(budget: float, queues: list[tuple[float, float]]) -> float:
    """The virtual time at which ``budget`` tokens are served from queues of (tokens, weight)."""
    time = served = 0.0
    active = sum(weight for _, weight in queues)
    for end, weight in sorted((tokens / weight, weight) for tokens, weight in queues):
        if served + (end - time) * active >= budget:
            return time + (budget - served) / active
        served, time, active = served + (end - time) * active, end, active - weight
    return time


def mix_sources(df: DataFrame, targets: DataFrame, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """(key, source, use, tokens, finish, position) of the documents chosen, ordered by finish time.

    ``targets`` has the source, ``target_share`` and ``max_repeats``. ``budget`` is in tokens; by default it is the
    largest at which no source that has documents runs out of them. ``use`` counts the uses of a document from 1 and
    ``position`` the tokens of the mix up to and with the row.

    Defined cases: documents of no target source, without tokens or with null text aren't used; a source without
    documents contributes nothing and the others keep their weights; a budget beyond all sources gives every permitted
    use; documents with equal order are taken by key; repeated rows are separate documents; other columns are never
    looked at.
    """
    queue, totals = finish_times(df, targets, key, text, source, seed)
    limits = {row["source"]: row for row in totals.where("source_tokens > 0").collect()}  # one row for each target source
    weights = sum(row["weight"] for row in limits.values())
    if budget is None:
        budget = int(min((row["source_tokens"] * row["repeats"] * weights / row["weight"] for row in limits.values()), default=0))
    horizon = served_at(budget, [(row["source_tokens"] * row["repeats"], row["weight"]) for row in limits.values()])
    uses = queue.join(broadcast_if_small(totals, len(limits), 64), "source").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    uses = uses.withColumn("finish", (F.col("upto") + (F.col("use") - 1) * F.col("source_tokens")) / F.col("weight"))
    # a document's length after the horizon every source has served its share of the budget, so the cut lies before
    longest = queue.join(broadcast_if_small(totals, len(limits), 64), "source").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    uses = uses.where(F.col("finish") <= horizon * (1 + 1e-9) + longest).select("key", "source", "use", "tokens", "finish")
    order = ["finish", "source", "use", "key"]
    ranges = max(1, -(-uses.count() // BUCKET_ROWS))
    sorted_uses = cut_lineage(uses.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    sums = sorted_uses.groupBy("range").agg(F.sum("tokens").alias("in_range"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select("range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("offset")).where(F.col("offset") < budget)
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chosen = sorted_uses.join(broadcast_if_small(offsets, ranges, 24), "range").withColumn("position", F.sum("tokens").over(within) + F.col("offset")).where(F.col("position") <= budget)
    return chosen.select(F.col("key").alias(key), F.col("source").alias(source), "use", "tokens", "finish", "position")


def mix_shares(mix: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Target and actual share, tokens, documents and uses of each target source in a mix."""
    own = targets.groupBy(source).agg(F.max("target_share").alias("target_share"))
    used = mix.groupBy(source).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("use").alias("most_uses"))
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    rows = own.join(used, source, "left").fillna(0, ["tokens", "uses", "most_uses"]).withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    return rows.select(source, "target_share", "tokens", "uses", "most_uses", (F.col("tokens") / F.col("all_tokens")).alias("actual_share"))
