"""One surviving record for each group of duplicates, chosen field by field.

Duplicates are joined to groups by star contraction. In each group and field, a value that is a placeholder, damaged, or
cut off is out, and so is one that the recorded changes replace in the end: the changes of all members, in time, are a
partial order of the group's values. Of what is left the latest import counts, then the most trusted source. Where times
don't decide, because they are missing or equal, values are ordered by currency: which values replace which is learnt from
all timestamped changes (as an affix that goes, or as a pair of values). Together with the group's own changes this is one
relation, followed step by step also over values that the group doesn't hold, and the topologically latest values are left.

No step compares the values of a group in pairs: cut values are found by equality with the front parts of the others,
replaced ones by equality with the changes, so a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import reference_key
from ..session import broadcast_if_small, cut_lineage

FIELDS = ("title", "author", "year", "journal", "doi", "pages", "abstract")
#: Least changes that teach an order, and how many times more often than the other way round.
LEAST_CHANGES, LEAST_RATIO = 5, 4
#: Shards over which the members of a group meet its surviving values.
SALTS = 8

PLACEHOLDER = r"(?i)^([^\p{L}\p{N}]*|n/?a|n\.a\.|tbd|tba|unknown|none|null|untitled|anonymous|in press|to appear|n\.d\.|0+)$"
CUT = r"(\[truncated\]|\.\.|…)\s*$"
#: UTF-8 read as Latin-1 or as Windows-1252, and the replacement character.
GARBLED = "[Â-ß][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â€|�"
WHOLE = {
    "title": r"(?i)^(?!.*(\b(a|an|the|of|in|on|for|with|and|by|to|using|near|at|from)|[:,;(-])\s*$).*$",
    # not cut off, and not surnames alone
    "author": r"(?i)^(?!.*(\band others|\bet al\.?|\band|,|;)\s*$)(?!\s*[^\s,]+(\s+and\s+[^\s,]+)*\s*$).*$",
    "year": r"^\s*\{?(1[5-9]|20)\d\d(-\d\d)?\}?\s*$",
    "journal": r"^(?!.*\p{L}{1,6}\.(\s|$)).*$",
    "doi": r"(?i)^\s*(https?://(dx\.)?doi\.org/|doi:\s*)?10\.\d{4,9}/\S*[\p{L}\p{N}]\s*$",
    "pages": r"^\s*\p{L}?\d+\s*(-{1,2}|–|—)\s*\p{L}?\d+\s*$",
    "abstract": r"(?s)^.*[.!?…][\"'”’)\]]*\s*$",
}


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, group): the least node that each node of undirected edges (u, v) is joined with, by star contraction.

    Rounds grow with the logarithm of the longest path; ``most_rounds`` is a guard that raises an error.
    """
    current = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = cut_lineage(small.where("u <> v").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"groups still grow after {most_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("group"))
    return members.unionByName(members.select(F.col("group").alias("node"), "group")).distinct()


def _entry_value(name: str) -> Column:
    return F.get(F.filter(F.col("entry"), lambda x: F.lower(x["k"]) == name), F.lit(0))["v"]


def whole(field: Column, value: Column, fields: Sequence[str] = FIELDS) -> Column:
    """Whether a value by its look is neither placeholder nor garbled nor cut off."""
    fits = F.lit(True)
    for name in fields:
        if name in WHOLE:
            fits = F.when(field == name, value.rlike(WHOLE[name])).otherwise(fits)
    return F.coalesce(~F.trim(value).rlike(PLACEHOLDER) & ~value.rlike(CUT) & ~value.rlike(GARBLED) & fits, F.lit(False))


def _front_parts(field: Column, value: Column) -> Column:
    """The parts at which a longer value may have been cut: words, for abstracts sentences, for DOIs characters."""
    text = F.regexp_replace(F.regexp_replace(value, CUT, ""), r"(?i)\s+(and others|et al\.?)\s*$", "")
    words = F.split(text, " ")
    by_word = F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, 1, i), " "))
    by_sentence = F.filter(by_word, lambda x: x.rlike(r"[.!?]$"))
    by_character = F.transform(F.when(F.length(text) > 8, F.sequence(F.lit(8), F.length(text) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, F.lit(1), i))
    none = F.array().cast("array<string>")
    return F.when(field == "abstract", by_sentence).when(field == "doi", by_character).when(field.isin("year", "pages"), none).otherwise(by_word)


def learnt_order(changes: DataFrame) -> DataFrame:
    """(field, kind, old, new): what regularly replaces what; kind is ``prefix`` or ``suffix`` (``old`` goes) or ``pair``."""
    told = changes.where("old_value <> new_value AND trim(old_value) <> '' AND trim(new_value) <> '' AND changed_at IS NOT NULL").select("field", "old_value", "new_value").distinct()

    def kinds(old: str, new: str) -> DataFrame:
        o, n = F.col(old), F.col(new)
        kind = F.when(F.expr(f"endswith({old}, {new})"), "prefix").when(F.expr(f"startswith({old}, {new})"), "suffix").otherwise("pair")
        gone = F.when(kind == "prefix", F.expr(f"substring({old}, 1, length({old}) - length({new}))")).when(kind == "suffix", F.expr(f"substring({old}, length({new}) + 1)")).otherwise(o)
        return told.select("field", kind.alias("kind"), gone.alias("old"), F.when(kind == "pair", n).otherwise(F.lit("")).alias("new"))

    forth = kinds("old_value", "new_value").groupBy("field", "kind", "old", "new").agg(F.count("*").alias("n"))
    back = kinds("new_value", "old_value").groupBy("field", "kind", "old", "new").agg(F.count("*").alias("m"))
    return forth.join(back, ["field", "kind", "old", "new"], "left").fillna(0, ["m"]).where((F.col("n") >= LEAST_CHANGES) & (F.col("n") >= LEAST_RATIO * F.col("m"))).select("field", "kind", "old", "new")


def _outdated(kept: DataFrame, order: DataFrame, told: DataFrame, most_steps: int = 100) -> DataFrame:
    """(group, field, value) of the values between which times don't decide and that a later value of the group replaces.

    Times don't decide between values without a time, and between those of the group's latest time and most trusted
    source. From each of them the learnt ``order`` and the group's own changes lead to later values, step by step, until
    nothing new is reached; values that lead to each other replace neither.
    """
    top = kept.groupBy("group", "field").agg(F.max("rank").alias("top"), F.count("*").alias("n")).where("n > 1")
    open_ = kept.join(top, ["group", "field"]).where((F.col("rank.imported_at").isNull()) | (F.col("rank") == F.col("top"))).select("group", "field", "value")
    open_ = open_.join(open_.groupBy("group", "field").agg(F.count("*").alias("n")).where("n > 1").select("group", "field"), ["group", "field"], "left_semi")
    rules, size = order.agg(F.count("*"), F.sum(F.octet_length("old") + F.octet_length("new") + 64)).first()
    order = broadcast_if_small(cut_lineage(order.withColumnRenamed("field", "of_field")), 1, size or 0)
    lengths = [row[0] for row in order.where("kind <> 'pair'").select(F.length("old").alias("n")).distinct().collect()]  # of affixes, a few dozen numbers
    reached = frontier = open_.withColumn("at", F.col("value"))
    reached = cut_lineage(reached)
    for _ in range(most_steps):
        # an affix of each learnt length, or the whole value, is looked up by equality
        ways = [F.struct(F.lit("pair").alias("kind"), F.col("at").alias("old"), F.lit(None).cast("string").alias("rest"))]
        for n in lengths:
            longer = F.length("at") > n
            ways += [F.when(longer, F.struct(F.lit("prefix").alias("kind"), F.substring("at", 1, n).alias("old"), F.substring("at", n + 1, 1 << 30).alias("rest")))]
            ways += [F.when(longer, F.struct(F.lit("suffix").alias("kind"), F.expr(f"substring(at, length(at) - {n} + 1)").alias("old"), F.expr(f"substring(at, 1, length(at) - {n})").alias("rest")))]
        tried = frontier.select("group", "field", "value", F.explode(F.array_compact(F.array(*ways))).alias("w")).select("group", "field", "value", "w.kind", "w.old", "w.rest")
        learnt = tried.join(order.withColumnsRenamed({"of_field": "field"}), ["field", "kind", "old"]).select("group", "field", "value", F.coalesce("rest", "new").alias("at"))
        own = frontier.withColumnRenamed("at", "old").join(told, ["group", "field", "old"]).select("group", "field", "value", F.col("new").alias("at"))
        frontier = cut_lineage(learnt.unionByName(own).distinct().join(reached, ["group", "field", "value", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(frontier))
    else:
        raise RuntimeError(f"values still lead to others after {most_steps} steps")
    later = reached.where("value <> at").join(kept.select("group", "field", F.col("value").alias("at")), ["group", "field", "at"], "left_semi")
    back = later.select("group", "field", F.col("at").alias("value"), F.col("value").alias("at"))
    return later.join(back, ["group", "field", "value", "at"], "left_anti").select("group", "field", "value").distinct()


def surviving_values(candidates: DataFrame, changes: DataFrame, sources: DataFrame, fields: Sequence[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(group, field, value) that survives, and the members (cand_id, group, field, value) of all groups.

    ``candidates`` has cand_id, entry (array of k, v), source, duplicate_of and imported_at; ``changes`` has entry_key,
    field, old_value, new_value, changed_at and change_id; ``sources`` has source and trust.

    Defined cases: a duplicate of no known record, of itself or of null is in no group; an entry without a field has no
    value there; a source without trust counts as 0; null and equal times of import are ordered by currency, and null ones
    otherwise come last; changes without effect, without time or of other records count for nothing, and of changes back and forth the
    last counts; equal values tie to the same survivor; a group without a usable value has none; other columns are
    never looked at.
    """
    trust = sources.groupBy("source").agg(F.max("trust").cast("int").alias("trust"))
    records = candidates.select("cand_id", reference_key(_entry_value("id")).alias("key"), reference_key(F.col("duplicate_of")).alias("of"), "source", "imported_at", "entry")
    keys = records.where("key <> ''").groupBy("key").agg(F.min("cand_id").alias("first"))
    to = records.where("of <> ''").join(keys.withColumnRenamed("key", "of"), "of").select(F.col("cand_id").alias("u"), F.col("first").alias("v"))
    same = records.join(keys, "key").select(F.col("cand_id").alias("u"), F.col("first").alias("v"))
    groups = cut_lineage(components(to.unionByName(same)))
    grouped = records.join(groups.withColumnRenamed("node", "cand_id"), "cand_id").join(broadcast_if_small(trust, 1, sources.agg(F.sum(F.octet_length("source") + 16)).first()[0] or 0), "source", "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), _entry_value(f).alias("value")) for f in fields])
    members = grouped.select("cand_id", "group", "key", "imported_at", F.coalesce("trust", F.lit(0)).alias("trust"), F.explode(pairs).alias("x")).select("cand_id", "group", "key", "imported_at", "trust", "x.field", "x.value")
    members = cut_lineage(members)

    values = members.where("value IS NOT NULL").groupBy("group", "field", "value").agg(F.max(F.struct("imported_at", "trust")).alias("rank"))
    usable = whole(F.col("field"), F.col("value"), fields)
    values = cut_lineage(values.withColumn("whole", usable))
    parts = values.select("group", "field", F.explode(F.array_distinct(_front_parts(F.col("field"), F.col("value")))).alias("value"))

    own = members.select("group", "key").where("key <> ''").distinct()
    told = changes.select(reference_key(F.col("entry_key")).alias("key"), F.lower(F.trim("field")).alias("field"), "old_value", "new_value", F.struct("changed_at", "change_id").alias("at"))
    told = told.where("old_value <> new_value AND at.changed_at IS NOT NULL").join(own, "key")
    left = told.groupBy("group", "field", F.col("old_value").alias("value")).agg(F.max("at").alias("left_at"))
    came = told.groupBy("group", "field", F.col("new_value").alias("value")).agg(F.max("at").alias("came_at"))
    replaced = left.join(came, ["group", "field", "value"], "left").where("came_at IS NULL OR left_at > came_at").select("group", "field", "value")

    kept = values.where("whole").join(parts, ["group", "field", "value"], "left_anti").join(replaced, ["group", "field", "value"], "left_anti")
    kept = cut_lineage(kept.select("group", "field", "value", "rank"))
    outdated = _outdated(kept, learnt_order(changes), told.select("group", "field", F.col("old_value").alias("old"), F.col("new_value").alias("new")))
    left = kept.join(outdated, ["group", "field", "value"], "left_anti")
    best = left.groupBy("group", "field").agg(F.max(F.struct(F.coalesce("rank.imported_at", F.to_timestamp(F.lit("0001-01-01"))).alias("at"), "rank.trust", "value")).alias("best"))
    return best.select("group", "field", F.col("best.value").alias("value")), members.select("cand_id", "group", "field", "value")


def surviving_members(survivors: DataFrame, members: DataFrame) -> DataFrame:
    """(cand_id, field): the members that hold the surviving value where the members don't all hold the same."""
    differing = members.groupBy("group", "field").agg((F.min("value") != F.max("value")).alias("differ"), (F.count("value") < F.count("*")).alias("some_null")).where("differ OR some_null").select("group", "field")
    wanted = survivors.join(differing, ["group", "field"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.where("value IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("cand_id"), F.lit(SALTS)).cast("int"))
    return salted.join(wanted, ["group", "field", "value", "salt"], "left_semi").select("cand_id", "field")


def surviving_records(survivors: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row for each group with the surviving value of each field."""
    return survivors.groupBy("group").pivot("field", list(fields)).agg(F.first("value"))
