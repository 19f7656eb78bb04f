import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.functions.identifiers import reference_key
from leafmill.operators import references as R

REF = "ref_table string, ref_field string, parent string, row_id long, key string, day date"
PERIOD = "parent string, key string, from_day date, to_day date"


def day(n):
    return datetime.date(2024, 1, n)


@pytest.mark.parametrize(
    ("spelling", "key"),
    [("[@Abc1]", "abc1"), (" @abc1 ", "abc1"), ("https://doi.org/10.1/X", "10.1/x"), ("doi:10.1/x", "10.1/x"), ("arXiv:2101.00001v2", "2101.00001"), ("2101.00001", "2101.00001"), ("alias:x", "alias:x"), ("pdf:Key", "pdf:key"), ("  ", ""), (None, None)],
)
def test_spellings_of_one_identifier(spark, spelling, key):
    assert spark.createDataFrame([(spelling,)], "v string").select(reference_key(F.col("v"))).first()[0] == key


def brute_force(refs, periods):
    found = set()
    for table, field, parent, row, key, d in refs:
        own = [p for p in periods if p[0] == parent and p[1] == key]
        if not own:
            found.add((row, "never"))
        elif d is not None and not any((a is None or a <= d) and (z is None or d < z) for _, _, a, z in own):
            first = min(a or datetime.date(1, 1, 1) for _, _, a, _ in own)
            found.add((row, "not_yet" if d < first else "gone"))
    return found


def test_orphans_equal_brute_force(spark):
    refs = [("t", "f", "p", i, f"k{i % 37}", day(1 + i % 28) if i % 11 else None) for i in range(600)]
    refs += [("t", "f", "p", 1000 + i, "hot", day(3)) for i in range(300)]  # a third of all rows
    periods = [("p", f"k{i}", day(1 + i % 20) if i % 7 else None, day(5 + i % 20) if i % 3 else None) for i in range(30)]
    periods += [("p", "k1", day(25), None), ("p", "hot", day(4), None), ("q", "k36", None, None)]
    got = R.orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(periods, PERIOD))
    assert {(r["row_id"], r["reason"]) for r in got.collect()} == brute_force(refs, periods)
    assert got.count() == len(brute_force(refs, periods))


def test_without_broadcast_the_result_is_the_same(spark):
    refs = spark.createDataFrame([("t", "f", "p", i, f"k{i}", day(2)) for i in range(50)], REF)
    periods = spark.createDataFrame([("p", f"k{i}", day(1), None) for i in range(25)], PERIOD)
    assert R.orphan_references(refs, periods, broadcast_limit=0).count() == 25


def test_empty_sides(spark):
    refs, periods = spark.createDataFrame([("t", "f", "p", 1, "k", day(2))], REF), spark.createDataFrame([("p", "k", day(1), None)], PERIOD)
    assert R.orphan_references(refs.limit(0), periods).count() == 0
    assert [r["reason"] for r in R.orphan_references(refs, periods.limit(0)).collect()] == ["never"]


def test_nulls_repeated_rows_and_clashing_columns(spark):
    chunks = spark.createDataFrame([(1, "Key1", "2024-01-05", "x"), (2, None, "2024-01-05", "x"), (3, "", "2024-01-05", "x"), (4, "gone", None, "x"), (4, "gone", None, "x"), (5, "k" * 100_000, "bad date", "x")], "row_id long, citation_key string, created_at string, maybe string")
    spec = R.Reference("chunks", "citation_key", "bib_entries", "row_id", "created_at")
    entries = spark.createDataFrame([("key1", datetime.datetime(2024, 1, 1), None, 1)], "id string, added_at timestamp, deleted_at timestamp, block int")
    refs = R.references(chunks, spec)
    orphans = R.orphan_references(refs, R.parent_periods(entries, "bib_entries", "id", "added_at", "deleted_at"))
    assert sorted(r["row_id"] for r in orphans.collect()) == [4, 4, 5]
    report = {r["period"]: (r["n_refs"], r["n_orphans"]) for r in R.orphan_report(refs, orphans).collect()}
    assert report == {"2024-01": (1, 0), None: (3, 3)}


def test_filter_rejects_most_unknown_keys(spark):
    keys = spark.range(5000).select(F.lit("p").alias("parent"), F.concat(F.lit("in"), "id").alias("key"))
    table, blocks = R.bloom_filter(keys, 5000)
    known = R.might_contain(keys, table, blocks)
    assert known.where("maybe").count() == 5000
    other = spark.range(5000).select(F.lit("p").alias("parent"), F.concat(F.lit("out"), "id").alias("key"))
    assert R.might_contain(other, table, blocks).where("maybe").count() < 250
